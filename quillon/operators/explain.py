"""Explain a request: the strategy, an estimate from statistics, the plan, and on demand counts and times."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.values import named
from quillon.plans.find import find
from quillon.plans.request import FindRequest


@dataclass(frozen=True)
class Explained:
    strategy: str
    index: str | None
    estimated: int | None
    plan: str
    scanned: int | None = None
    matched: int | None = None
    seconds: float | None = None
    phases: tuple[tuple[str, float], ...] = ()


def explain(df: DataFrame, request: FindRequest, id_field: str = "_id", dry_run: bool = True) -> Explained:
    """dry_run: nothing but the cardinality of an equality's field is computed. An equality is expected to
    match the rows divided by the field's distinct values."""
    strategy = request.strategy()
    index = f"{request.filters[0].field}" if strategy != "full_scan" else None
    estimated = None
    if strategy == "index_eq" and index in df.columns:
        n, distinct = df.agg(F.count(F.lit(1)), F.approx_count_distinct(named(index))).first()
        estimated = round(n / max(1, distinct))
    began = time.perf_counter()
    out = find(df, request, id_field)
    plan = out._jdf.queryExecution().explainString(out.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    planned = time.perf_counter() - began
    if dry_run:
        return Explained(strategy, index, estimated, plan)
    began = time.perf_counter()
    scanned = df.count()
    between = time.perf_counter()
    matched = out.count()
    ended = time.perf_counter()
    phases = (("plan", planned), ("scan", between - began), ("match", ended - between))
    return Explained(strategy, index, estimated, plan, scanned, matched, sum(took for _, took in phases), phases)
