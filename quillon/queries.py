"""The registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import log as L
from quillon.operators import sketch as K
from quillon.operators import stats as S
from quillon.plans.find import find, get
from quillon.plans.request import Filter, FindRequest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _find(name: str, source: str, key: str, request: FindRequest, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return find(table(spark, sf_dir, source), request, key, native_sort=True)

    run.__name__ = name
    query(sql)(run)


_EVENT = ("event_id", "event_type", "value")
_find("q01_scan_all", "events", "event_id", FindRequest(projection=_EVENT), "SELECT event_id, event_type, value FROM events")
_find("q04_eq_string", "events", "event_id", FindRequest((Filter("event_type", "eq", "click"),), projection=_EVENT), "SELECT event_id, event_type, value FROM events WHERE event_type = 'click'")
_find("q05_eq_number", "part", "p_partkey", FindRequest((Filter("p_size", "eq", "15"),), projection=("p_partkey", "p_name", "p_size")), "SELECT p_partkey, p_name, p_size FROM part WHERE p_size = 15")
_LINE = ("l_orderkey", "l_linenumber", "l_quantity")
for _q, _op, _sign in (("q06_gt", "gt", ">"), ("q07_gte", "gte", ">="), ("q08_lt", "lt", "<"), ("q09_lte", "lte", "<=")):
    _find(_q, "lineitem", "l_orderkey", FindRequest((Filter("l_quantity", _op, 25),), projection=_LINE), f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_sign} 25")
_find("q10_between", "lineitem", "l_orderkey", FindRequest((Filter("l_quantity", "between", (10, 20)),), projection=_LINE), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
_find("q11_conj_eq_range", "events", "event_id", FindRequest((Filter("event_type", "eq", "click"), Filter("value", "gte", 10)), projection=_EVENT), "SELECT event_id, event_type, value FROM events WHERE event_type = 'click' AND value >= 10")
_find("q12_conj_three", "orders", "o_orderkey", FindRequest((Filter("o_orderstatus", "eq", "O"), Filter("o_totalprice", "between", (1000, 100000)), Filter("o_custkey", "gt", 10)), projection=("o_orderkey", "o_custkey", "o_totalprice")), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 1000 AND 100000 AND o_custkey > 10")
_TOP = "SELECT event_id, value FROM events ORDER BY value {}, CAST(event_id AS VARCHAR) LIMIT 25"
_find("q16_topk_desc", "events", "event_id", FindRequest(sort_by="value", ascending=False, limit=25, projection=("event_id", "value")), _TOP.format("DESC"))
_find("q17_topk_asc", "events", "event_id", FindRequest(sort_by="value", limit=25, projection=("event_id", "value")), _TOP.format("ASC"))
_find("q18_limit_by_id", "orders", "o_orderkey", FindRequest(limit=10, projection=("o_orderkey", "o_orderstatus")), "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 10")
_find("q19_filter_topk_project", "events", "event_id", FindRequest((Filter("event_type", "eq", "purchase"), Filter("value", "between", (10, 400))), "value", False, 50, _EVENT), "SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase' AND value BETWEEN 10 AND 400 ORDER BY value DESC, CAST(event_id AS VARCHAR) LIMIT 50")
_find("q41_eq_text_of_number", "orders", "o_orderkey", FindRequest((Filter("o_orderstatus", "eq", 1),), projection=("o_orderkey",)), "SELECT o_orderkey FROM orders WHERE o_orderstatus = '1'")
_find("q42_range_on_text", "events", "event_id", FindRequest((Filter("event_type", "gte", 0),), projection=("event_id",)), "SELECT event_id FROM events WHERE FALSE")
_find("q43_exists", "documents", "doc_id", FindRequest((Filter("lang", "exists"),), projection=("doc_id", "lang")), "SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL")
_find("q44_unknown_field", "region", "r_regionkey", FindRequest((Filter("nowhere", "eq", 1),), projection=("r_name", "nowhere")), "SELECT r_regionkey, r_name FROM region WHERE FALSE")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 4242")
def q02_get_by_id(spark, sf_dir):
    return get(table(spark, sf_dir, "orders"), 4242, "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey = -1")
def q03_get_missing(spark, sf_dir):
    return get(table(spark, sf_dir, "orders"), -1, "o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM events WHERE value > 1e9")
def q13_empty_result(spark, sf_dir):
    return find(table(spark, sf_dir, "events"), FindRequest((Filter("value", "gt", 1e9),)), "event_id").agg(F.count(F.lit(1)).alias("n"))


_SORT = "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice {}, CAST(o_orderkey AS VARCHAR)) AS place FROM orders"


def _sorted(spark, sf_dir, ascending):
    """find's sort without a limit; the place of each row shows its order in a comparison that ignores it."""
    request = FindRequest(sort_by="o_totalprice", ascending=ascending, projection=("o_orderkey", "o_totalprice"))
    return L.numbered(find(table(spark, sf_dir, "orders"), request, "o_orderkey", native_sort=True))


@query(_SORT.format("ASC"))
def q14_sort_asc(spark, sf_dir):
    return _sorted(spark, sf_dir, True)


@query(_SORT.format("DESC"))
def q15_sort_desc(spark, sf_dir):
    return _sorted(spark, sf_dir, False)


def _event_log(spark, sf_dir):
    op = F.when(F.col("event_type") == "error", L.DELETE).when(F.col("event_type") == "signup", L.INSERT).otherwise(L.UPDATE)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("_id"), F.col("event_id").alias("seq"), op.alias("op"), "event_type", "value")


_LAST = "SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS c FROM events"


@query(f"SELECT user_id AS _id, event_id AS seq, event_type, value FROM ({_LAST}) WHERE r = 1 AND event_type <> 'error'")
def q20_replay_lww(spark, sf_dir):
    return L.replay(_event_log(spark, sf_dir)).drop("op")


@query(f"SELECT CAST(sum(c) AS BIGINT) AS entries, CAST(sum(l) AS BIGINT) AS live, CAST(sum(c) - sum(l) AS BIGINT) AS dead, (sum(c) - sum(l)) / CAST(sum(c) AS DOUBLE) AS waste_ratio FROM (SELECT c, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS l FROM ({_LAST}) WHERE r = 1)")
def q21_replay_counts(spark, sf_dir):
    return L.counts(_event_log(spark, sf_dir))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 2 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def q22_update_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    patch = orders.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"))
    return L.merge_update(orders, patch, "o_orderkey", {"o_orderpriority": F.col("o_orderkey") % 2 == 0})


@query("SELECT count(*) AS n FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey = a.o_orderkey AND b.o_orderstatus = 'F')")
def q23_insert_dup_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return L.duplicates(orders.select("o_orderkey"), orders.where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def q24_delete_set(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return L.without(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), gone, "c_custkey")


@query(f"SELECT user_id AS _id, event_id AS seq, CAST(1 AS INTEGER) AS op, event_type, value FROM ({_LAST}) WHERE r = 1 AND event_type <> 'error'")
def q25_compact(spark, sf_dir):
    return L.compact(_event_log(spark, sf_dir))


_RUNS = "SELECT l_orderkey AS k, max(l_extendedprice) AS v, 0 AS lvl FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, max(l_tax), 1 FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1 UNION ALL SELECT l_orderkey, -1.0, 2 FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY 1"


def _runs(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    base = line.groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_extendedprice").alias("v"))
    newer = line.where("l_orderkey % 3 = 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_tax").alias("v"))
    newest = line.where("l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("k")).distinct().withColumn("v", F.lit(-1.0))
    return [base, newer, newest]


@query(f"SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lvl DESC) AS r FROM ({_RUNS})) WHERE r = 1")
def q26_kway_merge(spark, sf_dir):
    return L.merge_runs(_runs(spark, sf_dir), "k")


@query(f"SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lvl DESC) AS r FROM ({_RUNS})) WHERE r = 1 AND lvl < 2")
def q27_level_read(spark, sf_dir):
    base, newer, newest = (r.withColumn("op", F.lit(L.INSERT)) for r in _runs(spark, sf_dir))
    return L.merge_runs([base, newer, newest.withColumn("op", F.lit(L.DELETE))], "k", "op").drop("op")


@query("SELECT event_type, count(*) AS n, min(event_id) AS min_key, max(event_id) AS max_key FROM events GROUP BY event_type")
def q28_posting_list(spark, sf_dir):
    return L.posting_list(table(spark, sf_dir, "events"), "event_type", "event_id")


def _hash_sql(value: str, salt: int = 0) -> str:
    return f"CAST('0x' || substr(md5(CAST({value} AS VARCHAR)), {1 + 8 * salt}, 8) AS BIGINT)"


_REGS = "SELECT h // 4194304 AS reg, max(CASE WHEN h % 4194304 = 0 THEN 23 ELSE 22 - CAST(floor(log2(h % 4194304)) AS BIGINT) END) AS rank FROM (SELECT {0} AS h FROM events{1}) GROUP BY 1"
_HLL = _REGS.format(_hash_sql("user_id"), "")


@query(_HLL)
def q29_hll_registers(spark, sf_dir):
    return K.hll_registers(table(spark, sf_dir, "events"), "user_id")


@query(f"WITH s AS (SELECT sum(pow(2.0, -rank)) AS s, count(*) AS n FROM ({_HLL})), r AS (SELECT n, (0.7213 / (1 + 1.079 / 1024) * 1024 * 1024) / (s + (1024 - n)) AS raw FROM s) SELECT round(CASE WHEN raw <= 2560 AND n < 1024 THEN 1024 * ln(1024.0 / (1024 - n)) ELSE raw END, 6) AS estimate FROM r")
def q30_hll_estimate(spark, sf_dir):
    return K.hll_estimate(K.hll_registers(table(spark, sf_dir, "events"), "user_id"))


@query(_HLL)
def q31_hll_union(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return K.hll_union(*[K.hll_registers(events.where(f"event_id % 2 = {k}"), "user_id") for k in range(2)])


_CMS = " UNION ALL ".join(f"SELECT CAST({r} AS BIGINT) AS row, CAST('0x' || substr(md5('{r}:' || CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 2000 AS col, user_id FROM events" for r in range(7))
_CELLS = f"SELECT row, col, count(*) AS n FROM ({_CMS}) GROUP BY 1, 2"


@query(_CELLS)
def q32_cms_cells(spark, sf_dir):
    return K.cms_cells(table(spark, sf_dir, "events"), "user_id")


@query(f"SELECT user_id, min(n) AS estimate FROM (SELECT DISTINCT row, col, user_id FROM ({_CMS})) JOIN ({_CELLS}) USING (row, col) GROUP BY 1")
def q33_cms_estimate(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return K.cms_estimate(events, "user_id", K.cms_cells(events, "user_id"))


_M, _K = K.bloom_size(1500)
_BITS = f"SELECT DISTINCT ({{0}} + i * ({{1}} | 1)) % {_M} AS bit FROM customer, range({_K}) r(i)".format(_hash_sql("c_custkey"), _hash_sql("c_custkey", 1))


@query(_BITS)
def q34_bloom_bits(spark, sf_dir):
    return K.bloom_bits(table(spark, sf_dir, "customer"), "c_custkey", _M, _K)


@query("SELECT c_custkey FROM customer")
def q45_bloom_no_false_negatives(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    return K.bloom_matches(customer, "c_custkey", K.bloom_bits(customer, "c_custkey", _M, _K), _M, _K)


_CASE = "CASE " + " ".join(f"WHEN value * 20 <= {b} THEN {i}" for i, b in enumerate(S.BOUNDS)) + f" ELSE {len(S.BOUNDS)} END"
_HIST = f"SELECT CAST({_CASE} AS BIGINT) AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1"


def _latencies(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.col("value") * 20).alias("us"))


@query(_HIST)
def q35_latency_hist(spark, sf_dir):
    return S.histogram(_latencies(spark, sf_dir), "us")


@query("SELECT quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events")
def q36_percentiles(spark, sf_dir):
    return S.percentiles(table(spark, sf_dir, "events"), "value")


@query(f"SELECT min(bucket) AS bucket FROM (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS total FROM ({_HIST})) WHERE upto >= 0.95 * total")
def q46_bucket_percentile(spark, sf_dir):
    return S.bucket_percentile(S.histogram(_latencies(spark, sf_dir), "us"), 0.95)


def _event_docs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("_id"), F.parse_json("props").alias("doc"))


@query("SELECT CAST(event_id AS VARCHAR) AS _id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 95")
def q37_json_range(spark, sf_dir):
    return find(_event_docs(spark, sf_dir), FindRequest((Filter("k", "gte", 95),))).select("_id")


@query("SELECT count(*) AS n, count(json_extract_string(props, '$.k')) AS present, count(json_extract_string(props, '$.nowhere')) AS absent FROM events")
def q38_json_presence(spark, sf_dir):
    out = find(_event_docs(spark, sf_dir), FindRequest(projection=("k", "nowhere")))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("present"), F.count("nowhere").alias("absent"))


@query("SELECT CAST(event_id AS VARCHAR) AS _id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 7")
def q47_json_eq(spark, sf_dir):
    return find(_event_docs(spark, sf_dir), FindRequest((Filter("k", "eq", "7"),))).select("_id")


@query("SELECT event_id, value * 20 AS us FROM events WHERE value * 20 > 2000 ORDER BY us DESC, event_id LIMIT 10")
def q39_slow_query_topk(spark, sf_dir):
    return S.slow_queries(_latencies(spark, sf_dir), "us", 2000, 10, "event_id")


@query("SELECT 'c_name' AS field, count(DISTINCT c_name) AS n FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer")
def q40_field_cardinality(spark, sf_dir):
    return S.cardinalities(table(spark, sf_dir, "customer"), ["c_name", "c_nationkey", "c_mktsegment"], exact=True)


@query(None)
def q48_native_sketches(spark, sf_dir):
    out = K.native_sketches(table(spark, sf_dir, "events"), "user_id")
    return out.select("distinct", F.hll_sketch_estimate("hll").alias("hll_estimate"), F.octet_length("cms").alias("cms_bytes"))


@query("SELECT event_type, event_id, row_number() OVER (ORDER BY event_type, event_id) AS place FROM events WHERE event_type IS NOT NULL")
def q49_ordered_dump(spark, sf_dir):
    return L.ordered_dump(table(spark, sf_dir, "events"), "event_type", "event_id")


_WEIGHTS = " UNION ALL ".join(f"SELECT CAST({r} AS BIGINT) AS row, CAST('0x' || substr(md5('{r}:' || CAST(l_suppkey AS VARCHAR)), 1, 8) AS BIGINT) % 2000 AS col, l_linenumber FROM lineitem" for r in range(7))


@query(f"SELECT row, col, CAST(sum(l_linenumber) AS BIGINT) AS n FROM ({_WEIGHTS}) GROUP BY 1, 2")
def q50_cms_add_n(spark, sf_dir):
    return K.cms_cells(table(spark, sf_dir, "lineitem"), "l_suppkey", times="l_linenumber").withColumn("n", F.col("n").cast("long"))


@query(f"SELECT CAST({_M} AS BIGINT) AS m, CAST({_K} AS BIGINT) AS k, count(*) AS popcount, pow(count(*) / {_M}.0, {_K}) AS rate FROM ({_BITS})")
def q51_bloom_fill(spark, sf_dir):
    return K.bloom_fill(K.bloom_bits(table(spark, sf_dir, "customer"), "c_custkey", _M, _K), _M, _K)


_NAMES = ("c_name", "c_nationkey", "c_mktsegment")
_REG = "SELECT '{0}' AS field, h // 4194304 AS reg, max(CASE WHEN h % 4194304 = 0 THEN 23 ELSE 22 - CAST(floor(log2(h % 4194304)) AS BIGINT) END) AS rank FROM (SELECT {1} AS h FROM customer) GROUP BY 2"


@query("WITH g AS (" + " UNION ALL ".join(_REG.format(c, _hash_sql(c)) for c in _NAMES) + "), s AS (SELECT field, sum(pow(2.0, -rank)) AS s, count(*) AS n FROM g GROUP BY 1), r AS (SELECT field, n, (0.7213 / (1 + 1.079 / 1024) * 1024 * 1024) / (s + (1024 - n)) AS raw FROM s) SELECT field, round(CASE WHEN raw <= 2560 AND n < 1024 THEN 1024 * ln(1024.0 / (1024 - n)) ELSE raw END, 6) AS estimate FROM r")
def q52_approx_cardinality(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    parts = [K.hll_estimate(K.hll_registers(customer, c)).select(F.lit(c).alias("field"), "estimate") for c in _NAMES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
