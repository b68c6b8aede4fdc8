"""The pipeline on the small tables: each stage against the plain version of its decision."""

import zlib

import brute
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import mixing, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] if "text" in docs.columns else []
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        if i == 1:
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(k for k, n, c in brute.components(before) if k == c)
        if i == 2:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r[0] for r in brute.contamination(before, items) if not r[5])
        if i < 4:
            assert docs.columns == columns
    assert counts[4] == counts[3]
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert corpus_pipeline.run(spark, SF).count() == counts[4]


def test_rules_stage_keeps_what_a_plain_version_keeps(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    kept = brute.quality_kept(rows, labels, quality.ALPHA, quality.DELTA, [grid for _, grid in quality.RULES.values()])
    assert sorted(r["doc_id"] for r in corpus_pipeline.rules(spark, docs, sf).collect()) == sorted(kept)
    assert len(kept) < sum(not r[-1] for r in brute.quality([r[:2] for r in rows]))  # the cutoffs reject some


def test_mixing_and_token_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(docs).collect()}
    corpus_pipeline.mixed(spark, docs, SF).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    times = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in mixed.collect())
    assert all(times.get(k, 0) * size == taken for k, (size, taken) in copies.items() if size)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, start = [], 0
    for k in sorted(r["doc_id"] for r in mixed.collect()):
        ids = [*tok.encode(texts[k] or "", add_special_tokens=False).ids, 1]
        expected.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.tokens(spark, mixed, SF).collect()) == expected


def test_stages_take_awkward_rows(spark, tmp_path):
    """Nulls, empty and repeated texts, repeated rows, clashing columns; then an empty table."""
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    long = " ".join(f"word{i}" for i in range(3000))
    made = [(None, None, None, None), (1, "", "en", "a"), (2, long, None, None), (2, long, None, None), (3, long, "en", "b"), (None, long + " more", "fr", "a"), (4, " \n ", "en", "a")]
    made += [(10 + k, " ".join(f"t{k}x{i}" for i in range(30)), "en", "ab"[k % 2]) for k in range(8)]
    schema = "doc_id long, text string, lang string, source string, cid long, n_words long, _words string, size long, part int, kept boolean"
    for rows in (made, []):
        docs = spark.createDataFrame([(*r, 1, 2, "x", 3, 4, False) for r in rows], schema)
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(rows)}-{name}")
            out = stage(spark, docs, str(tmp_path))
            assert i == 4 or out.columns == docs.columns
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if i == 1:
                assert sorted(r["doc_id"] for r in docs.collect()) == ([2, *range(10, 18)] if rows else [])
        assert bool(docs.count()) == bool(rows)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries()
