"""The pipeline against plain computations, stage by stage and as a whole."""

import re

import corpus_pipeline as P
from matchloom.llm import merge_dropout, quality_crf, secret_scan
from tests.llm.test_shingle_similarity import brute as brute_similar
from tests.llm.test_suffix_decontam import brute as brute_hits


def plain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    field = quality_crf.fit_field(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [r for r in docs.collect() if quality_crf.judge(field, r.text)[2]]
    groups = brute_similar({r.doc_id: r.text for r in rows})[1]
    rows = [r for r in rows if groups[r.doc_id] == r.doc_id]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in rows], items)
    rows = [r for r in rows if not hits[r.doc_id][4]]
    out = {}
    for r in rows:
        spans = sorted((m.start(), k, m.end()) for k, rule in enumerate(secret_scan.RULES) for m in re.compile(rule.pattern, rule.flags).finditer(r.text) if m.end(rule.group) - m.start(rule.group) >= rule.min_length)
        out[r.doc_id] = (r.lang, r.source, secret_scan.redact_text(r.text, spans, [x.kind for x in secret_scan.RULES]))
    return out


def test_run_equals_plain(spark, sf):
    want = plain(spark, sf)
    got = P.run(spark, sf)
    assert got.columns == ["doc_id", "lang", "source", "pieces"]
    assert {r.doc_id: (r.lang, r.source, r.text) for r in merge_dropout.decode(got).collect()} == want


def test_stages_keep_columns_and_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "'x' AS fp")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf).schema == docs.schema
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert P.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_stages_take_nulls_repeats_and_long_texts(spark, sf):
    """Defined results of each stage on odd rows; see the stages' docstrings."""
    long = "\n".join(" ".join(f"wo{k * 7919 % 99991}rd" for k in range(j, j + 12)) + "." for j in range(0, 60_000, 12))
    prose = "The old house by the river was sold to a family from the north last year."
    rows = [(1, None, "en", "s", 0), (None, prose, "en", "s", 5), (2, "", None, None, 0), (3, prose, "en", "s", 5), (3, prose, "en", "s", 5), (4, long, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {name: sorted((r.doc_id or 0 for r in stage(spark, docs, sf).collect())) for name, stage in P.STAGES}
    # Texts without words fail the quality rules; null ids are no copies of others.
    assert kept["quality rules"] == [0, 3, 3, 4]
    assert kept["near-duplicates"] == [0, 1, 3, 4]
    assert kept["benchmark decontamination"] == kept["secret scan"] == kept["piece encoding"] == [0, 1, 2, 3, 3, 4]
    encoded = P.STAGES[-1][1](spark, docs, sf)
    texts = sorted((r.text for r in merge_dropout.decode(encoded).collect()), key=str)
    assert texts == sorted((r[1] for r in rows), key=str)
