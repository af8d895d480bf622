import math
from collections import Counter

from matchloom.llm import ce_difference as M
from matchloom.llm.suffix_decontam import words_of


def plain(docs, good, size, smoothing):
    """Dictionaries only."""
    total = Counter(w.decode() for _, t in docs for w in words_of(t))
    words = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]]
    ids = {w: k + 1 for k, w in enumerate(words)}
    start, n_ids = len(words) + 1, len(words) + 2
    models = []
    for keep in (lambda i: i in good, lambda i: True):
        pair, before, single = Counter(), Counter(), Counter()
        for i, t in docs:
            if keep(i):
                last = start
                for w in words_of(t):
                    k = ids.get(w.decode(), 0)
                    pair[last, k] += 1
                    before[last] += 1
                    single[k] += 1
                    last = k
        n = sum(single.values()) + n_ids - 1
        models.append(lambda a, b, pair=pair, before=before, single=single, n=n: -math.log((pair[a, b] + smoothing * (single[b] + 1) / n) / (before[a] + smoothing)))
    out = {}
    for i, t in docs:
        last, loss, count = start, [0.0, 0.0], 0
        for w in words_of(t):
            k = ids.get(w.decode(), 0)
            loss = [x + m(last, k) for x, m in zip(loss, models)]
            last, count = k, count + 1
        out[i] = (count, *(x / count if count else None for x in loss))
    return out


def test_whole_table_equals_a_plain_model(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = docs.collect()
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    want = plain([(r.doc_id, r.text) for r in rows], good, 300, 50.0)
    got = M.ce_difference(docs, M.fit_tables(docs, labels, size=300)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, target, background = want[r.doc_id]
        assert r.n_tokens == n
        if n:
            assert abs(r.loss_target - target) < 1e-4 and abs(r.loss_background - background) < 1e-4 and abs(r.score - (target - background)) < 2e-4


def test_good_documents_score_lower(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    tables = M.fit_tables(docs, labels.where("doc_id % 2 = 0"))
    held = M.ce_difference(docs, tables).join(labels.where("doc_id % 2 = 1"), "doc_id")
    mean = {r.quality: r.s for r in held.groupBy("quality").agg({"score": "avg"}).withColumnRenamed("avg(score)", "s").collect()}
    assert mean[1] < mean[0]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (None, "a b", 0.0), (3, "a a b", 0.0), (3, "a a b", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    got = M.ce_difference(docs, M.fit_tables(docs, labels)).collect()
    assert sum(r.score is None for r in got) == 2 and len(got) == 5
    none = M.fit_tables(docs.limit(0), labels.limit(0))
    assert M.ce_difference(docs, none).count() == 5 and M.ce_difference(docs.limit(0), none).count() == 0


def test_rare_words_and_all_good_documents_count(spark):
    """Over 2,046 words, each with losses of its own, by models of whole tables."""
    docs = [(i, f"common w{i} x{i % 7} w{i % 50} common") for i in range(5000)]
    good = {i for i, _ in docs if i % 3 == 0}
    frame, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i in good), 0) for i, _ in docs], "doc_id long, quality int, toxic int")
    want = plain(docs, good, 10**6, 50.0)
    tables = M.fit_tables(frame, labels)
    assert (tables.n_words, tables.background, tables.target) == (5000 + 7 + 1, 25_000, 5 * len(good))
    got = {r.doc_id: r for r in M.ce_difference(frame, tables).collect()}
    for i, (n, target, background) in want.items():
        assert got[i].n_tokens == n and abs(got[i].loss_target - target) < 1e-9 and abs(got[i].loss_background - background) < 1e-9
    assert got[3000].score < got[3350].score  # they differ in rare words only


def test_sums_of_few_partitions_first_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the w{i % 40} the x{i % 7}") for i in range(400)], "doc_id long, text string").repartition(9)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 400, 3)], "doc_id long, quality int, toxic int")

    def scored():
        return sorted((r.doc_id, r.n_tokens, round(r.loss_target, 12), round(r.loss_background, 12)) for r in M.ce_difference(docs, M.fit_tables(docs, labels)).collect())

    once = scored()
    monkeypatch.setattr(M, "MOST_SLICES", 0)
    monkeypatch.setattr(M, "FEW_PARTITIONS", 2)
    assert scored() == once


def test_equal_rows_and_long_texts(spark):
    rows = [(None, "same text here")] * 300 + [(1, "word " * 100_000), (2, "same text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    got = M.ce_difference(docs, M.fit_tables(docs, labels)).collect()
    same = {(r.n_tokens, r.score) for r in got if r.doc_id != 1}
    assert len(got) == 302 and len(same) == 1 and {r.n_tokens for r in got if r.doc_id == 1} == {100_000}
