"""Similarity joins against a comparison of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.functions import similarity as Y
from matchloom.operators import similar as S


def slow_partial(a, b):
    a, b = sorted((a, b), key=len)
    m, n = len(a), len(b)
    return max([100.0 if a in b else 0.0] + [Y.indel_ratio(a, b[max(0, s) : min(n, s + m)]) for s in range(1 - m, n)])


def damaged(rng, text):
    for _ in range(rng.randrange(6)):
        k = rng.randrange(len(text) + 1)
        text = text[:k] + rng.choice(["", "X", "7", "-", "é", " "]) + text[k + rng.randrange(2) :]
    return text


def catalog(rng, n):
    """Articles of families, figures alone, short ones, and long names."""
    kinds = ["COPPER {}-{}", "BRUSHED STEEL {}/{}", "{}{}", "A{}", "{}-{}-{}", "PIPE OF SOME LENGTH {} MM RED GREEN", "Q{}W{}E{}", "É{} Ü"]
    return [rng.choice(kinds).format(*[rng.randrange(10 ** rng.randrange(1, 5)) for _ in range(3)]) for _ in range(n)]


def every_pair(queries, keys, score, cutoff, limit):
    ids = {}
    for i, k in keys:
        ids.setdefault(k, []).append(i)
    out = {}
    for q in set(queries) - {""}:
        found = sorted((-s, i) for k, own in ids.items() if k and (s := score(q, k)) >= cutoff - 1e-9 for i in own)[:limit]
        if found:
            out[q] = [(i, round(-s, 9)) for s, i in found]
    return out


def rows(df):
    out = {}
    for r in df.orderBy("query", F.desc("score"), "product_id").collect():
        out.setdefault(r.query, []).append((r.product_id, round(r.score, 9)))
    return out


@pytest.mark.parametrize("cutoff,limit", [(80, 10), (93, 10), (70, 3)])
def test_token_sort_join_loses_nothing(spark, cutoff, limit):
    rng = random.Random(cutoff)
    texts = catalog(rng, 250)
    keys = [(i, rng.choice([t, " ".join(t.split()[::-1])])) for i, t in enumerate(texts)]
    queries = [damaged(rng, rng.choice(texts)) for _ in range(150)] + catalog(rng, 50)
    q, k = spark.createDataFrame([(x,) for x in queries + [""]], "query string"), spark.createDataFrame(keys + [(9999, ""), (9998, None)], "product_id long, key string")
    want = every_pair(queries, keys, Y.token_sort_ratio, cutoff, limit)
    want = {q: v for q, v in want.items() if q.strip()}
    assert len(want) > 50 and rows(S.token_sort_join(q, k, cutoff, limit, q_block=7, k_block=40)) == want


@pytest.mark.parametrize("cutoff,limit", [(90, 5), (96, 10), (80, 4)])
def test_partial_join_loses_nothing(spark, cutoff, limit):
    rng = random.Random(cutoff)
    texts = catalog(rng, 200)
    keys = [(i, rng.choice([t, t + " AND MORE 12", "LONG BEFORE " + t, t[2:-2], t[: 1 + i % 3]])) for i, t in enumerate(texts)]
    queries = [damaged(rng, rng.choice(texts)) for _ in range(120)] + [x + " Y" * 40 for x in texts[:5]]
    q, k = spark.createDataFrame([(x,) for x in queries + [""]], "query string"), spark.createDataFrame(keys + [(9999, ""), (9998, None)], "product_id long, key string")
    want = every_pair(queries, keys, slow_partial, cutoff, limit)
    assert len(want) > 50 and rows(S.partial_join(q, k, cutoff, limit, q_block=7, k_block=40)) == want


def test_families_that_meet_are_few(spark):
    """Two thousand by two thousand of all kinds: families compared, and none of all by all."""
    rng = random.Random(5)
    words = ["".join(rng.choice("ABCDEFGHIJKLMNOPRSTUVWYZ") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    keys = [f"{rng.choice(words)} {rng.choice(words)} {rng.randrange(999)}-{rng.randrange(99)}" for _ in range(2000)]
    queries = [damaged(rng, rng.choice(keys)) for _ in range(2000)]
    frame = lambda xs: spark.createDataFrame([(x,) for x in sorted(set(xs))], "t string").select(S.sorted_tokens(F.col("t")).alias("s")).where("s <> ''").distinct()
    q, k = (frame(x).withColumns(S.family(F.col("s"))) for x in (queries, keys))
    pairs = S.similar_families(q, k, 80)
    met = pairs.join(q.groupBy(F.col("x").alias("q_x"), F.col("n").alias("q_n")).count().withColumnRenamed("count", "a"), ["q_x", "q_n"]).join(k.groupBy(F.col("x").alias("k_x"), F.col("n").alias("k_n")).count(), ["k_x", "k_n"])
    compared = met.agg(F.sum(F.col("a") * F.col("count"))).first()[0]
    assert compared / q.count() < 0.02 * k.count()
    plan = pairs._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], "query string"), spark.createDataFrame([(1, "A-1")], "product_id long, key string")
    q, k = spark.createDataFrame([("A-1",), (None,)], "query string"), spark.createDataFrame([], "product_id long, key string")
    for join in (S.token_sort_join, S.partial_join):
        assert join(none, some, 80, 5).collect() == [] and join(q, k, 80, 5).collect() == []
        assert rows(join(q, some, 80, 5)) == {"A-1": [(1, 100.0)]}


def test_windows_score_what_a_loop_scores():
    rng = random.Random(11)
    texts = sorted({"".join(rng.choice("AB-12 x") for _ in range(rng.randrange(20, 90))) for _ in range(200)})
    windows = Y.Windows(texts)
    for cutoff in (80, 90, 96, 0):
        for size in (1, 2, 5, 12, 20):
            q = "".join(rng.choice("AB-12 x") for _ in range(size))
            at, scores = windows.search(q, cutoff)
            want = {k: s for k, t in enumerate(texts) if (s := slow_partial(q, t)) >= cutoff - 1e-9 and s}
            assert {k: round(s, 6) for k, s in zip(at.tolist(), scores.tolist())} == {k: round(s, 6) for k, s in want.items()}
    long = "AB-12 x" * 12
    at, scores = Y.Windows([long + "AB", "x" * 90, long[:-3] + "QQ" + long]).search(long, 90)
    assert at.tolist() == [0, 2] and scores.tolist() == [100.0, 100.0]
