"""What keeps matching in bounds on large tables, and that nothing is lost by it."""

import random

from pyspark.sql import functions as F

from matchloom.functions import similarity as Y
from matchloom.operators import matching as M
from matchloom.operators import similar as S
from tests.test_matching import catalog


def test_texts_of_about_one_length_meet_by_whole_pieces(spark):
    """Every gram is common here, and some texts are very long."""
    rng = random.Random(4)
    some = {"".join(rng.choice("01") for _ in range(rng.randrange(1, 14))) for _ in range(150)} | {"01" * 40 + str(k) for k in range(12)}
    short = some | {t[rng.randrange(3) : len(t) - rng.randrange(20)] for t in some} - {""}
    s, k = spark.createDataFrame([(x,) for x in short], "query string"), spark.createDataFrame([(x,) for x in some], "key string")
    got = [tuple(r) for r in M.containing_pairs(s, k, 0.7).collect()]
    near = lambda a, b: min(len(a), len(b)) >= 0.7 * max(len(a), len(b))
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in short for b in some if (a in b or b in a) and near(a, b)}


def test_lines_of_equal_cells_are_searched_once(spark, monkeypatch):
    cat = catalog(spark, [(1, "ABC-100", "red cable of some length", "", "ss"), (2, "ABC-101", "blue cable of some length", "", "os")])
    rows = [(k, "ABC-10", None, "", False, 1.0) for k in range(1, 41)] + [(99, "ABC-10", "", None, False, 1.0), (100, "ABC-10", "n", "", True, 1.0)]
    items = spark.createDataFrame(rows, "item_id long, article_raw string, name_raw string, kaznisa_code_raw string, is_heading boolean, qty double")
    searched = []
    monkeypatch.setattr(M, "_article_stages", lambda rest, products, similar, real=M._article_stages: searched.append(rest.count()) or real(rest, products, similar))
    got = sorted((r.item_id, r.product_id, r.method, r.rank) for r in M.cascade(items, cat, similar=False, names=False).collect())
    assert searched == [1]
    assert got == sorted((i, p, "contains", p) for i in [*range(1, 41), 99] for p in (1, 2))


def test_a_stage_alone_sees_equal_cells_once(spark):
    rows = [(k, "ABC-10" if k % 2 else None, "n", None, False) for k in range(1, 41)] + [(99, "ABC-10", "n", "", True)]
    items = spark.createDataFrame(rows, "item_id long, article_raw string, name_raw string, kaznisa_code_raw string, is_heading boolean")
    seen = []

    def search(alike):
        seen.extend((r.item_id, r.article_raw) for r in alike.collect())
        return alike.where("article_raw <> ''").select("item_id", F.lit(7).alias("product_id"))

    assert sorted(tuple(r) for r in M.by_cells(items, search).collect()) == [(k, 7) for k in range(1, 41, 2)]
    assert sorted(seen) == [(1, "ABC-10"), (2, "")]


def test_long_grams_find_what_short_ones_find(spark):
    rng = random.Random(6)
    long = {"".join(rng.choice("AB-1") for _ in range(rng.randrange(1, 30))) for _ in range(200)}
    short = {t[rng.randrange(5) :][: rng.randrange(1, 20)] for t in long} - {""}
    s, k = spark.createDataFrame([(x,) for x in short], "short string"), spark.createDataFrame([(x,) for x in long], "long string")
    want = sorted((a, b) for a in short for b in long if a in b)
    assert sorted(tuple(r) for r in S.inside_pairs(s, k, 8).collect()) == want == sorted(tuple(r) for r in S.inside_pairs(s, k).collect())


def test_tries_find_what_a_loop_finds():
    rng = random.Random(2)
    word = lambda most: Y.token_sort("".join(rng.choice("AB-12 x") for _ in range(rng.randrange(most))))
    texts, queries = sorted({word(30) for _ in range(300)} - {""}), [word(30) for _ in range(60)] + [word(90) for _ in range(5)]
    for cutoff, limit, states in ((80, 10, 1_000_000), (93, 3, 1_000_000), (70, 2, 100)):
        got = {}
        for q, k, s in zip(*(x.tolist() for x in Y.SortedTries(texts, [1] * len(texts), states).search(queries, cutoff, limit))):
            got.setdefault(q, []).append((-round(s, 9), k))
        want = {q: sorted((-round(s, 9), k) for k, t in enumerate(texts) if (s := Y.indel_ratio(text, t)) >= cutoff - 1e-9)[:limit] for q, text in enumerate(queries) if text}
        assert {q: sorted(v)[:limit] for q, v in got.items()} == {q: v for q, v in want.items() if v}


def test_articles_that_are_mostly_figures_are_few_families(spark):
    texts = [f"LARGE-{k % 50}-{100000 + k}" for k in range(400)] + [str(10**8 + k) for k in range(50)]
    t = spark.createDataFrame([(x,) for x in texts], "s string").withColumns(S.family(F.col("s")))
    assert t.select("x", "n").distinct().count() == 3
    pairs = {tuple(r) for r in S.similar_families(t, t, 80).collect()}
    assert ("", 9, "", 9) in pairs and ("LARGE--", 15, "LARGE--", 14) in pairs and len(pairs) <= 9


def test_partial_scores_leave_out_what_figures_cannot_reach(spark):
    """The names have two digits at most, the articles eight."""
    q = spark.createDataFrame([(f"ECONXOMY-{k % 50}-{100000 + k}",) for k in range(100)] + [("GREEN PIPE 12",)], "query string").withColumns(S.pattern(F.col("query")))
    names = spark.createDataFrame([(f"GREEN PIPE ECONOMY SIZE {k}",) for k in range(99)], "text string")
    assert {r.x for r in S.windowed_texts(q, names, 90, True).select("x").distinct().collect()} <= {"GREEN PIPE "}


def test_views_of_matches_read_the_lines_once(spark, sf, monkeypatch):
    """Lines and statuses are written, so plans of what follows have no join of orders and catalog left."""
    from matchloom.plans import matching, registry
    from matchloom.plans.views import Tables

    t = Tables(spark, sf)
    assert "lineitem" not in " ".join(matching.matches(t).inputFiles())
    for name in ("mat_rematch_apply", "mat_hybrid"):
        files = registry.load().queries[name](spark, sf).inputFiles()
        assert not any("/lineitem.parquet" in f or "/lines-" in f for f in files)
