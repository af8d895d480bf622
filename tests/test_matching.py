"""Similarity scores, blocking without loss, statuses, decisions and prices."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.functions import similarity as Y
from matchloom.operators import changes as H
from matchloom.operators import matching as M
from matchloom.operators import pricing as P
from matchloom.operators import vectors as V


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def words(rng, n, most=14, letters="AB-12 x"):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_scores():
    rng = random.Random(1)
    for a, b in zip(words(rng, 400, 80), words(rng, 400, 80)):
        assert Y.lcs_length(a, b) == slow_lcs(a, b)
        assert Y.indel_ratio(a, b) == Y.indel_ratio(b, a)
        assert (Y.token_sort_ratio(a, b) == 100) == (Y.token_sort(a) == Y.token_sort(b))
    assert Y.partial_ratio("ABC", "xxABCxx") == 100
    assert round(Y.partial_ratio("ABC", "AXBXC"), 1) == 66.7 and Y.indel_ratio("ABC", "AXBXC") == 75


def test_search_finds_what_a_loop_finds():
    rng = random.Random(2)
    texts, queries = words(rng, 300, 90), words(rng, 60, 90)
    index = Y.TokenSortIndex(texts)
    for q in queries:
        for cutoff in (60, 80, 93):
            at, scores = index.search(q, cutoff)
            want = {k: Y.token_sort_ratio(q, t) for k, t in enumerate(texts) if Y.token_sort(q) and Y.token_sort_ratio(q, t) >= cutoff}
            assert {k: round(s, 9) for k, s in zip(at.tolist(), scores.tolist())} == {k: round(s, 9) for k, s in want.items()}
        assert [Y.partial_ratio(q, t, 90) for t in texts[:50]] == [s if (s := Y.partial_ratio(q, t)) >= 90 else 0.0 for t in texts[:50]]


def test_containing_pairs_lose_nothing(spark):
    rng = random.Random(3)
    q, k = set(words(rng, 150, 9, "AB1")) - {""}, set(words(rng, 150, 9, "AB1")) - {""}
    got = {tuple(r) for r in M.containing_pairs(spark.createDataFrame([(x,) for x in q], "query string"), spark.createDataFrame([(x,) for x in k], "key string")).collect()}
    assert got == {(a, b) for a in q for b in k if a in b or b in a}


def test_statuses(spark):
    items = spark.createDataFrame([(k, False, 2.0) for k in range(1, 7)] + [(9, True, 3.0)], "item_id long, is_heading boolean, qty double")
    rows = [(1, 1, 95.0, "contains"), (1, 2, 91.0, "fuzzy_article"), (2, 1, 95.0, "contains"), (2, 2, 89.0, "fuzzy_article"), (3, 1, 99.0, "name_exact"), (4, 1, 100.0, "exact"), (5, 1, 100.0, "fuzzy_article"), (5, 3, 100.0, "fuzzy_article")]
    catalog = spark.createDataFrame([(1, "ss"), (2, "ss"), (3, "os")], "id long, segment string")
    got = {r.item_id: (r.status, r.qty, r.product_id) for r in M.statuses(items, spark.createDataFrame(rows, M.CANDIDATE), catalog).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "multiple", 2: "fuzzy", 3: "fuzzy", 4: "exact", 5: "multiple", 6: "not_found", 9: "heading"}
    assert got[9][1] == 0 and got[1][2] == 1


CATALOG = "id long, num long, article string, name string, unit string, kaznisa double, rrts double, mrc double, opt double, partner double, brand string, multiplicity int, kaznisa_code string, segment string, is_active boolean"


def catalog(spark, rows):
    return spark.createDataFrame([(i, i, a, n, "m", None, None, None, None, None, "B", None, c, s, True) for i, a, n, c, s in rows], CATALOG)


def test_whole_cascade(spark):
    cat = catalog(spark, [(1, "ABC-100", "red cable of some length", "247-201-0001", "ss"), (2, "ABC-101", "blue cable of some length", "", "os"), (3, "XYZ-7", "green pipe with a long name here", "", "ss"), (4, "QRS-55", "unrelated", "", "ss")])
    lines = [(1, "abc–100 IEK", "n", ""), (2, "ABC-10", "n", ""), (3, "XYY-7", "n", ""), (4, "", "n", "247-201-0001"), (5, "", "1 / green pipe with a long name here", ""), (6, "", "here green pipe with a long name", ""), (7, "nothing", "n", "")]
    items = spark.createDataFrame([(i, a, n, c, False, 1.0) for i, a, n, c in lines], "item_id long, article_raw string, name_raw string, kaznisa_code_raw string, is_heading boolean, qty double")
    got = {}
    for r in M.cascade(items, cat, similar=False, names=False).collect():
        got.setdefault(r.item_id, []).append((r.rank, r.product_id, r.method))
    assert sorted(got) == [1, 2, 4, 5]
    assert got[1] == [(1, 1, "exact")] and sorted(got[2]) == [(1, 1, "contains"), (2, 2, "contains")]
    assert got[4] == [(1, 1, "code_exact")] and got[5] == [(1, 3, "name_exact")]


def test_similarity_stages(spark):
    cat = catalog(spark, [(1, "ABC-100", "red cable of some length", "", "ss"), (3, "XYZ-7", "green pipe with a long name here", "", "ss")])
    items = spark.createDataFrame([(3, "XYY-7", "n", "", False, 1.0), (6, "", "here green pipe with a long name", "", False, 1.0)], "item_id long, article_raw string, name_raw string, kaznisa_code_raw string, is_heading boolean, qty double")
    rows, products = M.prepared(items), M.keyed(cat)
    assert [(r.item_id, r.product_id, r.score) for r in M.article_fuzzy(rows, products).collect()] == [(3, 3, 80.0)]
    assert [(r.item_id, r.product_id, r.score) for r in M.name_fuzzy(rows, products).collect()] == [(6, 3, 100.0)]


@pytest.mark.parametrize("best,second,want", [(0.71, 0.0, "not_found"), (0.80, 0.70, "match"), (0.91, 0.90, "match"), (0.85, 0.83, "ambiguous")])
def test_decide(spark, best, second, want):
    assert spark.range(1).select(V.decide(F.lit(best), F.lit(second)).alias("d")).first().d == want


def test_price_golden(spark):
    line = spark.createDataFrame([(1, 2.0, 3, 1.2, 1.03, 1.0, 1.16, 0.8, None, 100.0, None, None, None)], "item_id long, qty double, rate int, margin double, logistics double, currency_rate double, nds double, gp double, kaznisa double, rrts double, mrc double, opt double, partner double")
    r = P.priced(line).first()
    assert (r.cost, r.quote, r.cost_sum, r.quote_sum) == (120.0, 144.0, 240.0, 288.0)


def test_diff_golden_and_apply_is_refused_twice(spark):
    cat = spark.createDataFrame([(1, "A", "n", "b", 100.0, None, None, "ss", True), (2, "B", "n", "b", 100.0, None, None, "ss", True), (3, "C", "n", "b", None, None, None, "ss", True)], "id long, article string, name string, brand string, rrts double, opt double, partner double, segment string, is_active boolean")
    inc = spark.createDataFrame([("A", "n", "b", None, 100.005, None, None), ("B", "n", "b", None, 100.02, None, None), ("C", "n", "b", None, 5.0, None, None), ("N", "x", None, 7.0, None, None, None)], "article string, name string, brand string, price_base double, price_rrts double, price_opt double, price_partner double")
    diff = H.price_diff(cat, inc)
    assert {r.article: r.kind for r in diff.collect()} == {"A": "skipped", "B": "updated", "C": "updated", "N": "new"}
    after = {r.article: (r.rrts, r.opt) for r in H.apply_diff(cat, diff).collect()}
    assert after == {"A": (100.0, None), "B": (100.02, None), "C": (5.0, None), "N": (None, 7.0)}
    with pytest.raises(ValueError):
        H.apply_diff(cat, diff, status="applied")


def test_inactive_products_are_new_and_the_order_of_rows_counts_not_their_place(spark):
    schema = "id long, article string, name string, brand string, rrts double, opt double, partner double, segment string, is_active boolean"
    cat = spark.createDataFrame([(1, "A", "n", "b", 1.0, 1.0, None, "ss", True), (2, "I", "n", "b", 1.0, None, None, "ss", False), (3, "D", "n", "b", 1.0, None, None, "ss", True), (4, "D", "n", "b", 2.0, None, None, "os", True), (5, "E", "n", "b", 2.0, None, None, "os", False)], schema)
    rows = [(k, "A", "n", "b", 5.0 if k == 3 else None, 100.0 + k, None, None) for k in range(1000)] + [(1000, "I", "n", "b", None, 7.0, None, None), (1001, "I", "m", "b", None, 8.0, None, None)]
    inc = spark.createDataFrame(rows, "row_no long, article string, name string, brand string, price_base double, price_rrts double, price_opt double, price_partner double")
    for parts in (1, 5, 16):
        diff = H.price_diff(cat, inc.repartition(parts), mark_missing=True)
        kinds = [(r.article, r.kind) for r in diff.where("article <> 'A'").collect()]
        assert sorted(kinds) == [("D", "deleted"), ("I", "new"), ("I", "new")]
        after = sorted((r.id, r.article, r.name, r.rrts, r.opt, r.is_active) for r in H.apply_diff(cat, diff).collect())
        assert after == [(1, "A", "n", 1099.0, 5.0, True), (2, "I", "n", 1.0, None, False), (3, "D", "n", 1.0, None, False), (4, "D", "n", 2.0, None, False), (5, "E", "n", 2.0, None, False), (6, "I", "m", 8.0, None, True)]


def test_numbers_are_gapless_and_repeatable(spark):
    rows = spark.range(5000).selectExpr("concat('k', id) AS k")
    top = spark.createDataFrame([(10,)], "m long")
    got = {r.k: r.n for r in H.numbered(rows.repartition(7), "k", "n", top).collect()}
    assert sorted(got.values()) == list(range(11, 5011))
    assert got == {r.k: r.n for r in H.numbered(rows.repartition(2), "k", "n", top).collect()}


def test_top_k_with_many_equal_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8)).astype("f4")
    rows = [(int(i), "ss", base[i % 40 if i % 3 else 0].tolist()) for i in rng.permutation(3000)]
    vectors = spark.createDataFrame(rows, "id long, segment string, embedding array<float>")
    queries = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 300 == 0], "query_id long, embedding array<float>")
    matrix = {i: np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) for i, _, v in rows}
    got = {}
    for r in V.top_k(queries, vectors, exclude_self=True).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    for q, found in got.items():
        want = sorted((-round(float(matrix[q] @ v), 9), i) for i, v in matrix.items() if i != q)[:8]
        assert [i for _, i in sorted(found)] == [i for _, i in want]


@pytest.mark.parametrize("minimum", [None, 0.3, 0.92])
def test_tiles_lose_nothing_and_skip_what_cannot_reach(spark, minimum):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = [(i, ["ss", "os", "xx"][i % 3], [float(x) for x in centres[i % 12] + rng.normal(size=16) * 0.15]) for i in range(1500)] + [(9000, "ss", None)]
    vectors = spark.createDataFrame(rows, "id long, segment string, embedding array<double>")
    queries = spark.createDataFrame([(i, [x + 0.05 for x in v]) for i, _, v in rows[:1500:25]] + [(1, None)], "query_id long, embedding array<double>")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    stored = {i: unit(v) for i, s, v in rows if v and s in ("ss", "os")}
    got = {}
    for r in V.top_k(queries, vectors, 4, ("ss", "os"), minimum=minimum, tile=40).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.similarity, 9)))
    want = {}
    for i, v in [(i, [x + 0.05 for x in v]) for i, _, v in rows[:1500:25]]:
        best = sorted((-round(float(unit(v) @ s), 9), k) for k, s in stored.items() if minimum is None or unit(v) @ s >= minimum)[:4]
        if best:
            want[i] = [(k, -s) for s, k in best]
    assert got == want and len(got) >= 40
    wanted = vectors.where("segment in ('ss', 'os') and embedding is not null")
    pivots = V.pivots_of(wanted)
    tiles, (_, asked) = V.vector_tiles(wanted, pivots, 40), V.query_tiles(queries.where("embedding is not null"), pivots, 40)
    share = V.tile_pairs(asked, tiles, minimum).count() / V.tile_pairs(asked, tiles, None).count()
    assert share == 1 if minimum is None else share < (0.9 if minimum < 0.5 else 0.4)


def test_upsert_twice_is_the_same(spark):
    cat = catalog(spark, [(1, "A", "old", "", "ss"), (2, "A", "other", "", "os")])
    rows = spark.createDataFrame([(1, "A", "first"), (2, "A", "last"), (3, "N", "new"), (4, None, "none")], "row_no int, article string, name string")
    once = H.upsert_catalog(cat, rows, "ss")
    twice = H.upsert_catalog(once.drop("change"), rows, "ss")
    assert {(r.id, r.article, r.name, r.segment) for r in once.collect()} == {(1, "A", "last", "ss"), (2, "A", "other", "os"), (3, "N", "new", "ss")} == {(r.id, r.article, r.name, r.segment) for r in twice.collect()}


def test_batches_that_repeat_a_key(spark):
    from matchloom.operators import review as R

    versions = spark.createDataFrame([("a", 1, "h1", True), ("b", 1, "h2", True)], "filename string, version long, file_hash string, is_active boolean")
    sent = spark.createDataFrame([(1, "a", "z"), (2, "a", "y"), (3, "a", "z"), (4, "b", "h1"), (5, "c", "x"), (6, "c", "x")], "seq int, filename string, file_hash string")
    got = sorted((r.filename, r.version, r.file_hash, r.is_active) for r in H.new_version(versions, sent, "seq").collect())
    assert got == [("a", 1, "h1", False), ("a", 2, "z", False), ("a", 3, "y", True), ("b", 1, "h2", True), ("c", 1, "x", True)]
    people = spark.createDataFrame([("P", "x", None, None, False)], "full_name string, position string, email string, phone string, is_active boolean")
    rows = spark.createDataFrame([(2, "P", None, "late", None), (1, "P", None, "first", None), (3, None, "n", "n", "n"), (4, "Q", None, None, "7")], "row_no int, full_name string, position string, email string, phone string")
    assert sorted((r.full_name, r.position, r.email, r.phone, r.is_active) for r in H.upsert_people(people, rows, "row_no").collect()) == [("P", "x", "first", None, True), ("Q", None, None, "7", True)]
    table = spark.createDataFrame([(1, "n", 1.0), (2, "m", 2.0)], "id long, name string, rrts double")
    edits = spark.createDataFrame([(1, 1, "old", 5.0), (2, 1, "new", None)], "at int, id long, name string, rrts double")
    assert sorted(tuple(r) for r in H.patch(table, edits, order="at").collect()) == [(1, "new", 5.0), (2, "m", 2.0)]
    lines = spark.createDataFrame([(1, "fuzzy", "x", 7)], "item_id long, status string, match_method string, product_id long")
    choices = spark.createDataFrame([(1, 1, 8, False), (2, 1, 9, False)], "at int, item_id long, chosen_id long, confirm_only boolean")
    assert [(r.status, r.product_id, r.corrected) for r in R.apply_choices(lines, choices, "at").collect()] == [("exact", 9, True)]
    new = spark.createDataFrame([(1, 1, "ai_match", 3), (2, 1, "ai_match", 4)], "at int, item_id long, status string, product_id long")
    assert [r.product_id for r in R.apply_rematch(lines, new, "at").collect()] == [4]


def plain_cascade(items, catalog, keep=5):
    """The whole cascade one line at a time, over prepared rows; equal texts are looked up once."""
    from functools import cache

    names = {p["id"]: set(p["norm_name"].split(" ")) for p in catalog}

    @cache
    def best(key, text, score, cutoff, limit):
        found = [(-s, p["id"]) for p in catalog if p[key] and (s := score(text, p[key], cutoff) if score is Y.partial_ratio else score(text, p[key])) and s >= cutoff - 1e-9] if text else []
        return [(i, -s) for s, i in sorted(found)[:limit]]

    @cache
    def contained(text, key):
        """(near enough in length, all) of the products whose key has the text in it, or the other way."""
        every = [p for p in catalog if text and p[key] and (text in p[key] or p[key] in text)]
        return [p["id"] for p in every if min(len(text), len(p[key])) / max(len(text), len(p[key])) >= 0.7], {p["id"] for p in every}

    @cache
    def equal(key, text):
        return min((p["id"] for p in catalog if text and p[key] == text), default=None)

    def like(found, seen, method, rows):
        for i, s in rows:
            if i not in seen:
                found.append((i, s, method))
                seen.add(i)

    def line(r):
        q, bare, name = r["q"], r["q_brandless"], r["q_name"] if len(r["q_name"]) >= 20 else ""
        code = r["q_code"] if sum(c.isdigit() for c in r["q_code"]) == 10 and (q or r["q_name"]) else ""
        for key, text, method in (("norm_art", q, "exact"), ("norm_art", bare, "exact"), ("norm_code", code, "code_exact")):
            if equal(key, text) is not None:
                return [(equal(key, text), 100.0, method)]
        found, seen = [], set()
        for text in (q, bare):
            like(found, seen, "contains", [(i, 95.0) for i in contained(text, "norm_art")[0]])
            like(found, seen, "fuzzy_article", best("norm_art", text, Y.token_sort_ratio, 80, 10))
        like(found, seen, "fuzzy_name_from_article", best("norm_name", q, Y.partial_ratio, 90, 5))
        if found:
            return found
        for text in (r["q_nocyr"], r["q_nocyr_brandless"]):
            if equal("norm_nocyr", text) is not None:
                return [(equal("norm_nocyr", text), 100.0, "exact_nocyr")]
        like(found, seen, "contains_nocyr", [(i, 95.0) for i in contained(r["q_nocyr"], "norm_nocyr")[0]])
        like(found, seen, "fuzzy_nocyr", best("norm_nocyr", r["q_nocyr"], Y.token_sort_ratio, 80, 10))
        if found or not name:
            return found
        if equal("norm_name", name) is not None:
            return [(equal("norm_name", name), 99.0, "name_exact")]
        near, seen = contained(name, "norm_name")
        found, seen = [(i, 93.0, "name_contains") for i in near], set(seen)
        like(found, seen, "name_fuzzy", best("norm_name", name, Y.token_sort_ratio, 93, 10))
        words = set(name.split(" "))
        like(found, seen, "name_partial", [(i, s) for i, s in best("norm_name", name, Y.partial_ratio, 96, 10) if len(words & names[i]) / len(words) >= 0.4])
        return found

    out = {}
    for r in items:
        found = sorted(line(r), key=lambda x: -round(x[1], 9))  # stable: equal scores as they were found
        if found:
            out[r["item_id"]] = found[: 1 if found[0][1] >= 100 else keep]
    return out


def test_whole_cascade_equals_one_line_at_a_time(spark, sf):
    """All lines with their codes; some with Cyrillic before the article, some with a name as article."""
    from matchloom.operators.catalog import active, keyed
    from matchloom.plans.views import Tables

    t = Tables(spark, sf)
    raw = F.when(F.expr("item_id % 11 = 0"), F.concat(F.lit("ЩИТ РАСПРЕДЕЛИТЕЛЬНЫЙ "), "article_raw")).when(F.expr("item_id % 101 = 5"), F.concat(F.expr("substring(name_raw, 3, 30)"), F.lit("q"))).otherwise(F.col("article_raw"))
    lines = t("v_spec_items").withColumn("article_raw", raw)
    items = spark.createDataFrame(lines.collect(), lines.schema)
    cat = spark.createDataFrame(t("v_catalog").collect(), t("v_catalog").schema)
    want = plain_cascade([r.asDict() for r in M.prepared(items).collect()], [r.asDict() for r in keyed(active(cat)).collect()])
    got = {}
    for r in M.cascade(items, cat, nocyr=True).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r.product_id, round(r.score, 6), r.method))
    assert len(got) > 3000 and got == {i: [(p, round(s, 6), m) for p, s, m in x] for i, x in want.items()}
    methods = {m for x in got.values() for _, _, m in x}
    assert methods >= {"exact", "code_exact", "contains", "fuzzy_article", "exact_nocyr", "name_exact"}


def test_similarity_of_the_whole_article_comes_before_containment_of_the_bare_one(spark):
    cat = catalog(spark, [(1, "ABCDEFGHIJK", "n", "", "ss")])
    items = spark.createDataFrame([(1, "ABCDEFGHIJ IEK", "n", "", False, 1.0)], "item_id long, article_raw string, name_raw string, kaznisa_code_raw string, is_heading boolean, qty double")
    (r,) = M.cascade(items, cat).collect()
    assert (r.product_id, r.method) == (1, "fuzzy_article") and 80 <= r.score < 95
