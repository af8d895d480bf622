"""Similarity joins of short texts: all pairs above a bound, found through indexes.

Texts of catalogs come in families that differ in figures alone.  A family is the text
without its digits, and its length.  What is left out of two texts can agree in at most as many
places as the one with fewer digits has, so a bound of the whole texts bounds their families.

Token-sort scores of at least c need a common subsequence of c/200 of both lengths, so the
families have that many characters in common, counted with repeats.  Every (character,
occurrence) is a token, rarest first; the families' prefixes meet in an equi-join, and lengths,
positions and the whole overlap are checked before any text is compared.  Families of so many
digits that they need share nothing else meet all families of a length in reach.

A partial score bounds the edits of the shorter text against a window of the longer one, so
one of enough equal pieces of its family stays whole (here texts that are half digits or more stand
for themselves); each piece looks for the longer texts by its rarest gram.  Families that
cannot reach the bound against any text, by letters and digits, are not looked for.

Both joins lose nothing.  Families that stay are compared in tasks, in blocks of bounded size
on either side: token-sort scores along tries, partial ones text by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import similarity
from matchloom.operators.stored import stored

#: Texts of the two sides in one block, of partial scores and of tries.
QUERY_BLOCK, KEY_BLOCK = 500, 4000
TRIE_QUERIES, TRIE_KEYS = 20_000, 100_000
#: Queries that go along a trie together.
TOGETHER = 1024
#: Pairs of texts that a task compares, about, and the most tasks.
TASK_PAIRS, MOST_TASKS = 4_000_000, 2_000
#: Up to this length all pieces of a text are listed; in longer ones the shorter text is looked for by so many of its characters.
LISTED, LONG_GRAM = 64, 32
_EPS = 1e-9


def grams(text: Column, size: int = 3) -> Column:
    """Distinct grams of ``size`` characters; a shorter text has none."""
    n = F.length(text)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _by_rarest(s: DataFrame, k: DataFrame, size: int) -> DataFrame:
    """(short, long) of texts of at least ``size`` characters, by the short one's rarest gram (by its count over ``long``)."""
    postings = k.select("long", F.explode(grams(F.col("long"), size)).alias("gram"))
    common = postings.groupBy("gram").count()
    asked = s.select("short", F.explode(grams(F.col("short"), size)).alias("gram")).join(common, "gram", "left")
    rarest = asked.groupBy("short").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "gram")).alias("least")).where("least.n > 0").select("short", F.col("least.gram").alias("gram"))
    return rarest.join(postings, "gram").where(F.contains("long", "short")).select("short", "long")


def near_inside_pairs(short: DataFrame, long: DataFrame, ratio: float) -> DataFrame:
    """``inside_pairs`` whose short text has at least ``ratio`` of the long one's length (0.5 at least).

    A text of n characters has few pieces of such length, so all are listed and joined by
    equality, and a common gram is no common key.  Very long texts are looked for by long grams.
    """
    if ratio < LONG_GRAM / LISTED:
        raise ValueError("the ratio must be 0.5 at least")
    s, k = short.select("short").where("short <> ''").distinct(), long.select("long").where("long <> ''").distinct()
    n = F.length("long")
    least = F.ceil(n * ratio - _EPS).cast("int")
    at = lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.substring(F.col("long"), i, size)))
    listed = k.where(n <= LISTED).select("long", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(least, n), at)))).alias("piece"))
    found = s.where(F.length("short") <= LISTED).withColumn("piece", F.xxhash64("short")).join(listed, "piece").where(F.contains("long", "short")).select("short", "long")
    more = _by_rarest(s.where(F.length("short") >= LONG_GRAM), k.where(n > LISTED), LONG_GRAM)
    return found.unionByName(more.where(F.length("short") >= least))


def inside_pairs(short: DataFrame, long: DataFrame, size: int = 3) -> DataFrame:
    """(short, long): distinct texts of which ``long`` has ``short`` in it.

    Texts of three and more characters are looked for by their rarest 3-gram (by its count over
    ``long``), shorter ones by all places of one or two characters.  With a greater ``size`` texts of so many
    characters are looked for by their rarest gram of that size, which far fewer texts of a large catalog have.
    """
    s, k = short.select("short").where("short <> ''").distinct(), long.select("long").where("long <> ''").distinct()
    n = F.length("short")
    found = _by_rarest(s.where(n >= size), k, size)
    if size > 3:
        found = found.unionByName(_by_rarest(s.where((n >= 3) & (n < size)), k, 3))
    parts = k.select("long", F.explode(F.array_union(grams(F.col("long"), 1), grams(F.col("long"), 2))).alias("short"))
    return found.unionByName(s.where(n < 3).join(parts, "short").select("short", "long"))


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")), " ")


def family(text: Column) -> dict[str, Column]:
    """x: the text without digits; n: its length; dig: its digits."""
    return {"x": F.regexp_replace(text, "[0-9]", ""), "n": F.length(text), "dig": F.regexp_count(text, F.lit("[0-9]"))}


def pattern(text: Column) -> dict[str, Column]:
    """As ``family``, but x is the text itself if half of it are digits; own: whether it is."""
    made = family(text)
    own = 2 * made["dig"] >= made["n"]
    return made | {"x": F.when(own, text).otherwise(made["x"]), "own": own & (made["dig"] > 0)}


_FAMILY = ("x", "n", "dig")


def _bags(families: DataFrame, counts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(families with their (character, occurrence) tokens, rarest first; counts of tokens)."""
    chars = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("x")), lambda i: F.substring(F.col("x"), i, F.lit(1))))
    tokens = F.flatten(F.transform(chars, lambda c: F.transform(F.sequence(F.lit(1), F.length("x") - F.length(F.replace(F.col("x"), c, F.lit("")))), lambda k: F.concat(c, k.cast("string")))))
    each = families.where("x <> ''").select("x", "n", F.explode(tokens).alias("token"))
    counts = each.groupBy("token").count() if counts is None else counts
    ranked = each.join(counts, "token", "left").groupBy("x", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "token"))), lambda t: t["token"]).alias("tokens"))
    return families.join(ranked, ["x", "n"], "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))), counts


def _least_overlap(cutoff: float) -> Column:
    """Tokens that a family shares at least with any partner of enough score; under 1 it may share none."""
    return (F.ceil(F.col("n") * cutoff / (200 - cutoff) - _EPS) - F.col("dig")).cast("int")


def similar_families(queries: DataFrame, keys: DataFrame, cutoff: float) -> DataFrame:
    """(q_x, q_n, k_x, k_n): families whose texts can reach a token-sort score of ``cutoff``."""
    if not 200 / 3 < cutoff <= 100:
        raise ValueError("the bound must be over 66.7 and at most 100")
    k, counts = _bags(keys.select(*_FAMILY).distinct(), None)
    q, _ = _bags(queries.select(*_FAMILY).distinct(), counts)
    marked = lambda families, mark: families.select(*[F.col(c).alias(f"{mark}_{c}") for c in (*_FAMILY, "tokens")], _least_overlap(cutoff).alias(f"{mark}_least"))
    q, k = marked(q, "q"), marked(k, "k")

    def prefix(families: DataFrame, mark: str) -> DataFrame:
        tokens, least = F.col(f"{mark}_tokens"), F.col(f"{mark}_least")
        able = families.where((least >= 1) & (least <= F.size(tokens)))
        return able.select("*", F.posexplode(F.slice(tokens, 1, F.greatest(F.size(tokens) - least + 1, F.lit(1)))).alias(f"{mark}_at", "token"))

    need = F.ceil(cutoff * (F.col("q_n") + F.col("k_n")) / 200 - _EPS) - F.least("q_dig", "k_dig")
    alike = (200 * F.least("q_n", "k_n") >= cutoff * (F.col("q_n") + F.col("k_n")) - _EPS) & (F.size(F.array_intersect("q_tokens", "k_tokens")) >= need)
    both = prefix(q, "q").join(prefix(k, "k"), "token")
    left = lambda m: F.size(f"{m}_tokens") - F.col(f"{m}_at")
    first = ~F.arrays_overlap(F.slice("q_tokens", 1, F.col("q_at")), F.slice("k_tokens", 1, F.col("k_at")))
    named = both.where((F.least(left("q"), left("k")) >= need) & first & alike)
    # Families that may share nothing but digits meet all of a length in reach.
    reach = F.sequence(F.ceil(F.col("q_n") * cutoff / (200 - cutoff) - _EPS).cast("int"), F.floor(F.col("q_n") * (200 - cutoff) / cutoff + _EPS).cast("int"))
    sized = q.withColumn("k_n", F.explode(reach))
    numeric = sized.join(k, "k_n").where(((F.col("q_least") < 1) | (F.col("k_least") < 1)) & alike)
    columns = ["q_x", "q_n", "k_x", "k_n"]
    return named.select(columns).unionByName(numeric.select(columns))


def _members(texts: DataFrame, size: int, mark: str, by: tuple[str, ...], *fields: str) -> DataFrame:
    """Rows of each group ``by`` in hashed blocks of about ``size``: (by..., mark_b, mark_rows, mark_m)."""
    counts = texts.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("_n"))
    dealt = texts.join(counts, list(by)).withColumn(f"{mark}_b", F.pmod(F.xxhash64(fields[0]), F.col("_n")))
    return dealt.groupBy(*by, f"{mark}_b").agg(F.collect_list(F.struct(*fields)).alias(f"{mark}_rows"), F.count("*").alias(f"{mark}_m"))


def _gathered(pairs: DataFrame, blocks: DataFrame, by: list[str], of: list[str], mark: str, size: int) -> DataFrame:
    """(of..., mark_rows, mark_m): the blocks that each ``of`` meets, put together up to about ``size`` rows."""
    met = pairs.join(blocks, by)
    total = met.groupBy(*of).agg(F.ceil(F.sum(f"{mark}_m") / size).alias("_n"))
    chunk = F.pmod(F.xxhash64(*by, f"{mark}_b"), F.col("_n"))
    return met.join(total, of).groupBy(*of, chunk.alias("_chunk")).agg(F.flatten(F.collect_list(f"{mark}_rows")).alias(f"{mark}_rows"), F.sum(f"{mark}_m").alias(f"{mark}_m"))


def _dealt(work: DataFrame) -> DataFrame:
    """Rows of (q_rows, q_m, k_rows, k_m) over tasks by the number of their pairs of texts."""
    work = stored(work.select("q_rows", "k_rows", (F.col("q_m") * F.col("k_m")).alias("work")), "similar-blocks")
    total, rows = work.agg(F.sum("work"), F.count("*")).first()
    least = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return work.repartition(max(least, min(MOST_TASKS, rows, int((total or 0) // TASK_PAIRS) + 1))).select("q_rows", "k_rows")


_SCORED = "query string, product_id long, score double"


def _best(found: dict[str, list], limit: int) -> pd.DataFrame:
    rows = [(q, i, -s) for q, own in found.items() for s, i in sorted(own)[:limit]]
    return pd.DataFrame(rows, columns=["query", "product_id", "score"])


def _sorted_scores(batches, cutoff: float, limit: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for queries, keys in zip(pdf["q_rows"], pdf["k_rows"]):
            each = np.array([len(r["ids"]) for r in keys], dtype=np.int64)
            ids, first = np.concatenate([r["ids"] for r in keys]), np.cumsum(each) - each
            tries = similarity.SortedTries([r["s"] for r in keys], each.tolist())
            texts, names = [r["s"] for r in queries], np.array([r["query"] for r in queries], dtype=object)
            for k in range(0, len(texts), TOGETHER):
                q, at, scores = tries.search(texts[k : k + TOGETHER], cutoff, limit)
                n = each[at]
                q, scores = np.repeat(q, n), np.repeat(scores, n)
                product = ids[np.arange(len(q)) + np.repeat(first[at] - np.cumsum(n) + n, n)]
                order = np.lexsort((product, -scores, q))
                q, scores, product = q[order], scores[order], product[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < limit
                yield pd.DataFrame({"query": names[k + q[keep]], "product_id": product[keep], "score": scores[keep]})


def _partial_scores(batches, cutoff: float, limit: int) -> Iterator[pd.DataFrame]:
    """The shorter texts of a block are the patterns, be they queries or keys."""
    for pdf in batches:
        for queries, keys in zip(pdf["q_rows"], pdf["k_rows"]):
            names, ids = [r["key"] for r in keys], [r["ids"].tolist() for r in keys]
            texts = [r["query"] for r in queries]
            found: dict[str, list] = {}
            if len(texts[0]) <= len(names[0]):
                windows = similarity.Windows(names)
                for q in texts:
                    at, scores = windows.search(q, cutoff)
                    found[q] = [(-s, i) for k, s in zip(at.tolist(), scores.tolist()) for i in ids[k]]
            else:
                windows = similarity.Windows(texts)
                for k, name in enumerate(names):
                    at, scores = windows.search(name, cutoff)
                    for j, s in zip(at.tolist(), scores.tolist()):
                        found.setdefault(texts[j], []).extend((-s, i) for i in ids[k])
            yield _best(found, limit)


def _top(found: DataFrame, limit: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), "product_id")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= limit).drop("r")


def _least_ids(keys: DataFrame, text: str, limit: int) -> DataFrame:
    """(text, ids): the ``limit`` smallest product ids of each text."""
    place = Window.partitionBy(text).orderBy("product_id")
    return keys.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= limit).groupBy(text).agg(F.collect_list("product_id").alias("ids"))


def token_sort_join(queries: DataFrame, keys: DataFrame, cutoff: float, limit: int, q_block: int = TRIE_QUERIES, k_block: int = TRIE_KEYS) -> DataFrame:
    """(query, product_id, score): the ``limit`` best products of each distinct query by token-sort
    score; ties go to the smaller id.  ``keys`` is (product_id, key); empty texts are left out."""
    s = keys.where("key is not null").select("product_id", sorted_tokens(F.col("key")).alias("s")).where("s <> ''")
    k = stored(_least_ids(s, "s", limit).withColumns(family(F.col("s"))), "similar-keys")
    q = stored(queries.select("query").where("query <> ''").distinct().withColumn("s", sorted_tokens(F.col("query"))).where("s <> ''").withColumns(family(F.col("s"))), "similar-queries")
    pairs = similar_families(q, k, cutoff)
    k_blocks = _members(k, k_block, "k", ("x", "n"), "s", "ids").withColumnsRenamed({"x": "k_x", "n": "k_n"})
    q_blocks = _members(q, q_block, "q", ("x", "n"), "s", "query").withColumnsRenamed({"x": "q_x", "n": "q_n"})
    met = _gathered(stored(pairs, "similar-pairs"), k_blocks, ["k_x", "k_n"], ["q_x", "q_n"], "k", k_block)
    work = _dealt(met.join(q_blocks, ["q_x", "q_n"]))
    return _top(work.mapInPandas(lambda it: _sorted_scores(it, cutoff, limit), _SCORED), limit)


def _pieces(cutoff: float) -> Column:
    """Pieces of a family's text, of which one is whole in any window of enough score."""
    n = (F.floor((1 - cutoff / 100) * 2 * F.col("n") + _EPS) + 1).cast("int")
    size = F.greatest((F.length("x") / n).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(F.col("x"), k * size + 1, F.when(k == n - 1, F.length("x")).otherwise(size)))


def windowed_texts(patterns: DataFrame, texts: DataFrame, cutoff: float, equal: bool) -> DataFrame:
    """(x, n, text): texts that are longer than a family's (or as long, with ``equal``) and have one of its pieces.

    A window has no more letters and digits in common with a pattern than either has, which
    leaves out texts, and families against the longest text and the most digits of any.
    """
    if not 75 <= cutoff <= 100:
        raise ValueError("the bound must be from 75 to 100")
    need = F.ceil(F.col("n") * cutoff / (200 - cutoff) - _EPS)
    sized = texts.select("text", F.length("text").alias("t_n"), F.regexp_count("text", F.lit("[0-9]")).alias("t_dig"))
    longest, digits, letters = sized.agg(F.max("t_n"), F.max("t_dig"), F.max(F.col("t_n") - F.col("t_dig"))).first()
    able = F.least(F.col("n") - F.col("dig"), F.lit(letters or 0)) + F.least("dig", F.lit(digits or 0)) >= need
    able = patterns.select(*_FAMILY, "own").distinct().where((F.col("n") <= (longest or 0)) & able)
    shortest = able.agg(F.min("n")).first()[0]
    if shortest is None:
        return able.select("x", "n", F.lit("").alias("text"))  # of no families
    sized = sized.where(F.col("t_n") >= shortest)
    pieces = able.select("x", "n", "dig", "own", F.explode(F.array_distinct(_pieces(cutoff))).alias("short"))
    shared = F.least(F.col("n") - F.col("dig"), F.col("t_n") - F.col("t_dig")) + F.least("dig", "t_dig")
    out = None
    for own, long in ((False, F.regexp_replace("text", "[0-9]", "")), (True, F.col("text"))):
        mine, whole = pieces.where(F.col("own") == own), sized.withColumn("long", long)
        found = mine.join(inside_pairs(mine, whole), "short").join(whole, "long")
        found = found.where((F.col("t_n") >= F.col("n") if equal else F.col("t_n") > F.col("n")) & (shared >= need)).select("x", "n", "text").distinct()
        out = found if out is None else out.unionByName(found)
    return out


def partial_join(queries: DataFrame, keys: DataFrame, cutoff: float, limit: int, q_block: int = QUERY_BLOCK, k_block: int = KEY_BLOCK) -> DataFrame:
    """As ``token_sort_join`` by partial score."""
    k = stored(_least_ids(keys.where("key <> ''"), "key", limit).withColumns(pattern(F.col("key"))), "similar-keys")
    q = stored(queries.select("query").where("query <> ''").distinct().withColumns(pattern(F.col("query"))), "similar-queries")
    # Queries as patterns: their families meet keys.
    key_rows = k.select(F.col("key").alias("text"), F.array(F.struct("key", "ids")).alias("k_rows"), F.lit(1).alias("k_m"), F.lit(0).alias("k_b"))
    met = _gathered(windowed_texts(q, k.select(F.col("key").alias("text")), cutoff, True), key_rows, ["text"], ["x", "n"], "k", k_block)
    first = met.join(_members(q, q_block, "q", ("x", "n"), "query"), ["x", "n"])
    # Keys as patterns: their families meet queries.
    query_rows = q.select(F.col("query").alias("text"), F.array(F.struct("query")).alias("q_rows"), F.lit(1).alias("q_m"), F.lit(0).alias("q_b"))
    met = _gathered(windowed_texts(k, q.select(F.col("query").alias("text")), cutoff, False), query_rows, ["text"], ["x", "n"], "q", k_block)
    second = met.join(_members(k, q_block, "k", ("x", "n"), "key", "ids"), ["x", "n"])
    columns = ["q_rows", "q_m", "k_rows", "k_m"]
    work = _dealt(first.select(columns).unionByName(second.select(columns)))
    return _top(work.mapInPandas(lambda it: _partial_scores(it, cutoff, limit), _SCORED), limit)
