import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from matchloom.llm import simhash_trie as S
from matchloom.llm.components import connected_components


def brute_fingerprint(text):
    words = []
    for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    expected = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", expected[i]) for i in texts}


def test_spark_hash_is_the_same(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b ç")).alias("h")).first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest("a b ç".encode(), 42)


def test_trie_join_finds_all_pairs_and_no_other():
    rng = random.Random(3)
    base = [rng.getrandbits(12) for _ in range(150)]
    rows = sorted({(rng.randrange(4), v) for v in base})
    groups, values = np.array([g for g, _ in rows]), np.array([v for _, v in rows], dtype=np.uint64)
    found = {(int(i), int(j)) for a, b in S.trie_self_join(values, groups, 12) for i, j in zip(a, b)}
    brute = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][0] == rows[j][0] and (rows[i][1] ^ rows[j][1]).bit_count() <= 2}
    assert found == brute


def test_links_with_and_without_splitting_hot_subtrees(spark):
    rng = random.Random(5)
    fps = {}
    for c in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            v = centre
            for k in rng.sample(range(64), rng.randrange(4)):
                v ^= 1 << k
            fps[len(fps)] = v
    expected = brute_components(fps)
    distinct = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in set(fps.values())], "fp long")
    for rows in (20_000, 3):
        edges = S.links(distinct, subtree_rows=rows)
        comp = {r.node & (2**64 - 1): r.component for r in connected_components(edges).collect()}
        for i, v in fps.items():
            for j, w in fps.items():
                assert (expected[i] == expected[j]) == (v == w or (v in comp and comp.get(v) == comp.get(w)))


def test_nulls_empty_repeats_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  \n", "x"), (4, "one two", "y"), (4, "one two", "y"), (None, "One two", None), (9, "a b c d e f", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (None, 4), (9, 9)], key=str)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 9]
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_no_text_is_lost_with_a_repeated_id(spark):
    rows = [(3, "alpha beta gamma delta", 1), (7, "alpha beta gamma delta", 1), (7, "totally other words here now", 1), (8, "one two six", 5), (8, "one two six", 4), (8, "one two six", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text_key int")
    for parts in (1, 3):
        got = sorted(tuple(r) for r in S.drop_near_duplicates(docs.repartition(parts)).collect())
        assert got == [(3, "alpha beta gamma delta", 1), (7, "totally other words here now", 1), (8, "one two six", 4)]


def test_string_ids_and_very_long_texts(spark):
    long = " ".join(f"w{k * 31 % 20011}" for k in range(150_000))
    docs = spark.createDataFrame([("x", long), ("k", long), ("b", "short one here"), (None, None)], "doc_id string, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got["x"] == got["k"] == (f"{brute_fingerprint(long):016x}", "k")
    assert got["b"][1] == "b" and got[None] == ("0" * 16, None)


def test_chain_of_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 101)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
