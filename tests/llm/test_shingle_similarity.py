import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom.llm import shingle_similarity as M
from matchloom.llm import simhash_trie


def brute(texts):
    """(similar pairs, smallest id of each component), all pairs compared."""
    sets = {i: set(simhash_trie.shingles(t, 5)) for i, t in texts.items()}
    of, pairs = {i: i for i in texts}, set()
    for i, j in combinations(sorted(texts), 2):
        x, y = sets[i], sets[j]
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 10 * len(x & y) >= 8 * len(x | y):
            pairs.add((i, j))
            a, b = of[i], of[j]
            if a != b:
                of = {k: min(a, b) if v in (a, b) else v for k, v in of.items()}
    return pairs, of


def families():
    """Copies with up to six changed words of 150; a two-bit fingerprint rule misses most."""
    out = {}
    for f in range(30):
        words = [f"f{f}w{k * 7 % 97}x{k}" for k in range(150)]
        for c in range(12):
            out[f * 100 + c] = " ".join(f"c{c}" if k in {(c * 11 + 25 * m) % 150 for m in range(c % 7)} else w for k, w in enumerate(words))
    return out


def components(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.id: r.component_id for r in M.similar_documents(docs).collect()}


def test_recall_against_all_pairs(spark, monkeypatch):
    texts = families()
    pairs, want = brute(texts)
    assert len(pairs) > 300
    for small in (8, 2):  # all pairs of a bucket; leaders first
        monkeypatch.setattr(M, "SMALL_BUCKET", small)
        assert components(spark, texts) == want
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(want.values())


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """A crowd in which a third of all pairs is linked; blocks of buckets, too."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    texts = {}
    for i in range(400):
        changed = set(rng.sample(range(150), rng.randrange(13)))
        texts[i] = " ".join(f"x{rng.randrange(900)}" if k in changed else w for k, w in enumerate(base))
    _, want = brute(texts)
    assert 1 < len(set(want.values())) < 400
    for shingles in (1 << 19, 5000):
        monkeypatch.setattr(M, "BLOCK_SHINGLES", shingles)
        got = components(spark, texts)
        assert sum(got[i] != want[i] for i in texts) == 0


def test_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(5, None), (4, ""), (7, "a b"), (7, "a b"), (None, "c d"), (9, "c d"), (None, "e")], "doc_id long, text string")
    got = sorted(((r.id or 0, r.component_id) for r in M.similar_documents(docs).collect()), key=str)
    assert got == sorted([(5, 4), (4, 4), (7, 7), (7, 7), (0, 9), (9, 9), (0, None)], key=str)
    assert M.drop_similar(docs.limit(0)).count() == 0


def test_string_ids_long_texts_and_lost_rows(spark):
    long = " ".join(f"w{k * 31 % 20011}" for k in range(60_000))
    rows = [("b", long), ("a", long + " end"), ("c", "another text altogether"), ("c", "a second text of the same id")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r.doc_id, r.text[:9]) for r in M.drop_similar(docs).collect())
    assert got == [("a", long[:9]), ("c", "a second "), ("c", "another t")]


def test_trie_self_join_gives_candidates(spark, monkeypatch):
    """Without any band the trie's links alone reach the near copies within its budget, and the
    check on whole sets follows: near fingerprints of sets that are not alike do not link."""
    monkeypatch.setattr(M, "band_keys", lambda values: np.empty(0, dtype=np.uint64))
    monkeypatch.setattr(M, "SMALL_BUCKET", 4)
    base = [f"w{k * 31 % 2003}x{k}" for k in range(2000)]
    texts = {}
    for c in range(12):  # one changed word at the end each
        texts[20 - c] = " ".join([*base, f"end{c}"])
    texts[30] = " ".join(f"v{k}" for k in range(2000))
    _, want = brute(texts)
    fps = {i: simhash_trie.fingerprint_of_hashes(M.shingle_set(t)) for i, t in texts.items()}
    of = {i: i for i in texts}
    for i, j in combinations(sorted(texts), 2):
        if (fps[i] ^ fps[j]).bit_count() <= simhash_trie.BUDGET and of[i] != of[j]:
            a, b = of[i], of[j]
            of = {k: min(a, b) if v in (a, b) else v for k, v in of.items()}
    assert of == want and set(want.values()) == {9, 30}
    assert components(spark, texts) == want

    # All sets in one trie component: those that are not alike stay apart.
    groups = M.with_trie_groups
    monkeypatch.setattr(M, "with_trie_groups", lambda nodes: groups(nodes.withColumn("fp", F.col("size") % 2)))
    small = dict(list(families().items())[:30])
    assert components(spark, small) == brute(small)[1]
