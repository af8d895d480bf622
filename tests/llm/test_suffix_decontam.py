import hashlib
import random
import re

from matchloom.llm import suffix_decontam as S

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = {}
    for name, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    lengths = {len(k) for k in windows}
    out = {}
    for key, text in docs:
        w, hit, names = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[k]
        out[key] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


def rows_of(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_whole_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert rows_of(S.contamination(docs, bench)) == expected
    assert any(v[4] for v in expected.values())
    assert {r.doc_id for r in S.remove_contaminated(docs, bench).collect()} == {k for k, v in expected.items() if not v[4]}
    assert rows_of(S.contamination(docs, bench, block_bytes=3000)) == expected  # several blocks


def test_random_small_vocabulary(spark):
    rng = random.Random(2)
    make = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(["a", "B", "é", "7", "zz"]) for _ in range(n))
    docs = [(i, make(rng.randrange(60))) for i in range(80)] + [(100, None), (101, ""), (102, "...")]
    items = [(i, make(rng.randrange(3, 9))) for i in range(12)] + [(50, "a"), (51, None), (52, "--"), (53, make(30)), (53, make(8))]
    got = rows_of(S.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4))
    assert got == brute(docs, items, 4)


def test_longest_matches(spark):
    docs = spark.createDataFrame([(2, "x a b c d e y"), (1, "q a b c d z"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e f")], "item_id long, text string")
    got = sorted(tuple(r) for r in S.longest_matches(docs, bench, window=3).collect())
    assert got == [("7", 0, 5, 2, 1), ("7", 1, 4, 2, 2), ("7", 2, 3, 2, 3)]


def test_edges(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so ONE two, three!", "c"), (1, "so ONE two, three!", "c"), (None, "one two", None)], "doc_id long, text string, _words string")
    assert S.remove_contaminated(docs, bench).collect() == docs.where("doc_id is null").collect()
    assert S.contamination(docs.limit(0), bench).count() == 0
    assert S.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert [r.n_hit for r in S.contamination(docs, bench).collect()] == [3, 3, 0]


def test_memory_of_a_block():
    """Flat arrays: a block costs a small multiple of its text."""
    import random
    import tracemalloc

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(20_000)]
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(400))) for k in range(900)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    block = S.Block(items)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 12 * size and peak < 40 * size
    assert block.names(0) == ["i0"] and block.spans[0] == 10


def test_very_long_text_and_clashing_columns(spark):
    rng = __import__("random").Random(4)
    words = [f"w{k}" for k in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(200_000))
    items = [("a", " ".join(long.split()[150_000:150_030])), ("a", " ".join(long.split()[150_000:150_030])), ("b", "w1 w2 zz")]
    docs = spark.createDataFrame([(1, long, 5), (2, None, 6), (3, "w1 w2 zz w3", 7)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in S.contamination(docs, bench).collect()}
    assert got[1][0] >= 30 and got[1][2] and got[2] == (0, 0, False) and got[3] == (3, 1, True)
    for block_bytes in (1 << 20, 40):
        left = S.remove_contaminated(docs, bench, block_bytes=block_bytes)
        assert [tuple(r) for r in left.collect()] == [(2, None, 6)]
    assert S.contamination(docs.limit(0), bench).count() == 0
