import random

from matchloom.llm import trie_token_counts as C
from matchloom.llm.pieces import SPACE


def test_trie_equals_word_by_word():
    rng, model = random.Random(6), C.unigram()
    words = {SPACE + "".join(rng.choice("theioanrsé日xK😀") for _ in range(rng.randrange(0, 60))) for _ in range(3000)} | {SPACE, SPACE + "the", SPACE + "there"}
    words = list(words)
    assert C.trie_counts(words, model).tolist() == [C.count_one(w, model) for w in words]


def test_best_segmentation_by_enumeration():
    model = C.unigram()

    def ways(word):
        if not word:
            yield 0.0, 0
        for k in range(1, len(word) + 1):
            s, t = model.scores.get(word[:k]), 1
            if s is None and k == 1:
                t = len(word[0].encode())
                s = t * model.byte_score
            if s is not None:
                for more, n in ways(word[k:]):
                    yield s + more, t + n

    for word in ("▁the", "▁other", "▁haonéx", "▁日x"):
        best = max(s for s, _ in ways(word))
        assert C.count_one(word, model) in {n for s, n in ways(word) if abs(s - best) < 1e-9}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, known = C.unigram(), {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = C.token_counts(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = [w.decode() for w in texts[r.doc_id].encode().split()]
        for w in set(words) - known.keys():
            known[w] = C.count_one(SPACE + w, model)
        assert (r.n_words, r.n_distinct, r.n_tokens) == (len(words), len(set(words)), sum(known[w] for w in words))


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \n", 1), (None, "a b", 1), (4, "x" * 100_000, 1), (4, "x" * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in C.token_counts(docs).collect()}
    assert got[1] == got[2] == got[3] == 0 and got[None] == 2 and got[4] > 0
    assert C.token_counts(docs).count() == 6 and C.token_counts(docs.limit(0)).count() == 0


def test_long_words_are_scored_each_time(spark):
    rows = [(k, f"short {'y' * (100 + k % 3)} short") for k in range(30)]
    model = C.unigram()
    for r in C.token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        assert r.n_tokens == 2 * C.count_one(SPACE + "short", model) + C.count_one(SPACE + "y" * (100 + r.doc_id % 3), model)
