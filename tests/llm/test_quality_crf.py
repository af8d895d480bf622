import re
from itertools import product

import numpy as np

from matchloom.llm import quality_crf as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_base_counts_of_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = Q.fit_field(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = Q.quality(docs, field).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id for r in rows if r.kept}
    assert {r.doc_id for r in Q.keep_good(docs, field).collect()} == kept
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    failed = {r.doc_id for r in rows if r.base_failed}
    assert len(good & kept) >= 0.97 * len(good - failed)


def test_fit_is_repeatable_and_generalises(spark):
    """Fitted on a sample, judged on the labelled rows that are not in it."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    even, odd = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    field, again = Q.fit_field(docs, even), Q.fit_field(docs, even)
    assert np.array_equal(field.weights, again.weights)
    rows = Q.quality(docs.join(odd, "doc_id"), field).join(odd, "doc_id").collect()
    rows = [r for r in rows if not r.base_failed]
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)


def test_lines_of_one_document_get_both_labels(spark):
    """Line labels, not document labels: a text that is half prose, half boilerplate."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    field = Q.fit_field(docs, labels)
    prose = [r.text for r in docs.join(labels, "doc_id").where("quality = 1 and lang = 'en' and length(text) between 2000 and 3000 and text not like '%|%'").limit(5).collect()]
    junk = "\n".join("$$$ ".join(f"ab{i}{k}" for k in range(12)) + "$$$" for i in range(30))
    for text in prose:
        counts, words, rows = Q.measure(f"{text}\n{junk}", field.common)
        lines = np.cumsum([len(words) - 30, 30])
        y = field.decode(rows)
        assert y[: lines[0]].mean() > 0.5 and not y[lines[0] :].any()
        assert 0.1 < Q.judge(field, f"{text}\n{junk}")[1] < 0.9
    mixed = [0 < r.content_share < 1 for r in Q.quality(docs.where("text like '%\n%'"), field).collect()]
    assert sum(mixed) >= 0.2 * len(mixed)
    assert 0 < field.min_share < 1 and field.moves[0, 0] > field.moves[0, 1] and field.moves[1, 1] > field.moves[1, 0]


def test_line_labels_and_share():
    rng = np.random.default_rng(4)
    clean, bad = np.zeros((40, len(Q.FEATURES))), np.zeros((40, len(Q.FEATURES)))
    clean[:, 0] = bad[:, 0] = 1
    clean[:, 1], bad[:, 3] = 3 + rng.random(40), 2 + rng.random(40)
    clean[7, -1] = 1  # a line that many documents share
    mixed = np.concatenate([bad[:10], clean[:5]])
    got = Q.line_labels([clean, bad, mixed], np.array([True, False, False]))
    assert got[0].sum() == 39 and got[0][7] == 0 and not got[1].any() and got[2].tolist() == [0] * 10 + [1] * 5
    assert Q.least_share(np.array([0.0, 0.1, 0.8, 0.9]), np.array([False, False, True, True])) in np.arange(3, 17) / 20
    assert Q.least_share(np.array([0.5]), np.array([True])) == Q.MIN_CONTENT_SHARE


def test_equal_sequences_go_to_content():
    field = Q.LineField(np.zeros((len(Q.FEATURES), 2)), np.zeros((2, 2)))
    assert field.decode(np.ones((4, len(Q.FEATURES)))).tolist() == [1, 1, 1, 1]


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(0)
    for n in range(1, 8):
        field = Q.LineField(rng.normal(size=(len(Q.FEATURES), 2)), rng.normal(size=(2, 2)))
        rows = rng.normal(size=(n, len(Q.FEATURES)))
        emit = rows @ field.weights
        best = max(product((0, 1), repeat=n), key=lambda y: sum(emit[k, y[k]] for k in range(n)) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
        assert tuple(field.decode(rows)) == best


def test_gradient():
    rng = np.random.default_rng(1)
    field = Q.LineField(rng.normal(size=(len(Q.FEATURES), 2)), rng.normal(size=(2, 2)))
    rows, labels = rng.normal(size=(3, 4, len(Q.FEATURES))), rng.integers(0, 2, (3, 4))
    real = np.arange(4) < np.array([[4], [2], [1]])
    base, dw, dm = field.log_likelihood(rows, labels, real)
    for target, grad in ((field.weights, dw), (field.moves, dm)):
        for at in ((0, 1), (1, 0)):
            target[at] += 1e-6
            up = field.log_likelihood(rows, labels, real)[0]
            target[at] -= 1e-6
            assert abs((up - base) / 1e-6 - grad[at]) < 1e-3


def test_edges(spark):
    long = "\n".join(f"Ln{i} xo{i * 7} ye{i} za{i} vi{i * 3}." for i in range(30_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, "\n \n\t", "x"), (4, long, None), (4, long, None), (None, "a b c " * 40, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    field = Q.LineField.neutral()
    got = Q.quality(docs, field).collect()
    assert sorted(r.kept for r in got) == [False, False, False, False, True, True]
    assert Q.keep_good(docs, field).columns == docs.columns
    assert Q.keep_good(docs, field).count() == 2
    assert Q.quality(docs.limit(0), field).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert np.array_equal(Q.fit_field(docs, empty).weights, field.weights)


def test_fit_reads_all_labelled_documents(spark):
    """More than 1,500 documents of a class, and bad ones that are all longer than 64 KiB:
    the fit equals a plain one over every labelled document."""
    good = [(k, f"The h{k} house by the r{k * 7} river was sold to a f{k * 3} family from the north.\nIt rained on d{k} day.") for k in range(1600)]
    bad = [(5000 + k, "\n".join("$$$ ".join(f"ab{i}x{j}q{k}" for j in range(12)) + "$$$" for i in range(700))) for k in range(3)]
    assert all(len(t) > 64 << 10 for _, t in bad)
    docs = spark.createDataFrame([*good, *bad, (9000, "no label"), (9001, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(9001, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    field = Q.fit_field(docs, labels)
    rows, sides = [Q.measure(t)[2] for _, t in good + bad], np.array([True] * 1600 + [False] * 3)
    flat, lengths, y = np.concatenate(rows), np.array([len(r) for r in rows]), np.concatenate(Q.line_labels(rows, sides))
    plain = Q.LineField.fit(lambda at, chained: at.sums(flat, y, lengths, chained))
    assert np.allclose(field.weights, plain.weights, atol=1e-2) and np.allclose(field.moves, plain.moves, atol=1e-2)
    assert all(not Q.judge(field, t)[2] for _, t in bad) and all(Q.judge(field, t)[2] for _, t in good)


def test_common_lines_and_share_are_of_all_documents(spark):
    """A line that three of 1,400 documents share, wherever their ids hash to; counts of shares add up over parts."""
    lines = Q.measured(spark.createDataFrame([(k, f"only w{k}" + ("\nsubscribe here" if k in (3, 700, 1399) else "")) for k in range(1400)], "doc_id long, text string"))
    assert Q.common_lines(lines, 1400) == {Q.line_key(b"subscribe here")} and not Q.common_lines(lines, 2000)
    rng = np.random.default_rng(2)
    shares, good = rng.random(500), rng.random(500) < 0.7
    assert Q.best_share(Q.share_counts(shares[:200], good[:200]) + Q.share_counts(shares[200:], good[200:])) == Q.least_share(shares, good)


def test_chains_of_any_length_have_the_gradient_of_their_likelihood():
    """One chain of 300 lines, one of a single line, odds beyond the range of exp; curvature is exact for single lines."""
    rng = np.random.default_rng(5)
    f = len(Q.FEATURES)
    rows, labels, lengths = rng.normal(size=(304, f)), rng.integers(0, 2, 304), np.array([300, 1, 3])
    rows[7] *= 1000
    for chained in (True, False):
        field = Q.LineField(rng.normal(size=(f, 1)) * np.array([[-0.5, 0.5]]), rng.normal(size=(2, 2)) * chained)
        base = field.sums(rows, labels, lengths, chained).sum(axis=0)
        for k in range(f + 4 * chained):
            moved = Q.LineField(field.weights.copy(), field.moves.copy())
            if k < f:
                moved.weights[k] += np.array([-0.5, 0.5]) * 1e-6
            else:
                moved.moves.reshape(4)[k - f] += 1e-6
            up = moved.sums(rows, labels, lengths, chained).sum(axis=0)
            assert np.isclose((up[1] - base[1]) / 1e-6, base[2 + k], atol=1e-2, rtol=1e-3)
            if not chained:
                bend = base[6 + f :].reshape(f + 4, f + 4)[k, :f]
                assert np.allclose((base[2 : 2 + f] - up[2 : 2 + f]) / 1e-6, bend, atol=1e-2, rtol=1e-3)
