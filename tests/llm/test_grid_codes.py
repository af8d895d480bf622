import hashlib

import numpy as np
import pytest

from matchloom.llm import grid_codes as G

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """All entries for all parts, in whole numbers of any size."""
    rows = sorted((r for r in rows), key=lambda r: (r[0] is None, r[0] or 0, [float(x) for x in r[1]]))
    v = [[int(np.floor(float(np.float32(x)) * 1024)) for x in r[1]] for r in rows]
    d = len(v[0]) // parts
    cut = [[x[p * d : (p + 1) * d] for x in v] for p in range(parts)]
    books = [[list(x) for x in cut[p][:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in cut[p]:
                groups.setdefault(near(x, books[p])[1], []).append(x)
            for e, own in groups.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    coded = [[near(cut[p][k], books[p]) for p in range(parts)] for k in range(len(rows))]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in c) for c in coded]
    total = {}
    for r, e in zip(rows, errors):
        total[r[2]] = total.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in c), e, total[r[2]], digest) for r, c, e in zip(rows, coded, errors)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], label) for i, v, label in rows], SCHEMA)


def results(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def sample(n, d, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in np.float32(rng.normal(0, spread, d))], int(rng.integers(3)) if rng.random() < 0.8 else None) for i in rng.permutation(n)]


@pytest.mark.parametrize("width", [1, 16, 64, 4096])
def test_equals_all_entries_for_all_parts(spark, width):
    rows = sample(150, 8, width)
    got = results(G.coded_vectors(frame(spark, rows).repartition(3), entries=20, width=width))
    assert got == plain(rows, entries=20)


def test_few_rows_ties_and_repeats(spark):
    rows = [(1, [0.0] * 4, 1), (1, [0.0] * 4, 1), (2, [1.0, 0, 0, 1], None), (None, [0.5, 0.5, 0, 0], None), (3, [0.5, 0, 0, 0.5], 1)] * 2
    assert results(G.coded_vectors(frame(spark, rows))) == plain(rows)
    assert results(G.coded_vectors(frame(spark, rows), entries=1, rounds=2)) == plain(rows, entries=1, rounds=2)


def test_vectors_without_a_code_go(spark):
    rows = [(1, [1.0, 2, 3, 4], 1), (2, None, 1), (3, [1.0, None, 3, 4], 1), (4, [float("nan"), 1, 1, 1], 1), (5, [float("inf"), 1, 1, 1], 1), (6, [], 1), (7, [1.0] * 8, 1), (8, [1.0] * 3, 1)]
    assert results(G.coded_vectors(frame(spark, rows))) == plain(rows[:1])
    assert G.coded_vectors(frame(spark, [])).collect() == []
    assert G.coded_vectors(frame(spark, rows[1:6])).collect() == []


def test_very_large_components(spark):
    rows = [(k, [float(np.float32(x)) for x in (3e5 * k, -1e9, 2e12 + 3e10 * k, k)], k % 2) for k in range(6)]
    got = results(G.coded_vectors(frame(spark, rows), entries=3))
    assert [r[:2] for r in got] == [r[:2] for r in plain(rows, entries=3)] and got[0][4] == plain(rows, entries=3)[0][4]
    beyond = [(1, [3e38, -3e38, 0, 1], 1), (2, [0.0, 0, 0, 1], 1)]
    assert max(r.error for r in G.coded_vectors(frame(spark, beyond), entries=1).collect()) == G.LONG


def test_clashing_columns(spark):
    rows = sample(40, 8, 3)
    df = frame(spark, rows).selectExpr("*", "1 as v", "2 as of", "3 as error", "4 as code")
    assert results(G.coded_vectors(df, entries=9)) == plain(rows, entries=9)


def test_cells_keep_what_can_be_nearest():
    rng = np.random.default_rng(1)
    book = rng.integers(-200, 200, (40, 4))
    points = rng.integers(-260, 260, (3000, 4))
    all_d = ((points[:, None] - book) ** 2).sum(axis=2)
    for width, kept in ((32, 10_000), (32, 5), (7, 100)):
        grid = G.GridCells(book, width, kept)
        for k in range(0, len(points), 500):
            e, d = grid.nearest(points[k : k + 500])
            assert (e == all_d[k : k + 500].argmin(axis=1)).all() and (d == all_d[k : k + 500].min(axis=1)).all()
        assert grid.evaluated < grid.asked / 2


def test_one_label_and_one_vector_for_most_rows(spark):
    rows = [(k, [0.25] * 8, 7) for k in range(400)] + sample(60, 8, 4)
    assert results(G.coded_vectors(frame(spark, rows).repartition(5), entries=16)) == plain(rows, entries=16)
