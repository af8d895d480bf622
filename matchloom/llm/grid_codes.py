"""Vector codes of a product codebook, nearest entries by memoised grid cells.

Vectors become integers, are cut into parts, and every part is named by the nearest of
its codebook's entries.  Each part lies in a cell of a coarse grid.  What is known of a
cell is kept: the entries that no other entry dominates over the whole cell.  An entry
is dominated if its least distance to the cell's box exceeds the greatest distance of
another one, for then it is nearest to no point of the box.  Only the entries left are
evaluated, exactly.

A pass over the table is one task-local map; tasks pass on one sum for each entry, so
what is shuffled and what comes to the driver is bounded by the codebook.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import materialize

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Width of a grid cell in the integers' unit (1,024 a unit of the vectors).
CELL_WIDTH = 16
#: Cells that a task remembers at most for a part; beyond that it begins anew, which changes no result.
CELLS_KEPT = 20_000
#: Rows that one numpy pass works on, and integers of a temporary array at most.
ROWS, SCRATCH = 2048, 4 << 20
#: Below this absolute value distances of parts of up to 2^6 components stay in 64 bits.
SMALL = 1 << 27
#: Below this one sums of squares of up to 2^8 doubled components are whole numbers of a double.
CENTRED = 1 << 20
#: Components beyond are held at this value, errors at the greatest long.
LARGEST = 1 << 62
LONG = (1 << 63) - 1


def _integers(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.floor(values.astype(np.float64) * 1024.0)
    big = np.abs(x) >= LARGEST
    return np.where(big, np.where(x > 0, LARGEST, -LARGEST), np.where(big, 0, x).astype(np.int64))


class GridCells:
    """The undominated entries of the cells of one part's codebook (entries x components)."""

    def __init__(self, book: np.ndarray, width: int = CELL_WIDTH, kept: int = CELLS_KEPT):
        self.book, self.width, self.kept = book, width, kept
        self.memo: dict[bytes, np.ndarray] = {}
        self.asked = self.evaluated = 0
        self.doubled = 2.0 * book if book.size and np.abs(book).max() < CENTRED else None
        self.squares = (self.doubled * self.doubled).sum(axis=1) if self.doubled is not None else None

    def _near_centre(self, low: np.ndarray) -> np.ndarray:
        """cells x entries: those that the ball round the box leaves.  An entry farther from the centre than
        the nearest one by the ball's diameter is dominated; a matrix product tells, exact in this range."""
        if self.doubled is None or np.abs(low).max(initial=0) >= CENTRED:
            return np.ones((len(low), len(self.book)), dtype=bool)
        centre = 2.0 * low + (self.width - 1)
        square = (centre * centre).sum(axis=1)[:, None] + self.squares - 2 * (centre @ self.doubled.T)
        distance = np.sqrt(np.maximum(square, 0)) / 2
        return distance <= distance.min(axis=1, keepdims=True) + (self.width - 1) * np.sqrt(self.book.shape[1]) + 1e-3

    def _undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries that can be nearest to an integer point of its box."""
        out: list[np.ndarray] = []
        size = max(1, SCRATCH // max(1, self.book.size))
        for k in range(0, len(cells), size):
            lows = cells[k : k + size] * self.width
            cell, entry = np.nonzero(self._near_centre(lows))
            low, e = lows[cell], self.book[entry]
            above, below = low - e, e - (low + self.width - 1)
            least, most = np.maximum(np.maximum(above, below), 0), np.maximum(np.abs(above), np.abs(below))
            near, far = (least * least).sum(axis=1), (most * most).sum(axis=1)
            bound = np.minimum.reduceat(far, np.searchsorted(cell, np.arange(len(lows))))
            keep = near <= bound[cell]
            out += np.split(entry[keep], np.cumsum(np.bincount(cell[keep], minlength=len(lows)))[:-1])
        return out

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each point (int64, small values); ties go to the lower entry."""
        if not len(points):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        cells, which = np.unique(points // self.width, axis=0, return_inverse=True)
        which = which.reshape(-1)
        keys = [c.tobytes() for c in np.ascontiguousarray(cells)]
        new = [k for k, key in enumerate(keys) if key not in self.memo]
        if len(self.memo) + len(new) > self.kept:
            self.memo.clear()
            new = list(range(len(keys)))
        self.memo.update(zip([keys[k] for k in new], self._undominated(cells[new])))
        lists = [self.memo[key] for key in keys]
        counts = np.array([len(x) for x in lists])
        flat, starts = np.concatenate(lists), np.concatenate([[0], np.cumsum(counts)])
        entry, error = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
        self.asked += len(points) * len(self.book)
        limit = max(1, SCRATCH // max(1, self.book.size))
        for k in range(0, len(points), limit):
            mine = which[k : k + limit]
            n = counts[mine]
            begin = np.concatenate([[0], np.cumsum(n)])
            pick = flat[np.arange(begin[-1]) - np.repeat(begin[:-1] - starts[mine], n)]
            gap = np.repeat(points[k : k + limit], n, axis=0) - self.book[pick]
            distance = (gap * gap).sum(axis=1)
            self.evaluated += len(distance)
            least = np.minimum.reduceat(distance, begin[:-1])
            hit = np.flatnonzero(distance == np.repeat(least, n))
            row = np.searchsorted(begin, hit, side="right") - 1
            first = np.unique(row, return_index=True)[1]
            entry[k : k + limit], error[k : k + limit] = pick[hit[first]], least
        return entry, error


def _nearest_large(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``GridCells.nearest`` in whole numbers of any size, entry by entry."""
    entries, errors = [], []
    b = book.astype(object)
    for p in points.astype(object):
        d = [int(sum((p - e) ** 2)) for e in b]
        k = min(range(len(d)), key=lambda i: (d[i], i))
        entries.append(k)
        errors.append(d[k])
    return np.array(entries, dtype=np.int64), np.array(errors, dtype=object)


class Coder:
    def __init__(self, books: np.ndarray, width: int = CELL_WIDTH):
        self.books = books
        self.small = not books.size or int(np.abs(books).max()) < SMALL
        self.grids = [GridCells(b, width) for b in books]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, squared distances), rows x parts, of integer vectors."""
        parts, _, d = self.books.shape
        entry = np.empty((len(vectors), parts), np.int64)
        error = np.empty((len(vectors), parts), object)
        fits = np.abs(vectors).max(axis=1, initial=0) < SMALL if self.small and d <= 64 else np.zeros(len(vectors), bool)
        for p, grid in enumerate(self.grids):
            own = vectors[:, p * d : (p + 1) * d]
            entry[fits, p], error[fits, p] = grid.nearest(own[fits])
            entry[~fits, p], error[~fits, p] = _nearest_large(own[~fits], self.books[p])
        return entry, error


def _blocks(batches, column: int):
    """Batches in pieces of ROWS, with their integer vectors."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            piece = batch.slice(k, ROWS)
            lists = piece.column(column)
            yield piece, _integers(lists.flatten().to_numpy(zero_copy_only=False)).reshape(piece.num_rows, -1)


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, parts: int) -> DataFrame:
    """(vec_id, v, label): the vectors that have a code.

    Null vectors and those with a null or non-finite component go; so do those without
    components, of a length that ``parts`` does not divide, and of another length than
    the vector of the smallest id.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(vector_col).cast("array<double>")
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v"), label.alias("label"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & F.forall("v", finite))
    first = rows.orderBy(*_by_id()).limit(1).select(F.size("v")).collect()
    return rows.where(F.size("v") == first[0][0]) if first else rows


def _by_id() -> list[Column]:
    return [F.col("vec_id").asc_nulls_last(), F.col("v")]


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Parts x entries x components: those of the smallest ids (ties: the smaller vector)."""
    found = [r["v"] for r in rows.orderBy(*_by_id()).limit(entries).select("v").collect()]
    if not found:
        return np.zeros((parts, 0, 0), np.int64)
    return np.ascontiguousarray(_integers(np.array(found, dtype=np.float64)).reshape(len(found), parts, -1).swapaxes(0, 1))


def moved_books(rows: DataFrame, books: np.ndarray, width: int = CELL_WIDTH) -> np.ndarray:
    """One round: every entry becomes the floor of the mean of its parts; an unused one stays."""
    parts, k, d = books.shape

    def run(batches):
        coder, count = Coder(books, width), np.zeros((parts, k), np.int64)
        high, low = np.zeros((parts, k, d), np.int64), np.zeros((parts, k, d), np.int64)
        for _, v in _blocks(batches, 0):
            entry, _ = coder.nearest(v)
            for p in range(parts):
                own = v[:, p * d : (p + 1) * d]
                np.add.at(count[p], entry[:, p], 1)
                np.add.at(high[p], entry[:, p], own >> 31)
                np.add.at(low[p], entry[:, p], own & 0x7FFFFFFF)
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_pydict({
                "part": np.repeat(p, d), "entry": np.repeat(e, d), "place": np.tile(np.arange(d), len(p)),
                "n": np.repeat(count[p, e], d), "high": high[p, e].reshape(-1), "low": low[p, e].reshape(-1),
            })

    sums = rows.select("v").mapInArrow(run, "part long, entry long, place long, n long, high long, low long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out = books.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), whole("high"), whole("low")).collect():
        out[r["part"], r["entry"], r["place"]] = ((int(r["high"]) << 31) + int(r["low"])) // r["n"]
    return out


def fit_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, width: int = CELL_WIDTH) -> np.ndarray:
    """Codebooks over all of ``rows``, which is read once a round."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = moved_books(rows, books, width)
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray, width: int = CELL_WIDTH) -> DataFrame:
    """(vec_id, label, code, error) of each of ``kept_vectors``."""

    def run(batches):
        coder = Coder(books, width)
        for piece, v in _blocks(batches, 1):
            entry, error = coder.nearest(v)
            yield pa.RecordBatch.from_arrays([
                piece.column(0), piece.column(2), pa.array(["".join(f"{e:02x}" for e in row) for row in entry.tolist()], pa.string()),
                pa.array([min(int(sum(row)), LONG) for row in error.tolist()], pa.int64()),
            ], names=["vec_id", "label", "code", "error"])

    kind = dict(rows.dtypes)
    return rows.select("vec_id", "v", "label").mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")


def coded_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, width: int = CELL_WIDTH) -> DataFrame:
    """One row per kept vector: code, its error, the error summed over its label, the codebooks' digest.

    ``kept_vectors`` says which rows have a code; the others are not in the result.  Rows
    that repeat an id or a vector are rows of their own; null ids sort last, null labels
    are one label.  Equal distances go to the lower entry.  Fewer rows than entries make
    a smaller codebook.  An empty table, or one without a kept vector, gives no rows.
    Components beyond 2^62 are held there and errors at the greatest long.  Further columns are ignored.
    """
    rows = kept_vectors(vectors, id_col, vector_col, label_col, parts)
    books = fit_books(rows, parts, entries, rounds, width)
    coded = materialize(encode(rows, books, width), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The result in DuckDB SQL, every part against every entry in each round."""
    near = "SELECT i, p, min({{'d': list_sum(list_transform(list_zip(a, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS m, any_value(a) AS a FROM parts JOIN b{k} USING (p) GROUP BY i, p"
    ctes = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS i, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT i, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS a FROM kept, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, i - 1 AS e, a AS c FROM parts WHERE i <= {entries})",
    ]
    for k in range(rounds):
        ctes.append(f"n{k} AS MATERIALIZED ({near.format(k=k)})")
        ctes.append(f"s{k} AS (SELECT p, m.e AS e, j, sum(a[j])::HUGEINT AS s, count(*) AS n FROM n{k}, range(1, (SELECT max(len(a)) FROM parts) + 1) t(j) GROUP BY ALL)")
        ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(x.c, b{k}.c) AS c FROM b{k} LEFT JOIN (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM s{k} GROUP BY p, e) x USING (p, e))")
    return f"""
    WITH {', '.join(ctes)},
    last AS MATERIALIZED ({near.format(k=rounds)}),
    coded AS (SELECT i, string_agg(lower(lpad(to_hex(m.e), 2, '0')), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM last GROUP BY i),
    sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (i) GROUP BY label)
    SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
    FROM coded JOIN kept USING (i) JOIN sums ON kept.label IS NOT DISTINCT FROM sums.label
    """
