"""SentencePiece-style encoding with seeded merge-dropout, and lossless decoding.

Texts are cut into units (a run of spaces with the word after it, line breaks
alone); pieces never cross units.  Within a unit, merge candidates are worked off
an agenda in merge order (ties: leftmost).  A candidate is skipped for good with
probability ``alpha``, decided by a keyed hash of the seed, the document's id, the
number of the unit in its text and the candidate's place: so each occurrence of a
word is cut by itself, and the same call gives the same pieces on any cluster.

What does not depend on the dropout is kept: a unit's agenda without a skip is a
fixed run of candidates, and so is what follows a given skip.  These runs form a
tree a unit, grown as occurrences ask for them.  An occurrence draws for the
candidates of a run; at its first skip it goes on in the run below that skip.

Spaces become the space mark; characters without a piece, and the mark itself
where a text has it, become byte pieces: so decoding gives the text back exactly.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.common import map_rows
from matchloom.llm.pieces import MODEL, SPACE, PieceTable, SpanHashes, code_matrix, load

SEED = 42
ALPHA = 0.1
#: Runs that a task remembers before it starts anew, and units that it encodes at once.
REMEMBERED = 250_000
UNITS_AT_ONCE = 1 << 19
#: Runs that are worked out together, and the longest unit among them.
BATCH_UNITS = 20_000
BATCH_CHARS = 32

_UNIT = re.compile(r" +[^ \n]*|[^ \n]+|\n+")
_M1, _M2, _MASK = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1
#: A candidate (place, size) as one number, and what it adds to the hash.
_SIZES = BATCH_CHARS + 1
_ADDS = (np.arange(BATCH_CHARS, dtype=np.uint64)[:, None] * np.uint64(_M1) + np.arange(_SIZES, dtype=np.uint64) * np.uint64(_M2)).ravel()
_LOW = np.uint64(0xFFFFFFFF)


def document_key(seed: int, doc_id) -> int:
    return int.from_bytes(hashlib.blake2b(f"document {doc_id}".encode(), digest_size=8, key=seed.to_bytes(8, "little", signed=True)).digest(), "little")


def unit_key(document: int, number: int) -> int:
    x = (document + number * _M2) & _MASK
    x = (x ^ (x >> 32)) * _M1 & _MASK
    return x ^ (x >> 29)


def _unit_keys(documents: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    x = documents + numbers.astype(np.uint64) * np.uint64(_M2)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_M1)
    return x ^ (x >> np.uint64(29))


class _Grown:
    """A numpy array that grows."""

    def __init__(self, kind):
        self.values, self.n = np.empty(1024, dtype=kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.values):
            self.values = np.concatenate([self.values[: self.n], np.empty(max(self.n, len(more)), self.values.dtype)])
        self.values[self.n : self.n + len(more)] = more
        self.n += len(more)


class Encoder:
    """Encodes texts; keeps the runs of units over the texts of a task."""

    def __init__(self, path: str, alpha: float):
        self.path, self.pieces = path, load(path)
        self.limit = int(alpha * (1 << 32))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # run of a unit without skips; -1: not batched
        self.below: dict[int, int] = {}  # run after a skip, by run and candidate
        self.ids: list[bytes] = []  # packed ids of a unit that has no further skip
        self.units: list[str] = []
        self.start, self.stop = _Grown(np.int64), _Grown(np.int64)  # of a run in ``candidates``
        self.above, self.skip = _Grown(np.int64), _Grown(np.int64)
        self.candidates = _Grown(np.int16)

    def merge(self, unit: str, key: int, offset: int = 0) -> list[str]:
        """The pieces of a unit (space marks in place), before bytes stand in."""
        sym: list[str | None] = list(unit)
        n = len(sym)
        if n == 1:
            return sym
        rank = self.pieces.ranks.get
        agenda = [(r, i, 2) for i in range(n - 1) if (r := rank(unit[i : i + 2])) is not None]
        if not agenda:
            return sym
        heapify(agenda)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        limit = self.limit
        while agenda:
            _, i, size = heappop(agenda)
            j = right[i]
            if sym[i] is None or j >= n or len(sym[i]) + len(sym[j]) != size:
                continue
            h = (key + (offset + i) * _M1 + size * _M2) * _M1 & _MASK
            if (h ^ (h >> 29)) & 0xFFFFFFFF < limit:
                continue
            sym[i] += sym[j]
            sym[j] = None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := rank(sym[i] + sym[k])) is not None:
                    heappush(agenda, (r, i, size + len(sym[k])))
            p = left[i]
            if p >= 0 and (r := rank(sym[p] + sym[i])) is not None:
                heappush(agenda, (r, p, len(sym[p]) + size))
        return [s for s in sym if s is not None]

    def _packed(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for piece in pieces:
            found = self.pieces.ids.get(piece)
            if found is None:
                out += [self.pieces.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
            else:
                out.append(found)
        return np.array(out, dtype="<i4").tobytes()

    def unit(self, unit: str, key: int) -> bytes:
        """Packed ids of one occurrence of a unit, by itself."""
        # A space mark of the text itself must not read as a space: it never merges.
        out, at = [], 0
        for k, part in enumerate(unit.split(SPACE)):
            if k:
                out.append(np.array([self.pieces.byte_ids[b] for b in SPACE.encode()], dtype="<i4").tobytes())
            if part:
                out.append(self._packed(self.merge(part.replace(" ", SPACE), key, at)))
            at += len(part) + 1
        return b"".join(out)

    def _grow(self, units: list[str], above: np.ndarray, skips: np.ndarray) -> None:
        """Add the runs of units after their skips (a row of candidates each, the newest last)."""
        lengths = np.array([len(u) for u in units])
        order = np.argsort(lengths, kind="stable")
        start, size = np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64)
        packed = [b""] * len(units)
        bounds = [0, *np.searchsorted(lengths[order], (9, 17)).tolist(), len(units)]
        for low, high in zip(bounds, bounds[1:]):
            for at in range(low, high, BATCH_UNITS):
                part = order[at : min(at + BATCH_UNITS, high)]
                own = part.tolist()
                codes, size[part], found = self._batch([units[k] for k in own], skips[part])
                start[part] = self.candidates.n + np.cumsum(size[part]) - size[part]
                self.candidates.add(codes)
                for k, ids in zip(own, found):
                    packed[k] = ids
        self.start.add(start)
        self.stop.add(start + size)
        self.above.add(above)
        self.skip.add(skips[:, -1] if skips.shape[1] else np.full(len(units), -1))
        self.ids += packed
        self.units += units

    def _batch(self, units: list[str], skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(candidates after the newest skip, all units' in a row; how many each unit has; its
        packed ids without a further skip).

        A row per unit; the agenda of a row is an array with, for each piece by its
        start, the rank of merging it with the next one.  Each round takes the
        lowest (leftmost) candidate of every row.
        """
        table, ranks, ids = _table(self.path)
        units = [u.replace(" ", SPACE) for u in units]
        n, length = len(units), np.array([len(u) for u in units])
        spans = SpanHashes(code_matrix(units, length), 0)
        depth = int(length.max())
        none = np.iinfo(np.int64).max

        def rank(rows, start, end):
            return ranks[table.find(spans.of(rows, start, end))]

        place = np.arange(depth + 2)
        end = np.where(place[:-1] < length[:, None], place[:-1] + 1, 0)
        left = np.broadcast_to(place - 1, (n, depth + 2)).copy()
        agenda = np.full((n, depth + 1), none, dtype=np.int64)
        row, start = np.nonzero(place[:-1] + 1 < length[:, None])
        agenda[row, start] = rank(row, start, start + 2)
        live, taken = np.arange(n), [(np.empty(0, np.int64), np.empty(0, np.int64))]
        free = np.full(n, not skips.shape[1])  # the newest skip lies behind
        while len(live):
            some = agenda[live]
            i = some.argmin(axis=1)
            go = some[np.arange(len(live)), i] < none
            live, i = live[go], i[go]
            j = end[live, i]
            stop = end[live, j]
            agenda[live, i] = none
            code = i * _SIZES + stop - i
            if skips.shape[1]:
                skip = (skips[live] == code[:, None]).any(axis=1)
                free[live] |= skips[live, -1] == code
            else:
                skip = np.zeros(len(live), dtype=bool)
            rows, i, j, stop, code = live[~skip], i[~skip], j[~skip], stop[~skip], code[~skip]
            taken.append((rows[free[rows]], code[free[rows]]))
            end[rows, i], end[rows, j], agenda[rows, j] = stop, 0, none
            left[rows, stop] = i
            more = stop < length[rows]
            r, a = rows[more], i[more]
            agenda[r, a] = rank(r, a, end[r, stop[more]])
            before = left[rows, i]
            more = before >= 0
            r, a = rows[more], before[more]
            agenda[r, a] = rank(r, a, stop[more])
        row, start = np.nonzero(end)
        stop = end[row, start]
        found = table.find(spans.of(row, start, stop))
        counts = np.bincount(row, minlength=n)
        stops = np.cumsum(counts).tolist()
        packed = ids[found].astype("<i4").tobytes()
        out = [packed[4 * (b - c) : 4 * b] for b, c in zip(stops, counts.tolist())]
        for k in np.unique(row[found < 0]).tolist():  # characters without a piece
            own = slice(stops[k] - int(counts[k]), stops[k])
            out[k] = self._packed([units[k][a:b] for a, b in zip(start[own].tolist(), stop[own].tolist())])
        row, code = (np.concatenate(x) for x in zip(*taken))
        order = np.argsort(row, kind="stable")
        return code[order].astype(np.int16), np.bincount(row, minlength=n), out

    def _runs_below(self, runs: np.ndarray, codes: np.ndarray, depth: int) -> np.ndarray:
        """The run that follows each run's skip; ``depth`` skips lie above all of them."""
        keys, where = np.unique(runs * len(_ADDS) + codes, return_inverse=True)
        found = np.array([self.below.get(k, -1) for k in keys.tolist()], dtype=np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            above, code = np.divmod(keys[new], len(_ADDS))
            skips, at = [code], above
            for _ in range(depth):
                skips.append(self.skip.values[at])
                at = self.above.values[at]
            found[new] = np.arange(len(self.ids), len(self.ids) + len(new))
            self._grow([self.units[k] for k in above.tolist()], above, np.stack(skips[::-1], axis=1))
            self.below.update(zip(keys[new].tolist(), found[new].tolist()))
        return found[where]

    def _some(self, units: list[str], keys: np.ndarray) -> list[bytes]:
        """Packed ids of occurrences of units with their keys."""
        if len(self.ids) > REMEMBERED:
            self._forget()
        # Long units go one by one and are not remembered, so what is held is bounded.
        fresh = [u for u in dict.fromkeys(units) if u not in self.known and not (len(u) > BATCH_CHARS or SPACE in u)]
        if fresh:
            self.known.update(zip(fresh, range(len(self.ids), len(self.ids) + len(fresh))))
            self._grow(fresh, np.full(len(fresh), -1), np.empty((len(fresh), 0), np.int64))
        run = np.fromiter((self.known.get(u, -1) for u in units), np.int64, len(units))
        live, depth = np.flatnonzero(run >= 0), 0
        while len(live):
            own, key = run[live], keys[live]
            at, stop, hits = self.start.values[own], self.stop.values[own], []
            while True:
                go = at < stop
                live, key, at, stop = live[go], key[go], at[go], stop[go]
                if not len(live):
                    break
                code = self.candidates.values[at]
                h = (key + _ADDS[code]) * np.uint64(_M1)
                skip = ((h ^ (h >> np.uint64(29))) & _LOW) < self.limit
                hits.append((live[skip], code[skip]))
                go = ~skip
                live, key, at, stop = live[go], key[go], at[go] + 1, stop[go]
            if not hits:
                break
            live, code = (np.concatenate(x) for x in zip(*hits))
            run[live] = self._runs_below(run[live], code.astype(np.int64), depth)
            depth += 1
        out = list(map(self.ids.__getitem__, run.tolist())) if self.ids else [b""] * len(units)
        for k in np.flatnonzero(run < 0).tolist():
            out[k] = self.unit(units[k], int(keys[k]))
        return out

    def encode(self, text: str, document: int = 0) -> bytes:
        return self.encode_all([text], [document])[0]

    def encode_all(self, texts: list[str], documents: list[int]) -> list[bytes]:
        """Packed ids of texts with the keys of their documents."""
        cut = [_UNIT.findall(t) for t in texts]
        counts = np.array([len(u) for u in cut], dtype=np.int64)
        units = [u for some in cut for u in some]
        stops = np.cumsum(counts)
        numbers = np.arange(len(units)) - np.repeat(stops - counts, counts)
        keys = _unit_keys(np.repeat(np.array(documents, dtype=np.uint64), counts), numbers)
        packed: list[bytes] = []
        for at in range(0, len(units), UNITS_AT_ONCE):
            packed += self._some(units[at : at + UNITS_AT_ONCE], keys[at : at + UNITS_AT_ONCE])
        return [b"".join(packed[b - c : b]) for b, c in zip(stops.tolist(), counts.tolist())]


@lru_cache(maxsize=2)
def _table(path: str):
    """(hash table of the pieces, their merge ranks, their ids); at -1: no merge, no id."""
    pieces = load(path)
    order = list(pieces.ids)
    ranks = np.array([*(pieces.ranks[p] for p in order), np.iinfo(np.int64).max], dtype=np.int64)
    return PieceTable(order), ranks, np.array([*(pieces.ids[p] for p in order), -1], dtype=np.int64)


@lru_cache(maxsize=2)
def _encoder(path: str, alpha: float) -> Encoder:
    """Kept over the tasks of a worker."""
    return Encoder(path, alpha)


def decode_ids(ids: np.ndarray, path: str = MODEL) -> str:
    raw = load(path).raw
    return b"".join([raw[k] for k in ids.tolist()]).decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, seed: int = SEED, alpha: float = ALPHA, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``keep`` columns, pieces: array<int>): one row per input row.

    A null text has null pieces, an empty one none; null ids are one document to the
    keyed hash; rows that repeat an id and a text get the same pieces; a very long
    text is encoded in parts of UNITS_AT_ONCE units; equal ranks merge leftmost first;
    an empty table gives no rows.  Columns of ``docs`` that are not named are left
    out, whatever their names (``keep`` must not name doc_id or pieces).
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c) for c in keep])

    def make():
        encoder = _encoder(path, alpha)

        def run(batch):
            texts = batch.column(1).to_pylist()
            found = encoder.encode_all([t or "" for t in texts], [document_key(seed, i) for i in batch.column(0).to_pylist()])
            packed = [None if t is None else np.frombuffer(p, "<i4") for t, p in zip(texts, found)]
            return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(packed, pa.list_(pa.int32()))], names=["doc_id", *keep, "pieces"])

        return run

    fields = [f for f in chosen.schema.fields if f.name != "text" or "text" in keep]
    return map_rows(chosen, make, T.StructType([*fields, T.StructField("pieces", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """The columns of ``encoded`` with ``text`` in place of ``pieces``; null gives null."""
    at = encoded.columns.index("pieces")
    names = [*(c for c in encoded.columns if c != "pieces"), "text"]

    def run(batches):
        for b in batches:
            texts = [None if x is None else decode_ids(np.array(x, dtype=np.int64), path) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], *b.columns[at + 1 :], pa.array(texts, pa.string())], names=names)

    fields = [f for f in encoded.schema.fields if f.name != "pieces"]
    return encoded.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_pieces, n_byte_pieces, pieces_sha256, decoded_sha256, lossless).

    Encodes and decodes every whole text in one pass; digests are of the packed
    little-endian 32-bit ids and of the decoded UTF-8 text.  A null text counts as
    empty and is lossless; otherwise as in ``encode``.
    """

    def make():
        encoder = _encoder(path, alpha)
        is_byte = np.zeros(len(load(path).raw), dtype=bool)
        is_byte[load(path).byte_ids] = True

        def run(batch):
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for text, packed in zip(texts, encoder.encode_all(texts, [document_key(seed, i) for i in batch.column(0).to_pylist()])):
                ids = np.frombuffer(packed, "<i4")
                back = decode_ids(ids, path)
                rows.append((len(ids), int(is_byte[ids].sum()), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
            kinds = {"n_pieces": pa.int64(), "n_byte_pieces": pa.int64(), "pieces_sha256": pa.string(), "decoded_sha256": pa.string(), "lossless": pa.bool_()}
            return {"doc_id": batch.column(0), **{n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(kinds.items())}}

        return run

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"doc_id {kind}, n_pieces long, n_byte_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean")
