"""Benchmark decontamination with suffix arrays over the training texts.

The training table is cut into shards (what a task holds at a time).  Each shard
gets a suffix array over its words, every suffix of every benchmark item is
binary-searched in it, and the intervals give verbatim matches: those of at
least a window mark hit words, and the longest can be reported with locations.
Documents with hits are then removed.

Words that no item has cannot be part of a match, so a shard keeps only its runs
of item words that are long enough for the shortest window, with a separator
between runs.  That drops no match.  The benchmark is the stated query set: it is
held in blocks of bounded size, and each block is searched in all shards.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.common import map_rows, materialize, slices

WINDOW_WORDS = 10
#: UTF-8 bytes of benchmark text that a task holds at a time.
BLOCK_BYTES = 8 << 20

# A-Z become a-z; digits, a-z and all bytes of other letters stay; the rest separates.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def window_ids(tokens: np.ndarray, words: int) -> np.ndarray:
    """For each place an id of the ``words`` tokens from there: equal ids for equal windows."""

    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])[: len(x)]

    whole, size, out, done = tokens.astype(np.int64), 1, None, 0
    while size <= words:
        if words & size:
            out, done = whole if out is None else _paired(out, ahead(whole, done)), done + size
        whole, size = _paired(whole, ahead(whole, size)) if size * 2 <= words else whole, size * 2
    return out


class Block:
    """The suffixes of some benchmark items over their own vocabulary (ids from 1).

    All arrays are flat, with one entry a word of the items or less: a suffix is
    known by its place in ``tokens``.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW_WORDS):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str] = []
        tokens, sizes = [], []
        for name, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], dtype=np.int32)
            if len(ids):
                tokens.append(ids)
                sizes.append(len(ids))
                self.items.append(name)
        self.tokens = np.concatenate(tokens) if tokens else np.empty(0, np.int32)
        size = np.array(sizes, np.int64)
        self.starts = np.arange(len(self.tokens))
        self.item = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.begins = np.cumsum(size) - size
        self.lengths = (self.begins + size)[self.item] - self.starts
        #: Window length of a suffix that is the first to begin with that window, else 0.
        self.spans = np.zeros(len(self.tokens), np.int64)
        own = np.minimum(size, window)[self.item] if len(size) else np.empty(0, np.int64)
        owners, first = [], []
        for w in np.unique(own).tolist():
            at = np.flatnonzero((own == w) & (self.lengths >= w))
            kinds, where, ids = np.unique(window_ids(self.tokens, w)[at], return_index=True, return_inverse=True)
            self.spans[at[where]] = w
            pairs = np.unique(ids * len(size) + self.item[at])
            first.append(at[where][pairs // len(size)])
            owners.append((pairs % len(size)).astype(np.int32))
        first_, owner = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (first, owners))
        order = np.argsort(first_, kind="stable")
        #: The items of a window, by its first suffix: ``owners[cuts[q] : cuts[q + 1]]``.
        self.owners = owner[order]
        self.cuts = np.searchsorted(first_[order], np.arange(len(self.tokens) + 1))
        self.shortest = int(self.spans[self.spans > 0].min()) if tokens else 0
        self.longest = int(self.lengths.max()) if tokens else 0

    def names(self, q: int) -> list[str]:
        """Items with the window that suffix ``q`` is the first to begin with."""
        return [self.items[k] for k in self.owners[self.cuts[q] : self.cuts[q + 1]].tolist()]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the words that follow, by prefix doubling to ``depth`` words."""
    rank, k = text.astype(np.int64), 1
    while True:
        order = np.argsort(rank, kind="stable")
        if k >= depth:
            return order
        later = np.concatenate([rank[k:], np.zeros(min(k, len(rank)), np.int64)])[: len(rank)]
        _, rank = np.unique(rank * (int(rank.max()) + 1) + later, return_inverse=True)
        k *= 2
        if int(rank.max()) == len(rank) - 1:
            return np.argsort(rank, kind="stable")


def search(text: np.ndarray, order: np.ndarray, block: Block):
    """(longest, low, high, wlow, whigh): for every suffix of the block the length of its
    longest match, the interval of ``order`` that has it, and the interval of its window."""
    n = len(block.starts)
    longest = np.zeros(n, np.int64)
    low, high = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    wlow, whigh = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_ = np.arange(n)
    padded = np.concatenate([text, np.zeros(block.longest + 1, text.dtype)])
    depth = 0
    while len(open_):
        want = block.tokens[block.starts[open_] + depth]

        def bound(strict: bool, want=want, open_=open_):
            a, b = low[open_].copy(), high[open_].copy()
            while (go := a < b).any():
                mid = (a + b) >> 1
                seen = padded[order[np.minimum(mid, len(order) - 1)] + depth]
                right = go & ((seen <= want) if strict else (seen < want))
                a = np.where(right, mid + 1, a)
                b = np.where(go & ~right, mid, b)
            return a

        a, b = bound(False), bound(True)
        hit = a < b
        open_ = open_[hit]
        low[open_], high[open_] = a[hit], b[hit]
        depth += 1
        longest[open_] = depth
        whole = block.spans[open_] == depth
        wlow[open_[whole]], whigh[open_[whole]] = a[hit][whole], b[hit][whole]
        open_ = open_[block.lengths[open_] > depth]
    return longest, low, high, wlow, whigh


class Shard:
    """Suffix array of some texts, restricted to what items of a block can match."""

    def __init__(self, texts: list[str | None], block: Block):
        words = [words_of(t) for t in texts]
        get = block.vocabulary.get
        self.counts = np.array([len(w) for w in words], np.int64)
        parts = [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)) for w in words]
        zero = np.zeros(1, np.int32)
        stream = np.concatenate([x for p in parts for x in (p, zero)] or [zero])
        #: Where each text begins in the stream; a separator follows each text.
        self.begins = np.cumsum(self.counts + 1) - (self.counts + 1)
        self.size = len(stream)
        known = np.concatenate([[False], stream > 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= max(block.shortest, 1)
        starts, ends = starts[long], ends[long]
        lengths = ends - starts + 1  # with the separator
        offset = np.cumsum(lengths) - lengths
        self.place = np.repeat(starts - offset, lengths) + np.arange(int(lengths.sum()))
        self.text = stream[self.place] if len(starts) else np.empty(0, np.int32)
        if len(starts):
            self.text[offset + lengths - 1] = 0
        self.order = suffix_array(self.text, block.longest) if len(self.text) else np.empty(0, np.int64)

    def document_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, positions, side="right") - 1


def find_hits(texts: list[str | None], block: Block):
    """(words per text, hit flags of all words in a row, (text, item names) pairs)."""
    shard = Shard(texts, block)
    change = np.zeros(shard.size + 1, np.int64)
    names: list[set[str]] = [set() for _ in texts]
    if len(shard.order) and len(block.starts):
        *_, low, high = search(shard.text, shard.order, block)
        for q in np.flatnonzero(high > low).tolist():
            at = shard.place[shard.order[low[q] : high[q]]]
            np.add.at(change, at, 1)
            np.add.at(change, at + block.spans[q], -1)
            for d in np.unique(shard.document_of(at)).tolist():
                names[d].update(block.names(q))
    hit = np.cumsum(change[:-1]) > 0
    return shard.counts, [hit[b : b + n] for b, n in zip(shard.begins.tolist(), shard.counts.tolist())], names


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """Functions that collect one block of the benchmark each, of bounded size."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    part = F.pmod(F.xxhash64("name", "text"), F.lit(n))
    return [lambda k=k: Block([(r.name, r.text) for r in items.where(part == k).toLocalIterator()], window) for k in range(n)]


def _marked(docs: DataFrame, text_col: str, blocks: list) -> DataFrame:
    """``docs`` and three columns: _words, _hit (bits of hit words), _names."""
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("_words", T.LongType()), T.StructField("_hit", T.BinaryType()), T.StructField("_names", T.ArrayType(T.StringType()))])
    t = names.index(text_col)
    for number, load in enumerate(blocks):
        block, first = load(), number == 0

        def run(batches, block=block, first=first):
            for part in slices(batches, names[t]):
                counts, hits, items = find_hits(part.column(t).to_pylist(), block)
                own = part.columns[: len(names)]
                if not first:  # what earlier blocks found
                    before = part.column(len(names) + 1).to_pylist()
                    hits = [h | np.unpackbits(np.frombuffer(b, np.uint8), count=len(h)).astype(bool) for h, b in zip(hits, before)]
                    items = [x | set(y) for x, y in zip(items, part.column(len(names) + 2).to_pylist())]
                yield pa.RecordBatch.from_arrays([*own, pa.array(counts), pa.array([np.packbits(h).tobytes() if h.any() else bytes((len(h) + 7) // 8) for h in hits], pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=schema.fieldNames())

        docs = docs.mapInArrow(run, schema)
        if number + 1 < len(blocks):
            docs = materialize(docs, "decontam-block")
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; a very long text is a shard of its
    own; an item without words has no window; a null item id is named by the empty
    string; repeated documents come out repeatedly, repeated items count once; an empty
    benchmark hits nothing, an empty table gives no rows; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    marked = _marked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", blocks_of(benchmark, item_col, "text", window, block_bytes))

    def run(batches):
        for b in batches:
            hits = [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in b.column(3).to_pylist()]
            items = b.column(4).to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_words": b.column(2), "n_hit": pa.array(hits, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()), "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], "contaminated": [h > 0 for h in hits]})

    return marked.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any hit word, all columns as they are, whatever their names.

    Null and empty texts stay.  Blocks of the benchmark are searched one after another,
    with what is left written between them, so one block is held at a time.
    """
    t = docs.columns.index(text_col)
    loads = blocks_of(benchmark, item_col, "text", window, block_bytes)

    def maker(block: Block):
        def run(batch):
            _, hits, _ = find_hits(batch.column(t).to_pylist(), block)
            return batch.filter(pa.array([not h.any() for h in hits]))

        return lambda: run

    for number, load in enumerate(loads):
        docs = map_rows(docs, maker(load()), docs.schema, text=text_col)
        if number + 1 < len(loads):
            docs = materialize(docs, "decontam-block")
    return docs


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, item_at, words, doc_id, doc_at): for every benchmark suffix with a match
    of at least its window the longest one over all shards, and the first place of it
    (smallest doc_id, then word).  Only item ids, positions and lengths are shuffled."""
    found = None
    loads = blocks_of(benchmark, item_col, "text", window, block_bytes)
    for load in loads:

        def make(block=load()):
            def run(batch):
                shard = Shard(batch.column(1).to_pylist(), block)
                if not len(shard.order) or not len(block.starts):
                    return {"item_id": pa.array([], pa.string()), "item_at": pa.array([], pa.int64()), "words": pa.array([], pa.int64()), "doc_id": batch.column(0).slice(0, 0), "doc_at": pa.array([], pa.int64())}
                longest, low, high, *_ = search(shard.text, shard.order, block)
                ids = batch.column(0).to_pylist()
                rows = []
                for q in np.flatnonzero(longest >= np.minimum(block.lengths, window)).tolist():
                    item = int(block.item[q])
                    at = q - int(block.begins[item])
                    places = shard.place[shard.order[low[q] : high[q]]]
                    docs_at = shard.document_of(places)
                    where = min((ids[d], int(p - shard.begins[d])) for d, p in zip(docs_at.tolist(), places.tolist()) if ids[d] is not None) if any(ids[d] is not None for d in docs_at.tolist()) else (None, int(places[0] - shard.begins[docs_at[0]]))
                    rows.append((block.items[item], at, int(longest[q]), *where))
                cols = list(zip(*rows)) or [()] * 5
                return {"item_id": pa.array(cols[0], pa.string()), "item_at": pa.array(cols[1], pa.int64()), "words": pa.array(cols[2], pa.int64()), "doc_id": pa.array(cols[3], batch.column(0).type), "doc_at": pa.array(cols[4], pa.int64())}

            return run

        part = map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"item_id string, item_at long, words long, doc_id {dict(docs.dtypes)[id_col]}, doc_at long")
        if len(loads) > 1:  # so that the block can go
            part = materialize(part, "longest-matches")
        found = part if found is None else found.unionByName(part)
    best = F.min(F.struct((-F.col("words")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "doc_at")).alias("b")
    return found.groupBy("item_id", "item_at").agg(best).select("item_id", "item_at", (-F.col("b.n")).alias("words"), "b.doc_id", "b.doc_at")
