"""Language-model scoring by cross-entropy difference.

A target model (all documents labelled as good) and a background model (all
documents) are bigram models over one shared vocabulary, with the same smoothing.
Each token of a text has a loss under either model; the mean difference, target
minus background, scores the text: the lower, the closer to the target.

The vocabulary is every word, and counts are taken over every whole document.  An
n-gram (a pair of words, a word, a word as the one before) goes by a key of hashed
bits, whose top bits name its bucket.  Keys have SPARE_BITS more bits than the text
has bytes in binary, so at any size less than one n-gram in a million shares its key.  Slices of text send their distinct keys
with counts to the buckets, which add them up: the model is a written table of a row
a bucket, of which the driver sees four numbers.  For scoring, texts are dealt over
chunks by a hash of the row, and a chunk asks the buckets for the counts of its
distinct keys.  Buckets and chunks grow in number with the text, not in size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import SLICE_BYTES, map_rows, materialize, slices
from matchloom.llm.suffix_decontam import words_of

#: Weight of the unigram model in a bigram estimate, in counts.
SMOOTHING = 50.0
#: Bytes of text a bucket and a chunk, and how many there are at least.
BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 256
CHUNK_BYTES, LEAST_CHUNKS = 8 << 20, 64
#: Slices up to which a bucket's counts are added up at once; beyond, those of so many partitions are first.
MOST_SLICES, FEW_PARTITIONS = 2048, 64
#: Bits of a key beyond those that count the bytes of text.
SPARE_BITS = 20

#: In place of word hashes: any word outside a limited vocabulary, the start of a text.
_OTHER, _START = 1, 2
#: The low bits of a key: a pair of words, a word, a word as the one before.
_PAIR, _WORD, _BEFORE = 0, 1, 2
_ZSTD = pa.Codec("zstd", 1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents; each slice counts its own words first."""

    def make():
        def run(batch):
            seen: dict[bytes, int] = {}
            ids = [seen.setdefault(w, len(seen)) for t in batch.column(0).to_pylist() for w in words_of(t)]
            n = np.bincount(ids, minlength=len(seen)) if ids else np.empty(0, np.int64)
            return {"word": pa.array([w.decode("utf-8", "replace") for w in seen], pa.string()), "n": pa.array(n, pa.int64())}

        return run

    return map_rows(docs.select(F.col(text_col).alias("text")), make, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_of(docs: DataFrame, size: int, text_col: str = "text") -> list[str]:
    """The most frequent words of the whole table (ties: by word)."""
    return [r.word for r in word_counts(docs, text_col).orderBy(F.desc("n"), "word").limit(size).collect()]


@dataclass
class Tables:
    """The model: ``counts`` is (bucket, keys, background, target), packed 64-bit arrays by key."""

    counts: DataFrame
    bits: int  # of a bucket
    width: int  # of a hash
    n_words: int
    background: int
    target: int
    smoothing: float
    #: A limited vocabulary; None: every word.
    words: frozenset[bytes] | None


def _keys(first: np.ndarray, second: np.ndarray | np.uint64, kind: int, width: int) -> np.ndarray:
    x = first * _M1 + second * _M2
    x = (x ^ (x >> np.uint64(29))) * _M1
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(64 - width)) << np.uint64(2) | np.uint64(kind)


class Slice:
    """The n-grams of some texts.

    ``keys``: distinct and sorted; ``length``: tokens of each text; for each token
    of all texts in a row ``pair``, ``word`` and ``before`` are places in ``keys``.
    """

    def __init__(self, texts: list[str | None], words: frozenset[bytes] | None, width: int):
        self.width = width
        seen: dict[bytes, int] = {}
        flat: list[int] = []
        add = seen.setdefault
        self.length = np.zeros(len(texts), dtype=np.int64)
        for k, t in enumerate(texts):
            found = words_of(t)
            self.length[k] = len(found)
            flat += [add(w, len(seen)) for w in found]
        hashes = [_OTHER if words is not None and w not in words else xxhash.xxh64_intdigest(w) for w in seen]
        hashes = np.array([*hashes, _START], dtype=np.uint64)
        now = np.array(flat, dtype=np.int64)
        last = np.concatenate([[0], now[:-1]]) if len(now) else now
        last[(np.cumsum(self.length) - self.length)[self.length > 0]] = len(seen)
        distinct, pair = np.unique(last * len(hashes) + now, return_inverse=True)
        a, b = np.divmod(distinct, len(hashes))
        every = np.concatenate([_keys(hashes[a], hashes[b], _PAIR, width), _keys(hashes, np.uint64(0), _WORD, width), _keys(hashes, np.uint64(0), _BEFORE, width)])
        self.keys, at = np.unique(every, return_inverse=True)
        self.pair, self.word, self.before = at[pair], at[len(distinct) + now], at[len(distinct) + len(hashes) + last]

    def counts(self, weights: np.ndarray) -> np.ndarray:
        """Occurrences of each key, those of a text times its weight (0 or 1)."""
        own = np.repeat(weights, self.length).astype(bool)
        n = len(self.keys)
        return sum(np.bincount(x[own], minlength=n) for x in (self.pair, self.word, self.before))

    def buckets(self, bits: int) -> tuple[np.ndarray, list[slice]]:
        """The buckets that have keys, and where they are."""
        bucket, start = np.unique(self.keys >> np.uint64(self.width + 2 - bits), return_index=True)
        return bucket.astype(np.int32), [slice(a, b) for a, b in zip(start.tolist(), [*start[1:].tolist(), len(self.keys)])]


def _packed(values: np.ndarray, parts: list[slice], by_step: bool = False) -> pa.Array:
    """64-bit values (or their steps, for sorted keys), byte plane by byte plane, compressed."""
    out = []
    for p in parts:
        x = values[p]
        if by_step:
            x = np.diff(x, prepend=np.uint64(0))
        planes = x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
        out.append(len(x).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True))
    return pa.array(out, pa.binary())


def _unpacked(column: pa.ChunkedArray, by_step: bool = False) -> list[np.ndarray]:
    planes = [_ZSTD.decompress(x[8:], 8 * int.from_bytes(x[:8], "little"), asbytes=True) for x in column.to_pylist()]
    out = [np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel() for x in planes]
    return [np.cumsum(x, dtype=np.uint64) for x in out] if by_step else [x.astype(np.int64) for x in out]


def _total_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def fit_tables(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int | None = None, smoothing: float = SMOOTHING) -> Tables:
    """The model of all documents and of all those labelled good.

    ``size`` limits the vocabulary to that many most frequent words, for a caller
    that wants a small model (ties: by word); other words then count as one.  Ids are
    matched as text.  A null id is in the background only; repeated rows count each
    time, repeated labels once; null and empty texts have nothing to count; an empty
    table or no good document gives a model without counts.
    """
    words = None if size is None else frozenset(w.encode() for w in vocabulary_of(docs, size, text_col))
    total = _total_bytes(docs, text_col)
    bits = (max(LEAST_BUCKETS, -(-total // BUCKET_BYTES)) - 1).bit_length()
    width = min(62, max(total.bit_length() + SPARE_BITS, bits))
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("string").alias("id"), F.lit(True).alias("good")).distinct()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).join(good, "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"), F.spark_partition_id().alias("part"))

    def count(batches):
        for part in slices(batches, "text"):
            s = Slice(part.column(0).to_pylist(), words, width)
            if not len(s.pair):
                continue
            own = part.column(1).to_numpy(zero_copy_only=False)
            background, target = s.counts(np.ones(len(own))), s.counts(own)
            bucket, parts = s.buckets(bits)
            here = pa.array(np.full(len(parts), part.column(2)[0].as_py(), np.int32))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket), "part": here, "keys": _packed(s.keys, parts, True), "background": _packed(background, parts), "target": _packed(target, parts)})

    def add_up(part: pa.Table) -> pa.Table:
        keys, at = np.unique(np.concatenate(_unpacked(part["keys"], True)), return_inverse=True)
        n = [np.zeros(len(keys), dtype=np.int64) for _ in range(2)]
        for k, name in enumerate(("background", "target")):
            np.add.at(n[k], at, np.concatenate(_unpacked(part[name])))
        n[0], n[1], keys = n[0][n[0] > 0], n[1][n[0] > 0], keys[n[0] > 0]
        is_word = (keys & np.uint64(3)) == _WORD
        one = [slice(0, len(keys))]
        sums = {"n_words": int(is_word.sum()), "n_background": int(n[0][is_word].sum()), "n_target": int(n[1][is_word].sum())}
        return pa.table({"bucket": part["bucket"][:1], "part": part["part"][:1], "keys": _packed(keys, one, True), "background": _packed(n[0], one), "target": _packed(n[1], one), **{k: pa.array([v], pa.int64()) for k, v in sums.items()}})

    kind = "bucket int, part int, keys binary, background binary, target binary"
    summed = f"{kind}, n_words long, n_background long, n_target long"
    counts, many = rows.mapInArrow(count, kind), total // SLICE_BYTES + 1
    # A frequent word's bucket has a row a slice: sums of few partitions keep its last group small.
    while many > MOST_SLICES:
        few = counts.withColumn("part", (F.col("part") / FEW_PARTITIONS).cast("int"))
        counts, many = few.groupBy("bucket", "part").applyInArrow(add_up, summed).select("bucket", "part", "keys", "background", "target"), many // FEW_PARTITIONS
    counts = counts.groupBy("bucket").applyInArrow(add_up, summed)
    counts = materialize(counts, "n-gram-counts")
    n_words, background, target = (x or 0 for x in counts.agg(F.sum("n_words"), F.sum("n_background"), F.sum("n_target")).first())
    return Tables(counts.select("bucket", "keys", "background", "target"), bits, width, n_words if words is None else len(words), background, target, smoothing, words)


def ce_difference(docs: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score): one row per input row.

    Losses and score are means per token in nats; a text without tokens (null,
    empty, blank) has none of them.  Repeated rows score alike; a null id is kept; a
    very long text is a chunk's own; an empty table gives no rows; further columns,
    whatever their names, are left out.
    """
    kind = dict(docs.dtypes)[id_col]
    bits, width, words, n_words, smoothing = tables.bits, tables.width, tables.words, tables.n_words, tables.smoothing
    totals = {"target": tables.target, "background": tables.background}

    def ask(texts: pa.Table) -> pa.Table:
        s = Slice(texts["text"].to_pylist(), words, width)
        bucket, parts = s.buckets(bits)
        return pa.table({"bucket": pa.array(bucket), "chunk": pa.array(np.full(len(parts), texts["chunk"][0].as_py())), "keys": _packed(s.keys, parts, True)})

    def look_up(asked: pa.Table, model: pa.Table) -> pa.Table:
        keys = np.concatenate([*_unpacked(model["keys"], True), np.array([2**64 - 1], dtype=np.uint64)])
        n = {name: np.concatenate([*_unpacked(model[name]), [0]]) for name in totals}
        own = _unpacked(asked["keys"], True)
        stops = np.cumsum([0, *map(len, own)]).tolist()
        parts = [slice(a, b) for a, b in zip(stops, stops[1:])]
        own = np.concatenate([*own, np.empty(0, np.uint64)])
        at = np.searchsorted(keys, own)
        known = keys[at] == own
        return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], **{name: _packed(np.where(known, n[name][at], 0), parts) for name in totals}})

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        s = Slice(texts["text"].to_pylist(), words, width)
        found = found.sort_by("bucket")
        of = np.repeat(np.arange(len(s.length)), s.length)
        mean = {}
        for name, total in totals.items():
            n = np.concatenate([*_unpacked(found[name]), np.empty(0, np.int64)])
            p = (n[s.word] + 1.0) / (total + n_words + 1.0)
            loss = np.log(n[s.before] + smoothing) - np.log(n[s.pair] + smoothing * p)
            mean[name] = np.bincount(of, weights=loss, minlength=len(s.length)) / np.maximum(s.length, 1)
        none = s.length == 0
        columns = {"loss_target": mean["target"], "loss_background": mean["background"], "score": mean["target"] - mean["background"]}
        return pa.table({"doc_id": texts["doc_id"], "n_tokens": pa.array(s.length), **{k: pa.array(v, pa.float64(), mask=none) for k, v in columns.items()}})

    chunks = max(LEAST_CHUNKS, -(-_total_bytes(docs, text_col) // CHUNK_BYTES))
    # Rows that repeat an id and a text are told apart by where they are read, so no chunk gets them all.
    texts = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.spark_partition_id()), F.lit(chunks)).alias("chunk"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Both groupings read one exchange of the texts.
    asked = texts.groupBy("chunk").applyInArrow(ask, "bucket int, chunk long, keys binary")
    found = asked.groupBy("bucket").cogroup(tables.counts.groupBy("bucket")).applyInArrow(look_up, "chunk long, bucket int, target binary, background binary")
    return texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(score, f"doc_id {kind}, n_tokens long, loss_target double, loss_background double, score double")
