"""SimHash near-duplicate detection by a binary-trie self-join.

1. Each text gets a 64-bit fingerprint: per bit, the majority over the XXH64
   values of its word shingles.
2. Equal fingerprints collapse to one before anything is compared, so copies
   cost one partial aggregation, whatever their number.
3. Two fingerprints with at most ``BUDGET`` differing bits agree on at least
   ``BLOCKS - BUDGET`` of BLOCKS equal bit blocks.  For each choice of that many
   blocks the fingerprints are read in a bit order that puts the chosen blocks
   first; a trie over that order is split over the cluster below those blocks
   (where the error budget for the path is zero), and each subtree is joined
   with itself: node pairs go down together, differing bits add up, and a pair
   is dropped as soon as it exceeds the budget.
   No pair of fingerprints is lost, and each fingerprint has at most
   1 + 64 + 2016 values within two bits, so work is linear in their number.
4. A subtree emits only a spanning forest of its links; the components are then
   found by contraction on those few edges.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import free_name, map_rows, materialize
from matchloom.llm.components import connected_components

SHINGLE_WORDS = 3
SEED = 42
BUDGET = 2
BLOCKS = 4
#: Members of a subtree beyond which it is split again below further blocks.
SUBTREE_ROWS = 20_000
#: Node pairs that are kept in memory at once.
FRONTIER = 1 << 18

_ORDERS = list(combinations(range(BLOCKS), BLOCKS - BUDGET))


def shingles(text: str | None, n: int = SHINGLE_WORDS) -> list[bytes]:
    """Word shingles of a text with A-Z lower-cased; the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) <= n:
        return [b" ".join(words)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    joined = b" ".join(words)
    return [joined[a:b] for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())]


def fingerprint_of_hashes(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, n: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    xxh = xxhash.xxh64_intdigest
    return fingerprint_of_hashes(np.array([xxh(s, seed) for s in shingles(text, n)], dtype=np.uint64))


def text_key(text):
    """Column: a hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE_WORDS) -> DataFrame:
    """(id, key, fp): one row per input row; fp is the fingerprint as a signed long.

    A null or empty text has fingerprint zero; ``key`` is ``text_key``.
    """

    def make():
        def run(batch):
            fps = np.array([fingerprint(t, n) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            return {"id": batch.column(0), "key": batch.column(1), "fp": pa.array(fps.view(np.int64))}

        return run

    return map_rows(docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")), make, f"id {dict(docs.dtypes)[id_col]}, key long, fp long")


def _permuted(values: np.ndarray, first: tuple[int, ...], width: int, total: int) -> np.ndarray:
    """Values of ``total`` bits with the blocks ``first`` moved to the top, in order."""
    blocks = [*first, *(b for b in range(total // width) if b not in first)]
    out = np.zeros_like(values)
    mask = np.uint64((1 << width) - 1)
    for b in blocks:
        out = (out << np.uint64(width)) | ((values >> np.uint64(total - width * (b + 1))) & mask)
    return out


def trie_self_join(values: np.ndarray, groups: np.ndarray, bits: int, budget: int = BUDGET):
    """Yield index pairs (i, j), i < j, of values in one group within ``budget`` bits.

    ``values`` (low ``bits`` bits count) must be sorted within sorted ``groups`` and
    distinct there.  A trie node at depth d is a run of values that share d bits.
    Node pairs descend together; both children of both nodes are paired, a
    crossing step costs one differing bit, and pairs over budget are pruned.
    The frontier is worked off as a stack of blocks, so memory is bounded.
    """
    if len(values) < 2:
        return
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    ends = np.concatenate([starts[1:], [len(groups)]])
    many = ends - starts > 1
    starts, ends = starts[many], ends[many]
    zero = np.zeros(len(starts), dtype=np.int8)
    stack = [(0, starts, ends, starts.copy(), ends.copy(), zero)]
    ones = [np.concatenate([[0], np.cumsum((values >> np.uint64(bits - 1 - d)) & np.uint64(1), dtype=np.int64)]) for d in range(bits)]
    while stack:
        depth, a0, a1, b0, b1, err = stack.pop()
        if not len(a0):
            continue
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(depth, a0[:half], a1[:half], b0[:half], b1[:half], err[:half]), (depth, a0[half:], a1[half:], b0[half:], b1[half:], err[half:])]
            continue
        if depth == bits:
            keep = a0 < b0
            if keep.any():
                yield a0[keep], b0[keep]
            continue
        # Values of a node are sorted, so those with a one at this depth come last.
        am = a1 - (ones[depth][a1] - ones[depth][a0])
        bm = b1 - (ones[depth][b1] - ones[depth][b0])
        next_pairs = []
        for lo_a, hi_a, lo_b, hi_b, cost in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            ok = (lo_a < hi_a) & (lo_b < hi_b) & (err + cost <= budget)
            same = lo_a == lo_b
            ok &= ~(same & (hi_a - lo_a == 1))  # a value with itself
            if cost:
                ok &= ~((a0 == b0) & (lo_a > lo_b))  # the mirror of a pair below one node
            if ok.any():
                next_pairs.append((lo_a[ok], hi_a[ok], lo_b[ok], hi_b[ok], (err[ok] + cost).astype(np.int8)))
        if next_pairs:
            stack.append((depth + 1, *(np.concatenate(x) for x in zip(*next_pairs))))


class _Forest:
    """Union-find over positions of one block of subtrees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while True:
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            low, high = np.minimum(ra[open_], rb[open_]), np.maximum(ra[open_], rb[open_])
            np.minimum.at(p, high, low)

    def roots(self, x: np.ndarray) -> np.ndarray:
        p, r = self.parent, self.parent[x]
        while True:
            up = p[r]
            if (up == r).all():
                p[x] = r
                return r
            r = up


def _join_subtrees(batches, rest: int):
    """Rows (top, path, fp, value) sorted by top, path, value -> spanning links (a, b).

    (top, path) names a subtree; the low ``rest`` bits of value are below it.  A
    subtree that goes on in the next batch is held back until it is whole.
    """
    mask = np.uint64((1 << rest) - 1)

    def solve(top, path, fp, value):
        new = np.concatenate([[True], (top[1:] != top[:-1]) | (path[1:] != path[:-1])])
        forest = _Forest(len(fp))
        for i, j in trie_self_join(value.view(np.uint64) & mask, np.cumsum(new), rest):
            forest.add(i, j)
        root = forest.roots(np.arange(len(fp)))
        linked = root != np.arange(len(fp))
        return pa.RecordBatch.from_pydict({"a": pa.array(fp[root[linked]]), "b": pa.array(fp[linked])})

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(k).to_numpy() for k in range(4)])
        top, path = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if sum(len(x[0]) for x in held) < 1 << 15 or (held[0][0][0] == top[-1] and held[0][1][0] == path[-1]):
            continue
        columns = [np.concatenate(x) for x in zip(*held)]
        cut = len(columns[0]) - int(np.argmin(((columns[0] == top[-1]) & (columns[1] == path[-1]))[::-1]))
        yield solve(*(x[:cut] for x in columns))
        held = [[x[cut:] for x in columns]]
    if held:
        yield solve(*(np.concatenate(x) for x in zip(*held)))


_ROUTED = "top long, path long, fp long, value long"


def _routes(rows: DataFrame, total: int) -> DataFrame:
    """Rows (top, fp, value) once per choice of blocks of the low ``total`` bits of value."""
    width = total // BLOCKS
    below = total - width * (BLOCKS - BUDGET)

    def run(batches):
        for batch in batches:
            value = batch.column(2).to_numpy().view(np.uint64) & np.uint64((1 << total) - 1)
            for tag, first in enumerate(_ORDERS):
                moved = _permuted(value, first, width, total)
                path = (np.uint64(tag) << np.uint64(40)) | (moved >> np.uint64(below))
                yield pa.RecordBatch.from_pydict({"top": batch.column(0), "path": pa.array(path.view(np.int64)), "fp": batch.column(1), "value": pa.array(moved.view(np.int64))})

    return rows.mapInArrow(run, _ROUTED)


def links(fps: DataFrame, subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """(a, b): spanning links between distinct fingerprints (column ``fp``) within the budget.

    A subtree of more than ``subtree_rows`` members is routed once more below two
    quarter blocks of its remaining 32 bits, by the same argument, so that a hot
    path is dealt over many tasks.  That is exact; nothing is capped.
    """

    def joined(rows: DataFrame, rest: int) -> DataFrame:
        spread = rows.repartition("top", "path").sortWithinPartitions("top", "path", "value")
        return spread.mapInArrow(lambda it: _join_subtrees(it, rest), "a long, b long")

    routed = _routes(fps.select(F.lit(0).cast("long").alias("top"), "fp", F.col("fp").alias("value")), 64)
    hot = materialize(routed.groupBy("path").count().where(F.col("count") > subtree_rows).select("path"), "hot-paths")
    if hot.isEmpty():
        return joined(routed, 32)
    deep = _routes(routed.join(hot, "path", "left_semi").select(F.col("path").alias("top"), "fp", "value"), 32)
    return joined(routed.join(hot, "path", "left_anti").select("top", "path", "fp", "value"), 32).unionByName(joined(deep, 16))


def named_groups(nodes: DataFrame, linked: DataFrame, node: str) -> DataFrame:
    """(node, group, component_id) of all nodes (``node``, low: its smallest id).

    ``linked`` has (node, component) of those with links; a node without stands for itself.
    """
    linked = materialize(linked.withColumnRenamed("node", node).join(nodes, node), "components")
    lowest = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    moved = linked.join(lowest, "component").select(node, "component", "component_id")
    own = F.col("component").isNull()
    return nodes.join(moved, node, "left").select(node, F.coalesce("component", node).alias("group"), F.when(own, F.col("low")).otherwise(F.col("component_id")).alias("component_id"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE_WORDS) -> DataFrame:
    """(id, key, fp, group, component_id): one row per input row; rows of one group are linked."""
    marked = materialize(fingerprints(docs, id_col, text_col, n), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    return marked.join(named_groups(distinct, connected_components(links(distinct.select("fp"))), "fp"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per input row.

    ``component_id`` is the smallest id reachable over links.  Null and empty
    texts have fingerprint zero and link like any other; a bit set in just half of the
    shingles is 0; a very long text is hashed in parts; a null id is kept, and takes no
    part in minima (a component of null ids alone has a null id); repeated rows come
    out as often as they came in; an empty table gives none; other columns, whatever
    their names, are not read.
    """
    return grouped(docs, id_col, text_col, n).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[..., DataFrame] = grouped) -> DataFrame:
    """The rows of ``docs`` but one of each group: that with the smallest id (ties: text hash).

    All columns stay as they are, whatever their names.  Rows without an id stay.  Of
    rows that repeat an id with its text one stays, the first by its JSON; an id with
    several texts is judged text by text.  ``find`` gives the groups.
    """
    found = materialize(find(docs, id_col, text_col).where("id is not null").select("id", "key", "group"), "near-duplicates")
    first = found.groupBy("group").agg(F.min(F.struct("id", "key")).alias("first"))
    key = free_name(docs, "_text_key")
    gone = found.join(first, "group").where(F.struct("id", "key") != F.col("first")).select(F.col("id").alias(id_col), F.col("key").alias(key)).distinct()
    marked = docs.withColumn(key, text_key(F.col(text_col)))
    kept = marked.join(gone.hint("merge"), [id_col, key], "left_anti")  # what goes grows with the input
    repeated = materialize(found.groupBy("id", "key").count().where("count > 1").select(F.col("id").alias(id_col), F.col("key").alias(key)), "repeated-rows")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = kept.join(repeated, [id_col, key], "left_semi").groupBy(id_col, key).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return kept.join(repeated, [id_col, key], "left_anti").select(*docs.columns).unionByName(once)
