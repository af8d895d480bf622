"""Near-duplicates by the Jaccard similarity of word shingles.

1. Texts with the same set of shingles collapse to one node before anything is compared.
2. Fingerprints of the sets go through the binary-trie self-join of ``simhash_trie``
   (its budget and block choices).  Nodes whose fingerprints its links connect share a
   bucket, so whatever the trie links is a candidate, and so is the rest of its component.
3. Pairs of 0.8 similarity lie mostly beyond the trie's budget, so min-hash bands add
   further buckets: nodes that agree in a whole band share one.
   At 0.8 similarity a pair misses all bands with probability 3e-5.
4. Candidates of fitting sizes are verified on their whole sets, which are taken from
   the texts again, for members of buckets only.  In a small bucket all pairs are; in
   a larger one members are first compared with a leader.  Buckets that such links
   leave in several components are searched whole (``_search``), a block against a
   block, through an inverted index of their shingles; what comes out is a spanning
   forest of the links, so no pairs are emitted and no bucket is cut.
5. Components over the verified links.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm import simhash_trie
from matchloom.llm.common import map_rows, materialize
from matchloom.llm.components import connected_components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 20, 4
#: Members up to which all pairs of a bucket are verified at once; rounds of leaders in larger ones.
SMALL_BUCKET = 8
LEADER_ROUNDS = 3
#: Shingles of a block of a bucket's members.
BLOCK_SHINGLES = 1 << 19
SEED = 42

_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in simhash_trie.shingles(text, SHINGLE_WORDS)], dtype="<u8"))


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key a band; none for an empty set."""
    if not len(values):
        return np.empty(0, dtype=np.uint64)
    low = np.full(len(_A), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 2048):
        np.minimum(low, (values[at : at + 2048, None] * _A + _B).min(axis=0), out=low)
    return np.array([xxhash.xxh64_intdigest(low[k * BAND_ROWS : (k + 1) * BAND_ROWS].tobytes(), k) for k in range(BANDS)], dtype=np.uint64)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                least, most = sorted((len(x), len(y)))
                shared = len(np.intersect1d(x, y, assume_unique=True)) if least >= SIMILARITY * most else 0
                keep.append(shared >= SIMILARITY * (least + most - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("node").alias("a"), F.col("body").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("body").alias("y"))
    return pairs.distinct().join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


class _Members:
    """Some members of a bucket: nodes, their components, an inverted index of their shingles."""

    def __init__(self, nodes: np.ndarray, own: np.ndarray, bodies: list[bytes]):
        self.nodes, self.own = nodes, own
        self.sets = [np.frombuffer(x, "<u8") for x in bodies]
        self.sizes = np.array([len(x) for x in self.sets], dtype=np.int64)
        flat = np.concatenate([*self.sets, np.empty(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.shingles, self.holders = flat[order], np.repeat(np.arange(len(nodes)), self.sizes)[order]

    def similar(self, x: np.ndarray) -> np.ndarray:
        """Positions of the members that are similar enough to a set."""
        low, high = np.searchsorted(self.shingles, x), np.searchsorted(self.shingles, x, side="right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        shared = np.bincount(self.holders[at], minlength=len(self.nodes))
        return np.flatnonzero(shared >= SIMILARITY * (self.sizes + len(x) - shared) - 1e-9)


def _search(asking: _Members, others: _Members) -> list[tuple[int, int]]:
    """A spanning forest, over components, of the links from ``asking`` to ``others``."""
    kinds, of = np.unique(np.concatenate([asking.own, others.own]), return_inverse=True)
    root = np.arange(len(kinds))
    mine, theirs = of[: len(asking.own)], of[len(asking.own) :]
    found = []
    for k, x in enumerate(asking.sets):
        at = others.similar(x)
        own = root[theirs[at]]
        for r, first in zip(*np.unique(own, return_index=True)):
            if root[mine[k]] != root[r]:
                found.append((int(asking.nodes[k]), int(others.nodes[at[first]])))
                root[root == root[r]] = root[mine[k]]
    return found


def _search_buckets(large: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): forests of the links in split buckets (key, node, size, own).

    A bucket's members are dealt over blocks by hash, as many as their shingles ask for,
    and each pair of blocks is a group; a member goes to as many groups as there are blocks.
    """
    blocks = large.groupBy("key").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    dealt = large.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "own").join(sets, "node")

    def run(group: pa.Table) -> pa.Table:
        block, i = group["block"].to_numpy(), group["i"][0].as_py()
        nodes, own, bodies = group["node"].to_numpy(), group["own"].to_numpy(), group["body"].to_pylist()
        some = lambda at: _Members(nodes[at], own[at], [bodies[k] for k in at.tolist()])
        if group["j"][0].as_py() == i:
            # The members of the largest component need not ask each other.
            kinds, n = np.unique(own, return_counts=True)
            found = _search(some(np.flatnonzero(own != kinds[n.argmax()])), some(np.arange(len(own))))
        else:
            found = _search(some(np.flatnonzero(block == i)), some(np.flatnonzero(block != i)))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b) between ``nodes`` (node, size, keys): the components over them are those of all similar candidates.

    ``sets_of`` gives (node, body) for a table of nodes.
    """

    def pair(x, y):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    def fits(x, y):
        return F.least(x, y) >= SIMILARITY * F.greatest(x, y) - 1e-9

    rows = nodes.select("node", "size", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("lead")).where("n > 1")
    # Sides that grow with the input are merged at every size.
    members = materialize(rows.join(sizes.hint("merge"), "key"), "buckets")
    sets = materialize(sets_of(members.select("node").distinct()), "candidate-sets")
    small = members.where(F.col("n") <= SMALL_BUCKET).select("key", "node", "size")
    some = small.alias("l").join(small.alias("r"), "key").where(F.expr("l.node < r.node") & fits(F.col("l.size"), F.col("r.size"))).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    star = members.where((F.col("n") > SMALL_BUCKET) & (F.col("node") != F.col("lead.node")) & fits(F.col("size"), F.col("lead.size"))).select(*pair(F.col("lead.node"), F.col("node")))
    found = materialize(_similar(some.union(star), sets), "links")
    large = members.where(F.col("n") > SMALL_BUCKET).select("key", "node", "size")
    for k in range(LEADER_ROUNDS):
        if large.isEmpty():
            return found
        named = connected_components(found).withColumnRenamed("component", "own")
        large = materialize(large.select("key", "node", "size").join(named, "node", "left").select("key", "node", "size", F.coalesce("own", "node").alias("own")), "large-buckets")
        split = large.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.min_by(F.struct("node", "own", "size"), F.xxhash64("node", F.lit(k))).alias("lead")).where("low <> high")
        large = materialize(large.join(split.select("key", "lead"), "key"), "split-buckets")
        if k + 1 < LEADER_ROUNDS:
            more = large.where((F.col("own") != F.col("lead.own")) & fits(F.col("size"), F.col("lead.size"))).select(*pair(F.col("lead.node"), F.col("node")))
            found = materialize(found.union(_similar(more, sets)), "links")
    return materialize(found.union(_search_buckets(large.select("key", "node", "size", "own"), sets)), "links")


def with_trie_groups(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, size, fp, keys) as (node, size, keys), with one key more: of the component
    that the trie self-join's links between fingerprints give (its own where there are none)."""
    linked = connected_components(simhash_trie.links(materialize(nodes.select("fp").distinct(), "distinct-fingerprints"))).withColumnRenamed("node", "fp")
    group = F.xxhash64(F.lit("trie"), F.coalesce("component", "fp"))
    # Linked fingerprints grow with the input, so they are merged at every size.
    return nodes.join(linked.hint("merge"), "fp", "left").select("node", "size", F.array_append("keys", group).alias("keys"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, node, group, component_id): one row per input row; rows of one group are linked.

    ``component_id`` is the smallest id reachable over links.  Null and empty texts are
    copies of each other; a null id takes no part in minima; a very long text is hashed
    in parts; repeated rows come out repeatedly; an empty table gives none; other
    columns, whatever their names, are not read.
    """

    def make(bodies: bool):
        def run(batch):
            sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], dtype=np.uint64)
            found = {"id": batch.column(0), "key": batch.column(1), "node": pa.array(nodes.view(np.int64))}
            if bodies:
                return found | {"body": pa.array([x.tobytes() for x in sets], pa.binary())}
            keys = pa.array([band_keys(x).view(np.int64) for x in sets], pa.list_(pa.int64()))
            fps = np.array([simhash_trie.fingerprint_of_hashes(x) for x in sets], dtype=np.uint64)
            return found | {"size": pa.array([len(x) for x in sets], pa.int64()), "fp": pa.array(fps.view(np.int64)), "keys": keys}

        return run

    kind = f"id {dict(docs.dtypes)[id_col]}, key long, node long"
    texts = docs.select(F.col(id_col).alias("id"), simhash_trie.text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    marked = materialize(map_rows(texts, lambda: make(False), f"{kind}, size long, fp long, keys array<long>"), "fingerprints")
    # One text stands for all of a node: the one of the smallest hash.
    low = materialize(marked.groupBy("node").agg(F.min("id").alias("low"), F.min("key").alias("own")), "nodes")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = materialize(low.join(nodes, "node").select("node", "own"), "candidates")
        some = texts.join(wanted.select(F.col("own").alias("key")).distinct().hint("merge"), "key", "left_semi").select("id", "key", "text").dropDuplicates(["key"])
        bodies = map_rows(some, lambda: make(True), f"{kind}, body binary")
        return bodies.join(wanted, (bodies["node"] == wanted["node"]) & (bodies["key"] == wanted["own"]), "left_semi").select("node", "body").dropDuplicates(["node"])

    nodes = with_trie_groups(marked.select("node", "size", "fp", "keys").dropDuplicates(["node"]))
    linked = connected_components(links(nodes, sets_of))
    named = simhash_trie.named_groups(low.select("node", "low"), linked, "node")
    return marked.select("id", "key", "node").join(named, "node")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``simhash_trie.drop_near_duplicates`` with this module's links."""
    return simhash_trie.drop_near_duplicates(docs, id_col, text_col, similar_documents)
