"""Token counts under a unigram model, by dynamic programming over a trie.

The distinct pre-tokens (a space mark and a word) of a slice of texts go into a
trie.  The best segmentation of a prefix under unigram piece scores depends on the
prefix alone, so its forward score and token count are computed once per trie
node, whichever pre-tokens share it; terminal nodes keep the count of their
pre-token, and a text's count is the sum over its pre-tokens.

The trie is held in arrays: pre-tokens sorted, a node being the first row that
has a prefix; nodes of one depth are computed together.  Counts of pre-tokens are
remembered within a task, so the trie only takes new ones.

Piece scores: the public inventory gives a merge order only, so scores follow
Zipf's law over it (log probability of rank r: -log(r + 1) - log H).  A character
without a piece costs its UTF-8 bytes as byte pieces.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import map_rows
from matchloom.llm.pieces import MODEL, SPACE, PieceTable, SpanHashes, code_matrix, load

#: Rows of the trie's arrays at a time, and the longest pre-token in them; longer
#: ones are computed one by one.
TRIE_ROWS = 20_000
TRIE_DEPTH = 40
#: Pre-tokens that a task remembers.
REMEMBERED = 300_000
#: Pieces of such a rank (runs of spaces) have no place in the merge order.
UNRANKED = 1 << 24


class Unigram:
    """Scores of pieces and of bytes, with a table from code-point hashes to scores."""

    def __init__(self, path: str):
        pieces = load(path)
        ranked = {p: r for p, r in pieces.ranks.items() if r < UNRANKED}
        log_h = float(np.log(np.sum(1.0 / np.arange(1, max(ranked.values()) + 2))))
        self.scores = {p: -float(np.log(r + 1)) - log_h for p, r in ranked.items()}
        self.byte_score = min(self.scores.values()) - 1.0
        self.longest = max(map(len, self.scores))
        self.table = PieceTable(list(self.scores))
        self.values = np.append(np.array(list(self.scores.values())), -np.inf)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Scores of span hashes; minus infinity where there is no such piece."""
        return self.values[self.table.find(hashes)]


@lru_cache(maxsize=2)
def unigram(path: str = MODEL) -> Unigram:
    return Unigram(path)


def _bytes_of(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


def count_one(word: str, model: Unigram) -> int:
    """Tokens of the best segmentation of one pre-token, without sharing."""
    n = len(word)
    score, tokens = [0.0] + [-np.inf] * n, [0] * (n + 1)
    for d in range(1, n + 1):
        size = len(word[d - 1].encode("utf-8", "surrogatepass"))
        for k in range(1, min(d, model.longest) + 1):
            s, t = model.scores.get(word[d - k : d]), 1
            if s is None:
                if k > 1:
                    continue
                s, t = size * model.byte_score, size
            if score[d - k] + s > score[d]:
                score[d], tokens[d] = score[d - k] + s, tokens[d - k] + t
    return tokens[n]


def trie_counts(words: list[str], model: Unigram) -> np.ndarray:
    """Token counts of distinct pre-tokens, each prefix scored once."""
    lengths = np.array([len(w) for w in words])
    out = np.zeros(len(words), dtype=np.int64)
    for i in np.flatnonzero(lengths > TRIE_DEPTH).tolist():
        out[i] = count_one(words[i], model)
    short = sorted(np.flatnonzero(lengths <= TRIE_DEPTH).tolist(), key=words.__getitem__)
    for k in range(0, len(short), TRIE_ROWS):
        rows = short[k : k + TRIE_ROWS]
        out[rows] = _sorted_trie([words[i] for i in rows], model)
    return out


def _sorted_trie(words: list[str], model: Unigram) -> np.ndarray:
    n = len(words)
    length = np.array([len(w) for w in words])
    depth = int(length.max())
    codes = code_matrix(words, length)
    differs = np.ones((n, depth), dtype=bool)
    differs[1:] = np.logical_or.accumulate(codes[1:] != codes[:-1], axis=1)
    spans = SpanHashes(codes, model.longest)
    score, tokens = np.zeros((n, depth + 1)), np.zeros((n, depth + 1), dtype=np.int32)
    rows = np.arange(n)
    for d in range(1, depth + 1):
        reach = length >= d
        node = np.flatnonzero(differs[:, d - 1] & reach)
        if not len(node):
            break
        size = _bytes_of(codes[node, d - 1].astype(np.int64))
        best, count = np.full(len(node), -np.inf), np.zeros(len(node), dtype=np.int32)
        for k in range(1, min(d, model.longest) + 1):
            s = model.lookup(spans.of(node, d - k, d))
            t = np.ones(len(node), dtype=np.int32)
            if k == 1:
                none = np.isneginf(s)
                s, t = np.where(none, size * model.byte_score, s), np.where(none, size, 1)
            total = score[node, d - k] + s
            better = total > best
            best = np.where(better, total, best)
            count = np.where(better, tokens[node, d - k] + t, count)
        # Every row that shares the prefix reads its node: the last one at or above it.
        first = np.zeros(n, dtype=np.int64)
        first[node] = np.arange(len(node))
        owner = np.maximum.accumulate(np.where(np.isin(rows, node, assume_unique=True), first, 0))
        score[:, d], tokens[:, d] = best[owner], count[owner]
    return tokens[rows, length].astype(np.int64)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """(doc_id, n_words, n_distinct, n_tokens): one row per input row, over whole texts.

    Words are separated by ASCII white space.  Null, empty and blank texts have no
    words and no tokens; repeated rows come out repeatedly.  Of segmentations of equal
    score that counts whose last token is the shortest.  Words over TRIE_DEPTH are scored
    alone, of any length, and not remembered.  An empty table gives none; further columns,
    whatever their names, are left out.
    """

    def make():
        model = unigram(path)
        known: dict[bytes, int] = {}  # of at most TRIE_DEPTH bytes each, so bounded in bytes too

        def run(batch):
            if len(known) > REMEMBERED:
                known.clear()
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column(1).to_pylist()]
            kinds = [set(w) for w in words]
            new = list(set().union(*kinds).difference(known))
            counts = trie_counts([SPACE + w.decode("utf-8", "surrogatepass") for w in new], model).tolist() if new else []
            fresh = dict(zip(new, counts))
            known.update((w, n) for w, n in fresh.items() if len(w) <= TRIE_DEPTH)
            of = lambda w: known[w] if w in known else fresh[w]
            return {
                "doc_id": batch.column(0),
                "n_words": pa.array([len(w) for w in words], pa.int64()),
                "n_distinct": pa.array([len(k) for k in kinds], pa.int64()),
                "n_tokens": pa.array([sum(map(of, w)) for w in words], pa.int64()),
            }

        return run

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"doc_id {kind}, n_words long, n_distinct long, n_tokens long")
