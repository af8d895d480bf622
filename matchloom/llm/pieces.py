"""Piece inventories of a public SentencePiece model, read from a path that is a parameter."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Where the public model lies unless a caller names another path; it is read there and never copied.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


_P = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hash_of(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_P) + ord(c) + 1) & (2**64 - 1)
    return h * int(_MIX) & (2**64 - 1)


class SpanHashes:
    """Hashes of all spans of many strings, by prefix sums; equal to ``hash_of`` of the span."""

    def __init__(self, codes: np.ndarray, longest: int):
        n, depth = codes.shape
        self.prefix = np.zeros((n, depth + 1), dtype=np.uint64)
        for d in range(depth):
            self.prefix[:, d + 1] = self.prefix[:, d] * _P + codes[:, d].astype(np.uint64) + np.uint64(1)
        self.power = np.ones(max(longest, depth) + 1, dtype=np.uint64)
        for k in range(len(self.power) - 1):
            self.power[k + 1 : k + 2] = self.power[k : k + 1] * _P

    def of(self, rows: np.ndarray, start, end) -> np.ndarray:
        return (self.prefix[rows, end] - self.prefix[rows, start] * self.power[end - start]) * _MIX


def code_matrix(words: list[str], lengths: np.ndarray) -> np.ndarray:
    """Code points of words, a row each, padded with zeros."""
    codes = np.zeros((len(words), int(lengths.max())), dtype=np.uint32)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return codes


class PieceTable:
    """From hashes to the positions of pieces in the given order, or -1."""

    BITS = 20

    def __init__(self, pieces: list[str]):
        keys = np.array([hash_of(p) for p in pieces], dtype=np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("pieces with equal hashes")
        self.shift = np.uint64(64 - self.BITS)
        self.order = np.argsort(keys >> self.shift, kind="stable")
        self.keys = keys[self.order]
        slots = np.searchsorted(self.keys >> self.shift, np.arange((1 << self.BITS) + 1, dtype=np.uint64))
        self.slots, self.depth = slots.astype(np.int32), int(np.diff(slots).max())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, dtype=np.int64)
        slot = (hashes >> self.shift).astype(np.int64)
        at, end = self.slots[slot], self.slots[slot + 1]
        for k in range(self.depth):
            live = np.flatnonzero(at + k < end)
            if not len(live):
                break
            place = at[live] + k
            same = self.keys[place] == hashes[live]
            out[live[same]] = self.order[place[same]]
        return out


@dataclass(frozen=True)
class Pieces:
    ids: dict[str, int]  # merge-type pieces, without bytes and control pieces
    ranks: dict[str, int]  # merge order: lower merges first
    raw: list[bytes]  # what each id stands for in a text
    byte_ids: list[int]


@lru_cache(maxsize=4)
def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, ranks, raw, byte_ids = {}, {}, [], [0] * 256
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            value = int(piece[3:5], 16)
            byte_ids[value] = k
            raw.append(bytes([value]))
        elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
            raw.append(b"")
        else:
            ids[piece] = k
            ranks[piece] = int(-model.get_score(k))
            raw.append(piece.replace(SPACE, " ").encode())
    return Pieces(ids, ranks, raw, byte_ids)
