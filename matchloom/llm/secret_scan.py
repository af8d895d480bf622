"""Secret scanning over a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over trigrams that
any match must contain (AND over parts that follow each other, OR over
alternatives).  Each block of documents gets an inverted index from the
trigrams that the rules ask for to the documents that hold them; a rule's query
is evaluated by intersecting and uniting postings, and only the documents that
remain are verified with the regular expression itself.  A rule without a
mandatory trigram (a bare run of hex digits) scans every document.

Index and queries are over text with A-Z lower-cased, so one index serves rules
with and without case.  Blocks are what one task reads at a time; nothing is
shuffled, and the memory of a block is bounded.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as C
import re._parser as parser
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import map_rows


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    min_length: int = 0  # of the group; shorter matches are dropped


# Public formats of credentials, base kinds first, in order of kind.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 20),
    Rule("hex", r"[0-9a-f]+", re.ASCII, 0, 24),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")

#: Strings a sub-expression may stand for before its trigrams are taken instead.
EXACT_LIMIT = 32

# A query is True (nothing is mandatory) or ("and" | "or", frozenset of trigrams and queries).


def _join(op: str, parts: list):
    if op == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif any(p is True for p in parts):
        return True
    flat: set = set()
    for p in parts:
        flat |= p[1] if isinstance(p, tuple) and p[0] == op else {p}
    return next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def _of_string(s: str):
    return _join("and", [s[i : i + 3] for i in range(len(s) - 2)])


def _of_strings(strings: set[str]):
    return _join("or", [_of_string(s) for s in strings]) if strings else True


def _fold(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _walk(items) -> tuple[set[str] | None, object]:
    """(all strings that the sequence can be, or None; query of what is mandatory)."""
    exact: set[str] | None = {""}
    whole = True
    asked: list = []

    def close() -> None:
        nonlocal exact
        asked.append(_of_strings(exact))

    for op, arg in items:
        strings, query = None, True
        if op is C.LITERAL:
            strings = {_fold(chr(arg))}
        elif op is C.IN and len(arg) <= EXACT_LIMIT and all(x[0] is C.LITERAL for x in arg):
            strings = {_fold(chr(x[1])) for x in arg}
        elif op is C.SUBPATTERN:
            strings, query = _walk(arg[3])
        elif op is C.BRANCH:
            ways = [_walk(way) for way in arg[1]]
            strings = set().union(*(w[0] for w in ways)) if all(w[0] is not None for w in ways) else None
            query = _join("or", [w[1] for w in ways])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            inner_strings, inner_query = _walk(inner)
            if inner_strings is not None and high != C.MAXREPEAT and high <= 4 and len(inner_strings) <= 4:
                strings = {"".join(x) for n in range(low, high + 1) for x in product(inner_strings, repeat=n)}
            elif low:
                query = inner_query
        if strings is not None and len(exact) * len(strings) <= EXACT_LIMIT:
            exact = {a + b for a in exact for b in strings}
            continue
        whole = False
        close()
        if strings is not None and len(strings) <= EXACT_LIMIT:
            exact = set(strings)
        else:
            asked.append(query)
            exact = {""}
    close()
    return (exact if whole else None), _join("and", asked)


def trigram_query(pattern: str, flags: int = re.ASCII):
    """The Boolean query over trigrams (A-Z folded) that every match satisfies, or True."""
    return _walk(parser.parse(pattern, flags & ~re.IGNORECASE))[1]


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


class Postings:
    """Inverted index of one block: trigram -> ordinals of the documents that hold it."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, wanted: list[str]):
        codes = {t: int.from_bytes(t.encode(), "big") for t in wanted}
        self.lists: dict[str, np.ndarray] = {t: np.empty(0, dtype=np.int64) for t in wanted}
        if len(data) < 3 or not codes:
            return
        # Positions whose first two bytes start a wanted trigram; then the third decides.
        pairs = np.zeros(1 << 16, dtype=bool)
        pairs[[c >> 8 for c in codes.values()]] = True
        two = (data[:-2].astype(np.uint16) << np.uint16(8)) | data[1:-1]
        at = np.flatnonzero(pairs[two])
        found = (two[at].astype(np.int64) << 8) | data[at + 2]
        for t, code in codes.items():
            self.lists[t] = np.unique(np.searchsorted(starts, at[found == code], side="right") - 1)

    def documents(self, query) -> np.ndarray:
        if isinstance(query, str):
            return self.lists[query]
        op, parts = query
        lists = sorted((self.documents(q) for q in parts), key=len)
        out = lists[0]
        for more in lists[1:]:
            out = np.intersect1d(out, more, assume_unique=True) if op == "and" else np.union1d(out, more)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(k, r, re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for k, r in enumerate(rules)]
        self.wanted = sorted({t for *_, q in self.rules for t in trigrams_of(q) if t.isascii()})
        self.longer = [re.compile(r.pattern[:-1] + "{%d,}" % r.min_length, r.flags) if re.fullmatch(r"\[[^\]]+\]\+", r.pattern) and not r.group else None for r in rules]
        if any(not t.isascii() for *_, q in self.rules for t in trigrams_of(q)):
            raise ValueError("rules must have ASCII literals")

    def candidates(self, texts: list[str]):
        """(rule, ordinals) for each rule: by postings, or all documents without a query."""
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        starts = np.cumsum([0, *(len(b) + 1 for b in raw)])[:-1]
        data = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
        index = Postings(data, starts, self.wanted)
        for k, rule, regex, query in self.rules:
            yield k, rule, regex, (range(len(texts)) if query is True else index.documents(query).tolist())

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule number, end) in order."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, rule, regex, some in self.candidates(texts):
            # A lone class repeated: its maximal runs of enough length are the same
            # matches as all runs with the short ones dropped.
            regex = self.longer[k] or regex
            for i in some:
                for m in regex.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.min_length:
                        out[i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


def _joined(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: counts of the base kinds, the digest of their spans, all spans.

    Spans are in code points of the whole text, of any length, end exclusive.  A null text
    has none, as an empty one; repeated rows come out repeatedly.  Spans of several kinds may
    overlap: all stay, by start and then in the order of the rules.  An empty table gives
    none; further columns, whatever their names, are left out.
    """

    def make():
        scanner, kinds = Scanner(rules), [r.kind for r in rules]
        base = {k for k, r in enumerate(rules) if r.kind in BASE}

        def run(batch):
            spans = scanner.scan([t or "" for t in batch.column(1).to_pylist()])
            counts = {kind: [sum(kinds[k] == kind for _, k, _ in s) for s in spans] for kind in BASE}
            return {
                "doc_id": batch.column(0),
                **{f"n_{kind}": pa.array(counts[kind], pa.int64()) for kind in BASE},
                "base_sha256": [hashlib.sha256(_joined([x for x in s if x[1] in base], kinds).encode()).hexdigest() for s in spans],
                "spans": pa.array([_joined(s, kinds) for s in spans], pa.string()),
            }

        return run

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"doc_id {dict(docs.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_text(text: str, spans: list[tuple[int, int, int]], kinds: list[str], mark: str = "[{}]") -> str:
    """Overlapping spans become one mark, named by the first of them."""
    out, at, until = [], 0, -1
    for a, k, b in spans:
        if a < until:
            until = at = max(until, b)
            continue
        out += [text[at:a], mark.format(kinds[k])]
        at = until = b
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns of ``docs`` with every span replaced by a mark of its kind.

    The column ``length_col``, if there is one, follows the changed texts; a text
    without a span, and a null one, stays as it is.
    """
    names = docs.columns
    t = names.index(text_col)
    c = names.index(length_col) if length_col in names else None

    def make():
        scanner, kinds = Scanner(rules), [r.kind for r in rules]

        def run(batch):
            texts = batch.column(t).to_pylist()
            spans = scanner.scan([x or "" for x in texts])
            if not any(spans):
                return batch
            new = [redact_text(x, s, kinds) if s else x for x, s in zip(texts, spans)]
            columns = list(batch.columns)
            columns[t] = pa.array(new, columns[t].type)
            if c is not None:
                lengths = columns[c].to_pylist()
                columns[c] = pa.array([len(n) if s else old for n, s, old in zip(new, spans, lengths)], columns[c].type)
            return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return run

    return map_rows(docs, make, docs.schema, text=text_col)
