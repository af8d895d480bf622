"""Quality rules: counts per document, and a linear-chain CRF over its lines.

Every line with a word is content or boilerplate.  A linear-chain conditional
random field over line features (length, symbols, repetition, ...) is trained
here by maximum likelihood on all labelled documents.  Labels are of lines, not of
documents (``line_labels``): a line that many labelled documents share is
boilerplate wherever it stands, and a line that a first model of single lines
clearly places against its document's label takes the other label.  So chains of
both labels are learned from, and moves between them.  Viterbi decoding then
labels the lines of every document together, and the share of words on content
lines decides retention; the least share is fitted on all labelled documents too.

Features are written once, a row a document.  Each step of a fit is one pass over
them in tasks, which add up value, gradient and curvature; only these sums, a few
hundred numbers a task, come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import map_rows, materialize, segment_sums, slices

#: Share of words on content lines from which a document stays, if none was fitted.
MIN_CONTENT_SHARE = 0.5
#: A line is boilerplate if this share of the labelled documents (and three at least) has it.
COMMON_SHARE = 0.002
#: The first model's probability of a line's own label below which it takes the other one.
DOUBT = 0.2
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Steps of a fit at most, and the expected gain in mean log-likelihood at which it ends.
STEPS = 100
LEAST_GAIN = 1e-10
L2 = 1e-3
#: Decimals of fitted parameters, so that the order in which tasks add up does not show.
DECIMALS = 6

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Least shares that are tried.
SHARES = np.arange(1, 20) / 20

_SYMBOLS = b"#*$%&|<>"
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_OTHER_MARKS = b"!?@^_=+~/\\[]{}()`\""
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
FEATURES = ("bias", "log_words", "word_length", "symbols", "digits", "upper", "repetition", "duplicate", "sentence_end", "marks", "repeated_windows", "short", "common")


def _without(raw: bytes, drop: bytes) -> int:
    return len(raw) - len(raw.translate(None, drop))


def repeated_words(words: list, size: int = WINDOW) -> np.ndarray:
    """Flags of the words inside windows of ``size`` words that occur twice or more."""
    n = len(words)
    hit = np.zeros(n, dtype=bool)
    if n <= size:
        return hit
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    key, distinct = ids[: n - size + 1], len(seen)
    for k in range(1, size):
        if distinct * len(seen) >= 1 << 62:  # rank before the packed value could overflow
            _, key = np.unique(key, return_inverse=True)
            distinct = len(key)
        key = key * len(seen) + ids[k : n - size + 1 + k]
        distinct *= len(seen)
    _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
    change = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(counts[where] > 1)
    change[starts] += 1
    np.add.at(change, starts + size, -1)
    return np.cumsum(change[:-1]) > 0


@dataclass
class Counts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


def line_key(line: bytes) -> int:
    return xxhash.xxh64_intdigest(line.strip(_SPACES))


def line_features(text: str | None) -> tuple[Counts, np.ndarray, np.ndarray, np.ndarray]:
    """(counts, words per line with a word, features of those lines but ``common``, their keys)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    lines = [(line, w) for line in raw.split(b"\n") if (w := line.split())]
    words = [w for _, ws in lines for w in ws]
    repeat = repeated_words(words)
    rows, seen, dup, at = np.zeros((len(lines), len(FEATURES)), dtype=np.float32), set(), 0, 0
    for k, (line, ws) in enumerate(lines):
        n, chars = len(ws), sum(map(len, ws))
        again = line in seen
        seen.add(line)
        dup += again
        rows[k] = (
            1, np.log1p(n), chars / n / 10, min(10 * _without(line, _SYMBOLS) / chars, 3), 5 * _without(line, _DIGITS) / chars, 3 * _without(line, _UPPER) / chars,
            1 - len(set(ws)) / n, again, line.rstrip()[-1:] in b".!?:", min(10 * _without(line, _OTHER_MARKS) / chars, 3), repeat[at : at + n].mean(), n < 3, 0,
        )
        at += n
    counts = Counts(len(words), len(text or "") - _without(raw, _SPACES), _without(raw, _SYMBOLS), dup, int(repeat.sum()))
    return counts, np.array([len(ws) for _, ws in lines], dtype=np.int64), rows, np.array([line_key(line) for line, _ in lines], dtype=np.uint64)


def measure(text: str | None, common: frozenset[int] = frozenset()) -> tuple[Counts, np.ndarray, np.ndarray]:
    """(counts, words per line with a word, features of those lines).

    ``common`` has the keys of lines that many documents share.
    """
    counts, words, rows, keys = line_features(text)
    rows[:, -1] = [k in common for k in keys.tolist()]
    return counts, words, rows


@dataclass
class LineField:
    """Linear-chain CRF with labels 0 (boilerplate) and 1 (content)."""

    weights: np.ndarray  # features x 2
    moves: np.ndarray  # 2 x 2
    common: frozenset[int] = frozenset()  # keys of lines that many documents share
    min_share: float = MIN_CONTENT_SHARE

    @classmethod
    def neutral(cls) -> LineField:
        """Without labelled rows every line is content."""
        w = np.zeros((len(FEATURES), 2))
        w[0, 1] = 1.0
        return cls(w, np.zeros((2, 2)))

    def decode(self, rows: np.ndarray) -> np.ndarray:
        """Viterbi: the best label sequence of one document's lines (ties: content)."""
        if not len(rows):
            return np.empty(0, dtype=np.int64)
        emit = (rows @ self.weights).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = emit[0]
        back = []
        for e0, e1 in emit[1:]:
            from0, from1 = a + m00 > b + m10, a + m01 > b + m11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + m00 if from0 else b + m10) + e0, (a + m01 if from1 else b + m11) + e1
        label = 0 if a > b else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return np.array(out[::-1], dtype=np.int64)

    def chains(self, rows: np.ndarray, labels: np.ndarray, lengths: np.ndarray):
        """Of chains one after the other: (log-likelihood a chain, probability of content a line,
        probabilities of the four moves into each line; zeros for a chain's first).

        Forward and backward go by the log odds of content, a number a line.
        """
        emit = rows @ self.weights
        move = np.exp(self.moves)
        (m00, m01), (m10, m11) = move.tolist()
        ends = np.cumsum(lengths)
        odds = emit[:, 1] - emit[:, 0]
        steps, forward, back, scales = odds.tolist(), odds.copy(), np.zeros(len(odds)), []
        for at, end in zip((ends - lengths).tolist(), ends.tolist()):
            r, scale = steps[at], 0.0
            if end - at > 1:
                ahead = [r]
                for d in steps[at + 1 : end]:
                    if r > 0:
                        x = exp(-r)
                        s0, s1, scale = m00 * x + m10, m01 * x + m11, scale + r
                    else:
                        x = exp(r)
                        s0, s1 = m00 + m10 * x, m01 + m11 * x
                    scale += log(s0)
                    r = d + log(s1 / s0)
                    ahead.append(r)
                forward[at:end] = ahead
                b, behind = 0.0, [0.0]
                for d in steps[end - 1 : at : -1]:
                    q = d + b
                    if q > 0:
                        x = exp(-q)
                        b = log((m10 * x + m11) / (m00 * x + m01))
                    else:
                        x = exp(q)
                        b = log((m10 + m11 * x) / (m00 + m01 * x))
                    behind.append(b)
                back[at:end] = behind[::-1]
            scales.append(scale + max(r, 0.0) + log1p(exp(-abs(r))))
        first = np.zeros(len(odds), dtype=bool)
        first[ends - lengths] = True
        content = 1 / (1 + np.exp(-np.clip(forward + back, -500, 500)))
        before, after = np.concatenate([[0.0], forward[:-1]]), odds + back
        pair = np.stack([np.zeros(len(odds)), after, before, before + after], axis=1) + self.moves.reshape(4)
        pair = np.exp(pair - pair.max(axis=1, keepdims=True))
        pair *= ~first[:, None] / pair.sum(axis=1, keepdims=True)
        moved = np.where(first, 0.0, self.moves[np.concatenate([[0], labels[:-1]]), labels])
        value = segment_sums(emit[np.arange(len(odds)), labels] - emit[:, 0] + moved, lengths) - np.array(scales)
        return value, content, pair

    def log_likelihood(self, rows: np.ndarray, labels: np.ndarray, real: np.ndarray):
        """Of padded sequences (S x T x features, S x T, S x T), with its gradient."""
        x, y, lengths = rows[real], labels[real], real.sum(axis=1)
        value, content, pair = self.chains(x, y, lengths)
        slope = x.T @ (y - content)
        return value.sum(), np.stack([-slope, slope], axis=1), (_moves_of(y, lengths) - pair).sum(axis=0).reshape(2, 2)

    def sums(self, rows: np.ndarray, labels: np.ndarray, lengths: np.ndarray, chained: bool = True) -> np.ndarray:
        """What a step of ``fit`` needs of some documents, to be added up: for those mostly of
        boilerplate and those mostly of content, their lines, log-likelihood, its gradient (by the
        difference of the weights and by the moves) and its curvature, lines and moves taken one by one."""
        if not chained:
            lengths = np.ones(len(labels), dtype=np.int64)
        value, content, pair = self.chains(rows, labels, lengths)
        side = 2 * segment_sums(labels, lengths) >= lengths
        f, of = len(FEATURES), np.repeat(side, lengths)
        out = np.zeros((2, 2 + (f + 4) + (f + 4) ** 2))
        slopes = np.concatenate([rows * (labels - content)[:, None], _moves_of(labels, lengths) - pair], axis=1)
        for k in (0, 1):
            x, p, q = rows[of == k].astype(float), content[of == k], pair[of == k]
            bend = np.zeros((f + 4, f + 4))
            bend[:f, :f] = (x * (p * (1 - p))[:, None]).T @ x
            bend[f:, f:] = np.diag(q.sum(axis=0)) - q.T @ q
            out[k] = np.concatenate([[len(x), value[side == k].sum()], slopes[of == k].sum(axis=0), bend.reshape(-1)])
        return out

    @classmethod
    def fit(cls, add_up: Callable[[LineField, bool], np.ndarray], start: LineField | None = None, chained: bool = True) -> LineField:
        """Maximum of the likelihood: ``add_up`` gives ``sums`` over all documents at a field.

        Documents whose lines are mostly of one label weigh as much as those of the other.
        Without ``chained`` it is a model of single lines: no moves.  Steps are quasi-Newton
        ones on the curvature, corrected by what the gradient did in the steps before, and are
        halved until the value rises; the function is concave, so the maximum is the only one.
        """
        f = len(FEATURES)
        ridge = np.concatenate([np.full(f, L2 / 2), np.full(4, L2)])

        def of(theta):
            return cls(np.stack([-theta[:f] / 2, theta[:f] / 2], axis=1), theta[f:].reshape(2, 2))

        def at(theta):
            both = add_up(of(theta), chained)
            if not both[:, 0].all():
                return None
            both = (both / both[:, :1]).sum(axis=0)
            return both[1] - (ridge * theta**2).sum() / 2, both[2 : f + 6] - ridge * theta, both[f + 6 :].reshape(f + 4, f + 4) + np.diag(ridge)

        theta = np.zeros(f + 4)
        if start is not None:
            theta = np.concatenate([start.weights[:, 1] - start.weights[:, 0], start.moves.reshape(4)])
        now = at(theta)
        if now is None:
            return cls.neutral()
        past: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(STEPS):
            value, slope, bend = now
            step, parts = slope.copy(), []
            for s, y in reversed(past):
                parts.append((s @ step) / (s @ y))
                step -= parts[-1] * y
            step = np.linalg.solve(bend, step)
            for (s, y), part in zip(past, reversed(parts)):
                step += s * (part - (y @ step) / (s @ y))
            gain, size = float(slope @ step), 1.0
            if gain < LEAST_GAIN:
                break
            while (new := at(theta + size * step))[0] < value + 1e-4 * size * gain and size > 1e-6:
                size /= 2
            change = slope - new[1]
            if size * (step @ change) > 0:
                past.append((size * step, change))
            theta, now = theta + size * step, new
        return of(np.round(theta, DECIMALS))


def _moves_of(labels: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Lines x 4: a one at the move into a line; none into the first of a chain."""
    out = np.zeros((len(labels), 4))
    out[np.arange(1, len(labels)), 2 * labels[:-1] + labels[1:]] = 1
    out[np.cumsum(lengths) - lengths] = 0
    return out


def first_labels(rows: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Labels of lines before any model: that of the document (a value a line), common lines are boilerplate."""
    return np.where(rows[:, -1] > 0, 0, good.astype(np.int64))


def turned_labels(single: LineField, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``first_labels`` with those turned that a model of single lines finds less probable than DOUBT."""
    emit = rows @ single.weights
    content = 1 / (1 + np.exp(np.clip(emit[:, 0] - emit[:, 1], -50, 50)))
    own = np.where(y == 1, content, 1 - content)
    return np.where((own < DOUBT) & (rows[:, -1] == 0), 1 - y, y)


def line_labels(rows: list[np.ndarray], good: np.ndarray) -> list[np.ndarray]:
    """Labels of the lines of each document: its own label, with two corrections.

    Common lines are boilerplate.  A model of single lines, fitted on what that
    gives, then turns the lines whose own label it finds less probable than DOUBT.
    """
    flat, lengths = np.concatenate(rows), np.array([len(r) for r in rows])
    start = first_labels(flat, np.repeat(good, lengths))
    single = LineField.fit(lambda field, chained: field.sums(flat, start, lengths, chained), chained=False)
    return np.split(turned_labels(single, flat, start), np.cumsum(lengths)[:-1])


def share_counts(shares: np.ndarray, good: np.ndarray) -> np.ndarray:
    """2 x 20: bad documents, good documents; last their number, before it those of each step's share or more."""
    return np.array([[*((shares[good == k][:, None] >= SHARES).sum(axis=0)), (good == k).sum()] for k in (False, True)])


def best_share(counts: np.ndarray) -> float:
    """The share in steps of 0.05 that parts good from bad documents best (ties: the middle one)."""
    if not counts[:, -1].all():
        return MIN_CONTENT_SHARE
    bad, good = counts[:, :-1] / counts[:, -1:]
    right = good + 1 - bad
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(SHARES[best[len(best) // 2]])


def least_share(shares: np.ndarray, good: np.ndarray) -> float:
    return best_share(share_counts(shares, good))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, base_failed, and as binaries words, features and key of each line): one row per input row."""

    def make():
        def run(batch):
            found = [line_features(t) for t in batch.column(1).to_pylist()]
            return {
                "doc_id": batch.column(0),
                **{n: pa.array([getattr(x[0], n) for x in found], pa.int64()) for n in COUNTS},
                "base_failed": pa.array([x[0].base_failed for x in found], pa.bool_()),
                **{n: pa.array([x[k].tobytes() for x in found], pa.binary()) for k, n in enumerate(("words", "rows", "keys"), 1)},
            }

        return run

    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"doc_id {kind}, {', '.join(f'{n} long' for n in COUNTS)}, base_failed boolean, words binary, rows binary, keys binary")


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The values of all lines of a batch, one after the other."""
    kind = {"words": np.int64, "rows": np.float32, "keys": np.uint64}[name]
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(-1, *([len(FEATURES)] if name == "rows" else []))


def _lengths(batch: pa.RecordBatch) -> np.ndarray:
    return pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64) // 8


def _with_common(batch: pa.RecordBatch, known: np.ndarray) -> np.ndarray:
    rows = _flat(batch, "rows").copy()
    rows[:, -1] = np.isin(_flat(batch, "keys"), known)
    return rows


def _known(common: frozenset[int]) -> np.ndarray:
    return np.array(sorted(common), dtype=np.uint64)


def _added(df: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of ``fn`` over all slices; a task gives one array."""

    def run(batches):
        total = None
        for batch in slices(batches, "rows"):
            x = fn(batch)
            total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.astype(float).tobytes()], pa.binary()), "n": pa.array([len(total)], pa.int64())})

    return sum(np.frombuffer(r["sums"]).reshape(r["n"], -1) for r in df.mapInArrow(run, "sums binary, n long").collect())


def common_lines(labelled: DataFrame, n: int) -> frozenset[int]:
    """Keys of lines that COMMON_SHARE of the ``n`` documents have, three documents at least.

    With more documents these are at most 1 / COMMON_SHARE times the mean number of lines.
    """

    def run(batches):
        for batch in batches:
            own = [np.unique(np.frombuffer(k, np.uint64)) for k in batch.column(0).to_pylist()]
            if own:
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(own).view(np.int64))})

    found = labelled.select("keys").mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= max(3, COMMON_SHARE * n))
    return frozenset(r.key % (1 << 64) for r in found.select("key").collect())


def fit_measured(lines: DataFrame, labels: DataFrame) -> LineField:
    """Fit on all labelled documents of ``measured``; an id with both labels counts for both.

    Documents without words have no lines to learn from.
    """
    marked = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("y")).distinct()
    # Both sides grow with the input, so they are merged at every size.
    labelled = materialize(lines.where("n_words > 0").join(marked.hint("merge"), "doc_id").select("y", "base_failed", "words", "rows", "keys"), "labelled-lines")
    sizes = {r.y: r["count"] for r in labelled.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return LineField.neutral()
    common = common_lines(labelled, sum(sizes.values()))

    def mark(batches):
        known = _known(common)
        for batch in slices(batches, "rows"):
            rows, ends = _with_common(batch, known), np.cumsum(_lengths(batch))
            bodies = [x.tobytes() for x in np.split(rows, ends[:-1])]
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "base_failed": batch.column("base_failed"), "words": batch.column("words"), "rows": pa.array(bodies, pa.binary())})

    own = materialize(labelled.mapInArrow(mark, "y int, base_failed boolean, words binary, rows binary"), "marked-lines")

    def start(batch):
        rows, lengths = _flat(batch, "rows"), _lengths(batch)
        return rows, first_labels(rows, np.repeat(batch.column("y").to_numpy(), lengths)), lengths

    def of_lines(field, chained):
        return _added(own, lambda batch: field.sums(*start(batch), chained))

    single = LineField.fit(of_lines, chained=False)

    def of_chains(field, chained):
        def add(batch):
            rows, y, lengths = start(batch)
            return field.sums(rows, turned_labels(single, rows, y), lengths, chained)

        return _added(own, add)

    field = LineField.fit(of_chains, single)

    def of_shares(batch):
        passed = ~batch.column("base_failed").to_numpy(zero_copy_only=False)
        return share_counts(_shares(field, _flat(batch, "rows"), _flat(batch, "words"), _lengths(batch))[passed], batch.column("y").to_numpy()[passed] == 1)

    return LineField(field.weights, field.moves, common, best_share(_added(own, of_shares)))


def fit_field(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineField:
    """Fit on all labelled documents; see ``fit_measured``."""
    return fit_measured(materialize(measured(docs, id_col, text_col), "line-features"), labels)


def _shares(field: LineField, rows: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The share of words on content lines of each document."""
    content = [field.decode(x) for x in np.split(rows, np.cumsum(lengths)[:-1])]
    return segment_sums(words * np.concatenate([*content, np.empty(0, np.int64)]), lengths) / np.maximum(1, segment_sums(words, lengths))


def judge(field: LineField, text: str | None, min_share: float | None = None) -> tuple[Counts, float, bool]:
    counts, words, rows = measure(text, field.common)
    share = float(words[field.decode(rows) == 1].sum() / max(1, counts.n_words))
    return counts, share, not counts.base_failed and share >= (field.min_share if min_share is None else min_share)


def judged(lines: DataFrame, field: LineField, min_share: float | None = None) -> DataFrame:
    """``quality`` of what ``measured`` gives."""

    def run(batches):
        known, least = _known(field.common), field.min_share if min_share is None else min_share
        for batch in slices(batches, "rows"):
            shares = _shares(field, _with_common(batch, known), _flat(batch, "words"), _lengths(batch))
            kept = ~batch.column("base_failed").to_numpy(zero_copy_only=False) & (shares >= least)
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in ("doc_id", *COUNTS, "base_failed")} | {"content_share": pa.array(shares), "kept": pa.array(kept)})

    return lines.mapInArrow(run, f"doc_id {dict(lines.dtypes)['doc_id']}, {', '.join(f'{n} long' for n in COUNTS)}, base_failed boolean, content_share double, kept boolean")


def quality(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text", min_share: float | None = None) -> DataFrame:
    """One row per input row: counts, base_failed, content_share, kept.

    Null, empty and blank texts have no words, so they fail the base rules;
    a very long text is a slice alone, all its lines decoded as one chain; equal
    label sequences go to content, the least share itself keeps; repeated rows come
    out repeatedly; a null id stays null; an empty table gives no rows; only the id
    and the text are read, so further columns of any name do no harm.
    """
    return judged(measured(docs, id_col, text_col), field, min_share)


def keep_good(docs: DataFrame, field: LineField, text_col: str = "text", min_share: float | None = None) -> DataFrame:
    """The rows of ``docs`` that pass (as ``quality`` has it), with all their columns."""
    t = docs.columns.index(text_col)

    def make():
        return lambda batch: batch.filter(pa.array([judge(field, x, min_share)[2] for x in batch.column(t).to_pylist()], pa.bool_()))

    return map_rows(docs, make, docs.schema, text=text_col)
