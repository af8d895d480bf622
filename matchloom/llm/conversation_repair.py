"""Structure of conversations: damage, faults, and the cheapest repair by Viterbi.

A legal conversation is empty, or an optional system turn before pairs of user and
assistant turns.  The turns of a conversation stream past a trellis of four states
(nothing yet, system, user, assistant), each with the cheapest edits that lead to it.

The survivors' edits are a tree of back pointers with reference counts: a branch that no
survivor needs goes at once, as does a survivor that another one beats whatever follows, chains are held as one string, and as soon as all survivors
share an ancestor the edits up to it are final and are given out.  Equal costs are decided by
the whole edits since the survivors' last common ancestor.  What is held is thus the
unresolved part, one byte an edit, and no text: every survivor carries the running digest of
its own repaired turns.

Faults are found beside it by Spark: repeated turns by an aggregation over (conversation,
role, digest of the text), never by a set held for a conversation.
"""

from __future__ import annotations

import hashlib
from collections import deque
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SYSTEM, USER, ASSISTANT = range(4)
#: State -> role initial -> state.
LEGAL = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: State -> (role, state) of the turn that may be put in or made of another.
FILL = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
FINAL = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Output columns of text are passed on in batches of about so many bytes or rows.
OUT_BYTES, OUT_ROWS = 4 << 20, 2000

_NOT_BLANK, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def _inserts(state: int) -> list[tuple[int, str]]:
    """(state, edits) that inserts alone reach at a cost that can pay: no state twice."""
    out = [(state, "")]
    while (after := FILL[out[-1][0]][1]) not in [s for s, _ in out]:
        out.append((after, out[-1][1] + "I"))
    return out


INSERTS = [_inserts(s) for s in range(4)]
#: (state, other): what the rest costs at most more from ``state`` than from ``other``, whatever
#: follows.  Inserts lead from one to the other; before any turn all is legal that is legal
#: between pairs, and there only a system turn more, which can be deleted instead.
SLACK = {
    (ASSISTANT, SYSTEM): 0, (ASSISTANT, START): DELETE, (ASSISTANT, USER): INSERT, (USER, ASSISTANT): INSERT, (USER, SYSTEM): INSERT, (USER, START): INSERT + DELETE,
    (START, ASSISTANT): 0, (START, SYSTEM): 0, (START, USER): INSERT, (SYSTEM, USER): INSERT, (SYSTEM, ASSISTANT): 2 * INSERT,
}


class _Node:
    """A string of edits after those of ``up``; ``refs`` counts children and survivors."""

    __slots__ = ("up", "edits", "refs")

    def __init__(self, up, edits: bytes, refs: int = 1):
        self.up, self.edits, self.refs = up, bytearray(edits), refs


class _Survivor:
    __slots__ = ("cost", "node", "digest", "turns")

    def __init__(self, cost, node, digest, turns):
        self.cost, self.node, self.digest, self.turns = cost, node, digest, turns


def _path(node: _Node, root: _Node) -> list:
    out = []
    while node is not root:
        out.append(node.edits)
        node = node.up
    return out[::-1]


def _less(a: list, b: list) -> bool:
    """Whether the joined strings of ``a`` come before those of ``b``, read until they differ."""
    i = j = x = y = 0
    while True:
        while i < len(a) and x == len(a[i]):
            i, x = i + 1, 0
        while j < len(b) and y == len(b[j]):
            j, y = j + 1, 0
        if i == len(a) or j == len(b):
            return i == len(a) and j < len(b)
        if a[i] is b[j] and x == y:
            x = y = len(a[i])
            continue
        n = min(len(a[i]) - x, len(b[j]) - y, 4096)
        left, right = a[i][x : x + n], b[j][y : y + n]
        if left != right:
            return left < right
        x, y = x + n, y + n


class Trellis:
    """The survivors of one conversation; ``turn`` and ``close`` return the edits that became final."""

    def __init__(self):
        self.root = _Node(None, b"", 1)
        self.alive = {START: _Survivor(0, self.root, hashlib.sha256(), 0)}

    def _best(self, offers: dict, state: int, cost: int, survivor: _Survivor, edits: str, source: int) -> None:
        old = offers.get(state)
        if old is None or cost < old[0]:
            offers[state] = (cost, survivor, edits, source)
        elif cost == old[0] and _less([*_path(survivor.node, self.root), edits.encode()], [*_path(old[1].node, self.root), old[2].encode()]):
            offers[state] = (cost, survivor, edits, source)

    @staticmethod
    def _written(survivor: _Survivor, state: int, edits: str, role: str, text: str) -> tuple:
        """The survivor's digest and number of turns after ``edits`` from ``state``."""
        digest, turns = survivor.digest, survivor.turns
        if edits != "D":
            digest = digest.copy()
        for edit in edits:
            if edit == "D":
                continue
            if edit == "K":
                line = f"{role}:{text}"
                state = LEGAL[state][role[:1]]
            else:
                filled, state = FILL[state]
                line = f"{filled}:{text}" if edit == "R" else f"{filled}:"
            digest.update(("\n" if turns else "").encode() + line.encode("utf-8", "surrogatepass"))
            turns += 1
        return digest, turns

    def turn(self, role: str, text: str, unusable: bool, truncated: bool) -> bytes:
        """One more turn; ``unusable`` ones can only be deleted."""
        offers: dict[int, tuple] = {}
        kept = TRUNCATED * truncated
        for source, survivor in self.alive.items():
            for state, before in INSERTS[source]:
                cost = survivor.cost + INSERT * len(before)
                self._best(offers, state, cost + DELETE, survivor, before + "D", source)
                if not unusable:
                    if role[:1] in LEGAL[state]:
                        self._best(offers, LEGAL[state][role[:1]], cost + kept, survivor, before + "K", source)
                    if FILL[state][0] != role:
                        self._best(offers, FILL[state][1], cost + REROLE + kept, survivor, before + "R", source)
        old, self.alive = self.alive, {}
        for state, (cost, survivor, edits, source) in offers.items():
            if any(other != state and offers[other][0] + SLACK.get((other, state), cost) < cost for other in offers):
                continue  # whatever follows, another one's end is cheaper
            survivor.node.refs += 1
            self.alive[state] = _Survivor(cost, _Node(survivor.node, edits.encode()), *self._written(survivor, source, edits, role, text))
        for survivor in old.values():
            self._release(survivor.node)
        return self._settle()

    def _release(self, node: _Node) -> None:
        node.refs -= 1
        while not node.refs and node is not self.root:
            node = node.up
            node.refs -= 1

    def _settle(self) -> bytes:
        """Chains become one node; what all survivors share is given out."""
        for s in self.alive.values():
            while s.node is not self.root and s.node.up is not self.root and s.node.up.refs == 1:
                up = s.node.up
                up.edits += s.node.edits
                s.node = up
            node = s.node
            while node is not self.root and node.up is not self.root:
                if node.up.refs == 1:
                    node.edits, node.up = node.up.edits + node.edits, node.up.up
                else:
                    node = node.up
        out = bytearray()
        while self.root.refs == 1:
            node = next(iter(self.alive.values())).node
            if node is self.root:
                break
            while node.up is not self.root:
                node = node.up
            out += node.edits
            node.up, node.edits, self.root = None, bytearray(), node
        return bytes(out)

    def unresolved(self) -> int:
        """Bytes of edits that are held."""
        nodes = {}
        for s in self.alive.values():
            node = s.node
            while node is not self.root:
                nodes[id(node)] = node
                node = node.up
        return sum(len(n.edits) for n in nodes.values())

    def close(self) -> tuple[bytes, int, str]:
        """(last edits, cost, digest of the repaired turns) at the end of the conversation."""
        offers: dict[int, tuple] = {}
        for source, survivor in self.alive.items():
            for state, before in INSERTS[source]:
                if state in FINAL:
                    self._best(offers, 0, survivor.cost + INSERT * len(before), survivor, before, source)
        cost, survivor, edits, source = offers[0]
        digest, _ = self._written(survivor, source, edits, "", "")
        return b"".join(_path(survivor.node, self.root)) + edits.encode(), cost, digest.hexdigest()


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): every row with its damage by crc32(conv_id:turn) % 20.

    0 drops it (copies 0), 1 empties the text, 2 takes ``.!?`` out of it, 3 repeats it
    (copies 2), 4 makes it a user's.  Nulls are one space in texts, roles and the key.
    """
    c = {name: F.col(col) for name, col in (("conv_id", id_col), ("turn", turn_col), ("role", role_col), ("text", text_col))}
    text = lambda x: F.coalesce(x.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text(c["conv_id"]), F.lit(":"), text(c["turn"])).cast("binary")) % 20
    rows = conversations.select(c["conv_id"].alias("conv_id"), c["turn"].alias("turn"), text(c["role"]).alias("role"), text(c["text"]).alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """As ``damaged``, every row as it is."""
    text = lambda x: F.coalesce(F.col(x), F.lit(" "))
    return conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), F.lit(1).alias("copies"))


def _ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with their faults, a conversation's in one partition and in order.

    ``again`` says that role and text stand at an earlier turn; rows that are equal at one turn
    (in order by role and text) are told apart where they pass.
    """
    rows = rows.withColumn("digest", F.sha2("text", 256))
    first = rows.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max(F.col("turn").isNull()).alias("first_null")).where("n > 1")
    f = first.select(F.col("conv_id").alias("f_id"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest"), "first_turn", "first_null")
    marked = rows.join(f, F.col("conv_id").eqNullSafe(F.col("f_id")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest")), "left")
    later = F.when(F.col("first_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first_turn"))
    slim = marked.select(
        "conv_id", "turn", "role", "text", "copies", F.coalesce(later, F.lit(False)).alias("again"),
        (~F.col("text").rlike(_NOT_BLANK)).alias("blank"), (~F.col("text").rlike(_ENDED)).alias("open_end"),
    )
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


class _Conversation:
    """Counts and trellis of the conversation that passes."""

    def __init__(self, key):
        self.key, self.trellis, self.audit = key, Trellis(), bytearray()
        self.low = self.high = self.turn = self.last = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = ""

    def row(self, turn, role, text, copies, again, blank, open_end) -> bytes:
        """Takes a row in; the edits that became final."""
        out = b""
        same = self.last == (turn, role, text)
        for _ in range(copies):
            if turn is not None and turn != self.turn:
                self.turn, self.high, self.distinct = turn, turn, self.distinct + 1
                self.low = turn if self.low is None else self.low
            pair = self.initial + role[:1]
            self.illegal += self.last is not None and pair not in ("su", "ua", "au")
            repeated = not blank and (again or same)
            cut = not blank and not repeated and open_end
            self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + repeated, self.truncated + cut
            out += self.trellis.turn(role, text, blank or repeated, cut)
            self.initial, self.last, same = role[:1], (turn, role, text), True
        return out

    def result(self) -> dict:
        last, cost, digest = self.trellis.close()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {
            "conv_id": self.key, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.illegal, "cost": cost, "audit": (bytes(self.audit) + last).decode(), "repaired_sha256": digest,
        }


def _batches(rows, schema: pa.Schema):
    """Row dictionaries in batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, str))
        if size > OUT_BYTES or len(held) >= OUT_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _passing(batches):
    """(conversation, its row or None at its end) of sorted rows."""
    now = None
    for batch in batches:
        for k in range(0, batch.num_rows, 256):  # few whole texts at a time
            for row in zip(*(batch.column(c).slice(k, 256).to_pylist() for c in range(batch.num_columns))):
                if now is None or now.key != row[0]:
                    if now is not None:
                        yield now, None
                    now = _Conversation(row[0])
                yield now, row[1:]
    if now is not None:
        yield now, None


def _streamed(batches, fields: list, results):
    """What ``results`` makes of passing rows, as batches; the id keeps its type."""
    first = next(batches, None)
    if first is not None:
        yield from _batches(results(_passing(chain([first], batches))), pa.schema([("conv_id", first.schema.field(0).type), *fields]))


_FIELDS = [*((name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_KINDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``damaged`` or ``undamaged`` rows: faults, cost, edits and digest.

    A null id is a conversation like others.  Null turns come first and have no gaps; turns
    that are equal go by role and text, so the result has one order.  A row's first fault of
    blank, repeated and cut off counts.  Of edits of equal cost those least in ASCII are taken.
    Conversations whose rows were all dropped have zeros, no edits and the digest of nothing;
    an empty table gives none; further columns are ignored.  Very long texts and conversations
    pass as they come: the digest of a whole conversation is a chain, so one task takes its
    turns one by one and holds none of them.
    """

    def results(passing):
        for conversation, row in passing:
            if row is None:
                yield conversation.result()
            else:
                conversation.audit += conversation.row(*row)

    return _ordered(rows).mapInArrow(lambda it: _streamed(it, _FIELDS, results), f"conv_id {dict(rows.dtypes)['conv_id']}, {_KINDS}")


_STEPS = [("step", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string())]


def edit_script(rows: DataFrame) -> DataFrame:
    """(conv_id, step, edit, turn, role): every edit in order, given out as it becomes final.

    ``edit`` is keep, rerole, delete or insert; ``turn`` is that of the row it is of (null for
    an insert), ``role`` the role after it (null for a deletion).  Cases as in ``repair_report``.
    """
    names = {"K": "keep", "R": "rerole", "D": "delete", "I": "insert"}

    def results(passing):
        held: deque = deque()
        state, step = START, 0
        for conversation, row in passing:
            if row is None:
                edits = conversation.trellis.close()[0]
            else:
                held.extend([row[:2]] * row[3])
                edits = conversation.row(*row)
            for e in edits.decode():
                turn, role = (None, None) if e == "I" else held.popleft()
                if e == "D":
                    role = None
                elif e == "K":
                    state = LEGAL[state][role[:1]]
                else:
                    role, state = FILL[state]
                yield {"conv_id": conversation.key, "step": step, "edit": names[e], "turn": turn, "role": role}
                step += 1
            if row is None:
                state, step = START, 0

    return _ordered(rows).mapInArrow(lambda it: _streamed(it, _STEPS, results), f"conv_id {dict(rows.dtypes)['conv_id']}, step long, edit string, turn long, role string")


def repair_sql() -> str:
    """The result over damaged conversations in DuckDB SQL: all states of all conversations, a turn at a time."""
    moves = []
    for q in range(4):
        for state, before in INSERTS[q]:
            lines, at = [], q
            for _ in before:
                lines, at = [*lines, FILL[at][0] + ":"], FILL[at][1]
            cost = INSERT * len(before)
            moves.append((q, state, before + "D", cost + DELETE, "D", "", "", lines))
            moves += [(q, to, before + "K", cost, "K", initial, "", lines) for initial, to in LEGAL[state].items()]
            moves.append((q, FILL[state][1], before + "R", cost + REROLE, "R", "", FILL[state][0], lines))
    ends = []
    for q in range(4):
        for state, before in INSERTS[q]:
            lines, at = [], q
            for _ in before:
                lines, at = [*lines, FILL[at][0] + ":"], FILL[at][1]
            if state in FINAL:
                ends.append((q, before, INSERT * len(before), lines))
    lit = lambda x: str(x) if isinstance(x, int) else f"'{x}'" if isinstance(x, str) else "[" + ", ".join(map(lit, x)) + "]::VARCHAR[]"
    values = lambda rows: ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    crc = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
    return f"""
    WITH RECURSIVE keyed AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS k FROM conversations),
    hurt AS (SELECT c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM keyed),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
    told AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open_end,
      lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) || substr(role, 1, 1) AS pair FROM ordered),
    rows AS MATERIALIZED (SELECT c, i, turn, role, text, pair, blank, again AND NOT blank AS dup, open_end AND NOT blank AND NOT again AS cut FROM told),
    moves(q, q2, edits, cost, edit, initial, fill, lines) AS (VALUES {values(moves)}),
    ends(q, edits, cost, lines) AS (VALUES {values(ends)}),
    v(c, i, q, cost, audit, lines) AS (
      SELECT DISTINCT c, 0::BIGINT, 0, 0::BIGINT, '', []::VARCHAR[] FROM keyed
      UNION ALL
      SELECT c, any_value(i), q2, min(o.cost), min(o).audit, arg_min(lines, o) FROM (
        SELECT v.c, v.i + 1 AS i, m.q2, {{'cost': v.cost + m.cost + CASE WHEN r.cut AND m.edit <> 'D' THEN {TRUNCATED} ELSE 0 END, 'audit': v.audit || m.edits}} AS o,
          v.lines || m.lines || CASE m.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [m.fill || ':' || r.text] END AS lines
        FROM v JOIN rows r ON r.c = v.c AND r.i = v.i + 1 JOIN moves m ON m.q = v.q
        WHERE m.edit = 'D' OR NOT (r.blank OR r.dup) AND (m.edit = 'K' AND substr(r.role, 1, 1) = m.initial OR m.edit = 'R' AND m.fill <> r.role)) GROUP BY c, q2),
    faults AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM rows GROUP BY c),
    done AS (SELECT c, min(o).cost AS cost, min(o).audit AS audit, arg_min(lines, o) AS lines FROM (
      SELECT v.c, {{'cost': v.cost + e.cost, 'audit': v.audit || e.edits}} AS o, v.lines || e.lines AS lines FROM v LEFT JOIN faults f ON f.c = v.c JOIN ends e ON e.q = v.q WHERE v.i = coalesce(f.n, 0)) GROUP BY c)
    SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
      cost::BIGINT AS cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
    FROM (SELECT DISTINCT c, conv_id FROM keyed) k JOIN done USING (c) LEFT JOIN faults USING (c)
    """
