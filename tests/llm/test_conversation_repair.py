import hashlib
import random
import re
import zlib
from itertools import product

from matchloom.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """(cost, audit, repaired) by trying every edit of every turn and inserts between, shortest first.

    ``turns``: (role, text, unusable, cut)."""
    best = None
    for edits in product("KRuRaD", repeat=0) if not turns else product(*[["D"] if u else ["K", "Ru", "Ra", "D"] for _, _, u, _ in turns]):
        kept = [(role if e == "K" else {"u": "user", "a": "assistant"}[e[1]], text) if e != "D" else None for e, (role, text, _, _) in zip(edits, turns)]
        base = sum({"K": 0, "R": 2, "D": 3}[e[0]] + (e != "D" and cut) for e, (_, _, _, cut) in zip(edits, turns))
        for gaps in product(("", "u", "a", "ua", "au"), repeat=len(turns) + 1):
            cost = base + 2 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            seq, audit = [], ""
            for k in range(len(turns) + 1):
                seq += [("user" if g == "u" else "assistant", "") for g in gaps[k]]
                audit += "I" * len(gaps[k])
                if k < len(turns):
                    audit += edits[k][0]
                    seq += [kept[k]] if kept[k] else []
            if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in seq)):
                best = min(best or (cost, audit, seq), (cost, audit, seq), key=lambda b: b[:2])
    return best


def plain(rows):
    out = {}
    for conv_id, turn, role, text in rows:
        turns = out.setdefault(conv_id, [])
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        turns += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    done = []
    for conv_id, turns in out.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, said, n = set(), [], {"b": 0, "d": 0, "t": 0}
        for _, role, text in turns:
            blank = not re.search(r"[^\x20\x09-\x0D]", text)
            again = not blank and (role, text) in seen
            cut = not blank and not again and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
            seen.add((role, text))
            n["b"], n["d"], n["t"] = n["b"] + blank, n["d"] + again, n["t"] + cut
            said.append((role, text, blank or again, cut))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        done.append((conv_id, gaps, n["b"], n["d"], n["t"], illegal, said))
    return done


def results(df):
    return sorted((tuple(r[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()), key=str)


def sample(n, seed, most=4):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "and then", "", "  \t", "Why?  ", "a.b", None, "é"]
    for c in range(n):
        for t in range(rng.randrange(1, most + 1)):
            yield c, None if rng.random() < 0.05 else t + (rng.random() < 0.1), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None]), rng.choice(texts)


def expected(rows):
    out = []
    for *faults, said in plain(rows):
        cost, audit, seq = cheapest(said)
        out.append((*faults, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in seq).encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_all_edits_tried(spark):
    rows = list(sample(90, 1, 3))
    assert results(R.repair_report(R.damaged(spark.createDataFrame(rows, SCHEMA).repartition(4)))) == expected(rows)


def dynamic(said):
    """All paths' best by state, with whole strings: (cost, audit, lines)."""
    alive = {0: (0, "", ())}
    for role, text, unusable, cut in said:
        new = {}
        for q, (cost, audit, lines) in alive.items():
            for state, before in R.INSERTS[q]:
                at, more = q, lines
                for _ in before:
                    more, at = (*more, R.FILL[at][0] + ":"), R.FILL[at][1]
                offers = [(state, "D", 3, ())]
                if not unusable:
                    if role[:1] in R.LEGAL[state]:
                        offers.append((R.LEGAL[state][role[:1]], "K", cut, (f"{role}:{text}",)))
                    offers.append((R.FILL[state][1], "R", 2 + cut, (f"{R.FILL[state][0]}:{text}",)))
                for to, e, c, line in offers:
                    offer = (cost + 2 * len(before) + c, audit + before + e, (*more, *line))
                    if to not in new or offer[:2] < new[to][:2]:
                        new[to] = offer
        alive = new
    ends = []
    for q, (cost, audit, lines) in alive.items():
        for state, before in R.INSERTS[q]:
            if state in R.FINAL:
                at, more = q, lines
                for _ in before:
                    more, at = (*more, R.FILL[at][0] + ":"), R.FILL[at][1]
                ends.append((cost + 2 * len(before), audit + before, more))
    return min(ends, key=lambda e: e[:2])


def test_long_conversations_give_out_edits_and_hold_little():
    rng = random.Random(3)
    for roles, held in ((None, 60), (["user", "assistant", "system", "x"], 150), (["user"], None), (["user", "user", "assistant"], 150)):
        # Without roles: turns in order, where one in ten is damaged.
        said = [(rng.choice(roles) if roles else ("user", "assistant")[(k + (rng.random() < 0.05)) % 2], f"t{k}.", rng.random() < 0.05, rng.random() < 0.2) for k in range(1500)]
        trellis, out, most = R.Trellis(), b"", 0
        for role, text, unusable, cut in said:
            out += trellis.turn(role, text, unusable, cut)
            nodes = set()
            for s in trellis.alive.values():
                node = s.node
                while node is not trellis.root:
                    nodes.add(id(node))
                    node = node.up
            assert len(nodes) <= 7
            most = max(most, trellis.unresolved())
        early = len(out)
        last, cost, digest = trellis.close()
        want = dynamic(said)
        assert (cost, (out + last).decode(), digest) == (want[0], want[1], hashlib.sha256("\n".join(want[2]).encode()).hexdigest())
        if held:
            assert most < held and early > 1200


def test_edit_script_says_the_audit(spark):
    df = spark.createDataFrame(list(sample(60, 7, 8)), SCHEMA)
    audits = {r.conv_id: r.audit for r in R.repair_report(R.undamaged(df)).collect()}
    steps = {}
    for r in sorted(R.edit_script(R.undamaged(df)).collect(), key=lambda r: (r.conv_id, r.step)):
        steps.setdefault(r.conv_id, []).append(r)
    for conv_id, audit in audits.items():
        own = steps.get(conv_id, [])
        assert "".join(r.edit[0].upper() for r in own) == audit
        assert LEGAL.fullmatch("".join(r.role[0] for r in own if r.role))


def test_nulls_ties_repeats_long_and_empty(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (None, 1, "user", "a."), (1, 5, "user", "x" * 3_000_00 + "."), (1, 6, "assistant", "b"), (2, 3, "assistant", "b."), (2, 3, "user", "a."), (3, 0, "", "é.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as copies", "2 as digest", "3 as again", "4 as kind")
    assert results(R.repair_report(R.damaged(df))) == expected(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert R.repair_report(R.damaged(empty)).collect() == [] and R.edit_script(R.undamaged(empty)).collect() == []
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert results(R.repair_report(R.damaged(spark.createDataFrame([(dropped, 0, "user", "a.")], SCHEMA)))) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_conversation_of_most_rows(spark):
    rng = random.Random(9)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"{rng.randrange(40)}.") for k in range(3000)] + list(sample(30, 11, 6))
    want = {}
    for conv_id, *faults, said in plain(rows):
        cost, audit, lines = dynamic(said)
        want[conv_id] = (conv_id, *faults, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert results(R.repair_report(R.damaged(spark.createDataFrame(rows, SCHEMA).repartition(6)))) == sorted(want.values(), key=str)
