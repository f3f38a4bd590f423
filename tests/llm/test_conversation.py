"""Conversation repair: all edit strings tried on small conversations, blocks against whole conversations, edges."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from driftwise.llm import conversation
from driftwise.llm.common import table
from driftwise.llm.conversation import Audit, Rows, finish, less
from tests.conftest import MEDIUM

SCHEMA = "conv_id long, turn long, role string, text string"


def lines_of(rows, edits):
    """Roles and lines that a string of edits makes, or None if it can't be applied; new roles are tried by the caller."""
    out, it = [], iter(rows)
    for e, new in edits:
        if e == "I":
            out.append((new, ""))
            continue
        role, text = next(it)
        if e != "D":
            out.append((role if e == "K" else new, text))
    return out


def brute(rows):
    """(cost, audit, lines) by trying every string of edits with up to two inserts in a gap."""
    seen, each = set(), []
    for role, text in rows:
        end = text.rstrip(conversation.SPACE)
        bad = not end or (role, text) in seen
        more = 3 * (not bad and end[-1] not in ".!?")
        seen.add((role, text))
        options = [(4, [("D", None)])]
        if not bad:
            options += [(more, [("K", None)])] + [(3 + more, [("R", r)]) for r in ("user", "assistant")]
        each.append(options)
    gaps = [(3 * k, [("I", r) for r in rs]) for k in range(3) for rs in itertools.product(("user", "assistant"), repeat=k)]
    best = None
    for choice in itertools.product(*([gaps] + [x for o in each for x in (o, gaps)])):
        cost, edits = sum(c for c, _ in choice), [e for _, es in choice for e in es]
        audit = "".join(e for e, _ in edits)
        if best and (cost, audit) >= best[:2]:
            continue
        out = lines_of(rows, edits)
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
            best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return best


def dp(rows):
    held, seen = Rows(), set()
    for role, text in rows:
        end = text.rstrip(conversation.SPACE)
        held.add(None, role, text, 1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0)
        seen.add((role, text))
    cost, node, last = finish(held.run(0))
    audit = str(node) + last
    return cost, audit, "\n".join(conversation.repaired(audit, rows, 0))


@pytest.mark.parametrize("seed", range(40))
def test_audit_is_the_best_of_all_edit_strings(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["user", "assistant", "system", "tool", " "]), rng.choice(["a.", "b.", "c", "", "d!"])) for _ in range(rng.randint(0, 3))]
    assert dp(rows) == brute(rows)


def test_equal_hashes_are_verified(monkeypatch):
    rng = random.Random(5)
    cases = [[(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "c.", "d?"])) for _ in range(40)] for _ in range(20)]
    want = [dp(c) for c in cases]
    monkeypatch.setattr(conversation, "_PRIME", 1)  # every hash is 0
    assert [dp(c) for c in cases] == want


def test_order_of_audits_is_that_of_their_strings():
    rng = random.Random(2)
    root = Audit()
    for _ in range(200):
        stem = root
        for _ in range(rng.randint(0, 70)):
            stem = Audit(stem, rng.choice(["K", "D", "IK"]))
        a = b = stem
        for _ in range(rng.randint(0, 9)):
            a, b = Audit(a, rng.choice(["K", "D", "IR"])), Audit(b, rng.choice(["K", "D", "IR"]))
        assert less(a, b) == (str(a) < str(b)) and len(str(a)) >= a.depth


def python_damage(rows):
    """Damaged rows of a conversation, by plain Python."""
    out = []
    def sp(v): return " " if v is None else str(v)
    for c, t, r, x in sorted(rows, key=lambda q: (q[1] is not None, q[1] or 0, sp(q[2]), hashlib.sha256(sp(q[3]).encode()).hexdigest())):
        code, role, text = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20, sp(r), sp(x)
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            out += [(t, "user" if code == 4 else role, text)] * (1 + (code == 3))
    return out


def expected(rows):
    got = {}
    for r in rows:
        got.setdefault(r[0], []).append(tuple(r))
    out = []
    for c, rs in got.items():
        after = python_damage(rs)
        turns = {t for t, _, _ in after if t is not None}
        seen, counts = set(), [0, 0, 0]
        for _, role, text in after:
            end = text.rstrip(conversation.SPACE)
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        cost, audit, text = dp([x[1:] for x in after])
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_python(spark):
    rows = table(spark, MEDIUM, "conversations")
    assert collected(conversation.repair(rows)) == expected(rows.select("conv_id", "turn", "role", "text").collect())


def test_edges_whole_and_in_blocks(spark):
    rng = random.Random(9)
    rows = [(None, None, None, None), (None, 3, "user", "x."), (1, None, "user", None), (1, 2, None, "a."), (1, 2, "user", "a."), (1, 2, "user", "a."),
            (2, 0, "system", "s."), (2, 1, "", "?"), (3, 5, "user", "long " * 200_000 + "."), (3, 6, "assistant", " \t\n"), (4, -3, "s", "."), (4, 9, "u", "!")]
    rows += [(7, rng.choice([None, *range(60)]), rng.choice(["user", "assistant", "system", None]), rng.choice(["a.", "b", "", None, "c!", f"{i}."])) for i in range(300)]
    rows += [(8, 1, "user", "again.")] * 50 + [(c, t, "user", "t.") for c in range(100, 130) for t in range(2)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", key long, again string")
    want = expected(rows)
    assert collected(conversation.repair(df)) == want
    assert collected(conversation.repair(df, block_rows=3)) == want
    assert collected(conversation.repair(df, block_bytes=1)) == want
    assert conversation.repair(df.limit(0)).collect() == []


def test_conversation_dropped_whole(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = conversation.repair(spark.createDataFrame([(gone, 0, "user", "hi.")], SCHEMA)).collect()[0]
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
