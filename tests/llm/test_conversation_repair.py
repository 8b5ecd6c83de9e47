"""Conversation repair against an exhaustive search of edits."""

import hashlib
import random
import re
import zlib

import pytest

from thermoflux.llm import conversation_repair as cr

BLANKS = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(BLANKS)
        out.append(cr.BLANK if not body else cr.DUPLICATE if (role, text) in seen else cr.TRUNCATED if body[-1] not in ".!?" else cr.NONE)
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """Least (cost, audit, turns) of all edits that leave initials matching the pattern, by trying them all."""
    best = None

    def go(i, roles, cost, audit, out, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if not re.match(r"s?(ua)*u?$", roles):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            best = min(best or (cost, audit, out), (cost, audit, out))
        if inserted < 2:
            for role in ("user", "assistant"):
                go(i, roles + role[0], cost + 5, audit + "I", (*out, (role, "")), inserted + 1)
        if i < len(rows):
            role, text = rows[i]
            go(i + 1, roles, cost + 2, audit + "D", out, 0)
            if fault[i] in (cr.NONE, cr.TRUNCATED):
                more = 5 if fault[i] == cr.TRUNCATED else 0
                if role:
                    go(i + 1, roles + role[0], cost + more, audit + "K", (*out, (role, text)), 0)
                for new in ("user", "assistant"):
                    go(i + 1, roles + new[0], cost + 1 + more, audit + "R", (*out, (new, text)), 0)

    go(0, "", 0, "", (), 0)
    return best


@pytest.mark.parametrize("width", [8, cr.WIDTH])
def test_repair_is_the_cheapest(width):
    rng = random.Random(width)
    for k in range(300):
        roles = ["system", "user", "assistant", "tool", ""] if k % 2 else ["user", "assistant", "user", "assistant", "system"]
        rows = [(rng.choice(roles), rng.choice(["a.", "b!", "c", "", f"{k}?"])) for _ in range(rng.randint(0, 6))]
        fault, edits, turns = faults(rows), [], []

        def emit(letter, role, text, edits=edits, turns=turns):
            edits.append(letter)
            if role is not None:
                turns.append((role, text))

        repair = cr.Repair(emit)
        repair.width = width
        for row, f in zip(rows, fault, strict=True):
            repair.add(*row, f)
        assert (repair.finish(), "".join(edits), tuple(turns)) == cheapest(rows, fault)


def test_long_conversation_is_not_held():
    rng, out = random.Random(1), [0]

    def emit(letter, role, text):
        out[0] += 1

    repair, most = cr.Repair(emit), 0
    for k in range(20_000):
        repair.add(rng.choice(["user", "assistant"]) if k % 7 == 0 else ("user", "assistant")[k % 2], "x.", cr.NONE)
        most = max(most, len(repair.pending))
    repair.finish()
    assert out[0] >= 20_000 and most < 500 and repair.width <= 4 * cr.WIDTH


ROWS = [
    (1, 0, "user", "Hello."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 5, "user", "And?"), (1, None, "system", "Be kind."), (1, 7, "assistant", "cut of"),
    (2, 0, None, None), (2, 0, "user", "same turn."), (2, 0, "assistant", "same turn."),
    (None, 3, "user", "no id."), (None, None, "assistant", "no turn."), (3, None, None, None),
    (4, 0, "user", " \n\t"), (5, 0, "", "no role."), (6, 2, "assistant", "a. " * 50_000), (6, 4, "assistant", "b. " * 50_000 + "\n\n"),
    *[(7, t, ("user", "assistant")[t % 2], f"turn {t}{'.' if t % 5 else ''}") for t in range(60)],
    *[(k, 0, "user", "one.") for k in range(100, 160)],
]


def test_summary_and_turns(spark):
    d = spark.createDataFrame([(*r, 1, "x", "y", 5) for r in ROWS], "conv_id long, turn long, role string, text string, fault int, audit string, dropped string, cost int")
    convs = {}
    for conv, turn, role, text in ROWS:
        kept = convs.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept += [(turn is not None, turn or 0, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    damaged = cr.damaged(d)
    got = {r["conv_id"]: r for r in cr.summary(damaged, dropped=damaged["dropped"]).collect()}
    turns = {}
    for r in cr.repaired(damaged, dropped=damaged["dropped"]).collect():
        turns.setdefault(r["conv_id"], {})[r["position"]] = f"{r['role']}:{r['text']}"
    assert set(got) == set(convs)
    for conv, kept in convs.items():
        kept.sort()
        rows = [(role, text) for _, _, role, text in kept]
        fault = faults(rows)
        r = got[conv]
        numbers = {t for there, t, _, _ in kept if there}
        assert r["gaps"] == (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0)
        assert (r["blank"], r["duplicate"], r["truncated"]) == tuple(fault.count(f) for f in (cr.BLANK, cr.DUPLICATE, cr.TRUNCATED))
        assert r["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        lines = [turns.get(conv, {})[k] for k in range(len(turns.get(conv, {})))]
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        if len(rows) < 8:
            cost, audit, want = cheapest(rows, fault)
            assert (r["cost"], r["audit"]) == (cost, audit) and lines == [f"{a}:{b}" for a, b in want]
    assert any(r["audit"] == "" and r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() for r in got.values())


def test_text_ids_and_empty_table(spark):
    d = spark.createDataFrame([("a", 0, "user", "x."), ("a", 1, "assistant", "y.")], "conv_id string, turn int, role string, text string")
    (row,) = cr.summary(d).collect()
    assert (row["conv_id"], row["cost"], row["audit"]) == ("a", 0, "KK")
    assert cr.summary(d.limit(0)).collect() == [] and cr.repaired(d.limit(0)).collect() == []
    assert cr.summary(d.withColumnRenamed("conv_id", "thread"), "thread").count() == 1


def test_one_shuffle_of_the_turns(spark):
    d = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    plan = cr.summary(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
