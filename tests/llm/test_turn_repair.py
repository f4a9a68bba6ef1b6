import hashlib
import heapq
import re
import zlib

import pytest

from millrace.llm.turn_repair import damage, digest, repair

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """Edits by a search for the cheapest path over (turn, initials so far), written independently of the operator."""
    by_conv = {}
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        turns = by_conv.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        turns += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        faults, seen = [], set()
        for _, _, role, text in turns:
            body = text.strip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = [t[1] for t in turns if t[0]]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [t[2][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        legal = lambda s: re.fullmatch("s?(ua)*u?", s) is not None
        heap, done = [(0, "", 0, "", ())], set()
        while heap:
            cost, audit, i, s, lines = heapq.heappop(heap)
            if i == len(turns) and re.fullmatch("(s?(ua)+)?", s):
                break
            state = (i, s[-1:])
            if state in done:
                continue
            done.add(state)
            push = lambda c, e, j, initial, line, at=(cost, audit, s, lines): legal(at[2] + initial) and heapq.heappush(heap, (at[0] + c, at[1] + e, j, at[2] + initial, at[3] + line))
            for role in ("user", "assistant"):
                push(2, "I", i, role[0], (f"{role}:",))
            if i < len(turns):
                _, _, own, text = turns[i]
                late = faults[i] == "truncated"
                push(3, "D", i + 1, "", ())
                if faults[i] in ("", "truncated"):
                    if own[:1] in ("s", "u", "a"):
                        push(late, "K", i + 1, own[0], (f"{own}:{text}",))
                    for role in ("user", "assistant"):
                        push(2 + late, "R", i + 1, role[0], (f"{role}:{text}",))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, int(cost), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


ROLES = ["system", "user", "assistant", "tool", "", None, "sys", "User", "u"]
TEXTS = ["Well.", "Well.", "no end", "", "  \n", None, "What? ", "a.b", "Ünd…", "x!" * 30]


@pytest.fixture(scope="module")
def rows():
    import random

    r = random.Random(3)
    out = []
    for conv in [*range(60), None]:
        for turn in range(r.randint(1, 9)):
            n = None if r.random() < 0.1 else turn + r.choice([0, 0, 0, 1, 5])
            out.append((conv, n, r.choice(ROLES), r.choice(TEXTS) if r.random() < 0.5 else f"text {r.random()}."))
    out += [(70, None, "user", "Hi."), (70, None, "assistant", "Yes."), out[0], out[0]]
    out += [(80, t, ("user", "assistant")[t % 2], f"turn {t}." if t % 7 else "late") for t in range(150)]
    out += [(81, 1, "user", "long " * 200_000 + "."), (82, 2**40, "system", "x."), (82, -3, "user", "y.")]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return out + [(dropped, 0, "user", "Gone.")]


SCHEMA = "conv_id long, turn long, role string, text string, conv string, dropped int, nth string, fault double, initial int, audit string, copy int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "n", 0.5, 7, "a", 3) for r in rows], SCHEMA)


def test_against_search(spark, rows):
    found = {}
    result = repair(damage(frame(spark, rows).repartition(7)))
    for r in result.withColumn("h", digest(result.repaired)).collect():
        found[r.conv] = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.h)
    assert found == brute(rows)
    assert any("R" in x[6] for x in found.values()) and any("I" in x[6] for x in found.values()) and any("D" in x[6] for x in found.values())


def test_empty_table_and_dropped_conversation(spark):
    assert repair(damage(frame(spark, []))).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    r = repair(damage(frame(spark, [(dropped, 0, "user", "Gone.")]))).first()
    assert (r.gaps, r.blank, r.cost, r.audit, r.repaired) == (0, 0, 0, "", [])


def test_plan_is_native_and_exchanges_once(spark, rows):
    plan = repair(damage(frame(spark, rows)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
