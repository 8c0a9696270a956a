import hashlib
import itertools
import random
import re
import zlib

import pytest

from sondage.llm import turn_repair as t

ROWS = "conv_id long, turn long, role string, text string, fault string, rows int"
BLANKS = " \t\n\x0b\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")):
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(turn, "user" if way == 4 else role, text)] * {0: 0, 3: 2}.get(way, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(BLANKS)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, flags):
    """Every way to edit up to three rows, with up to two inserts in each gap."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    choices = []
    for (_, role, text), fault in zip(rows, flags, strict=True):
        more = fault == "truncated"
        ways = [(3, "D", None)]
        if fault not in ("blank", "duplicate"):
            ways += [(more, "K", (role, text)), (2 + more, "R", ("user", text)), (2 + more, "R", ("assistant", text))]
        choices.append(ways)
    names = {"u": "user", "a": "assistant"}
    for put in itertools.product(gaps, repeat=len(rows) + 1):
        if best and 2 * len("".join(put)) > best[0]:
            continue
        for edits in itertools.product(*choices):
            out, audit, cost = [], "", 2 * len("".join(put))
            for gap, edit in itertools.zip_longest(put, edits):
                out += [(names[x], "") for x in gap]
                audit += "I" * len(gap)
                if edit:
                    cost, audit, out = cost + edit[0], audit + edit[1], out + [edit[2]] * (edit[2] is not None)
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def sha(messages):
    return hashlib.sha256("\n".join(f"{r}:{x}" for r, x in messages).encode()).hexdigest()


def whole(rows):
    rows = damaged(rows)
    flags = faults(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    first = [r[1][:1] for r in rows]
    counts = [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(flags.count(f) for f in ("blank", "duplicate", "truncated"))]
    cost, audit, messages = cheapest(rows, flags)
    return (*counts, sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False)), cost, audit, sha(messages))


def talks(seed, n, most):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for _ in range(rng.randrange(0, most + 1)):
            turn = rng.choice([None, 0, 1, 2, 3, 5, 9])
            text = rng.choice(["Hi.", "Hi.", "why?", "cut off", "so!  \n", " ", "", None, "x ", "no end\u0085", "é"])
            out.append((conv if conv else None, turn, rng.choice(["user", "assistant", "assistant", "system", "tool", "", None, "ärger"]), text))
    return out


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS).repartition(5)
    return {r.conv_id: tuple(r)[1:] for r in t.digest(df).collect()}


@pytest.mark.parametrize("block", [256, 1, 2])
def test_as_every_way_of_editing(spark, monkeypatch, block):
    monkeypatch.setattr(t, "BLOCK", block)
    rows = talks(block, 150, 3)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    want = {c: whole(rs) for c, rs in by.items() if len(damaged(rs)) <= 3}
    found = got(spark, rows)
    assert set(found) == set(by) and len(want) > 80
    assert {c: found[c] for c in want} == want


def test_blocks_change_nothing(spark, monkeypatch):
    rows = talks(5, 12, 60)
    whole_ = got(spark, rows)
    monkeypatch.setattr(t, "BLOCK", 7)
    assert got(spark, rows) == whole_


def test_a_long_conversation_and_awkward_tables(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(6000)]
    found = got(spark, rows)[1]
    assert set(found[6]) <= set("DIKR") and found[5] > 0
    ways = [zlib.crc32(f"1:{i}".encode()) % 20 for i in range(6000)]
    assert found[0] <= ways.count(0) and found[1:4] == (ways.count(1), ways.count(3), ways.count(2))
    big = [(2, 0, "user", "a " * 200_000 + "."), (2, 1, "assistant", "b" * 500_000)]
    assert got(spark, big)[2] == whole(big)
    dropped = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(spark, [(dropped, 0, "user", "Hi.")]) == {dropped: empty}
    assert t.digest(spark.createDataFrame([], ROWS)).count() == 0


def test_operator_gives_messages(spark):
    rows = [(3, 0, "system", "Be brief.", "x", 1), (3, 1, "assistant", "Yes.", "x", 1), (3, 2, "assistant", "Yes.", "x", 1)]
    r = t.repaired(t.flagged(spark.createDataFrame(rows, ROWS))).first()
    assert (r.cost, r.edits.translate(str.maketrans("JS", "IR"))) == (5, "KIKD")
    assert [(m.role, m.text) for m in r.messages] == [("system", "Be brief."), ("user", ""), ("assistant", "Yes.")]
