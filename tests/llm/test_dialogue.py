import hashlib
import itertools
import random
import re
import zlib

import pytest

from modspark.llm.dialogue import NOTHING, cheapest, damaged, joined, packed, repair, repaired_after_damage, shortest, transcripts, unpacked

SHAPE = re.compile(r"(s?(ua)+)?")


def brute(symbols: str, most: int = 2) -> tuple[int, str]:
    """Every choice of an edit a row, and every way to put up to ``most`` rows in."""
    per_row = []
    for c in symbols:
        more = 5 if c.isupper() else 0
        options = [(2, "D", "")]
        if c != "-":
            options += [(more, "K", c.lower()), (1 + more, "R", "u"), (1 + more, "R", "a")]
        per_row.append(options)
    put = [[(5 * len(x), "I" * len(x), "".join(x)) for n in range(most + 1) for x in itertools.product("ua", repeat=n)]]
    layout = put + [x for options in per_row for x in (options, put[0])]
    best = None
    for way in itertools.product(*layout):
        if SHAPE.fullmatch("".join(w[2] for w in way)):
            got = (sum(w[0] for w in way), "".join(w[1] for w in way))
            best = got if best is None else min(best, got)
    return best


def test_cheapest_is_brute_force():
    rng = random.Random(1)
    for n in range(4):
        for _ in range(25):
            symbols = "".join(rng.choice("uasxUASX-") for _ in range(n))
            assert cheapest(symbols) == brute(symbols), symbols


def test_more_inserts_change_nothing():
    rng = random.Random(2)
    for _ in range(60):
        symbols = "".join(rng.choice("uuaasxUA-") for _ in range(rng.randrange(9)))
        for start in range(4):
            assert shortest(symbols, start) == shortest(symbols, start, inserts=5)


def test_runs_join_to_the_whole():
    rng = random.Random(3)
    for _ in range(60):
        symbols = "".join(rng.choice("uuaaasxUA-") for _ in range(rng.randrange(2, 30)))
        cut = sorted(rng.sample(range(len(symbols) + 1), 2))
        parts = [{(p, q): v for p in range(4) for q, v in shortest(s, p).items()} for s in (symbols[: cut[0]], symbols[cut[0] : cut[1]], symbols[cut[1] :])]
        whole = {(p, q): v for p in range(4) for q, v in shortest(symbols, p).items()}
        assert joined(joined(parts[0], parts[1]), parts[2]) == whole
        assert joined(parts[0], joined(parts[1], parts[2])) == whole


def test_weights_order_by_cost_then_audit():
    ways = [(c, "".join(a)) for c in range(3) for n in range(4) for a in itertools.product("DIKR", repeat=n)]
    assert sorted(ways) == sorted(ways, key=lambda w: packed(*w, 5))
    assert all(unpacked(packed(*w, 5), 5) == w for w in ways)


def plain(rows: list[tuple], originals: list) -> dict:
    """The whole contract in plain loops, by dictionaries and one table a conversation, without inserted rows."""
    kept = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        kept += [(conv, turn, role, text)] * (2 if how == 3 else 1)
    out = {}
    for conv in set(originals):
        own = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        turns = {r[1] for r in own if r[1] is not None}
        initials = [r[2][:1] for r in own]
        states = {"": (0, "", [])}  # last initial -> cost, audit, lines
        for (_, _, role, text), fault in zip(own, faults, strict=True):
            new: dict = {}
            more = 5 if fault == "truncated" else 0
            for last, (cost, audit, lines) in states.items():
                ways = [(last, cost + 2, audit + "D", lines)]
                if fault not in ("blank", "duplicate"):
                    want = "a" if last == "u" else "u"
                    if role[:1] == want or (role[:1] == "s" and last == ""):
                        ways.append((role[:1], cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                    ways.append((want, cost + 1 + more, audit + "R", [*lines, f"{'user' if want == 'u' else 'assistant'}:{text}"]))
                for state, *value in ways:
                    if state not in new or tuple(value[:2]) < new[state][:2]:
                        new[state] = tuple(value)
            states = new
        cost, audit, lines = min((v for k, v in states.items() if k in ("", "a")), key=lambda v: v[:2])
        count = faults.count
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def corpus() -> list[tuple]:
    rng = random.Random(4)
    rows: list[tuple] = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "why", " ", "", None, "a. b", f"t{rng.random()}?", "line\nline.\n", " ", "é" * 3000 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    rows += rows[:40]  # repeated rows
    return rows


def test_query_is_the_plain_loop(spark):
    rows = corpus()
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", n long, key string").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in repaired_after_damage(table).collect()}
    assert got == plain(rows, [r[0] for r in rows])


def test_long_conversations_are_cut_and_joined(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["ok", f"{t}.", f"{t}", "same."])) for t in range(1700)]
    rows += [(8, 0, "user", "hi.")] * 900 + [(9, t, "user", "same again.") for t in range(700)]
    got = {r[0]: tuple(r[1:]) for r in repaired_after_damage(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain(rows, [7, 8, 9])


def test_messages_are_what_is_left(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "assistant", "B."), (2, 0, "user", "x")]
    done = repair(spark.createDataFrame(rows, SCHEMA))
    messages = sorted(tuple(r) for r in done.messages.collect())
    assert messages == [(1, 0, "K", "system", "S."), (1, 1, "R", "user", "A."), (1, 2, "K", "assistant", "B.")]
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in done.summary.collect()} == {1: (1, "KRK"), 2: (2, "D")}
    want = hashlib.sha256(b"system:S.\nuser:A.\nassistant:B.").hexdigest()
    assert [tuple(r) for r in transcripts(done.messages).collect()] == [(1, want)]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(5, 2**63 - 1, "user", "a."), (5, -(2**63), "assistant", "b.")]])
def test_odd_tables(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    got = {r[0]: tuple(r[1:]) for r in repaired_after_damage(table).collect()}
    want = plain(rows, [r[0] for r in rows])
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()}
    assert all(v[0] == min(want[k][0], 2**63 - 1) for k, v in got.items())
    assert damaged(table).columns == ["conv_id", "turn", "role", "text", "n"]
    assert cheapest("") == (0, "") and shortest("", NOTHING)[NOTHING] == (0, "")
