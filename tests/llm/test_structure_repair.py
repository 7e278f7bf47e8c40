import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache
from itertools import product

import pytest

from creditscope.llm import structure_repair as sr
from creditscope.llm.queries import QUERIES
from tests.conftest import SF001

sys.setrecursionlimit(20_000)
FOLLOWS = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(letters):
    """(cost, audit) by the states of the grammar, from the end."""
    @lru_cache(None)
    def rest(i, state, inserts):
        found = [(0, "")] if i == len(letters) and state in ("", "a") else []
        if inserts < 2:
            c, a = rest(i, FOLLOWS[state], inserts + 1)
            found.append((c + 3, "I" + a))
        if i < len(letters):
            x = letters[i]
            c, a = rest(i + 1, state, 0)
            found.append((c + 4, "D" + a))
            if x != ".":
                more = 3 if x.isupper() else 0
                if x.lower() == FOLLOWS[state] or (state == "" and x.lower() == "s"):
                    c, a = rest(i + 1, x.lower(), 0)
                    found.append((c + more, "K" + a))
                c, a = rest(i + 1, FOLLOWS[state], 0)
                found.append((c + more + 3, "R" + a))
        return min(found, default=(10**9, ""))

    return rest(0, "", 0)


def every_audit(letters):
    """(cost, audit) from all edit strings whose result the grammar accepts."""
    best = (4 * len(letters) + 1, "")
    slots = [[""] + ["".join(p) for k in (1, 2) for p in product("ua", repeat=k)]] * (len(letters) + 1)
    choices = [["D"] if x == "." else ["D", "K", "Ru", "Ra"] for x in letters]
    for edits in product(*choices):
        for ins in product(*slots):
            roles, audit, cost = "", "", 0
            for k in range(len(letters) + 1):
                roles, audit, cost = roles + ins[k], audit + "I" * len(ins[k]), cost + 3 * len(ins[k])
                if k < len(letters):
                    e, x = edits[k], letters[k]
                    audit += e[0]
                    cost += 4 if e == "D" else (3 if e[0] == "R" else 0) + (3 if x.isupper() else 0)
                    roles += "" if e == "D" else e[1] if e[0] == "R" else x.lower()
            if (cost, audit) < best and re.fullmatch(r"(s?(ua)+)?", roles):
                best = (cost, audit)
    return best


def streamed(letters):
    """(cost, audit) of turns with these letters, repaired piece by piece."""
    stream, out = sr._Stream(0), []
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for i, x in enumerate(letters):
        if x == ".":
            out += stream.add(i, "user", " ", False)
        else:
            out += stream.add(i, names[x.lower()], f"t{i}" + ("" if x.isupper() else "."), False)
    out += stream.finished()
    return sum(e[3] for e in out), "".join(e[2] for e in out)


def test_cheapest_is_every_audit():
    for n in range(4):
        for letters in product("sua.A" if n < 3 else "suA", repeat=n):
            assert cheapest(letters) == every_audit(letters), letters


def test_alignment_against_states():
    rng = random.Random(3)
    some = [tuple(rng.choices("suaxUA.", k=rng.randint(4, 9))) for _ in range(400)]
    for letters in [x for n in range(4) for x in product("suaxU.", repeat=n)] + some:
        assert streamed(letters) == cheapest(letters), letters


def test_long_conversations_in_pieces():
    rng = random.Random(5)
    for trial in range(300):
        n = rng.randint(6, 60)
        letters = list(("s" if trial % 3 == 0 else "") + "ua" * n)[:n]
        for _ in range(rng.randint(0, n // 3 + 1)):
            at = rng.randrange(len(letters))
            kind = rng.choice("suaxUA.-+")
            letters[at:at + 1] = [] if kind == "-" else [letters[at]] * 2 if kind == "+" else [kind]
            letters = letters or ["u"]
        assert streamed(letters) == cheapest(tuple(letters)), "".join(letters)


def test_stretch_without_anchor():
    for letters in ("u" * 120, "a" * 90, "U" * 60, "." * 200, "uaUA" * 25, "x" * 50 + "ua" * 30 + "s" * 40):
        assert streamed(letters) == cheapest(tuple(letters))


def test_band_skips_cells():
    table, low = sr._filled("ua" * 100, "ua" * 100, 20, 0, False)
    assert max(map(len, table)) < 10 and table[0][0 - low[0]] == 0


def brute(rows):
    """The query's rows by its definition, conversation by conversation."""
    text_ = lambda x: " " if x is None else x
    key = lambda x: (x is not None, x or 0)
    conversations = {}
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{text_(c)}:{text_(t)}".encode()) % 20
        r, x = text_(r), text_(x)
        kept = conversations.setdefault(c, [])
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            kept += [(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    out = set()
    for c, kept in conversations.items():
        kept.sort(key=lambda y: (key(y[0]), y[1].encode(), y[2].encode()))
        letters, seen, faults = "", set(), []
        for t, r, x in kept:
            core = x.strip(" \t\n\v\f\r")
            fault = "blank" if not core else "duplicate" if (r, x) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((r, x))
            faults.append(fault)
            initial = r[:1] if r[:1] and r[:1] in "sua" else "x"
            letters += "." if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = cheapest(tuple(letters))
        lines, state, rest = [], "", iter(kept)
        for e in audit:
            if e == "I":
                state = FOLLOWS[state]
                lines.append({"u": "user", "a": "assistant"}[state] + ":")
                continue
            t, r, x = next(rest)
            if e == "K":
                state = r[:1]
                lines.append(f"{r}:{x}")
            elif e == "R":
                state = FOLLOWS[state]
                lines.append({"u": "user", "a": "assistant"}[state] + ":" + x)
        turns = [t for t, _, _ in kept if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        out.add((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"),
                 faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                 hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def asked(df):
    return {tuple(r) for r in sr.digests(sr.repair(sr.damaged(df)), df).collect()}


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_structure_repair"](spark, SF001).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len({r[0] for r in rows})


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(9)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], [
        "Yes.", "no", "", " \t", None, "Ünï中😀!", "a:b\nc?", "x" * 60_000 + ".", " "]
    rows = [(rng.choice([1, 2, 3, None]) if i % 3 else 10 + i // 30, rng.choice([None, *range(12)]),
             rng.choice(roles), rng.choice(texts)) for i in range(600)]
    rows += [(7, 5, "user", "Same.")] * 40  # repeated rows
    rows += [(8, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(400)]
    return rows, spark.createDataFrame(
        [(*r, 1, "z", 0) for r in rows], "conv_id long, turn long, role string, text string, n long, conv string, step int")


def test_odd_rows(odd):
    rows, df = odd
    assert asked(df) == brute(rows)
    assert asked(df.limit(0)) == set()


def test_everything_dropped(spark):
    pairs = [(c, t) for c in range(200) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    df = spark.createDataFrame([(c, t, "user", "Hi.") for c, t in pairs], "conv_id long, turn long, role string, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert asked(df) == {(c, 0, 0, 0, 0, 0, 0, "", empty) for c, _ in pairs}


def test_edits_show_the_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Me again."), (1, 2, "assistant", "Hello"), (1, 3, "user", "")],
                               "conv_id long, turn long, role string, text string")
    rows = sr.repair(df).orderBy("step").collect()
    assert [(r.edit, r.role, r.text, r.fault) for r in rows] == [
        ("K", "user", "Hi.", None), ("I", "assistant", "", None), ("K", "user", "Me again.", None),
        ("K", "assistant", "Hello", "truncated"), ("D", "user", "", "blank")]
