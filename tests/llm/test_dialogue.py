"""Repairs against exhaustive search over all edits, and whole tables against plain Python."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from quizmill.llm import dialogue as di

GOOD = re.compile(r"(s?(ua)+)?")


def exhaustive(rows):
    """All ways to edit a few rows (role, text, fault), with up to two inserts before each and at the end."""
    best = None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    choices = [["D"] + ([] if fault in ("blank", "duplicate") else ["K", "Ru", "Ra"]) for *_, fault in rows]
    for gaps in product(inserts, repeat=len(rows) + 1):
        for picks in product(*choices):
            cost, audit, out = 0, "", []
            for gap, pick, row in zip(gaps, [*picks, None], [*rows, None], strict=True):
                out += [(role, "") for role in gap]
                audit += "I" * len(gap)
                cost += 5 * len(gap)
                if pick:
                    audit += pick[0]
                    cost += {"D": 2, "K": 0, "R": 1}[pick[0]] + (5 if row[2] == "truncated" and pick != "D" else 0)
                    if pick != "D":
                        out.append(({"K": row[0], "Ru": "user", "Ra": "assistant"}[pick], row[1]))
            if GOOD.fullmatch("".join(role[:1] for role, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best


def letters(rows):
    return "".join(di.LETTERS[3 * (di.INITIALS.find(role[:1]) if role[:1] in ("s", "u", "a") else 3) + {"": 0, "truncated": 1}.get(fault, 2)] for role, _, fault in rows)


def test_cheapest_edits_exhaustively():
    rng = random.Random(5)
    kinds = list(product(("system", "user", "assistant", "tool"), ("", "truncated", "blank")))
    for n in (0, 1, 2):
        for rows in product(kinds, repeat=n):
            rows = [(role, "t", fault) for role, fault in rows]
            assert di.cheapest_edits(letters(rows)) == exhaustive(rows)[:2], rows
    for _ in range(40):
        rows = [(*rng.choice(kinds),) for _ in range(3)]
        rows = [(role, "t", fault) for role, fault in rows]
        assert di.cheapest_edits(letters(rows)) == exhaustive(rows)[:2], rows


def full_search(rows):
    """Shortest edits by (cost, audit) over all prefixes and states, without checkpoints: strings are carried along."""
    nxt, new = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (2, 2, 3, 2)
    role = {2: "user", 3: "assistant"}

    def inserts(found):
        for _ in range(3):
            for q, (cost, audit, out) in list(found.items()):
                option = (cost + 5, audit + "I", [*out, (role[new[q]], "")])
                found[new[q]] = min(found.get(new[q], option), option, key=lambda o: o[:2])
        return found

    best = {0: (0, "", [])}
    for name, text, fault in rows:
        options = {}
        for q, (cost, audit, out) in inserts(best).items():
            def put(to, option):
                options[to] = min(options.get(to, option), option, key=lambda o: o[:2])
            put(q, (cost + 2, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                put(new[q], (cost + 1 + more, audit + "R", [*out, (role[new[q]], text)]))
                if name[:1] in nxt[q]:
                    put(nxt[q][name[:1]], (cost + more, audit + "K", [*out, (name, text)]))
        best = options
    return min((o for q, o in inserts(best).items() if q in (0, 3)), key=lambda o: o[:2])


def test_long_conversations():
    """Blocks of every size, against the search that carries strings. A prefix's least string stays least: strings in one state have the same future."""
    rng = random.Random(6)
    for n in (3, 4, 8, 9, 15, 16, 17, 40, 99, 100, 250):
        for _ in range(8):
            rows = [(rng.choice(("system", "user", "user", "assistant", "assistant", "tool")), "t", rng.choice(("", "", "", "truncated", "blank"))) for _ in range(n)]
            cost, audit = di.cheapest_edits(letters(rows))
            expected = full_search(rows)
            assert cost == expected[0]
            assert len(audit) - audit.count("I") == n
            assert price(rows, audit) == cost
            assert audit <= expected[1]


def price(rows, audit):
    """The cost of an audit, and that it gives a good conversation."""
    cost, state, at, roles = 0, 0, 0, ""
    for edit in audit:
        if edit in "IR":
            state = di.NEW[state]
            roles += di.ROLE[state][0]
        if edit == "I":
            cost += 5
            continue
        role, _, fault = rows[at]
        at += 1
        assert edit == "D" or fault not in ("blank", "duplicate")
        if edit == "K":
            roles += role[:1]
            state = di.NEXT[state][role[0]]
        cost += {"D": 2, "K": 0, "R": 1}[edit] + (5 if fault == "truncated" and edit != "D" else 0)
    assert at == len(rows) and GOOD.fullmatch(roles)
    return cost


def brute(rows):
    """The contract in plain Python: rows are (conv_id, turn, role, text)."""
    show = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text, kind = show(role), show(text), zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, full = set(), []
        for _, role, text in kept:
            stripped = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
            seen.add((role, text))
            full.append((role, text, fault))
        turns = [t for t, *_ in kept if t is not None]
        cost, audit, made = full_search(full)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(full, full[1:], strict=False)]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f[2] == k for f in full) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
        )
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = di.op12_conversation_repair(spark, sf)
    assert got.count() == len({r[0] for r in rows})
    assert found(got) == brute(rows)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(7)
    texts = [None, "", " \t", "Fine.", "Fine.", "Open", "Ends! \n", "é?", "x" * 5_000 + ".", "Say: what?"]
    rows = [(rng.choice([None, 1, 2, 3, -4, 10**17]), rng.choice([None, 0, 1, 2, 3, 4, 9, 2**40]), rng.choice([None, "", "user", "assistant", "assistant", "system", "usher", "Tool", "ü"]), rng.choice(texts)) for _ in range(300)]
    return rows + [(5, t, ("user", "assistant")[t % 2], "The same." if t % 2 else f"No {t}.") for t in range(1_500)] + [(6, 0, "user", "Hi.")] * 700 + [(-7, 10, "user", "only row")]


def test_odd_rows(spark, odd_rows):
    """Nulls in all columns, ties, hot and repeated rows, unknown and empty roles, huge ids, clashing names."""
    df = spark.createDataFrame(odd_rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS conv", "'y' AS key", "'z' AS kind", "'w' AS audit")
    assert found(di.repair_report(di.damaged(df), df)) == brute(odd_rows)
    none = df.limit(0)
    assert di.repair_report(di.damaged(none), none).count() == 0


def test_blocks_of_a_long_conversation(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(di, "BLOCK", 7)
    df = spark.createDataFrame(odd_rows, "conv_id long, turn long, role string, text string")
    assert found(di.repair_report(di.damaged(df), df)) == brute(odd_rows)


def test_repaired_rows(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, "conv_id long, turn long, role string, text string")
    by_conv = {}
    for r in sorted(di.repaired(di.damaged(df)).collect(), key=lambda r: r.place):
        by_conv.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    expected = {c: v[-1] for c, v in brute(odd_rows).items()}
    assert {c: hashlib.sha256("\n".join(by_conv.get(c, [])).encode()).hexdigest() for c in expected} == expected
    assert all(GOOD.fullmatch("".join(x[0] for x in rows)) for rows in by_conv.values())
