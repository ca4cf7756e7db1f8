"""Conversation repair against a plain dynamic program and against enumeration of all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from filmloom.llm import conversations
from filmloom.llm.queries import QUERIES

COLUMNS = "conv_id bigint, turn bigint, role string, text string, digest string, gone_by string"
FORM = re.compile(r"(s?(ua)+)?")
GOES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    """(conv_id, turn, role, text) after damage, in the order given, and all conv_ids."""
    out, ids = [], set()
    for conv_id, turn, role, text in rows:
        ids.add(conv_id)
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv_id)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out, ids


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain_best(rows):
    """(cost, audit) of rows (role, fault) by a row-by-row program that keeps the whole audit of each state."""
    def fill(states):
        out = dict(states)
        for _ in range(2):
            for (i, x), j in GOES.items():
                if i in out and x != "s":
                    way = (out[i][0] + 2, out[i][1] + "I")
                    out[j] = min(out.get(j, way), way)
        return out

    states = {0: (0, "")}
    for role, fault in rows:
        new: dict = {}
        for i, (cost, audit) in fill(states).items():
            ways = [(i, cost + 3, audit + "D")]
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                ways += [(GOES.get((i, role[:1])), cost + late, audit + "K")]
                ways += [(GOES.get((i, x)), cost + 2 + late, audit + "R") for x in "ua"]
            for j, c, a in ways:
                if j is not None:
                    new[j] = min(new.get(j, (c, a)), (c, a))
        states = new
    states = fill(states)
    return min(states[i] for i in (0, 3) if i in states)


def brute(rows):
    """The contract's row of every conversation, one row after the other."""
    out, ids = damage(rows)
    groups = defaultdict(list)
    for r in out:
        groups[r[0]].append(r)
    result = {}
    for conv_id in ids:
        held = sorted(groups[conv_id], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), digest(r[2], r[3])))
        seen, faults = set(), []
        for _, _, role, text in held:
            body = text.strip("\x20\t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for _, t, _, _ in held if t is not None]
        cost, audit = plain_best([(r[2], f) for r, f in zip(held, faults)])
        lines, source, state = [], iter(held), 0
        for letter in audit:
            row = next(source) if letter != "I" else None
            if letter == "D":
                continue
            role = row[2] if letter == "K" else "assistant" if state == 2 else "user"
            state = GOES[state, role[0]]
            lines.append(f"{role}:{row[3] if row else ''}")
        assert FORM.fullmatch("".join(line[0] for line in lines))
        initials = [r[2][:1] for r in held]
        result[conv_id] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                           sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                           hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return result


def found(df):
    rows = df.collect()
    assert df.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:9] for r in rows}


def odd_rows(seed=1):
    """Short and long conversations with gaps, nulls, ties, copies, odd roles and blank texts."""
    rng, rows = random.Random(seed), []
    for conv_id in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv_id, rng.choice([turn, turn, turn, 2 * turn, None]), rng.choice(["user", "assistant", "system", "tool", "", None, "ü"]),
                         rng.choice([f"Text {rng.randint(0, 3)}.", "no end", " \t\n", "", None, "é ü!", "x" * 30_000 + "?", "two\nlines.", "end. \r\n"])))
    for turn in range(700):  # a conversation with a third of the rows and more
        rows.append((1000, turn + turn // 100, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"Turn {turn}.", "again.", f"cut {turn}", ""])))
    return rows + rows[:40] + [rows[200]] * 50


def test_the_query_on_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op12_conversation_repair"](spark, sf)) == brute(rows)


@pytest.mark.parametrize("piece_rows", [1, 7, 4096])
def test_odd_rows_in_pieces_of_any_size(spark, piece_rows):
    rows = odd_rows()
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], COLUMNS).repartition(5)
    assert found(conversations.repaired(conversations.damaged(table), piece_rows)) == brute(rows)


def test_rows_without_damage_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Yes.")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = found(conversations.repaired(table))
    assert got[1] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest())
    assert got[2][5:7] == (2, "IK")
    nothing = spark.createDataFrame([], COLUMNS)
    assert conversations.repaired(conversations.damaged(nothing)).count() == 0


def test_edits_are_the_least_of_all():
    """All audits of short sequences, tried one by one."""
    rng = random.Random(2)
    for _ in range(60):
        rows = [(rng.choice("suat"), rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randint(0, 4))]
        best = None
        for size in range(len(rows), len(rows) + 5):
            for audit in map("".join, itertools.product("DIKR", repeat=size)):
                if len(audit) - audit.count("I") != len(rows):
                    continue
                source, state, cost = iter(rows), 0, 0
                for letter in audit:
                    role, fault = ("", "") if letter == "I" else next(source)
                    if letter == "D":
                        cost += 3
                        continue
                    late = fault == "truncated"
                    role = role if letter == "K" else "a" if state == 2 else "u"
                    cost += 2 * (letter != "K") + late
                    state = GOES.get((state, role)) if fault != "blank" else None
                    if state is None:
                        break
                if state in (0, 3) and (best is None or (cost, audit) < best):
                    best = cost, audit
        assert plain_best(rows) == best
        symbols = [conversations.symbol(r, f == "truncated", f == "blank") for r, f in rows]
        entries = [(0, conversations.Rope(None, None, "")), None, None, None]
        for s in symbols:
            entries = conversations.row_times(entries, conversations.TERMINALS[s])
        cost, rope = conversations.ended(entries)
        assert (cost, str(rope)) == best


def test_rules_keep_sequences_and_are_shared():
    rng = random.Random(4)
    for least in (2, 5):
        sequences = [[rng.choice([3, 5, 5, 9, 1]) for _ in range(rng.randint(0, 30))] for _ in range(80)] + [[3] * 9, [], [3, 3, 3]]
        rules, written = conversations.re_pair(sequences, least=least, most=1000)

        def spell(x):
            return [x] if x < 10 else spell(rules[x - 10][0]) + spell(rules[x - 10][1])

        assert [[y for x in s for y in spell(x)] for s in written] == sequences
        pairs = Counter(p for s in written for p in zip(s, s[1:]))
        assert rules and max((n for (a, b), n in pairs.items() if a != b), default=0) < least
        known = conversations.matrices(rules)
        for k, (a, b) in enumerate(rules):
            whole = conversations.times(known[a], known[b])
            assert [[e and (e[0], str(e[1])) for e in line] for line in known[10 + k]] == [[e and (e[0], str(e[1])) for e in line] for line in whole]
