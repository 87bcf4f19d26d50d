"""Conversation repair against an enumeration of all edits, and against its SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from tidewire.llm import conversations as c
from tidewire.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string, own string, lost_ int, d int, audit string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def plain(rows):
    """The report by plain Python: all edit strings of a conversation are tried."""
    by = {}
    for i, t, role, text in rows:
        by.setdefault(i, []).append((t, " " if role is None else role, " " if text is None else text))
    out = []
    for i, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for t, role, text in own:
            dark = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not dark else "d" if (role, text) in seen else "t" if dark[-1] not in ".!?" else "f")
            seen.add((role, text))
        best = None
        choices = []
        for (_, role, _), fault in zip(own, faults):
            more = 3 * (fault == "t")
            choices.append([("D", 4, "", 0)] if fault in "bd" else [("D", 4, "", 0), ("K", more, role[:1], 0), ("R", 3 + more, "u", 1), ("R", 3 + more, "a", 1)])
        inserts = ["", "u", "a", "ua", "au"]
        for pick in itertools.product(*choices):
            least = sum(p[1] for p in pick)
            if best and least > best[0]:
                continue
            for gaps in itertools.product(inserts, repeat=len(own) + 1):
                cost = least + 3 * sum(map(len, gaps))
                if best and cost > best[0]:
                    continue
                shape = gaps[0] + "".join((p[2] or ("" if p[0] == "D" else "?")) + g for p, g in zip(pick, gaps[1:]))
                if not LEGAL.match(shape):
                    continue
                audit = "I" * len(gaps[0]) + "".join(p[0] + "I" * len(g) for p, g in zip(pick, gaps[1:]))
                name = {"u": "user", "a": "assistant"}
                turns = [f"{name[g]}:" for g in gaps[0]]
                for p, g, (_, role, text) in zip(pick, gaps[1:], own):
                    turns += [] if p[0] == "D" else [f"{role if p[0] == 'K' else name[p[2]]}:{text}"]
                    turns += [f"{name[x]}:" for x in g]
                if best is None or (cost, audit) < best[:2]:
                    best = (cost, audit, "\n".join(turns))
        turns = [r[0] for r in own if r[0] is not None]
        gap = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((i, gap, faults.count("b"), faults.count("d"), faults.count("t"), illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()))
    return sorted(out, key=str)


def tables(seed, n=14):
    r = random.Random(seed)
    texts = ["Yes.", "No", "why?", "", None, " \x0b\t", "so on", "Well!\n", "Ü…", " "]
    rows = []
    for conv in [None, *range(n)]:
        for t in range(r.randint(1, 4)):
            rows.append((conv, r.choice([None, t, t, t, t + 2]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), r.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_all_edits(spark, seed):
    rows = tables(seed)
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).repartition(3)
    want = plain(rows)
    assert sorted((tuple(r) for r in c.report(df).collect()), key=str) == want
    assert sorted((tuple(r) for r in c.report(df, long=1, size=2).collect()), key=str) == want


def test_long_conversations_by_runs(spark):
    r = random.Random(7)
    rows = [(1, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["a.", "b", "c?", f"{t}."])) for t in range(300)] + [(1, 5, "user", "5.")] * 40 + [(2, t, ["user", "assistant"][t % 2], f"{t}!") for t in range(60)]
    df = spark.createDataFrame([(*x, "x", 1, 2, "y") for x in rows], SCHEMA).repartition(5)
    one, many = (sorted(tuple(x) for x in c.report(df, long=n, size=7).collect()) for n in (1000, 20))
    assert one == many and len(one) == 2 and one[1][7] == "K" * 60
    turns = [sorted(tuple(x) for x in c.repaired(df, long=n, size=7).collect()) for n in (1000, 20)]
    assert turns[0] == turns[1]
    for conv, *_, digest in one:
        assert hashlib.sha256("\n".join(f"{x[3]}:{x[4]}" for x in turns[0] if x[0] == conv).encode()).hexdigest() == digest


def test_damage(spark):
    rows = [(i, t, "assistant", f"One. Two! {i}?") for i in (*range(60), None) for t in (0, 1, None)] + [(3, 9, None, None)]
    got = sorted((tuple(r) for r in c.damaged(spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)).collect()), key=str)
    want = []
    for i, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(k, text)
        want += [(i, t, "user" if k == 4 else role, text, k == 0)] * (2 if k == 3 else 1)
    assert got == sorted(want, key=str)


def test_lost_and_empty(spark):
    lost = spark.createDataFrame([(1, 0, "user", "a.", True), (2, 0, "user", "a.", False)], "conv_id long, turn long, role string, text string, lost boolean")
    empty = hashlib.sha256(b"").hexdigest()
    got = {r["conv_id"]: tuple(r)[1:] for r in c.report(lost).collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", empty) and got[2][5:7] == (3, "KI")
    assert c.report(spark.createDataFrame([], SCHEMA)).collect() == [] and c.repaired(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    names = [c.split(" ")[0] for c in c_names]
    want = db.execute(f"SELECT {', '.join(names)} FROM ({SQL['op13_conversation_repair']})").fetchall()
    got = QUERIES["op13_conversation_repair"](spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)


c_names = c.REPORT.split(", ")
