"""Conversation structure repair: the cheapest edits that give a conversation the shape (system? (user assistant)+)?.

A row's first fault is blank (nothing but ASCII white space), duplicate (role and text stand earlier in the conversation)
or truncated (the last character that isn't white space is none of ".!?"). Edits: Keep (0), Rerole to user or assistant
(3), Delete (4; the only one for blank and duplicate rows), Insert an empty turn (3); truncated rows that stay cost 3
more. The grammar has four states: nothing yet, after the system turn, after a user, after an assistant. Backward, the
cost to go from each state is computed for each row; forward, the walk takes the ASCII-least initial of the edits whose
cost is that of the state. Costs to go differ by a few units at most, so that a row's kind and the differences make few
cases, and a row costs a look-up.

Conversations of up to `long` rows are sorted by one shuffle and solved as they stream by, one of them in memory. Longer
ones are cut into runs of rows by range: a run gives its costs to go as a 4 by 4 matrix of least sums, these are chained
backward, each run is walked from all four states, the states are chained forward, and the texts are hashed as a stream.

Defined cases: null roles and texts are one space (a role whose initial is none of s, u, a can't be kept), a null turn
comes first and counts in no gap, null conversation ids are one conversation. Rows of one turn are ordered by role, then
by the md5 of the text; equal rows are neighbours, all but the first of them duplicates. A conversation without rows has
zeros, an empty audit and the hash of nothing. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 40
#: The turn that may follow each state, beside a system turn at the start, and the state that it leads to.
NEXT = (("u", USER), ("u", USER), ("a", ASSISTANT), ("u", USER))
NAMES = {"u": "user", "a": "assistant"}
ENDS = (0, INF, INF, 0)  # nothing at all, or an assistant's turn, is complete
PAIRS = frozenset(("su", "ua", "au"))
BLANK, FINE, CUT = "blank", "fine", "truncated"
RUN = 50_000

Costs = tuple[int, ...]
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost): rows after the damage that crc32("conv_id:turn") modulo 20 asks for; lost ones are dropped, and only
    tell that there was such a conversation."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    c = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("role", "text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(c == 4, "user").otherwise(role).alias("role"),
        F.when(c == 1, "").when(c == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (c == 0).alias("lost"),
        F.explode(F.sequence(F.lit(1), F.when(c == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _judged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, own, d, lost): own is the fault that a row has by itself, d the md5 of its text."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("role", "text"))
    seen = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    own = F.when(seen == "", BLANK).when(F.right(seen, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)
    lost = F.col("lost") if "lost" in rows.columns else F.lit(False)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), own.alias("own"), F.md5(text.cast("binary")).alias("d"), lost.alias("lost"))


def _kind(role: str, own: str, repeated: bool) -> str:
    """What the cost of a row depends on: "d" if it must go, else its role's initial, or "-", in capitals if it is truncated."""
    if own == BLANK or repeated:
        return "d"
    first = role[:1] if role[:1] in ("s", "u", "a") else "-"
    return first if own == FINE else first.replace("-", "_").upper()


def _edits(kind: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, state after) of the edits that use up a row."""
    yield "D", DELETE, state
    if kind == "d":
        return
    more = TRUNCATED if kind in "SUA_" else 0
    if state == START and kind in "sS":
        yield "K", KEEP + more, SYSTEM
    role, to = NEXT[state]
    yield ("K", KEEP + more, to) if kind in (role, role.upper()) else ("R", REROLE + more, to)


def _plus(x: int, y: int) -> int:
    return min(INF, x + y)


@cache
def _relaxed(v: Costs) -> Costs:
    """Costs to go where turns may be inserted first."""
    for _ in range(3):
        v = tuple(min(v[s], _plus(INSERT, v[NEXT[s][1]])) for s in range(4))
    return v


def _scaled(v: Costs) -> tuple[Costs, int]:
    least = min(v)
    return tuple(x - least if x < INF else INF for x in v), least


@cache
def _before(kind: str, after: Costs) -> tuple[Costs, int]:
    """Costs to go before a row, from those after it, as differences from the least; and the least."""
    return _scaled(_relaxed(tuple(min(_plus(cost, after[to]) for _, cost, to in _edits(kind, s)) for s in range(4))))


def costs_to_go(kinds: Iterable[str], end: Costs = ENDS) -> tuple[list[Costs], int]:
    """The differences of the costs to go before each row and at the end, and the least cost before the first row."""
    v, total = _scaled(end)
    v = _relaxed(v)
    out = [v]
    for kind in reversed(kinds):
        v, more = _before(kind, v)
        total += more
        out.append(v)
    return out[::-1], total


@cache
def _step(kind: str, before: Costs, after: Costs, state: int) -> tuple[str, int]:
    """The walk past one row: initials of its edits, those of inserted turns first, and the state after."""
    least, text = _before(kind, after)[1], ""
    while True:
        tight = [(i, to) for i, cost, to in _edits(kind, state) if _plus(cost, after[to]) == before[state] + least]
        role, to = NEXT[state]
        if before[state] == INSERT + before[to]:
            tight.append(("I", to))
        initial, state = min(tight)
        text += initial
        if initial != "I":
            return text, state


def walk(kinds: Iterable[str], costs: list[Costs], state: int = START) -> tuple[list[str], int]:
    """The initials of each row's edits from a state on, and the state at the end."""
    out = []
    for i, kind in enumerate(kinds):
        text, state = _step(kind, costs[i], costs[i + 1], state)
        out.append(text)
    return out, state


def _tail(state: int) -> str:
    """Turns inserted at the end of a conversation."""
    return {SYSTEM: "II", USER: "I"}.get(state, "")


def _turns(initials: str, role: str, text: str, state: int) -> tuple[list[tuple[str, str, str]], int]:
    """(edit, role, text) of what a row becomes."""
    out = []
    for i in initials:
        if i == "D":
            continue
        name, to = NEXT[state]
        if i == "K" and state == START and role[:1] == "s":
            to = SYSTEM
        out.append((i, role if i == "K" else NAMES[name], "" if i == "I" else text))
        state = to
    return out, state


def _solved(rows: list[tuple]) -> tuple[tuple, list[tuple[str, str, str]]]:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit) and the turns of one conversation's rows (turn, role, text, own, d)."""
    seen, kinds, faults = set(), [], {BLANK: 0, "duplicate": 0, CUT: 0, FINE: 0}
    for _, role, _, own, d in rows:
        repeated = (role, d) in seen
        seen.add((role, d))
        kinds.append(_kind(role, own, repeated))
        faults["duplicate" if repeated and own != BLANK else own] += 1
    costs, least = costs_to_go(kinds)
    initials, state = walk(kinds, costs)
    out, at = [], START
    for text, row in zip(initials, rows, strict=True):
        more, at = _turns(text, row[1], row[2], at)
        out += more
    out += _turns(_tail(state), "", "", at)[0]
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in PAIRS for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, faults[BLANK], faults["duplicate"], faults[CUT], illegal, least + costs[0][START], "".join(initials) + _tail(state)), out


def _nullable(values: pd.Series) -> list:
    return [None if x is pd.NA else int(x) for x in values]


def _streamed(rows: DataFrame, turns: bool) -> DataFrame:
    """Reports, or the turns, of conversations that fit in memory one by one."""

    def one(conv, own: list[tuple]) -> list[tuple]:
        facts, kept = _solved([r[:5] for r in own if not r[5]])
        if turns:
            return [(conv, n, *t) for n, t in enumerate(kept)]
        return [(conv, *facts, hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in kept).encode()).hexdigest())]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own, out = None, [], []
        names = [x.split(" ")[0] for x in (TURNS if turns else REPORT).split(", ")]
        frame = lambda: pd.DataFrame(out, columns=names).astype({n: "Int64" for n in names[:1]})
        for pdf in frames:
            for conv, *row in zip(_nullable(pdf["conv_id"]), _nullable(pdf["turn"]), pdf["role"], pdf["text"], pdf["own"], pdf["d"], pdf["lost"], strict=True):
                if own and conv != last:
                    out += one(last, own)
                    own = []
                own.append(tuple(row))
                last = conv
            if len(out) > 2000:
                yield frame()
                out = []
        if own:
            out += one(last, own)
        if out:
            yield frame()

    order = ["conv_id", "turn", "role", "d"]
    dealt = rows.select("conv_id", "turn", "role", "text", "own", "d", "lost").repartition("conv_id").sortWithinPartitions(*order)
    return mapped(dealt, run, TURNS if turns else REPORT, "text")


def _runs(rows: DataFrame, size: int) -> DataFrame:
    """Runs of up to `size` rows of the long conversations, in order: (conv_id, run, kinds, turns, roles, ds, n, sums), a row a run.

    Equal rows are one entry with their number n; `kinds` has a letter for each of them."""
    key = ["conv_id", "turn", "role", "d"]
    light = rows.filter("NOT lost").groupBy(*key, "own").agg(F.count("*").alias("n"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    first = light.groupBy("conv_id", "role", "d").agg(F.min(when).alias("first")).select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("d").alias("_d"), "first")
    light = light.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("d") == F.col("_d")))
    light = light.select(*key, "own", "n", (~F.col("turn").eqNullSafe(F.col("first.at"))).alias("repeated"))
    light = staged(light, "long-turns")  # ranges are sampled from what is there
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = light.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id().cast("long"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last, k = [], None, 0

        def packed():
            nonlocal held, k
            k += 1
            kinds = "".join(_kind(role, own, bool(again)) + "d" * (n - 1) for _, role, _, own, n, again, _ in held)
            count = {BLANK: 0, CUT: 0, "duplicate": 0, FINE: 0}
            for _, _, _, own, n, again, _ in held:
                count[BLANK if own == BLANK else "duplicate" if again else own] += 1
                count[BLANK if own == BLANK else "duplicate"] += n - 1
            firsts = [r[1][:1] for r in held]
            illegal = sum(a + b not in PAIRS for a, b in zip(firsts, firsts[1:], strict=False)) + sum((r[4] - 1) * (f + f not in PAIRS) for f, r in zip(firsts, held, strict=True))
            row = (last, held[0][6] << 32 | k, kinds, *([r[i] for r in held] for i in (0, 1, 2, 4)), [count[BLANK], count["duplicate"], count[CUT], illegal])
            held = []
            return pd.DataFrame([row], columns=["conv_id", "run", "kinds", "turns", "roles", "ds", "n", "sums"]).astype({"conv_id": "Int64"})

        for pdf in frames:
            for conv, *row in zip(_nullable(pdf["conv_id"]), _nullable(pdf["turn"]), pdf["role"], pdf["d"], pdf["own"], pdf["n"], pdf["repeated"], pdf["part"], strict=True):
                if held and (conv != last or len(held) >= size):
                    yield packed()
                held.append(row)
                last = conv
        if held:
            yield packed()

    return staged(mapped(dealt, run, "conv_id long, run long, kinds string, turns array<long>, roles array<string>, ds array<string>, n array<long>, sums array<long>"), "runs")


def _chained(runs: DataFrame) -> DataFrame:
    """(conv_id, run, edits, audit, end, cost): the edits of each entry of the runs and, of a conversation's last run, what is inserted at its end."""
    by = Window.partitionBy("conv_id").orderBy("run")

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for kinds in pdf["kinds"]:
                flat = []
                for j in range(4):  # the costs from all states to state j
                    costs, least = costs_to_go(kinds, tuple(0 if s == j else INF for s in range(4)))
                    flat += [_plus(x, least) for x in costs[0]]
                out.append(flat)
            yield pdf[["conv_id", "run"]].assign(m=out)

    def backward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run", ascending=False)
        v, out = _relaxed(ENDS), []
        for m in pdf["m"]:
            out.append(list(v))
            v = tuple(min(_plus(int(m[4 * j + s]), v[j]) for j in range(4)) for s in range(4))
        return pdf[["conv_id", "run"]].assign(v=out, cost=v[START])

    def walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ends, texts = [], []
            for kinds, v in zip(pdf["kinds"], pdf["v"], strict=True):
                costs, _ = costs_to_go(kinds, tuple(int(x) for x in v))
                # a state that no end can be reached from is no state of the walk
                each = [walk(kinds, costs, s) if costs[0][s] < INF else ([], s) for s in range(4)]
                ends.append([s for _, s in each])
                texts.append(["\t".join(t) for t, _ in each])
            yield pdf[["conv_id", "run", "cost"]].assign(ends=ends, texts=texts)

    def forward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run")
        state, out = START, []
        for ends in pdf["ends"]:
            out.append(state)
            state = int(ends[state])
        return pdf[["conv_id", "run"]].assign(entry=out, tail=[""] * (len(pdf) - 1) + [_tail(state)])

    group = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))  # a run a row: few for a conversation
    own = mapped(runs.select("conv_id", "run", "kinds"), matrices, "conv_id long, run long, m array<long>")
    ends = own.groupBy(group).applyInPandas(backward, "conv_id long, run long, v array<long>, cost long").select(F.col("run").alias("_run"), "v", "cost")
    ways = staged(mapped(runs.select("conv_id", "run", "kinds").join(ends, F.col("run") == F.col("_run")), walked, "conv_id long, run long, cost long, ends array<int>, texts array<string>"), "walks")
    taken = ways.select("conv_id", "run", "ends").groupBy(group).applyInPandas(forward, "conv_id long, run long, entry int, tail string").select(F.col("run").alias("_run"), "entry", "tail")
    text = F.element_at("texts", F.col("entry") + 1)
    return ways.join(taken, F.col("run") == F.col("_run")).select("conv_id", "run", "cost", "entry", "tail", text.alias("edits"), F.row_number().over(by).alias("nth"))


def _long(rows: DataFrame, turns: bool, size: int) -> DataFrame:
    """As _streamed(), for conversations of any length: what a task holds is a run, and its part of the audit."""
    runs = _runs(rows, size)
    edits = staged(_chained(runs), "edits")
    key = ["conv_id", "turn", "role", "d"]
    joined = runs.join(edits.select(F.col("run").alias("_run"), "edits", "tail", "entry"), F.col("run") == F.col("_run"))

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for conv, run, edits, tail, at, turns, roles, ds, n in zip(_nullable(pdf["conv_id"]), pdf["run"], pdf["edits"], pdf["tail"], pdf["entry"], pdf["turns"], pdf["roles"], pdf["ds"], pdf["n"], strict=True):
                steps, out, k, state = edits.split("\t"), [], 0, int(at)
                for i, (turn, role, d, m) in enumerate(zip(turns, roles, ds, n, strict=True)):
                    text = "".join(steps[k : k + int(m)])
                    k += int(m)
                    out.append((conv, run, i, None if turn is None or turn != turn else int(turn), role, d, text, state, tail if i == len(roles) - 1 else ""))
                    state = _turns(text, role, "", state)[1]
                yield pd.DataFrame(out, columns=["conv_id", "run", "i", "turn", "role", "d", "edits", "state", "tail"]).astype({"conv_id": "Int64", "turn": "Int64"})

    steps = mapped(joined, dealt, "conv_id long, run long, i long, turn long, role string, d string, edits string, state int, tail string")
    texts = rows.filter("NOT lost").select(*[F.col(c).alias(f"_{c}") for c in key], "text").dropDuplicates([f"_{c}" for c in key])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    ordered = steps.join(texts, same[0] & same[1] & same[2] & same[3]).select("conv_id", "run", "i", "role", "text", "edits", "state", "tail")
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "run", "i")

    def rebuilt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, digest, place, began = None, None, 0, False
        for pdf in frames:
            out = []
            for conv, role, text, initials, state, tail in zip(_nullable(pdf["conv_id"]), pdf["role"], pdf["text"], pdf["edits"], pdf["state"], pdf["tail"], strict=True):
                if not began or conv != last:
                    if began and not turns:
                        out.append((last, digest.hexdigest()))
                    last, digest, place, began = conv, hashlib.sha256(), 0, True
                kept, at = _turns(initials, role, text, int(state))
                kept += _turns(tail, "", "", at)[0]
                for edit, name, words in kept:
                    if turns:
                        out.append((conv, place, edit, name, words))
                    digest.update(f"{chr(10) if place else ''}{name}:{words}".encode())
                    place += 1
            if out:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if began and not turns:
            yield pd.DataFrame([(last, digest.hexdigest())], columns=names).astype({"conv_id": "Int64"})

    if turns:
        names = ["conv_id", "place", "edit", "role", "text"]
        return mapped(ordered, rebuilt, TURNS, "text")
    names = ["conv_id", "repaired_sha256"]
    hashes = mapped(ordered, rebuilt, "conv_id long, repaired_sha256 string", "text").select(F.col("conv_id").alias("_h"), "repaired_sha256")
    # the audit is a letter a row: what the caller asks for
    parts = F.array_sort(F.collect_list(F.struct("run", F.concat(F.translate("edits", "\t", ""), "tail").alias("x"))))
    audits = edits.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.concat_ws("", F.transform(parts, lambda p: p["x"])).alias("audit"))
    ends = runs.select("conv_id", "run", "sums", F.substring(F.element_at("roles", 1), 1, 1).alias("head"), F.substring(F.element_at("roles", -1), 1, 1).alias("foot"))
    ends = ends.withColumn("before", F.lag("foot").over(Window.partitionBy("conv_id").orderBy("run")))  # a row a run
    seam = F.when(F.col("before").isNotNull() & ~F.concat("before", "head").isin(*PAIRS), 1).otherwise(0)
    sums = ends.groupBy("conv_id").agg(*[F.sum(F.col("sums")[i] + (seam if i == 3 else 0)).alias(n) for i, n in enumerate(("blank", "duplicate", "truncated", "illegal"))])
    spans = rows.filter("NOT lost AND turn IS NOT NULL").select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    for other, name in ((audits, "_a"), (spans, "_g")):
        other = other.withColumnRenamed("conv_id", name)
        sums = sums.join(other, F.col("conv_id").eqNullSafe(F.col(name)), "left")
    sums = sums.join(hashes, F.col("conv_id").eqNullSafe(F.col("_h")))
    return sums.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _both(rows: DataFrame, turns: bool, long: int, size: int) -> DataFrame:
    own = _judged(rows)
    lengths = own.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("lost"), 0).otherwise(1)).alias("_left")).filter((F.col("n") > long) & (F.col("_left") > 0)).select(F.col("conv_id").alias("_big"))
    if lengths.isEmpty():
        return _streamed(own, turns)
    lengths = staged(lengths, "long")
    big = F.col("conv_id").eqNullSafe(F.col("_big"))
    return _streamed(own.join(lengths, big, "left_anti"), turns).unionByName(_long(own.join(lengths, big, "left_semi"), turns, size))


def report(rows: DataFrame, long: int = RUN, size: int = RUN) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of (conv_id, turn, role, text)."""
    return _both(rows, False, long, size)


def repaired(rows: DataFrame, long: int = RUN, size: int = RUN) -> DataFrame:
    """The repaired turns: conv_id, place from 0, edit (K, R or I), role, text."""
    return _both(rows, True, long, size)
