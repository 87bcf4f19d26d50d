"""Line diffs: the longest common subsequence by the furthest-reaching paths of Myers (1986), in linear space.

Lines become whole numbers first, and those that only one side has go, as they match nothing; what is left is split at
the middle of a shortest edit path again and again. Time goes with lines times differing lines, memory with the lines.
Where several subsequences are longest, one of them is taken; between two kept lines the removed ones come first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.batches import by_few, small_batches
from tidewire.functions.text import let


def _middle(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int, int]:
    """A run of matches (from x, y to u, v; maybe empty) in the middle of a shortest edit path between a[a0:a1] and b[b0:b1]."""
    n, m = a1 - a0, b1 - b0
    delta = n - m
    ahead, behind = {1: 0}, {1: 0}  # the furthest x on each diagonal, from either end; a missing one can't be reached

    def furthest(known: dict[int, int], d: int, k: int) -> int | None:
        """Where a path of d edits begins its matches on diagonal k: one line down from k + 1, or one to the right from k - 1."""
        down, right = known.get(k + 1), known.get(k - 1)
        down = None if down is None or not 0 <= down - k <= m or (k == d and d) else down
        right = None if right is None or right >= n or k == -d or not 0 <= right + 1 - k <= m else right + 1
        return down if right is None or (down is not None and down >= right) else right

    for d in range(n + m + 1):
        for k in range(-d, d + 1, 2):
            if (x := furthest(ahead, d, k)) is None:
                ahead.pop(k, None)
                continue
            at = x
            while x < n and x - k < m and a[a0 + x] == b[b0 + x - k]:
                x += 1
            ahead[k] = x
            if delta % 2 and abs(delta - k) < d and x + behind.get(delta - k, -1) >= n:
                return a0 + at, b0 + at - k, a0 + x, b0 + x - k
        for k in range(-d, d + 1, 2):
            if (x := furthest(behind, d, k)) is None:
                behind.pop(k, None)
                continue
            at = x
            while x < n and x - k < m and a[a1 - 1 - x] == b[b1 - 1 - x + k]:
                x += 1
            behind[k] = x
            if delta % 2 == 0 and abs(delta - k) <= d and x + ahead.get(delta - k, -1) >= n:
                return a1 - x, b1 - x + k, a1 - at, b1 - at + k
    raise AssertionError("unreachable")


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of the lines of a longest common subsequence, in order."""
    both = set(a) & set(b)
    number = {line: k for k, line in enumerate(both)}
    left, right = ([i for i, line in enumerate(side) if line in both] for side in (a, b))
    x, y = [number[a[i]] for i in left], [number[b[j]] for j in right]
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and x[a0] == y[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and x[a1 - 1] == y[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 < a1 and b0 < b1:
            i, j, u, v = _middle(x, y, a0, a1, b0, b1)
            out += zip(range(i, u), range(j, v), strict=True)
            todo += [(a0, i, b0, j), (u, a1, v, b1)]
    return sorted((left[i], right[j]) for i, j in out)


KINDS = ("context", "remove", "add")


def coded(a: list[str], b: list[str], around: int | None) -> list[int]:
    """changes() as numbers: three times the place of a line, in `b` if it is added, else in `a`, and the place of its kind in KINDS; -1 for "..."."""
    out: list[int] = []
    say = lambda kind, places: out.extend(3 * p + KINDS.index(kind) for p in places)
    runs, i, j = [], 0, 0  # changed stretches and the kept lines before each
    kept: list[int] = []
    for p, q in [*matches(a, b), (len(a), len(b))]:
        if p > i or q > j:
            runs.append((kept, range(i, p), range(j, q)))
            kept = []
        kept.append(p)
        i, j = p + 1, q + 1
    kept.pop()  # the end
    if not runs and around is not None:
        return out
    for nth, (own, gone, new) in enumerate(runs):
        room = len(own) if around is None else around * (2 if nth else 1)
        if len(own) > room:
            if nth:
                say("context", own[:around])
                out.append(-1)
            say("context", own[len(own) - around :])
        else:
            say("context", own)
        say("remove", gone)
        say("add", new)
    say("context", kept[: len(kept) if around is None else around])
    return out


def changes(a: list[str], b: list[str], around: int | None) -> list[dict[str, str]]:
    """Removed, added and kept lines, with `around` kept lines beside each change, or all of them; "..." stands for what is left out between."""
    line = lambda c: {"kind": KINDS[c % 3], "content": (b if c % 3 == 2 else a)[c // 3]}
    return [{"kind": "meta", "content": "..."} if c < 0 else line(c) for c in coded(a, b, around)]


def line_diff(before: str, after: str, around: int | None = 3) -> Column:
    """Lines (kind, content) that were removed and added between two texts, and those kept beside them; a null text is an empty one.

    What comes back from Python is a number a line; the lines themselves are taken from the texts where they are."""
    beside = None if around is None else max(0, around)
    small_batches()

    def numbers(p: str | None, q: str | None) -> list[int]:
        return coded((p or "").split("\n"), (q or "").split("\n"), beside)

    @F.arrow_udf("array<int>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return by_few(numbers, pa.list_(pa.int32()), x, y)

    def lines(row: Column) -> Column:
        line = lambda kind, content: F.struct(kind.alias("kind"), content.alias("content"))
        kind = lambda c: F.element_at(F.array(*[F.lit(k) for k in KINDS]), c % 3 + 1)
        at = lambda c: F.floor(c / 3).cast("int") + 1
        content = lambda c: F.when(c % 3 == 2, F.element_at(row["after"], at(c))).otherwise(F.element_at(row["before"], at(c)))
        return F.transform(row["codes"], lambda c: F.when(c < 0, line(F.lit("meta"), F.lit("..."))).otherwise(line(kind(c), content(c))))

    split = lambda text: F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    return let(F.struct(run(before, after).alias("codes"), split(before).alias("before"), split(after).alias("after")), lines)
