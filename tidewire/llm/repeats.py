"""Suffix-array dedup: suffixes ordered only through `depth` bytes, by radix passes from the most significant digit on.

Every byte of every document starts a suffix; two suffixes are equal when their first `depth` bytes are. The suffixes
are never sorted whole: each pass parts the groups that the pass before left, by one more digit, and lets go of groups
that have a single member; after the last digit the groups that are left are exactly the repeated windows.

Digit 1 is the least `gram`-byte gram (by hash, leftmost first) among a window's own grams: equal windows have equal
ones, and neighbouring windows mostly share theirs, so that a run of windows goes through this pass as one row instead of
one row a byte. Digit 2 is all that the windows of a run cover. Runs that are equal there are repeated as a whole.
Where one gram has unequal runs, one run of each kind goes on, and its single windows are parted by the remaining
digits: for grams with up to `crowd` kinds by the window's bytes in quarters, in numpy within a task; for more by shuffles
of blocks of 64, of 8 and of single windows, where only blocks that share their common
bytes with a different one go on. Digits are compared by 128 bits of hash of their bytes.

Defined cases: null and empty texts, and texts shorter than `depth`, have no windows; equal rows repeat each other;
overlapping repeats within one text count; extra columns are ignored; an empty table gives an empty result.
Scale: one row of about 50 bytes for about every `(depth - gram) / 2` bytes of text is shuffled twice; texts are shuffled
once, with the spans. No group is gathered: equal runs are counted map-side first, and crowds go by blocks of
windows, a few rows for each kind.

Passages: the same two digits over words instead of bytes (white space aside) find strings of `passage` words that another
document has too, whatever bytes they have. They are counted, not removed. Only runs whose gram another text has go on from
the first shuffle, by gram, where one run stands for all of a slice of texts; words are compared by 64 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, mapped, same_row, staged

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_CHARS = np.random.default_rng(2024).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64, kept."""
    have = _powers.get(int(base))
    if have is None or len(have) <= n:
        steps = np.full(max(n, 1 << 16) + 1, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Prefix:
    """Hashes of any stretch of some bytes, 64 bits by each of two polynomials."""

    def __init__(self, data: np.ndarray):
        self.sums = []
        for k, base in enumerate((_P, _Q)):
            values = _CHARS[k][data] * _power(base, len(data))[: len(data)]
            self.sums.append(np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)]))

    def of(self, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        base = (_P, _Q)[k]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        return _mix((self.sums[k][end] - self.sums[k][start]) * _power(inverse, len(self.sums[k]))[start])


_BLANK = np.isin(np.arange(256), list(b"\t\n\v\f\r "))
_EDGE = np.ones(1, dtype=np.int8)


class Words(Prefix):
    """The same of any stretch of the words of some bytes, which ASCII white space parts."""

    def __init__(self, data: bytes):
        flat = np.frombuffer(data, dtype=np.uint8)
        turn = np.diff(np.concatenate([_EDGE, _BLANK[flat].view(np.int8), _EDGE]))
        start, end = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_CHARS[0][flat] * _power(_P, len(flat))[: len(flat)], dtype=np.uint64)])
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        word = _mix((sums[end] - sums[start]) * _power(inverse, len(flat))[start])
        self.n, self.sums = len(word), []
        for base in (_P, _Q):
            self.sums.append(np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(word * _power(base, len(word))[: len(word)], dtype=np.uint64)]))


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each `span` neighbours."""
    n = len(h) - span + 1
    pad = -len(h) % span
    rows = np.concatenate([h, np.full(pad, np.iinfo(h.dtype).max, dtype=h.dtype)]).reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])


def runs(data: bytes, depth: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """Runs of windows with one least gram: start, count, offset of the gram in the first, the gram's hash, digit 2 (two halves)."""
    return _runs(Prefix(np.frombuffer(data, dtype=np.uint8)), len(data), depth, gram) if len(data) >= depth else None


def word_runs(data: bytes, depth: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """The same of words: windows of `depth` words, grams of `gram` words."""
    words = Words(data)
    return _runs(words, words.n, depth, gram) if words.n >= depth else None


def _runs(prefix: Prefix, n: int, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    at = np.arange(n - gram + 1)
    grams = prefix.of(at, at + gram, 0)
    bits = max(1, int(n).bit_length())
    # the high bits of the hash, then the place: the leftmost of equal grams is the least
    order = (grams >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)
    place = (_least(order, depth - gram + 1) & np.uint64((1 << bits) - 1)).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    count = np.diff(np.append(start, len(place)))
    least = place[start]
    end = start + count - 1 + depth
    tag = ((least - start).astype(np.uint64) << np.uint64(32)) | count.astype(np.uint64)
    halves = [_mix(prefix.of(start, end, k) ^ (tag * np.uint64(0xD6E8FEB86659FD93))) for k in (0, 1)]
    return start, count, least - start, grams[least].view(np.int64), halves[0].view(np.int64), halves[1].view(np.int64)


RUNS = "doc_id long, th long, start int, n int, gram long, d1 long, d2 long"


def _list_runs(docs: DataFrame, depth: int, gram: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            parts = []
            for i, t, th in zip(pdf["doc_id"], pdf["text"], pdf["th"], strict=True):
                got = runs(t.encode(), depth, gram) if t else None
                if got is not None:
                    parts.append((len(got[0]), i, th, got))
            if parts:
                size = [p[0] for p in parts]
                cols = [np.concatenate([p[3][k] for p in parts]) for k in range(6)]
                ids = pd.array([p[1] for p in parts], dtype="Int64").repeat(size)
                yield pd.DataFrame({"doc_id": ids, "th": np.repeat([p[2] for p in parts], size), "start": cols[0], "n": cols[1], "gram": cols[3], "d1": cols[4], "d2": cols[5]})

    return mapped(docs, run, RUNS, "text")


def _list_word_runs(docs: DataFrame, passage: int, gram: int) -> DataFrame:
    """Runs of words. Where texts of one slice share a gram, one run stands for it with the least th and the greatest (`other`); the rest are `known`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            parts = []
            for i, t, th in zip(pdf["doc_id"], pdf["text"], pdf["th"], strict=True):
                got = word_runs(t.encode(), passage, gram) if t else None
                if got is not None:
                    parts.append((len(got[0]), i, th, got))
            if parts:
                size = [p[0] for p in parts]
                start, n, grams, d1 = (np.concatenate([p[3][k] for p in parts]) for k in (0, 1, 3, 4))
                th = np.repeat(np.array([p[2] for p in parts], dtype=np.int64), size)
                order = np.lexsort([th, grams])
                first = np.flatnonzero(np.concatenate([[True], np.diff(grams[order]) != 0]))
                last = np.append(first[1:], len(order)) - 1
                shared = th[order[first]] != th[order[last]]
                known = np.zeros(len(order), dtype=bool)
                known[order] = np.repeat(shared, last - first + 1)
                other = th.copy()
                known[order[first]] = False
                other[order[first]] = th[order[last]]
                ids = pd.array([p[1] for p in parts], dtype="Int64").repeat(size)
                yield pd.DataFrame({"doc_id": ids, "th": th, "start": start, "n": n, "gram": grams, "d1": d1, "other": other, "known": known})

    return mapped(docs, run, "doc_id long, th long, start int, n int, gram long, d1 long, other long, known boolean", "text")


ASKED = ("gram", "d1", "d2", "many", "start", "n", "lo", "hi")


def _cut(docs: DataFrame, kinds: DataFrame, depth: int, passage: int | None = None) -> DataFrame:
    """The bytes that one run of each kind covers: (gram, d1, d2, many, lo, hi, words, bytes); of runs of words the hashes of their windows."""
    asked = kinds.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*ASKED, "words")).alias("asked"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for t, asked in zip(pdf["text"], pdf["asked"], strict=True):
                flat = t.encode()
                words = Words(flat) if any(a["words"] for a in asked) else None
                for a in asked:
                    if a["words"]:
                        at = np.arange(a["start"], a["start"] + a["n"])
                        data = words.of(at, at + passage, 1).tobytes()
                    else:
                        data = flat[a["start"] : a["start"] + a["n"] - 1 + depth]
                    rows.append((a["gram"], a["d1"], a["d2"], a["many"], a["lo"], a["hi"], a["words"], data))
            yield pd.DataFrame(rows, columns=["gram", "d1", "d2", "many", "lo", "hi", "words", "bytes"])

    # a text is asked for about as many runs as it has: bounded by the text
    return mapped(docs.join(asked, same_row(docs, asked)).select(docs["text"], "asked"), run, "gram long, d1 long, d2 long, many boolean, lo long, hi long, words boolean, bytes binary", "text")


def _quarters(data: bytes, depth: int) -> np.ndarray:
    """Digits 3 to 6 of each window, two 64-bit numbers each: (windows, 4, 2)."""
    prefix = Prefix(np.frombuffer(data, dtype=np.uint8))
    at = np.arange(len(data) - depth + 1)
    edge = [depth * q // 4 for q in range(5)]
    return np.stack([np.stack([prefix.of(at + edge[q], at + edge[q + 1], k) for k in (0, 1)], axis=1) for q in range(4)], axis=1)


def radix(digits: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which rows are equal to another row of their group in all digits: passes from the first digit on, singles let go."""
    alive = np.arange(len(digits))
    for d in range(digits.shape[1]):
        if not len(alive):
            break
        key = np.stack([group, digits[alive, d, 0], digits[alive, d, 1]])
        order = np.lexsort(key)
        key = key[:, order]
        fresh = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])
        number = np.cumsum(fresh) - 1
        more = np.bincount(number)[number] > 1
        alive, group = alive[order][more], number[more].astype(np.uint64)
    out = np.zeros(len(digits), dtype=bool)
    out[alive] = True
    return out


def _intervals(flags: np.ndarray) -> list[dict]:
    turn = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return [{"a": int(a), "b": int(b)} for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True)]


KIND = "gram long, d1 long, d2 long, spans array<struct<a:int,b:int>>"


def _within(kinds: DataFrame, depth: int) -> DataFrame:
    """Repeated windows of the kinds of one gram, for grams with few kinds: [a, b) of window numbers within a kind's run."""

    def solve(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if len(rows) > 1:
            digits = [_quarters(r[3], depth) for r in rows]
            flags = radix(np.concatenate(digits), np.repeat(np.array([r[4] for r in rows], dtype=np.uint64), [len(d) for d in digits]))
            parts = np.split(flags, np.cumsum([len(d) for d in digits])[:-1])
            out = [(*r[:3], _intervals(f)) for r, f in zip(rows, parts, strict=True) if f.any()]
            if out:
                yield pd.DataFrame(out, columns=["gram", "d1", "d2", "spans"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in frames:
            for g, d1, d2, data in zip(pdf["gram"], pdf["d1"], pdf["d2"], pdf["bytes"], strict=True):
                if len(held) > 2000 and held[-1][0] != g:
                    yield from solve(held)
                    held = []
                number = held[-1][4] + (held[-1][0] != g) if held else 0
                held.append((g, d1, d2, data, number))
        yield from solve(held)

    n = int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kinds.repartition(n, "gram").sortWithinPartitions("gram").mapInPandas(run, KIND)


BLOCKS = "gram long, d1 long, d2 long, j int, a int, b int, c1 long, c2 long, w1 long, w2 long"
WIDTHS = (64, 8, 1)


def blocks(data: bytes, least: int, depth: int, gram: int, width: int, chosen: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """The run's windows in blocks of `width` neighbours, by the bytes that they have before the least gram.

    Block numbers, [a, b) of window numbers, hashes of the bytes that all windows of the block have (core) and that any
    has (whole). `chosen` are the only blocks to take, null for all.
    """
    prefix = Prefix(np.frombuffer(data, dtype=np.uint8))
    at = np.arange(len(data) - gram + 1)
    off = int(np.flatnonzero(prefix.of(at, at + gram, 0).view(np.int64) == least)[0])
    left = off - (len(data) - depth)
    j = np.arange(left // width, off // width + 1)
    if chosen is not None:
        j = j[np.isin(j, chosen)]
    most, fewest = np.minimum(off, j * width + width - 1), np.maximum(left, j * width)
    a, b = off - most, off - fewest + 1
    core, end = off - j * width, off + gram + np.maximum(0, depth - gram - j * width - width + 1)
    tags = j.astype(np.uint64), most.astype(np.uint64) << np.uint64(32) | (b - a).astype(np.uint64)
    hashes = [_mix(prefix.of(lo, hi, k) ^ (tag * np.uint64(0xD6E8FEB86659FD93))).view(np.int64) for lo, hi, tag in ((core, end, tags[0]), (a, b - 1 + depth, tags[1])) for k in (0, 1)]
    return j, a, b, *hashes


def _list_blocks(kinds: DataFrame, depth: int, gram: int, width: int, before: int | None) -> DataFrame:
    """blocks() of each kind, within its blocks `js` of `before` windows where that is given."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            parts, keys = [], []
            for g, d1, d2, data, js in zip(pdf["gram"], pdf["d1"], pdf["d2"], pdf["bytes"], pdf["js"], strict=True):
                inner = None if before is None else (np.asarray(js)[:, None] * (before // width) + np.arange(before // width)).ravel()
                parts.append(blocks(data, g, depth, gram, width, inner))
                keys.append((g, d1, d2))
            if parts:
                of = np.repeat(np.array(keys, dtype=np.int64), [len(p[0]) for p in parts], axis=0)
                columns = dict(zip(("j", "a", "b", "c1", "c2", "w1", "w2"), (np.concatenate([p[k] for p in parts]) for k in range(7)), strict=True))
                yield pd.DataFrame({"gram": of[:, 0], "d1": of[:, 1], "d2": of[:, 2]} | columns)

    return kinds.mapInPandas(run, BLOCKS)


def _across(kinds: DataFrame, depth: int, gram: int) -> DataFrame:
    """The same for grams with many kinds: blocks of windows are rows, parted in a shuffle, and halved where that isn't enough.

    A block whose whole is another's is repeated. One of each whole goes on, in narrower blocks, where others have the
    same core and another whole; at width 1 core and whole are the window.
    """
    key = ["gram", "d1", "d2"]
    open_, before, found = kinds.withColumn("js", F.lit(None).cast("array<int>")), None, []
    for width in WIDTHS:
        rows = staged(_list_blocks(open_, depth, gram, width, before), "blocks")
        wholes = rows.groupBy("w1", "w2").agg(F.count("*").alias("c"), F.min(F.struct(*key, "j", "c1", "c2")).alias("one"))
        wholes = staged(wholes.select("w1", "w2", "c", "one.*"), "wholes")
        again = wholes.filter("c > 1").select("w1", "w2")
        found.append(rows.join(again, ["w1", "w2"]).select(*key, "a", "b"))
        if width > 1:
            shared = wholes.groupBy("c1", "c2").agg(F.count("*").alias("n")).filter("n > 1").select("c1", "c2")
            # a kind has at most depth - gram + 1 windows: the lists are bounded
            chosen = wholes.join(shared, ["c1", "c2"], "left_semi").groupBy(*key).agg(F.collect_list("j").alias("js"))
            open_, before = kinds.join(chosen, key), width
    spans = found[0].unionByName(found[1]).unionByName(found[2])
    return spans.groupBy(*key).agg(F.collect_list(F.struct("a", "b")).alias("spans"))


WORD_KIND = "gram long, d1 long, spans array<struct<a:int,b:int>>"


def _words_within(kinds: DataFrame) -> DataFrame:
    """Windows of words that another text has, of the kinds of one gram, for grams with few kinds: [a, b) of window numbers."""

    def solve(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        size = [len(r[4]) // 8 for r in rows]
        gram, lo, hi = (np.repeat(np.array([r[k] for r in rows], dtype=np.int64), size) for k in (0, 2, 3))
        window = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.int64)
        order = np.lexsort([window, gram])
        gram, window = gram[order], window[order]
        fresh = np.concatenate([[True], (gram[1:] != gram[:-1]) | (window[1:] != window[:-1])])
        first = np.flatnonzero(fresh)
        shared = np.zeros(len(order), dtype=bool)
        shared[order] = (np.minimum.reduceat(lo[order], first) != np.maximum.reduceat(hi[order], first))[np.cumsum(fresh) - 1]
        out = [(r[0], r[1], _intervals(f)) for r, f in zip(rows, np.split(shared, np.cumsum(size)[:-1]), strict=True) if f.any()]
        if out:
            yield pd.DataFrame(out, columns=["gram", "d1", "spans"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in frames:
            for r in zip(pdf["gram"], pdf["d1"], pdf["lo"], pdf["hi"], pdf["bytes"], strict=True):
                if len(held) > 2000 and held[-1][0] != r[0]:
                    yield from solve(held)
                    held = []
                held.append(r)
        if held:
            yield from solve(held)

    n = int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kinds.repartition(n, "gram").sortWithinPartitions("gram").mapInPandas(run, WORD_KIND)


def _words_across(kinds: DataFrame) -> DataFrame:
    """The same for grams with many kinds: windows are rows, counted map-side first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            size = pdf["bytes"].map(len).to_numpy() // 8
            if len(pdf):
                rows = pdf[["gram", "d1", "lo", "hi"]].loc[pdf.index.repeat(size)]
                yield rows.assign(j=np.concatenate([np.arange(k) for k in size]), w=np.frombuffer(b"".join(pdf["bytes"]), dtype=np.int64))

    rows = staged(kinds.select("gram", "d1", "lo", "hi", "bytes").mapInPandas(run, "gram long, d1 long, lo long, hi long, j int, w long"), "windows")
    shared = rows.groupBy("gram", "w").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo != hi").select("gram", "w")
    # a kind has at most passage - gram + 1 windows: the lists are bounded
    return rows.join(shared, ["gram", "w"]).groupBy("gram", "d1").agg(F.collect_list(F.struct(F.col("j").alias("a"), (F.col("j") + 1).alias("b"))).alias("spans"))


def _placed(listed: DataFrame, found: DataFrame, key: list[str], depth: int) -> DataFrame:
    """(doc_id, th, spans) of the runs whose kind is found, spans counted from the text's start."""
    hit = listed.join(found, key).select("doc_id", "th", F.transform("spans", lambda s: F.struct((F.col("start") + s["a"]).alias("a"), (F.col("start") + s["b"] - 1 + depth).alias("b"))).alias("spans"))
    # spans of one document: at most a few for every run of it
    return hit.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _word_kinds(own: DataFrame, passage: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Runs of words whose gram another text has, and their kinds with the least and the greatest th."""
    # known runs are dealt by text: a very common gram has but a few others in each slice
    of = Window.partitionBy("gram", F.when(F.col("known"), F.col("th")))
    listed = _list_word_runs(own, passage, gram).withColumn("lo", F.min("th").over(of)).withColumn("hi", F.max("other").over(of))
    listed = staged(listed.filter("known OR lo != hi").select("doc_id", "th", "start", "n", "gram", "d1"), "word-runs")
    kinds = listed.groupBy("gram", "d1").agg(F.min("th").alias("lo"), F.max("th").alias("hi"), F.min(F.struct("doc_id", "th", "start", "n")).alias("one"))
    return listed, staged(kinds.select("gram", "d1", "lo", "hi", "one.*"), "word-kinds")


def _mixed(kinds: DataFrame, crowd: int) -> DataFrame:
    """The kinds of grams that have several, and whether those are more than `crowd` (`many`)."""
    grams = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1").select(F.col("gram").alias("g"), (F.col("kinds") > crowd).alias("many"))
    return kinds.join(grams, F.col("gram") == F.col("g")).drop("g")


def _found(own: DataFrame, depth: int, gram: int, crowd: int, passage: int | None = None, word_gram: int = 16, word_crowd: int = 4096) -> tuple[DataFrame, DataFrame | None]:
    """find(), and (doc_id, th, passages, copied) where `passage` is given: texts are shuffled once for both."""
    if passage:
        word_listed, word_kinds = _word_kinds(own, passage, word_gram)
    listed = staged(_list_runs(own, depth, gram), "runs")
    kinds = listed.groupBy("gram", "d1", "d2").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "start")).alias("one"), F.max("n").alias("n"))
    kinds = staged(kinds, "kinds")
    none = F.lit(0).cast("long")
    mixed = _mixed(kinds, crowd).select("gram", "d1", "d2", "many", "one.*", "n", none.alias("lo"), none.alias("hi"), F.lit(False).alias("words"))
    if passage:
        mixed = mixed.unionByName(_mixed(word_kinds, word_crowd).select("gram", "d1", none.alias("d2"), "many", "doc_id", "th", "start", "n", "lo", "hi", F.lit(True).alias("words")))
    cut = staged(_cut(own, mixed, depth, passage), "cuts")
    passages = None
    if passage:
        one = word_kinds.filter("lo != hi").select("gram", "d1", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("spans"))
        parts = cut.filter("words")
        shared = one.unionByName(_words_within(parts.filter("NOT many"))).unionByName(_words_across(parts.filter("many")))
        placed = _placed(word_listed, shared, ["gram", "d1"], passage).select("doc_id", "th", "spans", F.lit(False).alias("copied"))
        # texts that stand in more than one row are passages of each other whole
        copies = own.select("doc_id", "th").withColumn("c", F.count("*").over(Window.partitionBy("th"))).filter("c > 1")
        copies = copies.select("doc_id", "th", F.lit(None).cast(placed.schema["spans"].dataType).alias("spans"), F.lit(True).alias("copied"))
        passages = staged(placed.unionByName(copies).groupBy("doc_id", "th").agg(F.first("spans", True).alias("passages"), F.max("copied").alias("copied")), "passages")
    cut = cut.filter("NOT words").select("gram", "d1", "d2", "bytes", "many")
    part = _within(cut.filter("NOT many").drop("many"), depth).unionByName(_across(cut.filter("many").drop("many"), depth, gram))
    whole = kinds.filter("c > 1").select("gram", "d1", "d2", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("spans"))
    # a kind that is repeated as a whole may have come through the other digits too
    return _placed(listed, whole.unionByName(part), ["gram", "d1", "d2"], depth), passages


def find(docs: DataFrame, depth: int = 400, gram: int = 128, crowd: int = 256) -> DataFrame:
    """(doc_id, th, spans) of the rows with repeated windows: spans are byte ranges [a, b) covered by them, may touch."""
    return _found(keyed(docs), depth, gram, crowd)[0]


def merged(spans) -> list[tuple[int, int]]:
    """The maximal ranges that the spans cover."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_bytes(data: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of `data` without the spans, and the maximal removed ranges."""
    removed = merged(spans)
    kept, at = [], 0
    for a, b in removed:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept), removed


def remove(docs: DataFrame, depth: int = 400, gram: int = 128, crowd: int = 256, passage: int | None = None, word_gram: int = 16, word_crowd: int = 4096) -> DataFrame:
    """The columns of op8's contract, and the removed byte ranges.

    With `passage`: n_shared_words, the words in strings of so many words that another document has too (white space
    aside, nothing is removed for them), and n_passages, their maximal runs."""
    own = keyed(docs)
    found, passages = _found(own, depth, gram, crowd, passage, word_gram, word_crowd)
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<a:int,b:int>>"
    if passages is None:
        rows = own.join(found, same_row(own, found), "left").select(own["doc_id"], own["text"], "spans")
    else:
        kind += ", n_shared_words long, n_passages long"
        empty = F.lit(None).cast(found.schema["spans"].dataType)
        both = found.select("doc_id", "th", "spans", empty.alias("passages"), F.lit(False).alias("copied"))
        both = both.unionByName(passages.select("doc_id", "th", empty.alias("spans"), "passages", "copied"))
        both = both.groupBy("doc_id", "th").agg(F.first("spans", True).alias("spans"), F.first("passages", True).alias("passages"), F.max("copied").alias("copied"))
        rows = own.join(both, same_row(own, both), "left").select(own["doc_id"], own["text"], "spans", "passages", "copied")

    def shared(data: bytes, spans, copied) -> tuple[int, int]:
        if not pd.isna(copied) and copied:
            n = len(data.split())
            return (n, 1) if n >= passage else (0, 0)
        ranges = merged(spans) if spans is not None else []
        return sum(b - a for a, b in ranges), len(ranges)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for i, t, spans, *more in zip(*(pdf[c] for c in pdf.columns), strict=True):
                data = t.encode() if t else b""
                kept, removed = cut_bytes(data, spans if spans is not None else [])
                row = (i, len(data), len(data) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), [{"a": a, "b": b} for a, b in removed])
                rows.append(row + shared(data, *more) if passage else row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    return mapped(rows, run, kind, "text")
