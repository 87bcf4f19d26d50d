"""Substring dedup by hashing of units: normalised lines, grouped by digest over all documents; the earliest one stays.

A unit is a line that isn't blank. Normalised: lower case, white space runs as one blank. Digest: 128 bits. The earliest
occurrence is that of the least (rank, doc_id, place in the text), with rank an optional column; all others are removed,
each with its line break, and what is removed is given as character ranges of the original text. A repeated paragraph is
a run of repeated lines, and goes with them.

With `sentences`, a number of words, sentences of so many words or more within the lines are units too (a line is cut
behind ".", "!" and "?"): for passages spliced into other lines. A line goes where the same line, or a sentence equal to
it, stands earlier; sentences go only from lines that stay.

With `run`, a number of words, runs of sentences that all stand earlier too go from lines that stay, if they have so many
words together: passages spliced into other lines go, sentences that repeat by chance stay. Their digests are 64 bits: of
10^10 sentences some three pairs are taken for equal, which matters where one of them completes a run.

Defined cases: null and empty texts have no units and stay as they are; rows that repeat a doc_id and text are one
document and keep alike what that document keeps (equal texts under different ids leave their units to the first); a null
id or rank sorts first; an empty table gives an empty result; columns of any name may stand beside doc_id and text.
Scale: units (about 60 bytes each) are shuffled once for the groups' first places and counts, after map-side
combination, and once for the join with the repeated digests; texts once with their removals. No group is gathered, and a
unit of a third of all rows is one row of each map task after the combination; the join on it is left to skew handling.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import edited, ids, mapped, plain, with_found

PIECE = re.compile(r"[^\n.!?]+[.!?]*")
LINE = re.compile(r"[^\n]+\n?")


def _digest(words: list[str]) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.md5(" ".join(words).lower().encode(), usedforsecurity=False).digest())


def units(text: str | None, sentences: int | None = None) -> list[tuple[int, int, int, int]]:
    """(start, end, digest's halves) of each line and, if given, of each sentence of so many words."""
    lines = {}
    for m in LINE.finditer(text or ""):
        if words := m[0].split():
            lines[m.start()] = (m.start(), m.end(), *_digest(words))
    out = [*lines.values()]
    for m in PIECE.finditer(text or "") if sentences else ():
        words = m[0].split()
        if len(words) >= sentences:
            d = _digest(words)
            if lines.get(m.start(), ())[2:] != d:  # else the line is this sentence
                out.append((m.start(), m.end(), *d))
    return out


def pieces(text: str | None) -> list[tuple[int, int, int, int, int]]:
    """(start, end, digest, 0, words) of each sentence that has a word."""
    out = []
    for m in PIECE.finditer(text or ""):
        if words := m[0].split():
            out.append((m.start(), m.end(), _digest(words)[0], 0, len(words)))
    return out


def _runs(found: list[tuple[int, int, int, int]], lines: list[tuple[int, int]], run: int) -> list[tuple[int, int]]:
    """Ranges of the runs of `run` or more words, from repeated sentences (number, start, end, words) that lie in none of `lines`."""
    out, held = [], []
    inside = iter(sorted(lines))
    line = next(inside, None)
    for k, a, b, w in sorted(found):
        while line and line[1] <= a:
            line = next(inside, None)
        if line and line[0] <= a:
            continue
        if held and held[-1][0] + 1 != k:
            out.append(held)
            held = []
        held.append((k, a, b, w))
    return [(h[0][1], h[-1][2]) for h in [*out, held] if sum(x[3] for x in h) >= run]


def _rows(docs: DataFrame, sentences: int | None, run_words: int | None, rank: str | None) -> DataFrame:
    """(rank if there is one, doc_id, th, p, q, d1, d2) of each unit: p is its range, start and end in 31 bits each, q the number and words of a
    sentence in 32 bits each, or -1. These rows are shuffled twice, so they are small."""
    rows = docs.select(*([F.col(rank).alias("rank")] if rank else []), ids(docs).alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    row = [c for c in rows.columns if c != "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            own = [[(u[0] << 31 | u[1], -1, *u[2:]) for u in units(t, sentences)] + [(u[0] << 31 | u[1], k << 32 | u[4], *u[2:4]) for k, u in enumerate(pieces(t) if run_words else ())] for t in pdf["text"]]
            size = [len(u) for u in own]
            if not sum(size):
                continue
            cols = np.array([u for us in own for u in us], dtype=np.int64)
            out = pdf[row].loc[pdf.index.repeat(size)].reset_index(drop=True)
            yield out.assign(p=cols[:, 0], q=cols[:, 1], d1=cols[:, 2], d2=cols[:, 3])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in row)
    return mapped(rows, run, f"{kinds}, p long, q long, d1 long, d2 long", "text")


SPANS = "array<struct<a:int,b:int>>"


def find(docs: DataFrame, sentences: int | None = None, rank: str | None = None, run: int | None = None) -> DataFrame:
    """(doc_id, th, n_units, spans) of the rows that lose something: spans are character ranges [a, b), by start; a line's holds its
    sentences'; n_units of them are lines (or sentences by `sentences`), the others runs."""
    rows = _rows(docs, sentences, run, rank)
    groups = rows.groupBy("d1", "d2").agg(F.count("*").alias("c"), F.min(F.struct(*[c for c in rows.columns if c in ("rank", "doc_id", "th", "p")])).alias("one")).filter("c > 1").drop("c")
    is_first = F.col("one.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("one.th") == F.col("th")) & (F.col("one.p") == F.col("p"))
    gone = rows.join(groups, ["d1", "d2"]).filter(~is_first).select("doc_id", "th", "p", "q").distinct()
    # the units of one text: bounded by the text
    high, low = lambda c, n: F.shiftright(c, n).cast("int"), lambda c, n: F.col(c).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
    a, b = high("p", 31).alias("a"), low("p", 31).alias("b")
    whole = F.array_sort(F.collect_list(F.when(F.col("q") < 0, F.struct(a, b))))
    some = F.collect_list(F.when(F.col("q") >= 0, F.struct(high("q", 32).alias("k"), a, b, low("q", 32).alias("w"))))
    found = gone.groupBy("doc_id", "th").agg(whole.alias("spans"), some.alias("some")).withColumn("n_units", F.size("spans"))
    if not run:
        return found.drop("some")

    @F.pandas_udf(SPANS)
    def with_runs(spans: pd.Series, some: pd.Series) -> pd.Series:
        out = []
        for own, more in zip(spans, some, strict=True):
            own = [(x["a"], x["b"]) for x in own]
            runs = _runs([(x["k"], x["a"], x["b"], x["w"]) for x in more], own, run)
            out.append([{"a": a, "b": b} for a, b in sorted(own + runs)])
        return pd.Series(out, dtype=object)

    return found.withColumn("spans", with_runs("spans", "some")).drop("some").filter(F.size("spans") > 0)


def _without(text: str, spans) -> str:
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["a"]])
        at = max(at, s["b"])
    out.append(text[at:])
    return "".join(out)


def remove(docs: DataFrame, sentences: int | None = None, rank: str | None = None, run: int | None = None) -> DataFrame:
    """All rows and columns of `docs`, text without the removed units; n_chars, if there, is counted anew where a text changed."""
    rows, (spans,) = with_found(docs, find(docs, sentences, rank, run), "spans")
    return edited(rows, docs, lambda texts, found: ([t if s is None else _without(t, s) for t, s in zip(texts, found, strict=True)], None), (spans,))


#: Words of a run of repeated sentences that goes, in the query and the pipeline.
RUN = 20


def report(docs: DataFrame, sentences: int | None = None, rank: str | None = None, run: int | None = None) -> DataFrame:
    """doc_id, n_units, n_removed (units), n_runs (of sentences), chars_removed, removed ("a-b,..." in characters), kept_sha256, changed."""
    rows, (spans, whole) = with_found(plain(docs), find(docs, sentences, rank, run), "spans", "n_units")

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for i, t, s, n in zip(pdf["doc_id"], pdf["text"], pdf[spans], pdf[whole].fillna(0), strict=True):
                t, s = t or "", [] if s is None else s
                kept = _without(t, s)
                out.append((i, len(units(t, sentences)), int(n), len(s) - int(n), len(t) - len(kept), ",".join(f"{x['a']}-{x['b']}" for x in s), hashlib.sha256(kept.encode()).hexdigest(), len(s) > 0))
            yield pd.DataFrame(out, columns=["doc_id", "n_units", "n_removed", "n_runs", "chars_removed", "removed", "kept_sha256", "changed"])

    return mapped(rows, told, "doc_id long, n_units long, n_removed long, n_runs long, chars_removed long, removed string, kept_sha256 string, changed boolean", "text")
