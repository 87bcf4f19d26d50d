"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

The words of a text are the runs of digits, ASCII letters (lower-cased) and non-ASCII characters. A window is `n`
consecutive words of one benchmark item; an item with fewer words, but not none, is one window. A document word inside
any occurrence of a window is hit. Hits of the hash set are verified word by word.

Defined cases: a null, empty or word-free text has no words and no hits; a null or word-free item has no windows; the
windows of an item with a null item_id hit like any others, but it has no name to be listed or counted by; repeated
documents and items are each judged by themselves; an empty benchmark hits nothing; columns of any name may stand beside
those that are read.

Scale: one narrow pass over the documents for each block of the benchmark, no shuffle for a single block. A block is
broadcast as sorted arrays: about 5 bytes for each byte of its text, and its distinct words. A benchmark of more than
`block_bytes` of text is cut into blocks by a hash of item_id and text; no task and no driver holds more than one. Each
block's hits are written; all hits are grouped once by document, and joined once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import edited, keyed, mapped, staged, with_found

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SPANS = "array<struct<start:int,end:int>>"
BLOCK_BYTES = 4 << 20


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


def _mix(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), dtype=np.uint64)
    for j in range(rows.shape[1]):
        h = (h ^ rows[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class NgramSet:
    """Windows of benchmark items. For each window length: sorted hashes, the place of one occurrence of each distinct window in
    `flat`, the items' words as numbers laid end to end, and the items of each window (`edge` into `of`)."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.vocab: dict[bytes, int] = {}
        parts = [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words(text)], dtype=np.int32) for _, text in items]
        self.names = [item for item, _ in items]
        self.flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
        size = np.array([len(p) for p in parts], dtype=np.int64)
        first = np.cumsum(size) - size
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        length = np.minimum(size, n)
        for k in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == k)
            count = size[own] - k + 1
            item = np.repeat(own, count)
            at = np.repeat(first[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            h = _mix(self.flat[at[:, None] + np.arange(k)])
            order = np.lexsort((at, h))
            h, at, item = h[order], at[order], item[order]
            # equal hashes with unequal words, should there be any, stay entries of their own
            new = np.ones(len(h), dtype=bool)
            same = np.flatnonzero(h[1:] == h[:-1]) + 1
            new[same] = (self.flat[at[same][:, None] + np.arange(k)] != self.flat[at[same - 1][:, None] + np.arange(k)]).any(axis=1)
            self.windows[k] = h[new], at[new], np.append(np.flatnonzero(new), len(h)), item

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: its number of words, its hit word spans [start, end), the items whose windows occur, sorted."""
        found = [words(t) for t in texts]
        sizes = np.array([len(w) + 1 for w in found], dtype=np.int64)  # one more: a gap that no window crosses
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ids = np.full(first[-1], -1, dtype=np.int32)
        for at, w in zip(first, found, strict=False):
            ids[at : at + len(w)] = np.fromiter(map(self.vocab.get, w, repeat(-1)), dtype=np.int32, count=len(w))
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        edge = np.zeros(len(ids) + 1, dtype=np.int64)
        items: list[set[str]] = [set() for _ in texts]
        for k, (hashes, place, bound, item) in self.windows.items():
            if len(ids) < k:
                continue
            at = np.flatnonzero(unknown[k:] == unknown[:-k])
            h = _mix(ids[at[:, None] + np.arange(k)])
            entry = np.searchsorted(hashes, h)
            while len(at):
                inside = entry < len(hashes)
                at, h, entry = at[inside], h[inside], entry[inside]
                match = hashes[entry] == h
                at, h, entry = at[match], h[match], entry[match]
                equal = (ids[at[:, None] + np.arange(k)] == self.flat[place[entry][:, None] + np.arange(k)]).all(axis=1)  # verified word by word
                np.add.at(edge, at[equal], 1)
                np.add.at(edge, at[equal] + k, -1)
                docs = np.searchsorted(first, at[equal], side="right") - 1
                for doc, e in np.unique(np.stack([docs, entry[equal]], axis=1), axis=0).tolist():
                    items[doc].update(self.names[i] for i in item[bound[e] : bound[e + 1]].tolist() if self.names[i] is not None)
                entry = entry + 1
        turn = np.diff(np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        docs = np.searchsorted(first, starts, side="right") - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        for s, e, doc in zip(starts, ends, docs, strict=True):
            spans[doc].append((int(s - first[doc]), int(e - first[doc])))
        return [(len(w), s, sorted(i)) for w, s, i in zip(found, spans, items, strict=True)]


def _parts(benchmark: DataFrame, block_bytes: int) -> int:
    total = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return -(-total // block_bytes) or 1


def _blocks(benchmark: DataFrame, n: int, parts: int) -> Iterator[NgramSet]:
    """The benchmark as `parts` n-gram sets, one after the other."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    for k in range(parts):
        part = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        yield NgramSet([tuple(r) for r in part.collect()], n)


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    new: list[list[int]] = []
    for a, b in sorted(spans):
        if new and a <= new[-1][1]:
            new[-1][1] = max(new[-1][1], b)
        else:
            new.append([a, b])
    return [(a, b) for a, b in new]


def _hits(docs: DataFrame, benchmark: DataFrame, n: int, parts: int) -> DataFrame:
    """(doc_id, th, spans, items) of the rows that any block hits, once for each key. A block's hits are written before the next is read."""
    spark, found, own = docs.sparkSession, [], keyed(docs)
    for block in _blocks(benchmark, n, parts):
        sent = spark.sparkContext.broadcast(block)

        def scan(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                got = sent.value.scan(pdf["text"].tolist())
                hit = [bool(g[1]) for g in got]
                if any(hit):
                    yield pdf.loc[hit, ["doc_id", "th"]].assign(spans=[[{"start": a, "end": b} for a, b in g[1]] for g in got if g[1]], items=[g[2] for g in got if g[1]])

        found.append(staged(mapped(own, scan, f"doc_id long, th long, spans {SPANS}, items array<string>", "text").dropDuplicates(["doc_id", "th"]), "hits"))
        sent.destroy()
    # the hits of one text: bounded by the text and the items that it holds
    return reduce(DataFrame.union, found).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, n_words, spans (hit words, [start, end)), items (sorted as strings) for each document."""
    schema = f"doc_id long, text string, n_words long, spans {SPANS}, items array<string>"
    parts = _parts(benchmark, block_bytes)
    if parts == 1:
        sent = docs.sparkSession.sparkContext.broadcast(next(_blocks(benchmark, n, 1)))

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                got = sent.value.scan(pdf["text"].tolist())
                yield pdf.assign(n_words=[g[0] for g in got], spans=[[{"start": a, "end": b} for a, b in g[1]] for g in got], items=[g[2] for g in got])

        return mapped(keyed(docs).drop("th"), scan, schema, "text")

    def unite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            spans = [[] if own is None else [{"start": a, "end": b} for a, b in _united([(s["start"], s["end"]) for s in own])] for own in pdf[names[0]]]
            yield pdf.assign(n_words=[len(words(t)) for t in pdf["text"]], spans=spans, items=[[] if i is None else i for i in pdf[names[1]]])

    rows, names = with_found(keyed(docs).drop("th"), _hits(docs, benchmark, n, parts), "spans", "items")
    return mapped(rows, unite, schema, "text")


def digest(found: DataFrame) -> DataFrame:
    """The columns of op2's contract from find()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def strip(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_share: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents (all columns of `docs`, in order) without their hit words; a document of which more than `max_share` of the words are hit goes.

    A removed span runs from the first byte of its first word to the last byte of its last word. Documents without
    hits keep their text untouched; n_chars, if there, is counted anew where a text changed. A benchmark of one block takes
    one narrow pass."""
    parts = _parts(benchmark, block_bytes)

    def cut(texts: list[str | None], sizes: list[int], spans: list[list[tuple[int, int]]]) -> tuple[list[str | None], list[bool]]:
        keep, new = [], []
        for text, size, own in zip(texts, sizes, spans, strict=True):
            hit = {i for a, b in own for i in range(a, b)}
            keep.append(not hit or len(hit) <= max_share * size)
            new.append(without(text, hit) if hit and keep[-1] else text)
        return new, keep

    if parts == 1:
        sent = docs.sparkSession.sparkContext.broadcast(next(_blocks(benchmark, n, 1)))

        def scan(texts: list[str | None]) -> tuple[list[str | None], list[bool]]:
            got = sent.value.scan(texts)
            return cut(texts, [g[0] for g in got], [g[1] for g in got])

        return edited(docs, docs, scan)

    def apply(texts: list[str | None], found: list) -> tuple[list[str | None], list[bool]]:
        spans = [[] if own is None else [(s["start"], s["end"]) for s in own] for own in found]
        return cut(texts, [len(words(t)) if s else 0 for t, s in zip(texts, spans, strict=True)], spans)

    rows, (spans,) = with_found(docs, _hits(docs, benchmark, n, parts), "spans")
    return edited(rows, docs, apply, (spans,))


def without(text: str, hit: set[int]) -> str:
    """`text` without the words numbered in `hit`, and without what stands between two of them."""
    flat, out, at, last = text.encode(), [], 0, -1
    plain = flat.translate(_WORDS)
    pos = 0
    for i, w in enumerate(plain.split()):
        pos = plain.index(w, pos)
        if i in hit:
            if last != i - 1 or last < 0:
                out.append(flat[at:pos])
            at, last = pos + len(w), i
        pos += len(w)
    out.append(flat[at:])
    return b"".join(out).decode()
