"""Quality classifier: supervised word, subword and word n-gram embeddings, averaged over a document, with a softmax output.

A document is the bag of its features: each word, the 3- and 4-grams of "<word>", and the pairs of neighbouring words,
hashed to the rows of one table of vectors; a word that repeats the one before it has a second pair, the same for all
words, so that repetition is learned of words never seen. The document's vector is their average; a softmax over two
classes stands on it. Both are learned by stochastic gradient descent in numpy, some documents a step.
After training, each table row is projected onto the difference of the two outputs, so that scoring sums one number a
feature: a word's own are kept summed in a bounded store, those of pairs are looked up in the projected table.

Defined cases: null, empty and blank texts have no features and get the score of the intercept; repeated rows get equal
scores; without labelled rows of both kinds the score is that of zero weights, 0.5; extra columns are ignored.
Scale: training on at most `most` labelled rows; scoring is narrow, with a broadcast of 1 MB.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, plain
from .labelled import held_out, sample

SIZE = 1 << 17
AGAIN = 0  # the row of the pair of any word and itself


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass"))


def features(word: str) -> list[int]:
    """Table rows of a word and of its character n-grams."""
    s = f"<{word}>"
    return [_hash(g) & (SIZE - 1) for g in (word, *(s[i : i + n] for n in (3, 4) for i in range(len(s) - n + 1)))]


def pair_rows(h: np.ndarray) -> np.ndarray:
    """Table rows of the pairs of neighbours among words with the 32-bit hashes `h`."""
    mixed = (h[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h[1:].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(64 - 17)).astype(np.int64)


class Subwords:
    """Projected feature values and the intercept."""

    def __init__(self, values: np.ndarray, bias: float):
        self.values, self.bias = values, bias


class Store(dict):
    """Number of each word met, and by number: sum of its feature values, how many they are, its hash. Emptied between calls when full."""

    def __init__(self, model: Subwords, cached: int = 200_000):
        self.model, self.cached = model, cached
        self.sums, self.counts, self.hashes = [], [], []

    def __missing__(self, word: str) -> int:
        ids = features(word)
        self.sums.append(float(self.model.values[ids].sum()))
        self.counts.append(len(ids))
        self.hashes.append(_hash(word))
        got = self[word] = len(self.sums) - 1
        return got

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """P(label 1) of each text."""
        if len(self) >= self.cached:
            self.clear()
            self.sums, self.counts, self.hashes = [], [], []
        tokens = [t.split() if t else [] for t in texts]
        sizes = np.array([len(w) for w in tokens], dtype=np.int64)
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(tokens)), dtype=np.int64, count=int(sizes.sum()))
        sums, counts, hashes = np.array(self.sums), np.array(self.counts, dtype=np.float64), np.array(self.hashes, dtype=np.uint32)
        own = np.repeat(np.arange(len(texts)), sizes)
        inner = own[1:] == own[:-1]
        again = np.zeros(len(at), dtype=bool)
        again[1:] = inner & (at[1:] == at[:-1])
        total = np.bincount(own, sums[at] if len(at) else None, len(texts)).astype(np.float64)
        n = np.bincount(own, counts[at] if len(at) else None, len(texts)).astype(np.float64)
        if len(at) > 1:
            total += np.bincount(own[1:][inner], self.model.values[pair_rows(hashes[at])[inner]], len(texts))
            n += np.bincount(own[1:][inner], minlength=len(texts))
            repeats = np.bincount(own[again], minlength=len(texts))
            total += repeats * float(self.model.values[AGAIN])
            n += repeats
        z = np.where(n > 0, total / np.maximum(n, 1), 0.0) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def bag(text: str | None, memo: dict[str, tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of a text, and the share of its features that each has."""
    words = text.split() if text else []
    known = [memo[w] if w in memo else memo.setdefault(w, (features(w), _hash(w))) for w in words]
    ids = np.fromiter(chain.from_iterable(k[0] for k in known), dtype=np.int64)
    if len(words) > 1:
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        ids = np.concatenate([ids, pair_rows(np.array([k[1] for k in known], dtype=np.uint32)), np.full(again, AGAIN)])
    own, counts = np.unique(ids, return_counts=True)
    return own, counts / max(1, len(ids))


class _Batch:
    """Some documents' rows and shares laid end to end, and their order by table row, for both ways of the gradient."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], y: list[int]):
        self.y = np.array(y)
        size = np.array([len(b[0]) for b in bags], dtype=np.int64)
        owner = np.repeat(np.arange(len(bags), dtype=np.int32), size)
        self.ids = np.concatenate([b[0] for b in bags]).astype(np.int32)
        self.part = np.concatenate([b[1] for b in bags]).astype(np.float32)
        order = np.argsort(self.ids, kind="stable")
        self.some = np.flatnonzero(size)
        self.first = (np.cumsum(size) - size)[self.some]
        self.owner_by_id, self.part_by_id = owner[order], self.part[order]
        self.rows, start = np.unique(self.ids[order], return_index=True)
        self.start = start.astype(np.int32)

    def vectors(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.y), table.shape[1]), dtype=np.float32)
        if len(self.ids):
            out[self.some] = np.add.reduceat(self.part[:, None] * table[self.ids], self.first, axis=0)
        return out

    def push(self, table: np.ndarray, down: np.ndarray) -> None:
        """Takes each document's `down` from its rows by their shares."""
        if len(self.ids):
            table[self.rows] -= np.add.reduceat(self.part_by_id[:, None] * down[self.owner_by_id], self.start, axis=0)


def train(rows: list[tuple[str | None, int]], dim: int = 8, rounds: int = 6, rate: float = 0.5, batch: int = 8, seed: int = 5) -> Subwords:
    if len({y for _, y in rows}) < 2:
        return Subwords(np.zeros(SIZE), 0.0)
    memo: dict[str, tuple[list[int], int]] = {}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    batches = [_Batch([bag(rows[k][0], memo) for k in order[i : i + batch]], [rows[k][1] for k in order[i : i + batch]]) for i in range(0, len(order), batch)]
    share = np.mean([y for _, y in rows])
    weigh = np.array([0.5 / (1 - share), 0.5 / share])  # both labels weigh the same in all
    table = rng.uniform(-1 / dim, 1 / dim, (SIZE, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), dtype=np.float32), np.zeros(2)
    done, steps = 0, rounds * len(batches)
    for _ in range(rounds):
        for k in rng.permutation(len(batches)):
            b = batches[k]
            lr = rate * (1 - done / steps)
            done += 1
            v = b.vectors(table)
            z = v @ out.T + bias
            q = np.exp(z - z.max(axis=1, keepdims=True))
            g = q / q.sum(axis=1, keepdims=True)
            g[np.arange(len(b.y)), b.y] -= 1
            g *= weigh[b.y][:, None]
            # the gradient of an average is small for each of its many rows; a step as for sums keeps rare rows learning
            b.push(table, (lr * 20 * (g @ out)).astype(np.float32))
            out -= (lr * g.T @ v).astype(np.float32)
            bias -= lr * 0.1 * g.sum(axis=0)
    return Subwords((table @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def model(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 4000) -> Subwords:
    """Trained on at most `most` labelled rows."""
    return train(sample(docs, labels, label, most))


def judge(docs: DataFrame, labels: DataFrame, most: int = 4000, threshold: float = 0.3) -> DataFrame:
    """The columns of op7's contract."""
    sent = docs.sparkSession.sparkContext.broadcast(model(docs, labels, most=most))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Store(sent.value)
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": store.scores(pdf["text"].tolist())})

    rows = mapped(plain(docs), run, "doc_id long, score double", "text", 2_000_000)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
