"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give document scores and offsets.

Labelled tokens come from the labelled documents: a token of a document marked toxic is toxic if its word, or its first
3 to 6 characters, stand in toxic documents far more often than in the others. The field has two tags, transition
weights, and hashed features of the token (word, beginnings, ending). It is trained by gradient steps on the likelihood
of tag sequences, with forward-backward over a batch of documents at a time. A document's score is a logistic function
of its expected number of toxic tokens and of its largest marginal.

Defined cases: null, empty and blank texts have no tokens and get the score of no evidence; repeated rows get equal
scores; without labelled rows of both kinds, or where no token can be labelled toxic, every score is 0 and nothing is
tagged; extra columns are ignored. Training rows are distinct texts: a shared beginning makes no copies.
Scale: training on at most `most` labelled rows; scoring is narrow, with one broadcast of the weights; long texts are
scored whole, and the memory of a task is a slice of about 2 million bytes of text, or one longer
text, with 64 bytes a token, and a bounded store of emissions.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import edited, mapped, plain
from .labelled import held_out, sample

SIZE = 1 << 18
SLICE = 2_000_000  # bytes of text scored abreast
STRIP = ".,;:!?\"'()[]{}*#%$&|"
TOKEN = re.compile(r"\S+")


_FRONT = [zlib.crc32(b"w"), zlib.crc32(b"s"), *(zlib.crc32(b"p%d" % n) for n in (3, 4, 5, 6))]
WIDTH = len(_FRONT)


def features(token: str) -> list[int]:
    """Hashed features of a token: the word, its last three and its first three to six characters; SIZE, the row without weight, for what it lacks."""
    w = token.lower().strip(STRIP) or token
    parts = (w, w[-3:], *(w[:n] for n in (3, 4, 5, 6)[: max(0, len(w) - 2)]))
    if w.isascii():
        ids = [zlib.crc32(x, f) & (SIZE - 1) for x, f in zip(map(str.encode, parts), _FRONT, strict=False)]
    else:
        ids = [zlib.crc32(x.encode("utf-8", "surrogatepass"), f) & (SIZE - 1) for x, f in zip(parts, _FRONT, strict=False)]
    return ids + [SIZE] * (WIDTH - len(ids))


def _begins(token: str) -> list[str]:
    w = token.lower().strip(STRIP) or token
    return [w, *(w[:n] + "-" for n in (3, 4, 5, 6) if len(w) > n)]


def unlike(rows: list[tuple[str | None, int]]) -> list[tuple[str | None, int]]:
    """One row for each text, but for case and white space, and label: copies would lend weight to words that only they have."""
    return list({(" ".join((t or "").split()).lower(), y): (t, y) for t, y in reversed(rows)}.values())[::-1]


class Tokens:
    """Documents as numbers of distinct tokens: `docs` holds an array for each, `words` the tokens, `rows` their features."""

    def __init__(self, texts: list[str | None]):
        known: dict[str, int] = {}
        self.docs = [np.array([known.setdefault(w, len(known)) for w in (t or "").split()], dtype=np.int32) for t in texts]
        self.words = list(known)
        self.rows = np.array([features(w) for w in self.words], dtype=np.int32).reshape(-1, WIDTH)


def toxic_words(tokens: Tokens, y: np.ndarray, share: float = 0.03, odds: float = 4.0) -> np.ndarray:
    """For each distinct token whether it is toxic, from the labels of the documents: its word, or a beginning of it, stands in toxic
    documents by these log-odds more often than in others, and in `share` of the toxic documents, two at least."""
    names: dict[str, int] = {}
    begins = [np.array([names.setdefault(b, len(names)) for b in _begins(w)], dtype=np.int32) for w in tokens.words]
    seen = np.zeros((2, len(names) + 1), dtype=np.int32)
    for doc, label in zip(tokens.docs, y.tolist(), strict=True):
        if len(doc):
            seen[label, np.unique(np.concatenate([begins[k] for k in np.unique(doc)]))] += 1
    n = np.bincount(y, minlength=2)
    least = max(2, math.ceil(share * n[1]))
    ratio = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    bad = (seen[1] >= least) & (ratio >= odds)
    return np.array([bad[b].any() for b in begins], dtype=bool)


def token_labels(rows: list[tuple[str | None, int]], share: float = 0.03, odds: float = 4.0) -> list[tuple[list[str], list[int]]]:
    """Tokens and tags of each document: those of toxic_words() in documents marked toxic."""
    tokens, y = Tokens([t for t, _ in rows]), np.array([y for _, y in rows], dtype=np.int64)
    bad = toxic_words(tokens, y, share, odds)
    return [([tokens.words[k] for k in doc], (bad[doc] & (label == 1)).astype(int).tolist()) for doc, label in zip(tokens.docs, y.tolist(), strict=True)]


def marginals(x: np.ndarray, sizes: np.ndarray, step: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """P(toxic) of every token, and with `pairs` the expected number of each transition (2 x 2), over documents laid end to end.

    x: exp of the emission weight of "toxic" against "other" for each token; step[i, j]: exp of a transition's weight.
    Forward and backward run over all documents abreast, the longest first, as ratios of the two tags' weights."""
    if not len(x):
        return np.empty(0), np.zeros((2, 2))
    (a, b), (c, d) = step
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order = np.argsort(-sizes, kind="stable")
    first, length = first[order], sizes[order]
    active = len(length) - np.searchsorted(length[::-1], np.arange(length[0]), side="right")  # documents longer than t
    f, g = np.empty(len(x)), np.ones(len(x))
    r = x[first[: active[0]]]
    f[first[: active[0]]] = r
    for t in range(1, len(active)):
        at = first[: active[t]] + t
        r = r[: active[t]]
        r = x[at] * (b + d * r) / (a + c * r)
        f[at] = r
    s = np.ones(len(first))
    for t in range(len(active) - 2, -1, -1):
        k = active[t + 1]
        at = first[:k] + t
        z = x[at + 1] * s[:k]
        s[:k] = (c + d * z) / (a + b * z)
        g[at] = s[:k]
    p = f * g / (1 + f * g)
    if not pairs:
        return p, None
    # pairs of neighbours within a document
    inner = np.ones(len(x), dtype=bool)
    inner[np.cumsum(sizes)[sizes > 0] - 1] = False
    at = np.flatnonzero(inner)
    z = x[at + 1] * g[at + 1]
    w = np.array([[np.full(len(at), a), b * z], [c * f[at], d * f[at] * z]])
    return p, (w / w.sum(axis=(0, 1))).sum(axis=2) if len(at) else np.zeros((2, 2))


class Crf:
    """Weights of emissions (hashed) and transitions, and the document score's three numbers."""

    def __init__(self):
        self.w, self.step, self.doc = np.zeros(SIZE + 1), np.array([[0.0, -2.0], [-1.0, 0.0]]), (0.0, 0.0, -50.0)

    def train(self, rows: list[tuple[str | None, int]], rounds: int = 3, rate: float = 0.3, batch: int = 64, seed: int = 3) -> Crf:
        """Two thirds of the rows train the field; the others, whose words it hasn't seen, the document score."""
        rows = unlike(rows)
        tail = [r for i, r in enumerate(rows) if i % 3 == 2]
        if len({y for _, y in tail}) < 2:
            tail = rows
        if len({y for _, y in rows}) < 2:
            return self
        field = [r for i, r in enumerate(rows) if i % 3 != 2] if tail is not rows else rows
        tokens, y = Tokens([t for t, _ in field]), np.array([y for _, y in field], dtype=np.int64)
        bad = toxic_words(tokens, y)
        if not any(bad[doc].any() for doc, label in zip(tokens.docs, y.tolist(), strict=True) if label):
            return self
        rng, past, past_step = np.random.default_rng(seed), np.full(SIZE + 1, 1e-6), np.full((2, 2), 1e-6)
        some = np.array([k for k, doc in enumerate(tokens.docs) if len(doc)])
        for _ in range(rounds):
            order = rng.permutation(some)
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                part = np.concatenate([tokens.docs[k] for k in own])
                sizes = np.array([len(tokens.docs[k]) for k in own])
                tags = (bad[part] & np.repeat(y[own] == 1, sizes)).astype(np.int64)
                kinds, place = np.unique(part, return_inverse=True)
                x = np.exp(np.clip(self.w[tokens.rows[kinds]].sum(axis=1), -30, 30))[place]
                p, pairs = marginals(x, sizes, np.exp(self.step))
                by_kind = np.bincount(place, p - tags, len(kinds))
                g = np.bincount(tokens.rows[kinds].ravel(), np.repeat(by_kind, WIDTH), SIZE + 1) / len(own)
                g[SIZE] = 0.0
                past += g * g
                self.w -= rate * g / np.sqrt(past) + 1e-5 * self.w
                inner = np.ones(len(tags), dtype=bool)
                inner[np.cumsum(sizes) - 1] = False
                at = np.flatnonzero(inner)
                seen = np.bincount(2 * tags[at] + tags[at + 1], minlength=4).reshape(2, 2)
                gs = (pairs - seen) / len(own)
                past_step += gs * gs
                self.step -= 0.1 * gs / np.sqrt(past_step)
        self._fit_score(tail)
        return self

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp of the emission weight of "toxic" against "other" for each word."""
        rows = np.array([features(w) for w in words], dtype=np.int32).reshape(-1, WIDTH)
        return np.exp(np.clip(self.w[rows].sum(axis=1), -30, 30))

    def _evidence(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, _ = marginals(x, sizes, np.exp(self.step), pairs=False)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        total = np.concatenate([[0.0], np.cumsum(p)])
        most = np.zeros(len(sizes))
        some = sizes > 0
        if some.any():
            most[some] = np.maximum.reduceat(p, edge[:-1][some])
        return p, np.maximum(0, total[edge[1:]] - total[edge[:-1]]), most

    def _fit_score(self, rows: list[tuple[str | None, int]], rounds: int = 400) -> None:
        y = np.array([y for _, y in rows], dtype=float)
        tokens = Tokens([t for t, _ in rows])
        x = np.exp(np.clip(self.w[tokens.rows].sum(axis=1), -30, 30))
        _, total, most = self._evidence(x[np.concatenate(tokens.docs)], np.array([len(d) for d in tokens.docs]))
        m = np.stack([np.log1p(total), most, np.ones(len(y))], axis=1)
        v = np.zeros(3)
        weigh = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-m @ v))
            h = (m * (weigh * q * (1 - q) + 1e-9)[:, None]).T @ m + 1e-2 * np.eye(3)
            v += np.clip(np.linalg.solve(h, m.T @ (weigh * (y - q)) - 1e-2 * v), -1, 1)
        self.doc = tuple(v)

    def scores(self, texts: list[str | None], store: Emissions) -> np.ndarray:
        """Score of each text."""
        return self._scored(texts, store)[3]

    def _scored(self, texts: list[str | None], store: Emissions) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of all tokens laid end to end, tokens of each text, and each text's largest marginal and score."""
        tokens = [t.split() if t else [] for t in texts]
        sizes = np.array([len(w) for w in tokens], dtype=np.int64)
        store.learn(set(chain.from_iterable(tokens)))
        x = np.fromiter(map(store.__getitem__, chain.from_iterable(tokens)), dtype=np.float64, count=int(sizes.sum()))
        p, total, most = self._evidence(x, sizes)
        return p, sizes, most, 1 / (1 + np.exp(-(np.log1p(total) * self.doc[0] + most * self.doc[1] + self.doc[2])))

    def score(self, texts: list[str | None], store: Emissions) -> list[tuple[float, list[tuple[int, int]]]]:
        """Score and [start, end) character offsets of the tokens with a marginal of 0.5 or more, for each text."""
        p, sizes, most, scores = self._scored(texts, store)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        out, learned = [], self.w.any()
        for i, t in enumerate(texts):
            spans = []
            if learned and most[i] >= 0.5:
                hit = set(np.flatnonzero(p[edge[i] : edge[i + 1]] >= 0.5).tolist())
                at = 0
                for k, w in enumerate(t.split()):
                    at = t.index(w, at)
                    if k in hit:
                        spans.append((at, at + len(w)))
                    at += len(w)
            out.append((float(scores[i]), spans))
        return out


class Emissions(dict):
    """Emission of each token met; emptied before a slice when `cached` have come: some 20 MB, and what a slice brings."""

    def __init__(self, crf: Crf, cached: int = 100_000):
        self.crf, self.cached = crf, cached

    def learn(self, tokens: set[str]) -> None:
        """Emissions of those tokens that aren't known, all in one step."""
        if len(self) >= self.cached:
            self.clear()
        if new := [t for t in tokens if t not in self]:
            self.update(zip(new, self.crf.emissions(new).tolist(), strict=True))


def model(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 4000) -> Crf:
    """Trained on at most `most` labelled rows."""
    return Crf().train(sample(docs, labels, label, most))


def tag(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, score, spans (offsets of toxic tokens) for each row of `docs`."""
    sent = docs.sparkSession.sparkContext.broadcast(crf)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Emissions(sent.value)
        for pdf in frames:
            got = sent.value.score(pdf["text"].tolist(), store)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": [g[0] for g in got], "spans": [[{"start": a, "end": b} for a, b in g[1]] for g in got]})

    return mapped(plain(docs), run, "doc_id long, score double, spans array<struct<start:int,end:int>>", "text", SLICE)


def judge(docs: DataFrame, labels: DataFrame, most: int = 4000) -> DataFrame:
    """The columns of op4's contract, and the offsets."""
    return tag(docs, model(docs, labels, most=most)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def keep_clean(docs: DataFrame, labels: DataFrame, most: int = 4000, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose score is below `threshold`."""
    sent = docs.sparkSession.sparkContext.broadcast(model(docs, labels, most=most))
    held: list[Emissions] = []  # one store for all slices of a task

    def clean(texts: list[str | None]) -> tuple[list[str | None], list[bool]]:
        if not held:
            held.append(Emissions(sent.value))
        return texts, (sent.value.scores(texts, held[0]) < threshold).tolist()

    return edited(docs, docs, clean, size=SLICE)
