"""BPE encoding and decoding with a contiguous rank array, equal to the tokenizers library on the word-end vocabulary.

A short word is a list of part boundaries and, beside it, the list of the ranks of adjacent parts. The least rank is
found by scanning, its right boundary is deleted, and the two neighbouring ranks are looked up anew, until no pair has
a rank. Words are short, so the scan beats a heap; a word of more than `SHORT` bytes, where a scan for each merge would take
quadratic time, has its boundaries linked and its ranks in a heap, and gets the same parts. The words of a batch that aren't
known yet and have equally many bytes are scanned side by side: a row of one rank array each, in numpy. Each task keeps the
encodings of words it has met, up to a bound. Texts are decoded from their ids.

Normalisation and splitting as the vocabulary file says (by the Unicode tables of Python): special tokens are cut out of the raw text first; then NFC,
white space, lower case by single characters, letters / single digits / other runs, and bytes as printable characters.

Defined cases: null and empty texts have no tokens, and decode to the empty text; words of any length are encoded
whole; repeated rows get equal values. Scale: narrow, no shuffle; memory is a batch, the bounded cache and the stretches met
in `STRETCHES` of the batch's.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import mapped, plain

_NONE = 1 << 60
SHORT = 200
#: Side by side go words of up to WIDE bytes of which there are FEW at least.
WIDE, FEW = 40, 16
#: So many stretches are looked up at once.
STRETCHES = 1 << 16
_NO_RANK = np.iinfo(np.int32).max


def byte_chars() -> list[str]:
    """The printable character for each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Store(dict):
    """Ids, as bytes, of what was met last. When `half` have come they are put behind, and what is met again from there stays."""

    def __init__(self, half: int, encode: Callable[[str], bytes]):
        self.half, self.encode, self.old = half, encode, {}

    def __missing__(self, text: str) -> bytes:
        return self.encode(text)

    def unknown(self, texts: set[str]) -> set[str]:
        """Those of `texts` that aren't known; all others are in the front."""
        new = texts.difference(self)
        if len(self) + len(new) > self.half:
            self.old, new = dict(self), texts
            self.clear()
        again = {c: self.old[c] for c in new if c in self.old}
        self.update(again)
        return new.difference(again)


class Bpe:
    """Encoder and decoder for a tokenizers file whose model is BPE with an end-of-word suffix."""

    def __init__(self, path: str, cached: int = 100_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        #: of each id, None where it has no token
        self.names = np.array([names.get(i) for i in range(max(names) + 1)], dtype=object)
        self.digits = np.array([str(i) for i in range(len(self.names))], dtype=object)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: (left id, right id) as one number -> (rank, id of the joined token) as one number
        self.ranks = {vocab[a] << 32 | vocab[b]: r << 32 | vocab[a + b] for r, (a, b) in enumerate(pairs)}
        #: the same for arrays: sorted (left id, right id), the rank of each, and the joined token by rank
        self.pairs = np.sort(np.fromiter(self.ranks, np.int64, len(self.ranks)))
        found = np.fromiter(map(self.ranks.__getitem__, self.pairs.tolist()), np.int64, len(self.pairs))
        self.rank, self.joined = (found >> 32).astype(np.int32), np.zeros(len(pairs), dtype=np.int32)
        self.joined[self.rank] = found & 0xFFFFFFFF
        #: ids of bytes within a word and at its end
        self.inner, self.last = (np.array([vocab[c + end] for c in byte_chars()], dtype=np.int32) for end in ("", model["end_of_word_suffix"]))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.lines = regex.compile(split["pattern"]["Regex"] + r"|\n")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache, self.known = Store(cached // 2, self.chunk), Store(cached // 4, lambda w: self.word(w).tobytes())

    def word(self, text: str) -> np.ndarray:
        """Ids of one word: boundaries and adjacent ranks side by side, least rank first, leftmost of equal ranks."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        parts = [*self.inner[data[:-1]].tolist(), int(self.last[data[-1]])]
        look = self.ranks.get
        if len(parts) > SHORT:
            return np.array(self._long(parts), dtype=np.int32)
        ranks = [look(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            parts[i] = least & 0xFFFFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = look(parts[i - 1] << 32 | parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = look(parts[i] << 32 | parts[i + 1], _NONE)
        return np.array(parts, dtype=np.int32)

    def _long(self, parts: list[int]) -> list[int]:
        """The same as word()'s scan: least rank first, leftmost of equal ranks; boundaries are linked, and stale ranks are passed over."""
        look, n = self.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := look(a << 32 | b)) is not None]
        heapify(heap)
        while heap:
            rank, i, a, b = heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = rank & 0xFFFFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := look(parts[i] << 32 | parts[k])) is not None:
                    heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := look(parts[h] << 32 | parts[i])) is not None:
                heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, `_NO_RANK` where it has none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(self.pairs.searchsorted(key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank[at], _NO_RANK)

    def _scanned(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """word()'s scan for words of equally many bytes, a row of `parts` each: which rows have no rank left, and their ids."""
        rows, ranks = np.arange(len(parts)), self._look(parts[:, :-1], parts[:, 1:])
        while ranks.shape[1]:
            i = ranks.argmin(axis=1)
            least = ranks[np.arange(len(i)), i]
            more = least != _NO_RANK
            if not more.all():
                yield rows[~more], parts[~more]
                rows, parts, ranks, i, least = rows[more], parts[more], ranks[more], i[more], least[more]
                if not len(rows):
                    return
            at = np.arange(len(i))
            parts[at, i] = self.joined[least]
            stay = np.ones(parts.shape, dtype=bool)
            stay[at, i + 1] = False
            parts, ranks = parts[stay].reshape(len(i), -1), ranks[stay[:, 1:]].reshape(len(i), -1)
            at, k = np.flatnonzero(i > 0), i[i > 0]
            ranks[at, k - 1] = self._look(parts[at, k - 1], parts[at, k])
            at, k = np.flatnonzero(i < ranks.shape[1]), i[i < ranks.shape[1]]
            ranks[at, k] = self._look(parts[at, k], parts[at, k + 1])
        yield rows, parts

    def _side_by_side(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word and its ids, as word() has them."""
        data = [w.encode() for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        flat, start = np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum(size) - size
        order = np.argsort(size, kind="stable")
        for of in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            if len(of) < FEW or size[of[0]] > WIDE:
                yield from ((words[k], self.word(words[k]).tobytes()) for k in of.tolist())
                continue
            held = flat[start[of][:, None] + np.arange(size[of[0]])]
            parts = self.inner[held]
            parts[:, -1] = self.last[held[:, -1]]
            for rows, ids in self._scanned(parts):
                yield from zip(map(words.__getitem__, of[rows].tolist()), ids.view(f"V{ids.itemsize * ids.shape[1]}").ravel().tolist(), strict=True)

    def learn(self, stretches: list[str]) -> None:
        """Store the ids of `stretches` without blanks, newlines or special tokens: as chunk(), all at once."""
        found = self._split("\n".join([*stretches, ""]), self.lines)
        words = set(found)
        words.discard("\n")
        self.known.update(self._side_by_side(list(self.known.unknown(words))))
        look, ids, rest = self.known.__getitem__, b"", iter(stretches)
        for w in found:
            if w == "\n":
                self.cache[next(rest)], ids = ids, b""
            else:
                ids = ids + look(w) if ids else look(w)

    def chunk(self, text: str) -> bytes:
        """Ids of a stretch without blanks or newlines, special tokens included."""
        if self.cut and "<|" in text:
            return b"".join([np.int32(self.special[part]).tobytes() if j % 2 else self._plain(part) for j, part in enumerate(self.cut.split(text))])
        return self._plain(text)

    def _split(self, text: str, pattern) -> list[str]:
        """The matches of `pattern` in a text as the vocabulary's rules change it."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # str.lower() looks around a capital sigma; the vocabulary's rule is by single characters
        text = text.replace("\u03a3", "\u03c3").lower()
        newer = [] if text.isascii() else [c for c in set(text) if unicodedata.category(c) == "Cn"]
        if not newer:
            return pattern.findall(text)
        # the pattern's library may know newer letters than the tokenizers library: none of them counts as one
        return [text[m.start() : m.end()] for m in pattern.finditer(text.translate(dict.fromkeys(map(ord, newer), "\ue000")))]

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self._split(text, self.words)))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text."""
        return next(self.encode_all([text])).tolist()

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, those of each stretch between blanks from the cache where known.

        White space never joins a word and never takes part in composition, so that a text can be cut at blanks. Stretches of
        some texts, or of a part of a long one, that the cache hasn't are learned at once."""
        held: list[list[str]] = []
        n = 0
        for text in texts:
            parts = text.replace("\n", " ").split(" ") if text else []
            if held and n + len(parts) > STRETCHES:
                yield from self._looked_up(held)
                held, n = [], 0
            if len(parts) > STRETCHES:
                yield np.concatenate([next(self._looked_up([parts[k : k + STRETCHES]])) for k in range(0, len(parts), STRETCHES)])
            else:
                held.append(parts)
                n += len(parts)
        yield from self._looked_up(held)

    def _looked_up(self, texts: list[list[str]]) -> Iterator[np.ndarray]:
        """Ids of each of some texts, given as stretches."""
        self.learn(list(self.cache.unknown({c for c in set().union(*texts) if len(c) < 64 and "<|" not in c})))
        for parts in texts:
            yield np.frombuffer(b"".join(map(self.cache.__getitem__, parts)), dtype=np.int32)

    def decode(self, ids) -> str:
        """As the library does without a decoder: the tokens joined by blanks; ids outside the vocabulary are left out."""
        ids = np.asarray(ids, dtype=np.int64)
        names = self.names[ids[(ids >= 0) & (ids < len(self.names))]].tolist()
        return " ".join(names if None not in names else [x for x in names if x is not None])

    def written(self, ids) -> str:
        """Decimal ids joined by blanks."""
        return " ".join(self.digits[ids].tolist())


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text and ids array<int> of each row of `docs`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for pdf in frames:
            yield pdf.assign(ids=list(bpe.encode_all(pdf["text"])))

    return mapped(plain(docs), run, "doc_id long, text string, ids array<int>", "text")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: of the ids as encoded, and of the text that decode() makes of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for pdf in frames:
            rows = []
            for i, ids in zip(pdf["doc_id"], bpe.encode_all(pdf["text"]), strict=True):
                rows.append((i, len(ids), hashlib.sha256(bpe.written(ids).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(plain(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "text")
