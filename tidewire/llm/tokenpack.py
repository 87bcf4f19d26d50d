"""Token-ID output: files of ids packed to the least number of bits that the vocabulary needs.

A file: b"TPK1", then little-endian unsigned 64-bit numbers: bits an id, ids a block, documents, ids; then document ids
(signed 64 bits; the least number stands for null), the documents' first ids within the file (one more than documents),
the byte offsets of blocks within the payload (one more than blocks), and the payload. A block holds its ids one after
the other, least significant bit first, and starts at a byte; the last block is shorter. So any id's place follows from
its number, a reader can fetch single blocks, and numpy unpacks a block at once.

write() makes files for each range of doc_id, in ascending order over files and within them (null first; rows that
repeat a doc_id by text); a file ends after `file_ids` ids, so that a task's memory doesn't follow the table. Each attempt of a task writes a file of its own name, and only the names that the successful
attempts report go into the manifest, so lost executors and repeated attempts leave no half files behind it.

Defined cases: null and empty texts have no ids besides the end id; an empty table makes no file. Scale: one range
shuffle of the texts; a task holds one batch of texts and its packed blocks; the manifest has a row for each file.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import keyed, mapped

MAGIC, BLOCK, NULL_ID = b"TPK1", 1 << 16, -(1 << 63)


def bits_for(vocab: int) -> int:
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of `bits` bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (flags.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1).astype(np.uint32)


class Packer:
    """Gathers documents for one file. Full blocks are packed at once."""

    def __init__(self, bits: int, block: int = BLOCK):
        self.bits, self.block, self.docs, self.starts, self.blocks, self.n = bits, block, [], [0], [], 0
        self.rest = np.empty(0, dtype=np.uint32)

    def add(self, doc_ids: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs += doc_ids
        self.starts += (self.n + np.cumsum(sizes)).tolist()
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        full = len(self.rest) // self.block * self.block
        self.blocks += [pack(self.rest[i : i + self.block], self.bits) for i in range(0, full, self.block)]
        self.rest = self.rest[full:]

    def file(self) -> list[bytes]:
        blocks = [*self.blocks, *([pack(self.rest, self.bits)] if len(self.rest) else [])]
        offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
        head = MAGIC + struct.pack("<4Q", self.bits, self.block, len(self.docs), self.n)
        return [head, np.array(self.docs, dtype="<i8").tobytes(), np.array(self.starts, dtype="<u8").tobytes(), offsets.tobytes(), *blocks]


class Reader:
    """Random access to one file through any object with seek() and read()."""

    def __init__(self, f):
        self.f = f
        f.seek(0)
        head = f.read(36)
        if head[:4] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, docs, self.n = struct.unpack("<4Q", head[4:])
        blocks = -(-self.n // self.block)
        self.docs = np.frombuffer(f.read(8 * docs), dtype="<i8")
        self.starts = np.frombuffer(f.read(8 * (docs + 1)), dtype="<u8").astype(np.int64)
        self.offsets = np.frombuffer(f.read(8 * (blocks + 1)), dtype="<u8").astype(np.int64)
        self.payload = 36 + 8 * (docs + docs + 1 + blocks + 1)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids numbered [start, end); reads only the blocks that hold them."""
        if start >= end:
            return np.empty(0, dtype=np.uint32)
        a, b = start // self.block, (end - 1) // self.block
        self.f.seek(self.payload + int(self.offsets[a]))
        data = self.f.read(int(self.offsets[b + 1] - self.offsets[a]))
        parts = [unpack(data[self.offsets[k] - self.offsets[a] : self.offsets[k + 1] - self.offsets[a]], self.bits, min(self.block, self.n - k * self.block)) for k in range(a, b + 1)]
        return np.concatenate(parts)[start - a * self.block : end - a * self.block]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


class Words(dict):
    """Encodes texts with the tokenizers library, each stretch between blanks only once while it is in this store.

    The vocabulary's splitter drops white space and no rule looks across it, so the ids of a text are those of its
    stretches. In Latin-1 texts, which NFC leaves alone, case is folded beforehand, as the vocabulary's rules do anyway,
    and marks like "," at the end of a stretch, behind a letter, are a word of their own. The store is bounded: when `cached` stretches have come, the older half goes, and what is met again from it stays."""

    def __init__(self, path: str, cached: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.fold = kinds[:1] == ["NFC"] and kinds[-1:] == ["Lowercase"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.bytes = byte_chars()
        self.cached, self.old = cached, {}

    def __missing__(self, c: str) -> bytes:
        got = self.old.get(c)
        if got is None:
            stem = c.rstrip(".,;:!?")
            if self.fold and stem and len(stem) < len(c) and stem[-1].isalpha():
                got = self[stem] + self[c[len(stem) :]]
            else:
                if self.fold and c.isalpha() and c.islower() and _latin(c):  # one word that no rule changes: to the model
                    ids = [t.id for t in self.tok.model.tokenize("".join([self.bytes[b] for b in c.encode()]))]
                else:
                    ids = self.tok.encode(c, add_special_tokens=False).ids
                got = struct.pack(f"<{len(ids)}I", *ids)
        if len(c) < 64:
            if len(self) >= self.cached:
                self.old = dict(self)
                self.clear()
            self[c] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<u4")
        if self.fold and not any(s in text for s in self.special) and "<|" not in text and _latin(text):
            text = text.lower()
        return np.frombuffer(b"".join([self[c] for c in text.replace("\n", " ").split(" ")]), dtype="<u4")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_loaded: dict[str, Words] = {}


def write(docs: DataFrame, path: str, tokenizer: str, vocab: int, end_id: int | None, files: int | None = None, file_ids: int = 16 << 20) -> DataFrame:
    """Write `docs` (doc_id, text) under `path`, a URI that all executors reach; returns the manifest.

    The manifest has file, first_id (ids of all files before), n_docs, n_ids, in ascending order of documents. `files` ranges
    of doc_id are written by as many tasks; a task begins a new file when one has `file_ids` ids."""
    spark, bits = docs.sparkSession, bits_for(vocab)
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = Words(tokenizer)
        words, packer, place = _loaded[tokenizer], Packer(bits), 0

        def close() -> pd.DataFrame:
            store, at = fs.FileSystem.from_uri(f"{path}/{uuid.uuid4().hex}.tpk")
            store.create_dir(os.path.dirname(at), recursive=True)
            with store.open_output_stream(at) as out:
                for part in packer.file():
                    out.write(part)
            return pd.DataFrame([(os.path.basename(at), place, len(packer.docs), packer.n)], columns=["file", "place", "n_docs", "n_ids"])

        for pdf in frames:
            ids = [words.encode(t) for t in pdf["text"]]
            if end_id is not None:
                ids = [np.append(x, np.uint32(end_id)) for x in ids]
            packer.add([NULL_ID if i is pd.NA else int(i) for i in pdf["doc_id"]], np.array([len(x) for x in ids]), np.concatenate(ids).astype(np.uint32))
            if packer.n >= file_ids:
                yield close()
                packer, place = Packer(bits), place + 1
        if packer.docs:
            yield close()

    # the partition number orders the files of different tasks
    parts = keyed(docs).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.col("th")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("th"))
    done = mapped(parts, run, "file string, place long, n_docs long, n_ids long", "text").withColumn("part", F.spark_partition_id()).collect()  # one row a file
    rows, before = [], 0
    for r in sorted(done, key=lambda r: (r["part"], r["place"])):
        rows.append((r["file"], before, r["n_docs"], r["n_ids"]))
        before += r["n_ids"]
    store, at = fs.FileSystem.from_uri(f"{path}/manifest.json")
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(at) as out:
        out.write(json.dumps({"bits": bits, "files": [dict(zip(("file", "first_id", "n_docs", "n_ids"), r, strict=True)) for r in rows]}).encode())
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    store, at = fs.FileSystem.from_uri(f"{path}/manifest.json")
    with store.open_input_stream(at) as f:
        files = json.loads(f.read())["files"]
    rows = [(x["file"], x["first_id"], x["n_docs"], x["n_ids"]) for x in files]
    return spark.createDataFrame(rows, "file string, first_id long, n_docs long, n_ids long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, one file a task."""
    files = manifest(spark, path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, base in zip(pdf["file"], pdf["first_id"], strict=True):
                store, at = fs.FileSystem.from_uri(f"{path}/{name}")
                with store.open_input_file(at) as f:
                    r = Reader(f)
                    for lo in range(0, len(r.docs), 2000):
                        hi = min(lo + 2000, len(r.docs))
                        s = r.starts[lo : hi + 1]
                        flat = np.ascontiguousarray(r.ids(int(s[0]), int(s[-1])), dtype="<u4")
                        crc = [zlib.crc32(flat[a:b]) for a, b in zip(s - s[0], s[1:] - s[0], strict=False)]
                        own = pd.array(np.where(r.docs[lo:hi] == NULL_ID, 0, r.docs[lo:hi]), dtype="Int64")
                        own[r.docs[lo:hi] == NULL_ID] = pd.NA
                        yield pd.DataFrame({"doc_id": own, "start": base + s[:-1], "n_tokens": np.diff(s), "ids_crc32": crc})

    tasks = max(1, min(files.count(), 4096))
    return mapped(files.repartition(tasks), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
