"""Media columns: GIF. Reads GIF87a/89a files to timed frames with colour histograms, and writes lossless ones.

decode() takes a file apart (screen, palettes, extensions), decodes the LZW code streams, lays rows of interlaced frames
in order, applies local or global palettes, transparency and the disposal rules, and gives each frame as composed on the
screen, with its delay. encode() writes 8-bit samples as frames of a given width, losslessly.

The code streams: the width of a code depends only on its number since the last clear code, so that the codes up to the
next clear code are cut out of the bits in one numpy step, and their strings are laid out without a string table.

Defined cases: null and empty texts are one row of blanks; texts of any length become several frames of at most `ROWS`
rows; repeated rows get equal values; a truncated or damaged stream raises ValueError when decoded directly, and
frames() gives a null list for such a cell, for a null cell and for an empty one. Scale: narrow; memory is a slice of a
batch or the longest text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, plain

WIDTH, ROWS = 192, 1024
_FIRST, _MOST = 258, 4096


def _widths(start: int, count: int, offset: int) -> np.ndarray:
    """Bits of the codes numbered 0, 1, ... since a clear code; `start`: bits at first; a table entry comes with each but the first."""
    filled = (1 << (start - 1)) + 2 + np.arange(count) - 1 + offset
    return np.clip(np.floor(np.log2(np.maximum(filled, 1))).astype(np.int64) + 1, start, 12)


#: Widths by the code size of the stream, for as many codes as the table has room, and more: 12 bits each from there on.
_BITS = {size: _widths(size + 1, 6000, 0) for size in range(2, 9)}
_ENDS = {size: np.concatenate([[0], np.cumsum(w)]) for size, w in _BITS.items()}


def lzw_encode(data: bytes) -> bytes:
    """Code stream of 8-bit samples. The table is cleared when it is full."""
    out: list[int] = [256]
    table: dict[int, int] = {}
    add, get, new, last = out.append, table.get, _FIRST, data[0]
    for c in data[1:]:
        key = last << 8 | c
        code = get(key)
        if code is not None:
            last = code
        else:
            add(last)
            last = c
            if new < _MOST:
                table[key] = new
                new += 1
            else:
                add(256)
                table.clear()
                new = _FIRST
    add(last)
    add(257)
    codes = np.array(out, dtype=np.int64)
    clear = np.flatnonzero(codes[:-1] == 256)
    # the first code is a clear code of 9 bits; each later one still has the width of its place in the old count
    place = np.arange(len(codes)) - np.repeat(clear, np.diff(np.append(clear, len(codes)))) - 1
    width = np.where(place < 0, 9, _BITS[8][np.maximum(place, 0)])
    inner = clear[1:]
    width[inner] = _BITS[8][place[inner - 1] + 1]
    at = np.concatenate([[0], np.cumsum(width)])
    spread = codes << (at[:-1] & 7)  # at most 19 bits: in up to three bytes, each bit of which belongs to one code
    byte, size = at[:-1] >> 3, int(at[-1] + 7) >> 3
    flat = sum(np.bincount(byte + k, (spread >> (8 * k)) & 255, size + 2) for k in range(3))
    return flat[:size].astype(np.uint8).tobytes()


def _strings(codes: np.ndarray, roots: int) -> np.ndarray:
    """Samples of the codes between two clear codes.

    Code number i adds the table entry roots + 2 + i - 1: the string of code i - 1 and the first sample of code i's. So a
    code beyond the roots is the string of an earlier code, its parent, and one sample more. All codes walk up their
    parents abreast, as often as their strings are long, and each step gives one sample of each string, from its end."""
    n = len(codes)
    parent = codes - (roots + 2)
    if (parent >= np.arange(n)).any() or ((codes >= roots) & (parent < 0)).any():
        raise ValueError("a code beyond the table")
    walk = []
    of, cur = np.arange(n), np.arange(n)
    length, first = np.ones(n, dtype=np.int64), codes.copy()
    while True:
        up = parent[cur] >= 0
        done = ~up
        first[of[done]] = codes[cur[done]]
        of, cur = of[up], parent[cur[up]]
        if not len(of):
            break
        length[of] += 1
        walk.append((of, cur))
    end = np.cumsum(length)
    out = np.empty(int(end[-1]), dtype=np.uint8)
    out[end - length] = first
    for k, (of, cur) in enumerate(walk):
        out[end[of] - 1 - k] = first[cur + 1]
    return out


def lzw_decode(data: bytes, size: int, most: int) -> bytes:
    """Samples of a code stream with `size` bits a sample, at most `most` of them."""
    clear, end, bits = 1 << size, (1 << size) + 1, np.frombuffer(data, dtype=np.uint8)
    wide = np.zeros(len(bits) + 4, dtype=np.uint32)
    wide[: len(bits)] = bits
    # the 24 bits from each byte on hold any code that begins in that byte
    window = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16
    ends, widths, total = _ENDS[size], _BITS[size], 8 * len(bits)
    out: list[np.ndarray] = []
    got, at = 0, 0
    while got < most:
        n = min(len(widths), int(np.searchsorted(ends, total - at, side="right")) - 1)
        while True:
            place = at + ends[:n]
            codes = (window[place >> 3] >> (place & 7).astype(np.uint32)).astype(np.int64) & ((1 << widths[:n]) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop) or at + ends[n] + 12 > total:
                break
            # a full table kept in use: all further codes have 12 bits
            n *= 2
            widths = np.append(widths, np.full(max(0, n - len(widths)), 12))
            ends = np.concatenate([[0], np.cumsum(widths)])
            n = min(n, int(np.searchsorted(ends, total - at, side="right")) - 1)
        if n <= 0:
            break
        cut = int(stop[0]) if len(stop) else n
        if cut:
            out.append(_strings(codes[:cut], clear))
            got += len(out[-1])
        if not len(stop):
            break
        at += int(ends[cut + 1])
        if codes[cut] == end:
            break
    flat = np.concatenate(out)[:most].tobytes() if out else b""
    if len(flat) < most:
        raise ValueError(f"{len(flat)} samples of {most}")
    return flat


@dataclass
class Frame:
    """One frame: where it lies, its samples, and the screen (height x width x 3) as shown for `delay` hundredths."""

    left: int
    top: int
    samples: np.ndarray
    delay: int
    disposal: int
    transparent: int | None
    screen: np.ndarray

    def histogram(self, per_channel: int = 2) -> list[int]:
        """Pixels of the shown screen by equal ranges of red, green and blue."""
        q = (self.screen.reshape(-1, 3).astype(np.int32) * per_channel) >> 8
        return np.bincount((q[:, 0] * per_channel + q[:, 1]) * per_channel + q[:, 2], minlength=per_channel**3).tolist()


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """Sub-blocks joined, and where they end."""
    parts = []
    while True:
        if at >= len(data):
            raise ValueError("a file that ends within a block")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def decode(data: bytes) -> list[Frame]:
    """All frames of a file, composed."""
    return list(shown_frames(data))


def shown_frames(data: bytes) -> Iterator[Frame]:
    """The frames of a file, composed, one after the other: a reader that lets go of them holds one screen."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, back, _ = struct.unpack("<HHBBB", data[6:13])
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data[at : at + 3 * n], dtype=np.uint8).reshape(-1, 3)
        at += 3 * n
    screen = np.zeros((height, width, 3), dtype=np.uint8)
    ground = shared[back] if shared is not None and back < len(shared) else np.zeros(3, dtype=np.uint8)
    delay, disposal, clear = 0, 0, None
    while True:
        kind = data[at : at + 1]
        if kind == b";":
            return
        if kind == b"!":
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9:
                bits, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear = bits >> 2 & 7, index if bits & 1 else None
        elif kind == b",":
            left, top, w, h, bits = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            palette = shared
            if bits & 0x80:
                n = 2 << (bits & 7)
                palette = np.frombuffer(data[at : at + 3 * n], dtype=np.uint8).reshape(-1, 3)
                at += 3 * n
            if palette is None:
                raise ValueError("a frame without a palette")
            size = data[at]
            body, at = _blocks(data, at + 1)
            samples = np.frombuffer(lzw_decode(body, size, w * h), dtype=np.uint8).reshape(h, w)
            if bits & 0x40:
                order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                laid = np.empty_like(samples)
                laid[order] = samples
                samples = laid
            before = screen.copy() if disposal == 3 else None
            area = screen[top : top + h, left : left + w]
            own = samples[: area.shape[0], : area.shape[1]]
            colours = palette[np.minimum(own, len(palette) - 1)]
            if clear is None:
                area[:] = colours
            else:
                area[own != clear] = colours[own != clear]
            yield Frame(left, top, samples, delay, disposal, clear, screen.copy())
            if disposal == 2:
                area[:] = ground
            elif disposal == 3:
                screen = before
            delay, disposal, clear = 0, 0, None
        else:
            raise ValueError("a file without an end")


_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def encode(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = 10) -> bytes:
    """A file of grey frames, `rows` rows each but the last, one over the other; len(samples) is a multiple of `width`."""
    count = len(samples) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(count, rows), 0xF7, 0, 0), _GREY]
    for top in range(0, count, rows):
        part = samples[top * width : (top + rows) * width]
        codes = lzw_encode(part)
        out += [b"!\xf9\x04", struct.pack("<BHB", 1 << 2, delay, 0), b"\0,", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08"]
        out += [bytes([len(codes[i : i + 255])]) + codes[i : i + 255] for i in range(0, len(codes), 255)]
        out.append(b"\0")
    return b"".join([*out, b";"])


def payload(text: str | None, unit: int = WIDTH) -> tuple[int, bytes]:
    flat = (text or "").encode()
    return len(flat), flat + b" " * (max(1, -(-len(flat) // unit)) * unit - len(flat))


def stored(data: bytes) -> tuple[bytes, str]:
    """What the frames of a file written by encode() show, and a feature of them: number, time and summed histogram."""
    parts, delay = [], 0
    for f in shown_frames(data):
        parts.append(f.screen[f.top : f.top + f.samples.shape[0], f.left : f.left + f.samples.shape[1], 0].tobytes())
        delay += f.delay
    flat = b"".join(parts)
    bins = np.bincount(np.frombuffer(flat, dtype=np.uint8) >> 4, minlength=16)
    return flat, f"gif;{len(parts)};{delay};" + ",".join(map(str, bins.tolist()))


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the stored file) of each row of `docs`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            own = [payload(t) for t in pdf["text"]]
            made = {p: encode(p) for p in {p for _, p in own}}
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [n for n, _ in own], "media": [made[p] for _, p in own]})

    return mapped(plain(docs), run, "doc_id long, n_bytes long, media binary", "text")


def read_back(files: DataFrame) -> DataFrame:
    """op6's columns from media()."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            done: dict[bytes, tuple] = {}
            rows = []
            for i, n, m in zip(pdf["doc_id"], pdf["n_bytes"], pdf["media"], strict=True):
                key = hashlib.sha256(m).digest()
                if key not in done:
                    flat, feature = stored(m)
                    done[key] = (len(flat), hashlib.sha256(flat).hexdigest(), zlib.crc32(flat[-16:]), len(m), key.hex(), feature)
                rows.append((i, n, *done[key]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return mapped(files.select("doc_id", "n_bytes", "media"), run, COLUMNS, "media")


def frames(table: DataFrame, column: str = "media") -> DataFrame:
    """All columns but a clashing `frames`, and frames: delay, disposal, place, size and colour histogram of each."""

    @F.pandas_udf("array<struct<delay:int,disposal:int,left:int,top:int,width:int,height:int,histogram:array<int>>>")
    def take(files: pd.Series) -> pd.Series:
        out = []
        for f in files:
            try:
                out.append([{"delay": x.delay, "disposal": x.disposal, "left": x.left, "top": x.top, "width": x.samples.shape[1], "height": x.samples.shape[0], "histogram": x.histogram()} for x in decode(bytes(f))] if f else None)
            except (ValueError, struct.error, IndexError):
                out.append(None)
        return pd.Series(out)

    return table.drop("frames").withColumn("frames", take(F.col(column)))
