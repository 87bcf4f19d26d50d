"""Repeated windows, GIF and the Jaccard forest against brute force."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import components, forest, gif, repeats
from tidewire.llm.decontaminate import words

from .conftest import SCHEMA, cases, key, prose


def force_repeats(texts, depth):
    seen = Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - depth + 1):
            if seen[t[i : i + depth]] > 1:
                gone[i : i + depth] = True
        turn = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
        out.append((len(t), int(gone.sum()), int((turn == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("depth", "gram", "crowd"), [(400, 128, 256), (40, 12, 256), (40, 12, 1)])
def test_repeats(spark, odd, none, depth, gram, crowd):
    got = repeats.remove(odd, depth, gram, crowd).drop("removed").collect()
    want = force_repeats([(r[1] or "").encode() for r in cases()], depth)
    assert key(got) == key((r[0], *w) for r, w in zip(cases(), want, strict=True))
    assert repeats.remove(none, depth, gram, crowd).count() == 0


def test_repeats_crowd(spark):
    """One gram in many different surroundings, and passages cut at every place."""
    r = random.Random(4)
    hub = prose(1, 30).replace("\n", " ")[:150]
    base = prose(2, 400)
    rows = [(i, prose(100 + i, 20) + hub + (prose(500 + i % 3, 40) if i % 2 else "")) for i in range(60)]
    rows += [(100 + i, base[(s := r.randrange(500)) : s + r.randrange(50, 900)]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (256, 5):
        got = repeats.remove(docs, 120, 40, crowd).drop("removed").collect()
        assert key(got) == key((x[0], *w) for x, w in zip(rows, force_repeats([t.encode() for _, t in rows], 120), strict=True))


def test_repeats_length(spark):
    """The contract's 400 bytes are the least that goes: passages of 51 words may be shorter, and stay."""
    r = random.Random(6)
    passages = [" ".join("".join(r.choices("abcdefgh", k=k)) for k in sizes) for sizes in ([5] * 51, [7] * 50, [7] * 50 + [0])]
    assert [len(p) for p in passages] == [305, 399, 400]
    rows = [(i, "".join(r.choices("klmnop", k=300)) + "qr"[i % 2] + passages[i // 2] + "st"[i % 2] + "".join(r.choices("klmnop", k=300))) for i in range(6)]
    got = {x["doc_id"]: [(s["a"], s["b"]) for s in x["removed"]] for x in repeats.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [], 4: [(301, 701)], 5: [(301, 701)]}


def force_passages(texts, n):
    """Words inside strings of n words that another row has too, and their runs."""
    split = [(t or "").encode().split() for t in texts]
    where = {}
    for k, w in enumerate(split):
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = []
    for w in split:
        hit = np.zeros(len(w) + 1, dtype=bool)
        for i in range(len(w) - n + 1):
            if len(where[tuple(w[i : i + n])]) > 1:
                hit[i : i + n] = True
        out.append((int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(np.int8)])) == 1).sum())))
    return out


@pytest.mark.parametrize(("n", "gram", "crowd"), [(50, 16, 4096), (12, 4, 4096), (12, 4, 1)])
def test_passages(spark, odd, none, n, gram, crowd):
    got = repeats.remove(odd, passage=n, word_gram=gram, word_crowd=crowd)
    plain = repeats.remove(odd)
    assert key(got.select(plain.columns).collect()) == key(plain.collect())
    want = force_passages([r[1] for r in cases()], n)
    assert key(got.select("doc_id", "n_bytes", "n_shared_words", "n_passages").collect()) == key((r[0], len((r[1] or "").encode()), *w) for r, w in zip(cases(), want, strict=True))
    assert repeats.remove(none, passage=n, word_gram=gram, word_crowd=crowd).count() == 0


def test_passages_crowd(spark):
    """One gram of words in many different surroundings, passages cut at every word, and repeats within one text alone, which don't count."""
    r = random.Random(4)
    hub = " ".join(prose(1, 9).split())
    base = prose(2, 200).split()
    rows = [(i, prose(100 + i, 20) + " " + hub + " " + (prose(500 + i % 3, 40) if i % 2 else "")) for i in range(60)]
    rows += [(100 + i, "\t\n".join(base[(s := r.randrange(100)) : s + r.randrange(5, 90)])) for i in range(40)]
    rows += [(200, (prose(77, 30) + "\n") * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = force_passages([t for _, t in rows], 14)
    assert want[-1] == (0, 0)
    for crowd in (4096, 5):
        got = repeats.remove(docs, passage=14, word_gram=5, word_crowd=crowd).select("doc_id", "n_shared_words", "n_passages").collect()
        assert key(got) == key((x[0], *w) for x, w in zip(rows, want, strict=True))


def test_passages_query(spark, tmp_path):
    """op8 tells passages of 51 words that two documents have, whatever bytes they have; of less than 400 bytes none is removed."""
    from tidewire.llm.queries import QUERIES

    r = random.Random(6)
    passages = [" ".join("".join(r.choices("abcdefgh", k=k)) for _ in range(n)) for n, k in ((51, 3), (51, 5), (49, 5))]
    rows = [(i, " ".join("".join(r.choices("klmnop", k=6)) for _ in range(60)) + " " + passages[i // 2] + "\n" + "".join(r.choices("klmnop", k=300))) for i in range(6)] + [(6, "".join(r.choices("abc ", k=900)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: (x["n_removed"], x["n_shared_words"], x["n_passages"]) for x in QUERIES["op8_suffix_repeats"](spark, str(tmp_path)).collect()}
    assert got == {0: (0, 51, 1), 1: (0, 51, 1), 2: (0, 51, 1), 3: (0, 51, 1), 4: (0, 0, 0), 5: (0, 0, 0), 6: (0, 0, 0)}


def force_links(rows, threshold=0.8, n=5):
    sets = []
    for _, t in rows:
        w = words(t)
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    name = lambda own: min((rows[k][0] for k in own if rows[k][0] is not None), default=None)
    out = []
    for i, (d, _) in enumerate(rows):
        same = [k for k in range(len(rows)) if sets[k] == sets[i]] if sets[i] else [i]
        every = [k for k in range(len(rows)) if top(k) == top(i)]
        out.append((d, name(same), name(every), links[i]))
    return out


@pytest.mark.parametrize("block", [128, 3])
def test_forest(spark, odd, none, block):
    rows = [r[:2] for r in cases()]
    base = prose(77, 200).split()
    r = random.Random(1)
    for i in range(30):  # near copies, a chain of them at every distance
        own = list(base)
        for _ in range(i // 2):
            own[r.randrange(len(own))] = f"other{r.randrange(9)}"
        rows.append((1000 + i, " ".join(own)))
    docs = spark.createDataFrame([(*x, "en", "s", 1, "k", 1, "a", 2, "b", 3.0) for x in rows], SCHEMA)
    assert key(forest.join(docs, block=block).collect()) == key(force_links(rows))
    assert forest.join(none).count() == 0


def test_signatures():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    a, b = np.unique(pool[:360]), np.unique(pool[40:])  # 320 of 400 in common
    sig = forest.signatures([a, b, a[:1]], 32)
    assert sig.shape == (3, 32) and len(set(sig[0].tolist())) == 32
    same = (sig[0].view(np.uint8) == sig[1].view(np.uint8)).mean()
    assert abs(same - 0.8) < 0.1
    assert 0.99999 > forest.meets(0.8, 6, 32) > 0.9999 > forest.meets(0.8, 8, 32)


def test_forest_shortens(spark, monkeypatch):
    """Pairs close to the threshold take shorter prefixes than near copies do; no pair is lost either way."""
    lengths, seen = [], []
    plain = forest._compared
    monkeypatch.setattr(forest, "_compared", lambda rows, length, *a: lengths.append(length) or plain(rows, length, *a))

    def pairs(changes):
        rows = []
        for i in range(60):
            own = prose(3000 + i, 220).split()
            other = list(own)
            for k in range(changes):
                other[10 + k * 25] = f"other{i}"
            rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
        return rows

    for changes in (1, 4):
        rows = pairs(changes)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert key(forest.join(docs).collect()) == key(force_links(rows))
        assert lengths == sorted(lengths, reverse=True)
        seen.append(lengths[-1])
        lengths.clear()
    assert seen[1] <= 6


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(150)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=3000) | st.builds(lambda b, n: b * n, st.binary(min_size=1, max_size=3), st.integers(1, 20_000)))
def test_lzw(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_lzw_full_table():
    data = np.random.default_rng(1).integers(0, 200, 400_000).astype(np.uint8).tobytes()
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def plain_lzw(samples, size):
    """A decoder's simplest meal: a clear code before each sample."""
    bits = [b for s in samples for code in (1 << size, s) for b in [code >> k & 1 for k in range(size + 1)]] + [((1 << size) + 1) >> k & 1 for k in range(size + 1)]
    return np.packbits(np.array(bits, dtype=np.uint8), bitorder="little").tobytes()


def frame(left, top, w, h, samples, size=2, flags=0, palette=b"", gce=None):
    codes = plain_lzw(samples, size)
    head = b"!\xf9\x04" + struct.pack("<BHB", *gce) + b"\0" if gce else b""
    return head + b"," + struct.pack("<HHHHB", left, top, w, h, flags) + palette + bytes([size, len(codes)]) + codes + b"\0"


def test_gif_rules():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    own = bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6])
    data = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 3, 0) + palette + b"!\xfe\x03abc\0"
    data += frame(0, 0, 2, 2, [1, 1, 1, 1], gce=(1 << 2, 5, 0))  # stays
    data += frame(0, 0, 2, 2, [0, 2, 2, 0], gce=(2 << 2 | 1, 7, 0))  # 0 is transparent; then the ground colour
    data += frame(0, 0, 1, 1, [2], gce=(3 << 2, 1, 0))  # then as before
    data += frame(1, 1, 1, 1, [1], flags=0x81, palette=own) + b";"
    red, green, blue = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    shown = [[tuple(p) for row in f.screen.tolist() for p in row] for f in gif.decode(data)]
    assert shown == [[red] * 4, [red, green, green, red], [green, blue, blue, blue], [blue, blue, blue, (8, 8, 8)]]
    assert [f.delay for f in gif.decode(data)] == [5, 7, 1, 0]
    assert gif.decode(data)[0].histogram() == [0, 0, 0, 0, 4, 0, 0, 0]
    laced = b"GIF89a" + struct.pack("<HHBBB", 1, 9, 0x81, 0, 0) + palette + frame(0, 0, 1, 9, [0, 1, 2, 3, 0, 1, 2, 3, 0], flags=0x40) + b";"
    assert gif.decode(laced)[0].samples.ravel()[[0, 8, 4, 2, 6, 1, 3, 5, 7]].tolist() == [0, 1, 2, 3, 0, 1, 2, 3, 0]
    for bad in (b"", b"GIF89a", data[:40], b"PNG" + data):
        with pytest.raises((ValueError, struct.error, IndexError)):
            gif.decode(bad)


def test_media(spark, odd, none):
    rows = gif.read_back(gif.media(odd)).collect()
    want = []
    for r in cases():
        flat = (r[1] or "").encode()
        pad = flat + b" " * (max(1, -(-len(flat) // 192)) * 192 - len(flat))
        want.append((r[0], len(flat), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:])))
    assert key(tuple(r)[:5] for r in rows) == key(want)
    assert gif.read_back(gif.media(none)).count() == 0
    media = gif.media(odd)
    kept = {(r["doc_id"], hashlib.sha256(r["media"]).hexdigest(), len(r["media"])) for r in media.collect()}
    assert {(r["doc_id"], r["media_sha256"], r["media_bytes"]) for r in rows} == kept
    files = media.unionByName(spark.createDataFrame([(50, 0, b""), (51, 0, None), (52, 0, b"GIF89a..")], media.schema)).withColumnRenamed("n_bytes", "frames")
    shown = gif.frames(files).collect()
    assert all((r["frames"] is None) == (r["doc_id"] in (50, 51, 52)) for r in shown)
    assert all(sum(f["histogram"]) == f["width"] * f["height"] for r in shown if r["frames"] for f in r["frames"][:1])
