"""Unit dedup, decontamination, tokens and byte pairs, against brute force."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewire.llm import bpe, decontaminate, lines, queries, tokenpack

from .conftest import cases, key

PATH = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@functools.cache
def words():
    return tokenpack.Words(PATH)


@pytest.fixture(scope="module")
def tok():
    return library()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lines_by_force(rows, sentences=None):
    """For each (doc_id, text): its units and those of them that aren't the first of their kind, as (start, end); rows must be distinct."""
    first, found = {}, {}
    for n, (i, t) in enumerate(rows):
        own = [(m.start(), m.end(), " ".join(m[0].split()).lower()) for m in re.finditer(r"[^\n]+\n?", t or "") if m[0].strip()]
        if sentences:
            lines = {(a, u) for a, _, u in own}
            more = [(m.start(), m.end(), " ".join(m[0].split()).lower()) for m in re.finditer(r"[^\n.!?]+[.!?]*", t or "")]
            own += [u for u in more if len(u[2].split()) >= sentences and (u[0], u[2]) not in lines]
        found[n] = own
        for a, _, u in own:
            first[u] = min(first.get(u, (True, 1 << 64)), (i is not None, i or 0, n, a))
    return [(own, [(a, b) for a, b, u in own if first[u] != (rows[n][0] is not None, rows[n][0] or 0, n, a)]) for n, own in found.items()]


def without(text, gone):
    covered = {k for a, b in gone for k in range(a, b)}
    return "".join(c for k, c in enumerate(text) if k not in covered)


@pytest.mark.parametrize("sentences", [None, 5])
def test_units(spark, odd, none, sentences):
    rows = list({(r[0], r[1]): r[:2] for r in cases()}.values())  # rows that repeat id and text are one document
    want = {r: (len(own), len(gone), sha(without(r[1] or "", gone))) for r, (own, gone) in zip(rows, lines_by_force(rows, sentences), strict=True)}
    got = key((r["doc_id"], r["n_units"], r["n_removed"], r["kept_sha256"]) for r in lines.report(odd, sentences).collect())
    assert got == key((r[0], *want[r[:2]]) for r in cases())
    removed = lines.remove(odd, sentences)
    assert removed.schema == odd.schema and lines.report(none).count() == 0 and lines.remove(none).count() == 0
    texts = {r: without(r[1], gone) if r[1] is not None else None for r, (_, gone) in zip(rows, lines_by_force(rows, sentences), strict=True)}
    assert key(r[:2] for r in removed.collect()) == key((r[0], texts[r[:2]]) for r in cases())
    with pytest.raises(TypeError):
        lines.report(odd.withColumn("doc_id", odd["doc_id"].cast("string")))


def test_units_rank(spark):
    docs = spark.createDataFrame([(1, "a b c d e f.", 2), (2, "A  b c d e f. And more", 1)], "doc_id long, text string, rank int")
    assert key(lines.remove(docs, 5, rank="rank").select("doc_id", "text").collect()) == [(1, ""), (2, "A  b c d e f. And more")]
    docs = spark.createDataFrame([(1, "a b c", 2), (2, "x\nA  b C\ny", 1), (3, "a b c", None)], "doc_id long, text string, rank int")
    assert key(lines.remove(docs, rank="rank").select("doc_id", "text").collect()) == [(1, ""), (2, "x\ny"), (3, "a b c")]


def test_whole_lines(spark):
    rows = [(1, "nt onor. the of it.\nkept here"), (2, "x\nNT  onor. the of it.\ny"), (3, "nt onor. the of it."), (4, "of was oran. ha edble a.\n\n of was oran. ha edble a.\nof was"), (5, None), (6, ""), (7, "Yes. one two three four five six. No.\nnew. One two three four five six. short"), (8, "one two three four five six.\nYes. One two three four five six. No."), (None, "of was\nfirst of all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for sentences in (None, 5):
        got = {r["doc_id"]: r["text"] for r in lines.remove(docs, sentences).collect()}
        assert got == {i: None if t is None else without(t, gone) for (i, t), (_, gone) in zip(rows, lines_by_force(rows, sentences), strict=True)}
        assert got[2] == "x\ny" and got[3] == "" and got[4] == "of was oran. ha edble a.\n\n"
    assert got[7] == "Yes. one two three four five six. No.\nnew. short" and got[8] == ""


def force_hits(text, items, n=10):
    own = decontaminate.words(text)
    hit, names = set(), set()
    for item, t in items:
        w = decontaminate.words(t)
        size = min(n, len(w))
        for j in range(len(w) - size + 1 if size else 0):
            for i in range(len(own) - size + 1):
                if own[i : i + size] == w[j : j + size]:
                    hit.update(range(i, i + size))
                    names.update([item] if item is not None else [])
    return len(own), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_decontamination(spark, odd, none, block):
    text = cases()[7][1]
    items = [("1", " ".join(text.split()[5:40])), ("02", None), ("3", "One, TWO"), ("4", ""), ("5", text), ("5", text), ("6", "..."), (None, " ".join(text.split()[8:60])), (None, "x1 y2")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, doc_id int")
    found = decontaminate.digest(decontaminate.find(odd, bench, block_bytes=block))
    assert key(found.collect()) == key((r[0], *force_hits(r[1], items)) for r in cases())
    assert decontaminate.find(none, bench).count() == 0
    assert decontaminate.digest(decontaminate.find(odd, bench.limit(0))).filter("contaminated").count() == 0
    assert decontaminate.strip(none, bench).count() == 0


def test_strip(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")], "item_id long, text string")
    inner = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame([(1, f"é {' '.join('abcdefghijklmnop')} {inner}; end", 9), (2, inner, 9), (3, None, None)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: r for r in decontaminate.strip(docs, bench).collect()}
    assert set(got) == {1, 3}  # what is mostly such passages goes
    assert got[1]["text"] == f"é {' '.join('abcdefghijklmnop')} ; end" and got[1]["n_chars"] == len(got[1]["text"])


def test_strip_takes_one_block_at_a_time(spark, odd, monkeypatch):
    pieces = cases()[7][1].split()
    bench = spark.createDataFrame([(k, " ".join(pieces[k * 12 : k * 12 + 11])) for k in range(9)] + [(9, "One, TWO")], "item_id long, text string")
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    whole = key(decontaminate.strip(odd, bench).collect())
    assert len(sent) == 1 and whole != key(cases())
    assert key(decontaminate.strip(odd, bench, block_bytes=150).collect()) == whole
    assert len(sent) > 3 and all(isinstance(b, decontaminate.NgramSet) for b in sent)


def test_bpe(spark, odd, none, tok):
    want = []
    for r in cases():
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert key(bpe.digests(odd, PATH).collect()) == key(want)
    full = bpe.encode(odd, PATH)
    assert full.columns == ["doc_id", "text", "ids"]
    assert key((r["doc_id"], len(r["ids"])) for r in full.collect()) == key(w[:2] for w in want)
    assert bpe.digests(none, PATH).count() == 0 and bpe.encode(none, PATH).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs", "Cn")), max_size=60) | st.text(alphabet="aAbß Σς'’0٣ \n\t.,<|>é́endoftxsard", max_size=80))
def test_bpe_any_text(text):  # no fixture: hypothesis would write out its arguments, the vocabulary with them
    tok = library()
    text = text.encode("utf-8", "ignore").decode()
    ids = tok.encode(text, add_special_tokens=False).ids
    own = bpe.loaded(PATH)
    assert own.encode(text) == ids
    assert own.decode(ids) == tok.decode(ids, skip_special_tokens=False)
    assert words().encode(text).tolist() == ids


def test_bpe_long_words(tok):
    own, r = bpe.loaded(PATH), np.random.default_rng(3)
    letters = np.array(list("aeiounrstlhd"))
    for word in ("a" * 5000, "".join(r.choice(letters, 5000)), "the" * 900 + "re", "é" * 700, "a" * 201, "".join(r.choice(letters, 201))):
        assert own.encode(word) == tok.encode(word, add_special_tokens=False).ids
    assert len(own.encode("".join(r.choice(letters, 1_000_000)))) > 100_000  # in seconds, not hours


def test_bpe_words_side_by_side(tok, monkeypatch):
    r = random.Random(4)
    names = ["".join(r.choice("aeiounrstlhdé") for _ in range(r.randint(1, 12))) for _ in range(6000)]
    texts = [" ".join(r.choice((w, w.title(), w + ".", w + "'s", f"{w},{w}")) for w in names[k : k + 400]) for k in range(0, 6000, 300)]
    texts += ["", None, "Σίσυφος ΣΑΣ <|endoftext|> e\u0301t\t\u0301x " + "Σ" * 70, "\n \n", "\u0378a b\u0378", *texts[:3]]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    one_by_one, scan = [], bpe.Bpe.word
    monkeypatch.setattr(bpe.Bpe, "word", lambda self, w: one_by_one.append(w) or scan(self, w))
    assert [x.tolist() for x in bpe.Bpe(PATH).encode_all(texts)] == want
    assert len(one_by_one) < 100  # of 6,000
    for cached, stretches in ((40, 1 << 16), (1000, 50), (100_000, 1000)):  # stores that are emptied, texts in parts
        monkeypatch.setattr(bpe, "STRETCHES", stretches)
        own = bpe.Bpe(PATH, cached)
        assert [x.tolist() for x in own.encode_all(texts)] == want and list(own.encode_all([])) == []
        assert own.decode(want[0]) == tok.decode(want[0], skip_special_tokens=False) and own.decode([*want[0], 1 << 20]) == own.decode(want[0])


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, (1 << 32) - 1), max_size=300))
def test_pack(bits, ids):
    ids = np.array([i & ((1 << bits) - 1) for i in ids], dtype=np.uint32)
    data = tokenpack.pack(ids, bits)
    assert len(data) == (len(ids) * bits + 7) // 8
    assert tokenpack.unpack(data, bits, len(ids)).tolist() == ids.tolist()


def test_token_files(spark, odd, none, tok, tmp_path):
    path = f"file://{tmp_path}/t"
    tokenpack.write(odd, path, PATH, 49_408, end_id=1, files=3)
    got = [tuple(r) for r in tokenpack.read(spark, path).collect()]
    ids = {t: tok.encode(t or "", add_special_tokens=False).ids + [1] for t in {r[1] for r in cases()}}
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    assert key((r[0], r[2], r[3]) for r in got) == key((r[0], len(ids[r[1]]), crc(ids[r[1]])) for r in cases())
    ordered = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in ordered] == [sum(x[2] for x in ordered[:i]) for i in range(len(ordered))]
    known = [r[0] for r in ordered if r[0] is not None]
    assert known == sorted(known) and [r[0] for r in ordered[:2]] == [None, None]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    tokenpack.write(odd, f"file://{tmp_path}/s", PATH, 49_408, end_id=1, files=2, file_ids=500)  # several files a task
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert key(tokenpack.read(spark, f"file://{tmp_path}/s").collect()) == key(got)
    assert tokenpack.manifest(spark, f"file://{tmp_path}/s").count() > 2
    tokenpack.write(none, f"file://{tmp_path}/e", PATH, 49_408, end_id=1)
    assert tokenpack.read(spark, f"file://{tmp_path}/e").count() == 0


def test_random_access(tmp_path):
    packer, rng = tokenpack.Packer(17, block=64), np.random.default_rng(1)
    docs = [rng.integers(0, 1 << 17, n).astype(np.uint32) for n in (0, 5, 64, 200, 1)]
    for i, d in enumerate(docs):
        packer.add([i], np.array([len(d)]), d)
    (tmp_path / "f").write_bytes(b"".join(packer.file()))
    with (tmp_path / "f").open("rb") as f:
        r = tokenpack.Reader(f)
        assert all(r.doc(i).tolist() == d.tolist() for i, d in enumerate(docs))
        assert r.ids(60, 130).tolist() == np.concatenate(docs)[60:130].tolist()
    (tmp_path / "g").write_bytes(b"nothing of that kind" * 3)
    with (tmp_path / "g").open("rb") as f, pytest.raises(ValueError):
        tokenpack.Reader(f)


def test_queries_run_through_operators(spark, sf_dir, tok):
    n = Counter()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    sizes = {r["doc_id"]: len(tok.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs}
    by = defaultdict(int)
    for r in queries.op5_token_output(spark, sf_dir).collect():
        by[r["doc_id"]] = r["n_tokens"] - 1
        n["rows"] += 1
    assert n["rows"] == len(docs) and by == sizes


def runs_by_force(rows, run):
    """Lines and runs of sentences that go, by plain lists: rows are (doc_id, text) in order of doc_id."""
    known, seen = {}, {}
    digest = lambda t: " ".join(t.split()).lower()
    parts = []
    for n, (_, text) in enumerate(rows):
        own = [m for m in re.finditer(r"[^\n]+\n?", text or "") if m[0].split()]
        some = [m for m in re.finditer(r"[^\n.!?]+[.!?]*", text or "") if m[0].split()]
        parts.append((own, some))
        for m in own:
            known.setdefault(digest(m[0]), (n, m.start()))
        for m in some:
            seen.setdefault(digest(m[0]), (n, m.start()))
    out = []
    for n, (own, some) in enumerate(parts):
        gone = [m.span() for m in own if known[digest(m[0])] != (n, m.start())]
        repeated = [seen[digest(m[0])] != (n, m.start()) and not any(a <= m.start() < b for a, b in gone) for m in some]
        k, runs = 0, []
        while k < len(some):
            e = k
            while e < len(some) and repeated[e]:
                e += 1
            if e > k and sum(len(m[0].split()) for m in some[k:e]) >= run:
                runs.append((some[k].start(), some[e - 1].end()))
            k = max(e, k + 1)
        out.append((gone, runs))
    return out


@pytest.mark.parametrize("run", [3, 12])
def test_runs(spark, none, run):
    r = random.Random(run)
    sentence = lambda: " ".join(r.choice("abcd") for _ in range(r.randint(1, 4))) + r.choice([".", "!", "?", "...", " \n", "\n\n", ". "])
    rows = [(i, "".join(sentence() for _ in range(r.randint(0, 14)))) for i in range(60)]
    passage = " the one. and the other passage of words! it goes on? so it does."
    rows += [(100 + i, f"x{i} y{i}." + passage + f" z{i}") for i in range(4)] + [(200, None), (201, ""), (202, ". . !\n?")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "k", 1, "a", 2, "b", 3.0) for i, t in rows], none.schema).repartition(4)
    want = {}
    for (i, t), (gone, runs) in zip(rows, runs_by_force(rows, run)):
        want[i] = (len(gone), len(runs), ",".join(f"{a}-{b}" for a, b in sorted(gone + runs)), sha(without(t or "", gone + runs)))
    got = {x["doc_id"]: (x["n_removed"], x["n_runs"], x["removed"], x["kept_sha256"]) for x in lines.report(docs, run=run).collect()}
    assert got == want and any(x[1] for x in got.values())
    assert {x["doc_id"]: None if x["text"] is None else sha(x["text"]) for x in lines.remove(docs, run=run).collect()} == {i: None if t is None else want[i][3] for i, t in rows}
    assert passage.strip() not in " ".join(x["text"] or "" for x in lines.remove(docs, run=12).filter("doc_id between 101 and 103").collect())
    assert lines.report(none, run=run).count() == 0 and lines.remove(none, run=run).count() == 0
