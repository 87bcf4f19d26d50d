"""Classifiers by held-out accuracy, the field's marginals and the URL filter by brute force."""

import itertools
import zlib
from urllib.parse import urlsplit

import numpy as np
import pytest

from tidewire.llm import labelled, quality, toxicity, urls

from .conftest import cases


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    step = np.exp(rng.normal(size=(2, 2)))
    sizes = np.array([3, 1, 0, 5])
    x = np.exp(rng.normal(size=sizes.sum()))
    p, pairs = toxicity.marginals(x, sizes, step)
    want, both, at = np.zeros(len(x)), np.zeros((2, 2)), 0
    for n in sizes:
        total, hit, joint = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.prod([x[at + i] if t else 1.0 for i, t in enumerate(tags)]) * np.prod([step[a, b] for a, b in itertools.pairwise(tags)])
            total += w
            hit += w * np.array(tags, dtype=float)
            for a, b in itertools.pairwise(tags):
                joint[a, b] += w
        want[at : at + n] = hit / total
        both += joint / total
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, both)


@pytest.mark.parametrize(("judge", "label", "least"), [(toxicity.judge, "toxic", 0.85), (quality.judge, "quality", 0.75)])
def test_held_out(spark, judge, label, least):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = judge(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    own = [r for r in rows if r["held_out"]]
    good, bad = ([r["score"] for r in own if r[label] == y] for y in (1, 0))
    assert len(good) > 5 and len(bad) > 5
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area >= least


@pytest.mark.parametrize("judge", [toxicity.judge, quality.judge])
def test_odd_rows(spark, odd, none, judge):
    labels = spark.createDataFrame([(i % 16 + 1, i % 2, i % 2, 0.5) for i in range(40)] + [(None, 1, 1, 0.5), (3, None, None, 0.5)], "doc_id long, quality int, toxic int, score double")
    rows = judge(odd, labels).collect()
    assert len(rows) == len(cases()) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 10}) == 1
    assert judge(none, labels).count() == 0
    assert len({r["score"] for r in judge(odd, labels.limit(0)).collect()}) == 1


def test_keep_clean(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = toxicity.keep_clean(odd, labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_offsets(spark):
    rows = [(i, f"plain words stand here {'vileword' if i % 2 else 'flower'} and end {i}", i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = docs.selectExpr("doc_id", "y AS toxic")
    got = toxicity.judge(docs, labels).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got)
    assert all([rows[r["doc_id"]][1][s["start"] : s["end"]] for s in r["spans"]] == (["vileword"] if r["doc_id"] % 2 else []) for r in got)


def test_common_beginning():
    banner = "all pages of this source begin with one and the same header line "
    rows = [(f"{banner} text {i} {'vileword' if i % 2 else 'flower'} end", i % 2) for i in range(120)]
    assert len(toxicity.unlike(rows + [(rows[0][0].upper() + " ", 0)])) == 120
    crf = toxicity.Crf().train(rows)
    got = crf.score([t for t, _ in rows], toxicity.Emissions(crf))
    assert [int(g[0] >= 0.5) for g in got] == [y for _, y in rows]


def test_few_toxic_rows():
    rows = [(f"text {i} {'vileword' if i % 15 == 0 else 'flower'} w{i} end", int(i % 15 == 0)) for i in range(90)]
    assert [sum(tags) for _, tags in toxicity.token_labels(rows)] == [y for _, y in rows]  # 6 toxic rows
    many = [(f"text {i} {'rare' if i < 16 else 'vile' if i < 1000 else 'flower'}", int(i < 1000)) for i in range(2000)]
    tags = toxicity.token_labels(many)
    assert not any(any(t) for _, t in tags[:16]) and all(any(t) for _, t in tags[16:1000])  # 16 of 1000 are no share


def test_no_token_to_label():
    rows = [(f"plain words {i}", i % 2) for i in range(60)]
    crf = toxicity.Crf().train(rows)
    assert all(g[0] < 1e-9 and not g[1] for g in crf.score([t for t, _ in rows] + [None, ""], toxicity.Emissions(crf)))


URLS = ["https://a.org/x", "http://EXAMPLE.org/es/1", "http://www.example.org/en/12?q#f", "http://example.org/en/2", "https://x.com/fr/", "https://x.com/fr", "https://x.com/de/1", "https://com/de/1", "https://notorg/", "https://q.org", "https://q.org?x=/", "no scheme", "", None, "x://y://z", "https://x.com#/de/", "https://é.org/\n?", "https://x.com/de/\n/#a", "https://casino-win.example.net/en/1"]


def force(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "a", "b") for i, u in enumerate(URLS)] + [(3, URLS[3], "a", "b"), (None, None, None, None)], "page_id long, url string, host string, verdict string")
    rows = urls.judge(pages).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        url = None if r["page_id"] is None else URLS[r["page_id"]]
        host, path = force(url)
        assert (r["host"], r["path"]) == (host, path) == urls.parts(url)
        fits = [(rule, said) for rule, said in urls.RULES if (host == (h := rule.split("/")[0]) or host.endswith("." + h)) and path.startswith(rule[len(h) :])]
        best = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert r["rule"] == best[0] and r["verdict"] == (best[1] or ("block" if r["score"] >= 0.5 else "allow"))
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_model():
    """Right on hosts that the model hasn't seen: folds by the host's own label."""
    rows = urls.labelled_urls()
    own = lambda u: urls.parts(u)[0].split(".")[-2]
    hosts = sorted({own(u) for u, _ in rows})
    fold = dict(zip(hosts, np.random.default_rng(1).permutation(len(hosts)) % 5, strict=True))
    right = []
    for k in range(5):
        w, b = urls.train([r for r in rows if fold[own(r[0])] != k])
        for u, y in [r for r in rows if fold[own(r[0])] == k]:
            assert urlsplit(u).netloc == urls.parts(u)[0]
            x = urls.features(*urls.parts(u))
            right.append((w[x].sum() / np.sqrt(max(1, len(x))) + b > 0) == y)
    assert np.mean(right) > 0.8


def test_quality_by_force():
    """Score of each text from the projected table, feature by feature."""
    model = quality.Subwords(np.random.default_rng(4).normal(size=quality.SIZE), 0.3)
    texts = ["one two two three", None, "", "  ", "one", "é" * 30 + " x x x", "a b\nc a b"]
    store = quality.Store(model)
    for t, got in zip(texts, store.scores(texts), strict=True):
        w = (t or "").split()
        rows = [k for x in w for k in quality.features(x)]
        for a, b in itertools.pairwise(w):
            rows.append(int(quality.pair_rows(np.array([quality._hash(a), quality._hash(b)], dtype=np.uint32))[0]))
            rows += [quality.AGAIN] if a == b else []
        z = sum(model.values[r] for r in rows) / len(rows) + 0.3 if rows else 0.3
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9
        ids, share = quality.bag(t, {})
        assert dict(zip(ids.tolist(), share.tolist(), strict=True)) == {r: rows.count(r) / len(rows) for r in rows}


def test_quality_pairs():
    """Only the order of words tells the labels apart."""
    rng = np.random.default_rng(6)
    rows = [(" ".join(x for _ in range(20) for x in (("alpha", "beta", "gamma") if y else ("beta", "alpha", "gamma"))[: 2 + rng.integers(2)]) , y) for y in (0, 1) for _ in range(60)]
    store = quality.Store(quality.train(rows))
    assert np.mean((store.scores([t for t, _ in rows]) >= 0.5) == np.array([y for _, y in rows])) > 0.95


def test_toxicity_by_force():
    """Scores from tokens one by one, by enumeration-free forward and backward sums."""
    crf = toxicity.Crf()
    crf.w, crf.step, crf.doc = np.append(np.random.default_rng(8).normal(size=toxicity.SIZE), 0.0), np.array([[0.0, -1.0], [-0.5, 0.7]]), (0.8, 1.1, -2.0)
    texts = ["a few words of text", None, "", "one", "the same the same"]
    for t, got in zip(texts, crf.scores(texts, toxicity.Emissions(crf)), strict=True):
        x = crf.emissions((t or "").split()).tolist()
        total, hit = 0.0, np.zeros(len(x))
        for tags in itertools.product((0, 1), repeat=len(x)):
            weight = np.prod([e if g else 1.0 for e, g in zip(x, tags, strict=True)]) * np.exp(sum(crf.step[a, b] for a, b in itertools.pairwise(tags)))
            total += weight
            hit += weight * np.array(tags, dtype=float)
        p = hit / total
        want = 0.8 * np.log1p(p.sum()) + 1.1 * (p.max() if len(p) else 0.0) - 2.0
        assert abs(got - 1 / (1 + np.exp(-want))) < 1e-9


def test_url_table_is_neutral(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").where("url IS NOT NULL").collect()
    hosts = {urls.parts(r["url"])[0] for r in pages}
    known = {label for h in hosts for label in h.split(".")} - {"com", "org", "net", "www"}
    own = {urls.parts(u)[0] for u, _ in urls.labelled_urls()}
    assert not known & {label for h in own for label in h.split(".")} and not known & set(urls.BLOCKED + urls.WANTED)


@pytest.mark.parametrize("long_at", [0, 7, 19])
def test_one_long_text_leaves_the_sample(spark, long_at):
    """A text beyond its share is passed over, wherever it stands; the others stay, with both labels, within the bound."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5][:60]
    rows = [(i, ("w%d " % i) * (3000 if k == long_at else 20)) for k, i in enumerate(ids)]
    docs = spark.createDataFrame([*rows, rows[1], (None, "x")], "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(i, k % 3 == 0) for k, i in enumerate(ids)], "doc_id long, toxic boolean").selectExpr("doc_id", "int(toxic) toxic")
    got = labelled.sample(docs, marks, "toxic", 4000, 40_000)
    assert sorted(t for t, _ in got) == sorted(t for k, (_, t) in enumerate(rows) if k != long_at)
    small = labelled.sample(docs, marks, "toxic", 4000, 2400)
    assert 0 < sum(len(t) for t, _ in small) <= 2400 and {y for _, y in small} == {0, 1} and set(small) < set(got)
    assert len(labelled.sample(docs, marks, "toxic", 10, 40_000)) == 10
    with pytest.raises(ValueError, match="longer"):
        labelled.sample(docs, marks, "toxic", 10, 200)
    assert labelled.sample(docs, marks.filter("toxic = 1"), "toxic", 4000, 40_000) and labelled.sample(docs, marks.limit(0), "toxic", 10) == []
