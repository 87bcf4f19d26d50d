"""Personal data: base spans against the plain patterns, the field's sums against enumeration, and held-out rewritten spans."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import pii
from tidewire.llm.queries import QUERIES

from .conftest import cases

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def check(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def plain(text):
    out = [(kind, *m.span()) for kind, p in PATTERNS.items() for m in re.finditer(p, text) if check(kind, m[0])]
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("a.@1 -+(9)%25é٣", max_size=60), st.lists(st.sampled_from(["a.b@c.de", "4111 1111 1111 1111", "+1 (017) 555-7713", "1.2.3.4", ".", " ", "@", "+", "x", "300.1.2.3", "-"]), max_size=8).map("".join)))
def test_base(text):
    assert pii.base(text) == plain(text)


def test_base_is_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "@" * 200_000, "+1 " * 100_000, "1 " * 200_000, "a@" * 100_000):
        pii.base(text)  # would take hours if it were quadratic


def test_sums_by_enumeration():
    r = np.random.default_rng(3)
    found = [(i, j, r.normal(size=4)) for i in range(5) for j in range(i + 1, min(i + 3, 5) + 1)]
    total, share = 0.0, np.zeros((len(found), 4))
    for size in range(6):
        for some in itertools.combinations(range(len(found)), size):
            own = sorted((found[x][0], found[x][1]) for x in some)
            if any(a[1] > b[0] for a, b in zip(own, own[1:])):
                continue
            for kinds in itertools.product(range(4), repeat=size):
                w = np.exp(sum(found[x][2][k] for x, k in zip(some, kinds)))
                total += w
                for x, k in zip(some, kinds):
                    share[x, k] += w
    alpha, p = pii._sums(5, found)
    assert np.isclose(alpha[-1], np.log(total)) and np.allclose(p, share / total)


def test_best_by_enumeration():
    """The dynamic program gives the cutting of the greatest sum."""
    text = "call 1 2 3 4 5 6 7 8 9 1 or 12.3.4.5 x@y.zz"
    tokens, found = pii.segments(text, 0, len(text))
    r = random.Random(5)
    field = pii.Field({f: np.array([r.gauss(0, 0.4) for _ in pii.KINDS]) for _, _, fs in found for f in fs})
    best = [0.0] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        best[j] = max([best[j - 1]] + [best[a] + max(field.scores(fs)) for a, b, fs in found if b == j])
    ends = {(tokens[a][0], tokens[b - 1][1]): fs for a, b, fs in found}
    got = field.best(text, [])
    assert np.isclose(sum(field.scores(ends[a, b])[pii.KINDS.index(k)] for k, a, b in got), best[-1])
    assert all(x[2] <= y[1] for x, y in zip(got, got[1:]))


@pytest.fixture(scope="module")
def field():
    return pii.train([])


def test_held_out(field):
    """Rewritten spans that training didn't see; plain texts and look-alikes stay clean."""
    r, hit, n = random.Random(99), 0, 0
    for _ in range(240):
        kind = r.choice(pii.KINDS)
        head, word = "it was said that one could ask at ", pii.rewritten(kind, pii.made_up(kind, r), r)
        fixed, added = pii.spans_of(f"{head}{word} and so on", field)
        hit, n = hit + ((kind, len(head), len(head) + len(word)) in fixed + added), n + 1
    assert hit / n >= 0.85
    for text in ("In 2024 it was 1,234,567.89, at rest. The dot of 3.14159 is there.", "1234567890123456 is not one", "10.20.300.400 neither", "", "no"):
        assert pii.spans_of(text, field) == ([], [])


def test_two_cards_in_a_row(field):
    r = random.Random(8)
    a, b = pii.made_up("card", r), pii.made_up("card", r)
    fixed, added = pii.spans_of(f"as of {a} {b} there", field)
    assert fixed == [] and added == [("card", 6, 22), ("card", 23, 39)]


def test_report_and_masks(spark, odd, none, field):
    rows = spark.createDataFrame([(i, t, "en", "s", 0, "k", 1, "a", 2, "b", 3.0) for i, t in [(1, None), (1, "x a.b@c.de y"), (1, "x a.b@c.de y"), (None, "4111 1111 1111 1111"), (3, "é +1 (017) 555-7713, 1.2.3.4" + " z" * 50_000 + " q@r.st")]], odd.schema).union(odd)
    got = sorted((tuple(r) for r in pii.report(rows, field).collect()), key=str)
    want = []
    for i, t in [(r["doc_id"], r["text"]) for r in rows.collect()]:
        spans = plain(t or "")
        n = [sum(s[0] == k for s in spans) for k in PATTERNS]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((i, *n, hashlib.sha256(text.encode()).hexdigest(), text, 0))
    assert got == sorted(want, key=str) and len(got) == len(cases()) + 5
    new = {r["text"] for r in pii.masked(rows, field).collect()}
    assert "x <email> y" in new and "<card>" in new and "é <phone>, <ip>" + " z" * 50_000 + " <email>" in new
    assert pii.report(none, field).collect() == [] and pii.masked(none, field).collect() == []


def test_query(spark, sf_dir):
    got = {r["doc_id"]: r for r in QUERIES["op12_personal_data"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        spans = plain(d["text"] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = got[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r["spans"].split(","))
        assert r["n_added"] == len(list(filter(None, r["spans"].split(",")))) - len(spans)
