"""Line diffs against a table of common subsequences; addresses against the standard library's networks."""

import ipaddress
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.functions import batches, content, diffs

LINES = st.lists(st.sampled_from("abcd"), max_size=12)


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=1500, deadline=None)
@given(LINES, LINES)
def test_longest_common_subsequence(a, b):
    m = diffs.matches(a, b)
    assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))
    assert len(m) == longest(a, b)
    whole = diffs.changes(a, b, None)
    assert [r["content"] for r in whole if r["kind"] != "add"] == a and [r["content"] for r in whole if r["kind"] != "remove"] == b


@settings(max_examples=500, deadline=None)
@given(LINES, LINES, st.integers(0, 3))
def test_context(a, b, around):
    whole, some = diffs.changes(a, b, None), diffs.changes(a, b, around)
    near = [any(w["kind"] != "context" for w in whole[max(0, k - around) : k + around + 1]) for k in range(len(whole))]
    want = []
    for k, w in enumerate(whole):
        if near[k]:
            if want and not near[k - 1]:
                want.append({"kind": "meta", "content": "..."})
            want.append(w)
    assert some == want


def test_many_lines():
    a = [str(i) for i in range(40_000)]
    assert len(diffs.matches(a, [x if i % 3 else "new" for i, x in enumerate(a)])) == 40_000 - 13_334


def test_column(spark):
    rows = spark.createDataFrame([("a\nb\nc", "a\nc\nd"), (None, "x"), ("", None), ("same", "same")], "x string, y string")
    got = [[(r["kind"], r["content"]) for r in row[0]] for row in rows.select(diffs.line_diff("x", "y", 1)).collect()]
    assert got == [[("context", "a"), ("remove", "b"), ("context", "c"), ("add", "d")], [("remove", ""), ("add", "x")], [], []]


def test_column_with_gaps(spark):
    x, y = [str(i) for i in range(30)], [str(i) for i in range(30) if i not in (4, 20)] + ["é"]
    got = spark.createDataFrame([("\n".join(x), "\n".join(y))], "x string, y string").select(diffs.line_diff("x", "y", 2)).first()[0]
    assert [(r["kind"], r["content"]) for r in got] == [(r["kind"], r["content"]) for r in diffs.changes(x, y, 2)]
    assert sum(r["kind"] == "meta" for r in got) == 2


def test_memory_follows_a_few_rows():
    """4,000 pairs of texts of 40 lines: a number a line is kept, not a dictionary with a copy of the line (over 30 MB)."""
    texts = pa.array(["\n".join(f"a line {k} of text {i}" for k in range(40)) for i in range(4000)])
    other = pa.array(["\n".join(f"a line {k} of text {i}" for k in range(1, 41)) for i in range(4000)])
    tracemalloc.start()
    got = batches.by_few(lambda p, q: diffs.coded(p.split("\n"), q.split("\n"), None), pa.list_(pa.int32()), texts, other)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 4000 and len(got[0]) == 41 and peak < 3_000_000
    assert batches.by_few(len, pa.int32(), texts[:0]).to_pylist() == []


@pytest.fixture(scope="module")
def judged(spark):
    addresses = ["0:0:0:0:0:0:0:1", "::ffff:7f00:1", "::ffff:0:8.8.8.8", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "fe80:0:0::1", "::", ":::", "64:ff9b::10.0.0.1", "::10.0.0.1", "1.2.3", "01.2.3.4", "fc00::", "fbff::1", "febf:ffff::", "fec0::", "g::1", "12345::", "1::", "::1:2:3:4:5:6:7", "::1:2:3:4:5:6:7:8"]
    addresses += [f"{a}.{b}.0.255" for a in (0, 1, 9, 10, 11, 100, 126, 127, 128, 169, 172, 192, 198, 223, 224, 255) for b in (0, 15, 16, 18, 19, 20, 31, 32, 63, 64, 127, 128, 168, 254)]
    return {r["t"]: r["b"] for r in spark.createDataFrame([(a,) for a in addresses], "t string").withColumn("b", content.private_address("t")).collect()}


def test_networks(judged):
    nets = [ipaddress.ip_network(n) for n in content.CLOSED]
    for text, got in judged.items():
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            assert not got, text
            continue
        ip = getattr(ip, "ipv4_mapped", None) or ip
        assert got == any(ip.version == n.version and ip in n for n in nets), text
