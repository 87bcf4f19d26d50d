"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Each text is the set of its word 5-grams (a text of fewer words, but not none, is one gram), by 64-bit hashes. Texts with
equal sets are one class; the class's least row stands for it. A representative has `trees` signatures. A signature is
`depth` = 8 minima of 8 bits each, the first one most significant, in one 64-bit number: signatures sorted as numbers are a
tree's prefix trie, and a trie node at length d is what agrees in the first d bytes.

The matched prefix is shortened step by step. At the whole length each row under a node is compared with the node's least
one by all their trees x depth minima: pairs whose minima agree in about `threshold` of all places (less a margin of more
than five standard deviations, so that no link is lost by it) are in one group. So tight groups fall together. From their
similarities the recall of each length follows: a pair of similarity s meets at length d with probability
p = 1 - (1 - s ** d) ** trees, so that each pair found stands for (1 - p) / p missed ones. The next length is the longest at
which the found are `recall` of both; there all rows under one node are compared in the same way, block by block, but
only where they are not yet in one group. What is found joins the estimate, and the shortening goes on until it reaches
`recall`, or single minima.

Groups, which chains of similar pairs hold together, are verified exactly: a group is cut into blocks of at most about
`block` members by a hash; every pair of blocks is one small group of rows, in which exact set intersections are a matrix
product over the grams. So each pair of a group is verified once, in one place, and only sums of links and a spanning
forest leave the task.

Result: doc_id, text_class (the least doc_id of the rows with an equal set), class_id (the least doc_id of the rows
connected by verified links), n_links (rows of other documents that are linked to this one, its own copies included).

Defined cases: null, empty and word-free texts are linked to nothing, and a class by themselves; a row with a null
doc_id takes part, and counts as greater than any id when the least is named (null where there is no other); rows that
repeat a doc_id are rows of their own; ties go to the least doc_id; extra columns are ignored; an empty table gives an
empty result.
Scale: 8 bytes for each row and tree are shuffled for each length; signatures of the rows under mixed nodes, once for each
such node and block (overlapping large nodes are taken as one where that makes fewer pairs); texts of grouped rows once. Hot copies fall together in the class aggregate, map-side; large nodes
and large groups of near copies are spread over their block pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, mapped, same_row, staged
from .components import components
from .decontaminate import words

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
DEPTH = 8


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Grams(dict):
    """Hashes of words, kept up to a bound; grams() gives the sorted distinct gram hashes of a text."""

    def __init__(self, n: int = 5, cached: int = 100_000):
        self.n, self.cached = n, cached

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.cached:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got

    def grams(self, text: str | None) -> np.ndarray:
        own = words(text)
        if not own:
            return np.empty(0, dtype=np.uint64)
        h = np.fromiter(map(self.__getitem__, own), dtype=np.uint64, count=len(own))
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            out = _mix(out * _P + h[j : len(h) - n + 1 + j])
        return np.unique(out)


def meets(similarity: np.ndarray | float, length: int, trees: int) -> np.ndarray | float:
    """The probability that two sets share a prefix of this length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def signatures(sets: list[np.ndarray], trees: int, seed: int = 11) -> np.ndarray:
    """For each non-empty set and tree, 8 bits of each of DEPTH minima, the first most significant: (sets, trees) of 64 bits."""
    rng = np.random.default_rng(seed)
    odd, add = rng.integers(0, 1 << 32, (2, trees, DEPTH), dtype=np.uint32)
    odd |= np.uint32(1)
    edge = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    flat = np.concatenate(sets)
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(sets), trees), dtype=np.uint64)
    for t in range(trees):
        for k in range(DEPTH):
            v = (low + add[t, k]) * odd[t, k]
            v ^= high
            v *= np.uint32(0x85EBCA6B)
            least = _mix(np.minimum.reduceat(v, edge).astype(np.uint64) * _P)
            out[:, t] = out[:, t] << np.uint64(8) | least & np.uint64(255)
    return out


def _sign(docs: DataFrame, n: int, trees: int) -> DataFrame:
    """doc_id, th, s1, s2 (128 bits of the set; null without words), signatures (null without words)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams(n)
        for pdf in frames:
            sets = [grams.grams(t) for t in pdf["text"]]
            some = [i for i, s in enumerate(sets) if len(s)]
            s1, s2, own = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if some:
                full = [sets[i] for i in some]
                edge = np.concatenate([[0], np.cumsum([len(s) for s in full])])[:-1]
                flat = np.concatenate(full)
                for out, base in ((s1, _P), (s2, _Q)):
                    for i, v in zip(some, np.add.reduceat(_mix(flat ^ base), edge).view(np.int64).tolist(), strict=True):
                        out[i] = v
                for i, row in zip(some, signatures(full, trees).view(np.int64), strict=True):
                    own[i] = row
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "th": pdf["th"], "s1": pd.array(s1, dtype="Int64"), "s2": pd.array(s2, dtype="Int64"), "signatures": own})

    return mapped(keyed(docs), run, "doc_id long, th long, s1 long, s2 long, signatures array<long>", "text", 1_000_000)


def _alike(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, alike) of `pairs` (a, b): the share of all minima in which the two agree."""

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        return pd.Series((np.stack(x.to_list()).view(np.uint8) == np.stack(y.to_list()).view(np.uint8)).mean(axis=1))

    x, y = (classes.select(F.col("node").alias(c), F.col("signatures").alias(f"s_{c}")) for c in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", share("s_a", "s_b").alias("alike"))


BINS = 256


def _compared(rows: DataFrame, length: int, least: float, threshold: float) -> DataFrame:
    """From (at, i, j, own, node, root, times, signatures), sorted by (at, i, j): edges (a, b) that join groups; and on rows without
    them, by similarity in BINS parts, the number of pairs at the threshold or above that were met."""

    def solve(sig: np.ndarray, own: np.ndarray, node: np.ndarray, root: np.ndarray, times: int, i: int, j: int) -> Iterator[tuple]:
        left, right = (np.arange(len(node)),) * 2 if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
        flat = sig.view(np.uint8).reshape(len(node), -1)
        front = sig >> np.uint64(8 * (DEPTH - length))
        ends, met = [], np.zeros(BINS + 1)
        for a in left.tolist():  # one row against the others of a block
            other = right[(root[right] != root[a]) & ((right > a) | (i != j))]
            alike = (flat[other] == flat[a]).mean(axis=1) if len(other) else np.empty(0)
            near = alike >= least
            if near.any():
                other, alike = other[near], alike[near]
                ends += [(a, b) for b in other.tolist()]
                # a pair is seen under each node that it shares: in all it counts once, and not where it shares none
                shares = (front[other] == front[a]).sum(axis=1)
                np.add.at(met, (alike * BINS).astype(np.int64), times / np.maximum(shares, 1) if times else np.minimum(shares, 1))
        if ends:
            pairs = np.array(ends)
            yield from ((int(node[k]), int(node[t]), None, None) for k, t in enumerate(_forest(len(node), pairs[:, 0], pairs[:, 1])) if t != k)
            yield from ((None, None, k, float(met[k])) for k in np.flatnonzero(met).tolist() if k >= threshold * BINS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        key, out = None, []

        def flush() -> list[tuple]:
            if len(held) < 2:
                return []
            own, node, root, times, sig = zip(*held, strict=True)
            return list(solve(np.stack(sig).view(np.uint64), np.array(own), np.array(node), np.array(root), times[0], key[1], key[2]))

        def frame() -> pd.DataFrame:
            a, b, part, met = zip(*out, strict=True)
            return pd.DataFrame({"a": pd.array(a, dtype="Int64"), "b": pd.array(b, dtype="Int64"), "bin": pd.array(part, dtype="Int32"), "met": met})

        for pdf in frames:
            for at, i, j, *rest in zip(pdf["at"], pdf["i"], pdf["j"], pdf["own"], pdf["node"], pdf["root"], pdf["times"], pdf["signatures"], strict=True):
                if (at, i, j) != key:
                    out += flush()
                    held, key = [], (at, i, j)
                held.append(tuple(rest))
            if out:
                yield frame()
                out = []
        if out := flush():
            yield frame()

    return mapped(rows, run, "a long, b long, bin int, met double")


def _units(some: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """(at, times, m, node, root): what is compared with what, in m blocks each: the rows under each node; or, where nodes of more than a
    block overlap so much that the rows of all of them together make fewer pairs, these rows at once, as a unit of its own with `times` 0."""
    plain = some.join(nodes, "at").select("at", "times", F.ceil(F.col("c") / block).cast("int").alias("m"), "node", "root", "c")
    wide = nodes.filter(F.col("c") > block)
    if not wide.limit(1).count():
        return plain.drop("c")
    held = staged(some.join(wide.select("at", "c"), "at"), "wide")
    hub = held.groupBy("at").agg(F.min("node").alias("hub"))
    linked = components(held.join(hub, "at").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    of = staged(held.join(linked.withColumnRenamed("root", "unit"), "node"), "units")
    pairs = of.select("unit", "at", "c").distinct().groupBy("unit").agg(F.sum(F.col("c") * F.col("c")).alias("by_node"))
    size = of.groupBy("unit").agg(F.count_distinct("node").alias("n"))
    whole = staged(size.join(pairs, "unit").filter(F.col("n") * F.col("n") < F.col("by_node")).select("unit", F.ceil(F.col("n") / block).cast("int").alias("m")), "whole")
    gone = of.join(whole, "unit", "left_semi").select("at").distinct()
    once = of.join(whole, "unit").groupBy("unit", "m", "node").agg(F.min("root").alias("root"))
    return plain.join(gone, "at", "left_anti").drop("c").unionByName(once.select(F.xxhash64("unit", F.lit("unit")).alias("at"), F.lit(0).alias("times"), "m", "node", "root"))


def _grouped(classes: DataFrame, threshold: float, trees: int, recall: float, margin: float, block: int) -> DataFrame:
    """(node, root) of the classes that have company, by the forest: see above. `classes` has node and signatures."""
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = spark.createDataFrame([], "node long, root long")
    edges = spark.createDataFrame([], "a long, b long")
    at_bin = (np.arange(BINS + 1) + 0.5) / BINS
    met = np.zeros(BINS + 1)
    met[int(threshold * BINS)] = 1.0  # one pair at the threshold is always reckoned with

    def note(counts: DataFrame) -> None:
        for r in counts.collect():  # at most BINS rows
            met[r["bin"]] += r["met"]

    def under(length: int) -> DataFrame:
        named = classes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # a node of a trie: the tree's number and the first `length` bytes
        return named.select("node", "root", F.explode(F.transform("signatures", lambda s, t: F.xxhash64(t, F.shiftrightunsigned(s, 8 * (DEPTH - length))))).alias("at"))

    def mixed(rows: DataFrame) -> DataFrame:
        """The nodes with rows of several groups."""
        return rows.groupBy("at").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")

    def joined(got: DataFrame) -> tuple[DataFrame, DataFrame]:
        if not got.limit(1).count():
            return edges, groups
        new = edges.union(got.select("a", "b"))
        return new, staged(components(new), "groups")

    # tight groups first, by the least member of each node: one pair a row
    rows = under(DEPTH)
    pairs = rows.join(mixed(rows), "at").filter("node != low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    got = staged(_alike(classes, pairs).filter(F.col("alike") >= threshold - margin), "met")
    edges, groups = joined(got)
    note(got.filter(F.col("alike") >= threshold).groupBy(F.floor(F.col("alike") * BINS).cast("int").alias("bin")).agg(F.count("*").alias("met")))
    length = DEPTH
    while True:
        reach = {d: met.sum() / (met / meets(at_bin.clip(threshold, 1.0), d, trees)).sum() for d in range(1, length + 1)}
        if length < DEPTH and (length == 1 or reach[length] >= recall):
            return groups
        length = max((d for d in range(1, length) if reach[d] >= recall), default=1)
        rows = under(length)
        some = rows.join(mixed(rows).select("at"), "at")
        some = staged(some, "under")
        # nodes of one length with the same members show the same pairs: one of them is enough
        nodes = some.groupBy("at").agg(F.count("*").alias("c"), F.min("node").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
        nodes = staged(nodes.groupBy("c", "n", "who").agg(F.min("at").alias("at"), F.count("*").cast("int").alias("times")).select("at", "times", "c"), "nodes")
        units = _units(some, nodes, block)
        rows = units.withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        rows = rows.select("at", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "node", "root", "times").join(classes, "node")
        got = staged(_compared(rows.repartition(parts, "at", "i", "j").sortWithinPartitions("at", "i", "j"), length, threshold - margin, threshold), "met")
        edges, groups = joined(got.filter("a IS NOT NULL"))
        note(got.filter("bin IS NOT NULL").groupBy("bin").agg(F.sum("met").alias("met")))


GRAMS = 300_000


def _links(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with a Jaccard similarity of at least `threshold`, exactly; within sets_a (i < j) if sets_b is None.

    Intersections are counted by ranges of gram hashes with about `GRAMS` grams each, so that long texts don't take more memory."""
    all_sets, na = sets_a + (sets_b or []), len(sets_a)
    size = np.array([len(s) for s in all_sets])
    both = np.zeros((na, len(all_sets) - na if sets_b is not None else na), dtype=np.float32)
    parts = int(size.sum()) // GRAMS + 1
    bounds = [np.uint64((1 << 64) * k // parts) for k in range(1, parts)]
    cuts = np.array([[0, *np.searchsorted(s, bounds).tolist(), len(s)] for s in all_sets])
    for k in range(parts):
        _count([s[a:b] for s, a, b in zip(all_sets, cuts[:, k], cuts[:, k + 1], strict=True)], na, sets_b is None, both)
    other = size[na:] if sets_b is not None else size[:na]
    # counts are whole numbers below 2 ** 24: exact
    shared_n = both.astype(np.int64)
    hit = shared_n >= threshold * (size[:na, None] + other[None, :] - shared_n) - 1e-9
    if sets_b is None:
        hit = np.triu(hit, 1)
    return np.nonzero(hit)


def _count(all_sets: list[np.ndarray], na: int, alone: bool, both: np.ndarray, width: int = 2048) -> None:
    """Adds the sizes of the intersections of the first `na` sets with each other, or with the rest, to `both`."""
    flat, owner = np.concatenate(all_sets), np.repeat(np.arange(len(all_sets), dtype=np.int32), [len(s) for s in all_sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, dtype=bool)
    start = np.flatnonzero(new)
    shared = np.diff(np.append(start, len(flat))) > 1
    keep = np.repeat(shared, np.diff(np.append(start, len(flat))))
    owner = owner[keep]
    column = np.cumsum(new[keep]) - 1
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(all_sets), width), dtype=np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        both += m[:na] @ (m[:na] if alone else m[na:]).T


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """The least member of each one's component."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = top(a), top(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
    return [top(x) for x in range(n)]


def _verify(rows: DataFrame, threshold: float) -> DataFrame:
    """From (root, i, j, own, node, copies, grams), sorted by (root, i, j): for each node its links, and an edge to its component's least."""

    def solve(group: list[tuple], i: int, j: int) -> list[tuple]:
        group = sorted({r[1]: r for r in group}.values(), key=lambda r: r[1])  # repeated rows bring a text twice
        if i == j:
            a, b = group, None
            x, y = _links([r[3] for r in a], None, threshold) if len(a) > 1 else (np.empty(0, int), np.empty(0, int))
            every, yy = a, y
        else:
            a, b = [r for r in group if r[0] == i], [r for r in group if r[0] == j]
            x, y = _links([r[3] for r in a], [r[3] for r in b], threshold) if a and b else (np.empty(0, int), np.empty(0, int))
            every, yy = a + b, y + len(a)
        copies = np.array([r[2] for r in every], dtype=np.int64)
        links = np.bincount(x, copies[yy], len(every)) + np.bincount(yy, copies[x], len(every)) if len(x) else np.zeros(len(every))
        order = sorted(range(len(every)), key=lambda k: every[k][1])
        place = np.empty(len(every), dtype=np.int64)
        place[order] = np.arange(len(every))
        tops = _forest(len(every), place[x], place[yy])
        return [(every[k][1], int(links[k]), every[order[tops[place[k]]]][1]) for k in range(len(every)) if links[k]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        key, out = None, []
        for pdf in frames:
            for root, i, j, own, node, copies, grams in zip(pdf["root"], pdf["i"], pdf["j"], pdf["own"], pdf["node"], pdf["copies"], pdf["grams"], strict=True):
                if (root, i, j) != key:
                    if len(held) > 1:
                        out += solve(held, key[1], key[2])
                    held, key = [], (root, i, j)
                held.append((own, node, copies, np.frombuffer(grams, dtype=np.uint64)))
            if out:
                yield pd.DataFrame(out, columns=["node", "links", "to"])
                out = []
        if len(held) > 1 and (out := solve(held, key[1], key[2])):
            yield pd.DataFrame(out, columns=["node", "links", "to"])

    return mapped(rows, run, "node long, links long, to long")


def _named(docs: DataFrame, threshold: float = 0.8, n: int = 5, trees: int = 32, recall: float = 0.99999, margin: float = 0.14, block: int = 128) -> tuple[DataFrame, DataFrame]:
    """The rows with their sets' digests, and for each class its row key, copies, links and the root of its group."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = staged(_sign(docs, n, trees), "signatures")
    # s1, 64 bits of the set's digest, names a class from here on
    classes = signed.filter("s1 IS NOT NULL").groupBy("s1", "s2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("one"), F.count("*").alias("copies"), F.any_value("signatures").alias("signatures"))
    classes = staged(classes, "classes")
    groups = _grouped(classes.select(F.col("s1").alias("node"), "signatures"), threshold, trees, recall, margin, block)

    count = groups.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("m"))
    member = groups.join(count, "root").join(classes.select(F.col("s1").alias("node"), "copies", "one"), "node")
    member = member.select("node", "root", "m", "copies", F.col("one.doc_id").alias("doc_id"), F.col("one.th").alias("th"))

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams(n)
        for pdf in frames:
            yield pdf.drop(columns="text").assign(grams=[grams.grams(t).tobytes() for t in pdf["text"]])

    own = keyed(docs)
    with_sets = mapped(member.join(own, same_row(member, own)).select("node", "root", "m", "copies", "text"), sets, "node long, root long, m int, copies long, grams binary", "text")
    pairs = with_sets.withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    pairs = pairs.select("root", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "node", "copies", "grams")
    pairs = pairs.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    verified = staged(_verify(pairs, threshold), "links")

    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(verified.filter("node != to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    names = classes.select(F.col("s1").alias("node"), "s2", "one", F.col("one.doc_id").alias("text_class"), "copies").join(links, "node", "left").join(linked, "node", "left")
    return signed, staged(names.withColumn("root", F.coalesce("root", "node")), "names")


def survivors(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, th, alone) of the rows that stay, one key for each group of linked rows: the least doc_id, null ones last, and of
    its texts that with the least hash. Rows without words are linked to nothing: all their keys stay, with `alone` true."""
    signed, names = _named(docs, **params)
    one = names.groupBy("root").agg(F.min("one").alias("one")).select("one.doc_id", "one.th", F.lit(False).alias("alone"))
    return one.union(signed.filter("s1 IS NULL").select("doc_id", "th", F.lit(True).alias("alone")).distinct())


def join(docs: DataFrame, **params) -> DataFrame:
    """doc_id, text_class, class_id, n_links of each row of `docs` (doc_id, text), with the parameters of _named(): see above."""
    signed, names = _named(docs, **params)
    least = names.groupBy("root").agg(F.min("text_class").alias("class_id"))
    names = names.join(least, "root").select("node", F.col("s2").alias("t2"), "text_class", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = signed.select("doc_id", "s1", "s2").join(names, (F.col("s1") == F.col("node")) & (F.col("s2") == F.col("t2")), "left")
    alone = F.col("node").isNull()
    return rows.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("text_class")).alias("text_class"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
