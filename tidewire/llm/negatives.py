"""Hard-negative mining: exact top-k by inner product through one-dimensional distance keys.

Components are whole numbers, floor(scale * x). A vector x gets one more component, sqrt(M^2 - |x|^2) with M the greatest
length; an anchor a gets a 0: then |a - x|^2 = |a|^2 + M^2 - 2 a.x, and a higher inner product is a lesser distance. Each
vector is stored under its nearest pivot, sorted by (pivot, distance to the pivot), in blocks of neighbours in that
order; a directory holds each block's pivot, least and greatest distance. By the triangle inequality the vectors of a
block are no nearer to an anchor than its own distance to the pivot is outside the block's interval of distances. A
search goes in rounds: every anchor has a radius, and scans those blocks within it that it hasn't scanned, by a matrix
product. Once the k-th best found is within the radius, nothing better is left and the anchor is done; else the radius
grows to the k-th best, or to three times the rows scanned where fewer than k are found.

First come the positives, the best of the anchor's label; then, for each positive's score, the best of other labels
within an interval of scores: the rings of distances that can hold it are scanned.

Equal vectors of one label are reduced to as many least ids as a list can hold: no other copy of them can be in one.
Anchors with equal vector and label are searched for once.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part. Rows alike in id,
label and components are one row, and "other" rows are all but the anchor's own. A null id comes last. Shorter vectors are
filled up with zeros, an empty one is all zeros. Components beyond 31 bits and lengths from 2**26 are an error, as sums
would not be exact. An anchor without positives, and a positive without negatives, have no rows. Extra columns are ignored.
Scale: pivots come from at most `sample` vectors; the directory has at most about `blocks` entries of 36 bytes, and is broadcast
with the pivots; beyond that the blocks grow. A round shuffles the blocks once, and each anchor once for each block that it
scans, in packs; tasks return each anchor's best. A task holds a block and a pack. How many blocks are passed over depends on the data:
where all distances are alike, as with few rows in many dimensions, work is anchors times rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import staged

NO_ID = (1 << 63) - 1  # a null id, inside
PACK = 512  # anchors that go to a block together
FIRST = 4096  # rows that an anchor scans at first

ROW = "id long, label long, v array<int>"
BLOCK = "block long, pivot int, lo double, hi double, n long, labels binary, ids binary, vectors binary"
BEST = "array<struct<t:long,score:long,id:long,copy:boolean>>"
STATE = f"q long, label long, v array<int>, tasks array<struct<t:long,lo:long,hi:long>>, done double, upto double, ready boolean, best {BEST}"
VISIT = "block long, qs binary, q_labels binary, q_vectors binary, owners binary, wanted binary"
HIT = "q long, t long, score long, id long, copy boolean"


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def quantised(rows: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v array<int>) of the rows that take part."""
    number = lambda e: e.cast("double")
    whole = F.forall(vector_col, lambda e: e.isNotNull() & ~F.isnan(number(e)) & (F.abs(number(e)) < float("inf")))
    large = F.raise_error(F.lit("a component is beyond 31 bits")).cast("int")
    v = F.transform(vector_col, lambda e: F.when(F.abs(number(e) * scale) < (1 << 31) - 1, F.floor(number(e) * scale).cast("int")).otherwise(large))
    part = rows.filter(F.col(label_col).isNotNull() & F.coalesce(whole, F.lit(False)))
    return part.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))


def _padded(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of numbers as rows of `dim` doubles, filled up with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), dim))
    out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def reduced(rows: DataFrame, k: int) -> DataFrame:
    """(id, label, v) with at most `k` rows, those of the least ids, for a label and vector."""
    schema = _arrow(ROW)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[tuple, set[int]] = {}
            for i, label, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault((label, tuple(v)), set()).add(i)
            out = [(i, label, v) for (label, v), own in by.items() for i in sorted(own)[:k]]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], f.type) for n, f in enumerate(schema)], schema=schema)

    few = rows.select("id", "label", "v").mapInArrow(least, ROW)
    for salt in (F.pmod(F.xxhash64("id"), F.lit(64)), F.lit(0)):  # copies of a vector meet in 64 parts first
        nth = F.dense_rank().over(Window.partitionBy("label", "v", salt).orderBy("id"))
        few = few.withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth")
    return few.dropDuplicates(["id", "label", "v"])


def _distances(x: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of rows x, with `last` as one more component, to the pivots."""
    d = (x**2).sum(axis=1)[:, None] + (last**2)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * (x @ pivots[:, :-1].T + np.outer(last, pivots[:, -1]))
    return np.sqrt(np.maximum(d, 0.0))


def _pivots(x: np.ndarray, k: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Centres of groups of the sample."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
        for p in np.unique(near):
            centres[p] = x[near == p].mean(axis=0)
    return centres


def _placed(found: DataFrame, sent: Broadcast, dim: int, far: float) -> DataFrame:
    """Each row with its nearest pivot and the distance to it."""
    out = f"pivot int, key double, {ROW}"
    schema = _arrow(out)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _padded(batch.column(2), dim)
            d = _distances(x, np.sqrt(np.maximum(0.0, far - (x**2).sum(axis=1))), sent.value)
            p = d.argmin(axis=1) if len(d) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p]), *batch.columns], schema=schema)

    return found.select("id", "label", "v").mapInArrow(place, out)


def _packed(ordered: DataFrame, dim: int, rows: int) -> DataFrame:
    """Blocks of up to `rows` rows of one pivot, from rows (part, pivot, key, id, label, v) in order."""
    schema = _arrow(BLOCK)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, k = [], 0, 0

        def block() -> pa.RecordBatch:
            nonlocal held, size, k
            t = pa.Table.from_batches(held).combine_chunks()
            held, size, k = [], 0, k + 1
            key, x = t["key"].to_numpy(), _padded(t["v"].chunk(0), dim).astype("<i4")
            row = (t["part"][0].as_py() << 32 | k, t["pivot"][0].as_py(), key[0], key[-1], len(key), t["label"].to_numpy().astype("<i8").tobytes(), t["id"].to_numpy().astype("<i8").tobytes(), x.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            p = batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
            for a, b in zip(edges, edges[1:], strict=False):
                while a < b:
                    if held and held[-1].column(1)[0].as_py() != p[a]:
                        yield block()
                    c = min(b, a + rows - size)
                    held.append(batch.slice(a, c - a))
                    size, a = size + c - a, c
                    if size == rows:
                        yield block()
        if held:
            yield block()

    return ordered.select("part", "pivot", "key", "id", "label", "v").mapInArrow(pack, BLOCK)


class Index:
    """Vectors (id, label, v) in blocks by pivot and distance, and the directory that chooses among the blocks."""

    def __init__(self, found: DataFrame, pivots: int = 32, sample: int = 10_000, block: int = 1024, blocks: int = 65_536, seed: int = 1):
        spark = found.sparkSession
        found = staged(found, "vectors")
        square = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
        n, dim, far = found.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
        self.dim, self.far = max(1, dim or 1), float(far or 0.0)
        if self.far >= 1 << 52:
            raise ValueError("vectors of a length of 2**26 or more: their sums would not be exact")
        chosen = found.orderBy(F.xxhash64("id", F.lit(seed)), "id", "label").limit(sample).select("v").collect()
        x = np.zeros((len(chosen), self.dim + 1))
        for i, r in enumerate(chosen):
            x[i, : len(r["v"])] = r["v"]
        x[:, -1] = np.sqrt(np.maximum(0.0, self.far - (x**2).sum(axis=1)))
        self.pivots = spark.sparkContext.broadcast(_pivots(x, pivots, seed))
        placed = staged(_placed(found, self.pivots, self.dim, self.far), "keys")  # ranges are sampled from what is there
        order = ["pivot", "key", "id"]
        dealt = placed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
        dealt = dealt.withColumn("part", F.spark_partition_id().cast("long"))
        self.blocks = staged(_packed(dealt, self.dim, max(block, -(-n // blocks))), "annuli")
        got = self.blocks.select("block", "pivot", "lo", "hi", "n").toPandas()  # a row a block
        self.directory = spark.sparkContext.broadcast(tuple(got[c].to_numpy() for c in got.columns))

    def search(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """(q, t, score, id, copy): for each task t of `asked` (q, label, v, tasks of (t, lo, hi)) the `k` best rows with a score from lo to hi
        and the same label, or without `same` another one; ties by id. copy tells a row with the asker's own vector."""
        n = asked.count()
        state = asked.select("q", "label", "v", "tasks", F.lit(-1.0).alias("done"), F.lit(-1.0).alias("upto"), F.lit(False).alias("ready"), F.array().cast(BEST).alias("best"))
        out = None
        while True:
            state = staged(_status(state, self, k), "askers")
            own = state.select("q", F.explode("best").alias("b")).select("q", "b.*")
            ready = own.join(state.filter("ready").select(F.col("q").alias("_q")), F.col("q") == F.col("_q"), "left_semi")
            out = ready if out is None else out.unionByName(ready)
            state = state.filter("NOT ready")
            if state.isEmpty():
                return out
            hits = _scanned(self.blocks, _visits(state.repartition(-(-n // PACK) or 1, "q"), self), self.dim, k, same)
            both = hits.unionByName(own).withColumn("nth", F.row_number().over(Window.partitionBy("q", "t").orderBy(F.desc("score"), "id")))
            best = both.filter(F.col("nth") <= k).groupBy(F.col("q").alias("_q")).agg(F.collect_list(F.struct("t", "score", "id", "copy")).alias("found"))
            state = state.join(best, F.col("q") == F.col("_q"), "left")
            state = state.select("q", "label", "v", "tasks", F.col("upto").alias("done"), "upto", "ready", F.coalesce("found", F.array().cast(BEST)).alias("best"))


def _bounds(x: np.ndarray, pivots: np.ndarray, directory: tuple, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For askers x: least and greatest distance of each block's rows (with room for rounding), and |a|^2 + M^2."""
    _, pivot, lo, hi, _ = directory
    d = _distances(x, np.zeros(len(x)), pivots)[:, pivot]
    total = (x**2).sum(axis=1) + far
    room = 1e-5 * np.sqrt(total + 1)[:, None]
    return np.maximum(0.0, np.maximum(lo - d, d - hi) - room), d + hi + room, total


def _status(state: DataFrame, index: Index, k: int) -> DataFrame:
    """Each asker with its next radius, or ready if no block can better its results."""
    pivots, directory, dim, far = index.pivots, index.directory, index.dim, index.far
    schema = _arrow(STATE)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):  # askers times blocks numbers
                batch = whole.slice(at, 64)
                least, most, total = _bounds(_padded(batch.column(2), dim), pivots.value, directory.value, far)
                upto, ready = [], []
                for i, (tasks, done, best) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(7).to_pylist(), strict=True)):
                    scores: dict[int, list[int]] = {}
                    for b in best:
                        scores.setdefault(b["t"], []).append(b["score"])
                    far_of = lambda s: float(np.sqrt(max(0.0, total[i] - 2.0 * s)))  # noqa: B023, E731
                    need = [far_of(min(scores[x["t"]])) if len(scores.get(x["t"], ())) == k else far_of(x["lo"]) for x in tasks]
                    short = any(len(scores.get(x["t"], ())) < k for x in tasks)
                    ring = (most[i] >= min((far_of(x["hi"]) for x in tasks), default=0.0)) & (least[i] <= max(need, default=-1.0))
                    left = np.flatnonzero(ring & (least[i] > done))
                    left = left[np.argsort(least[i][left], kind="stable")]
                    if len(left):  # the rows to scan next: all that can matter, or while results lack a few times those scanned
                        rows = np.cumsum(directory.value[4][left])
                        more = max(FIRST, 3 * int(directory.value[4][ring & (least[i] <= done)].sum())) if short else rows[-1]
                        upto.append(float(least[i][left[min(len(left) - 1, int(np.searchsorted(rows, more)))]]))
                    else:
                        upto.append(done)
                    ready.append(not len(left))
                cols = [*batch.columns[:5], pa.array(upto, pa.float64()), pa.array(ready, pa.bool_()), batch.column(7)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return state.mapInArrow(over, STATE)


def _visits(state: DataFrame, index: Index) -> DataFrame:
    """For each pack of askers a row for each block that some of them scan: their numbers, labels, vectors and tasks."""
    pivots, directory, dim, far = index.pivots, index.directory, index.dim, index.far
    schema = _arrow(VISIT)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PACK):
                batch = whole.slice(at, PACK)
                x = _padded(batch.column(2), dim)
                q, labels, done, upto = (batch.column(c).to_numpy() for c in (0, 1, 4, 5))
                wanted, owner, nearest = [], [], []
                for i, (tasks, best) in enumerate(zip(batch.column(3).to_pylist(), batch.column(7).to_pylist(), strict=True)):
                    for task in tasks:
                        wanted.append((task["t"], task["lo"], task["hi"]))
                        owner.append(i)
                    nearest.append(max((t["hi"] for t in tasks), default=0))
                wanted, owner = np.array(wanted, dtype=np.int64).reshape(-1, 3), np.array(owner, dtype=np.int64)
                for lo in range(0, len(directory.value[0]), 4096):
                    some = tuple(c[lo : lo + 4096] for c in directory.value)
                    least, most, total = _bounds(x, pivots.value, some, far)
                    hit = (least > done[:, None]) & (least <= upto[:, None]) & (most >= np.sqrt(np.maximum(0.0, total - 2.0 * np.array(nearest, dtype=np.float64)))[:, None])
                    for j in np.flatnonzero(hit.any(axis=0)):
                        own = np.flatnonzero(hit[:, j])
                        mine = np.isin(owner, own)
                        row = (int(some[0][j]), q[own].astype("<i8").tobytes(), labels[own].astype("<i8").tobytes(), x[own].astype("<i4").tobytes(), np.searchsorted(own, owner[mine]).astype("<i8").tobytes(), wanted[mine].astype("<i8").tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, schema, strict=True)], schema=schema)

    return state.mapInArrow(over, VISIT)


def _best(score: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the `k` best of each row where ok; ties by id."""
    value = np.where(ok, score, -np.inf)
    k = min(k, value.shape[1])
    bound = -np.partition(-value, k - 1, axis=1)[:, k - 1]
    r, c = np.nonzero(ok & (value >= bound[:, None]))
    order = np.lexsort((ids[c], -value[r, c], r))
    r, c = r[order], c[order]
    top = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[top], c[top]


def _scanned(blocks: DataFrame, visits: DataFrame, dim: int, k: int, same: bool) -> DataFrame:
    """The `k` best of each task among the blocks that a Spark task scans: a block, then its visits."""
    names = [x.split(" ")[0] for x in VISIT.split(", ")[1:]]
    kept = ["labels", "ids", "vectors"]
    none = lambda cs: [F.lit(None).cast("binary").alias(c) for c in cs]
    visits = staged(visits, "visits")
    there = blocks.join(visits.select(F.col("block").alias("_b")).distinct(), F.col("block") == F.col("_b"), "left_semi")
    rows = there.select("block", F.lit(0).alias("side"), *kept, *none(names)).unionByName(visits.select("block", F.lit(1).alias("side"), *none(kept), *names))
    rows = rows.repartition("block").sortWithinPartitions("block", "side")
    schema = _arrow(HIT)
    read = lambda b, kind, width=None: np.frombuffer(b, dtype=kind) if width is None else np.frombuffer(b, dtype=kind).reshape(-1, width)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = ids = x = square = None
        held, size = [], 0

        def merged(parts: list[np.ndarray]) -> np.ndarray:
            """The k best rows of each (q, t) of (q, t, score, id, copy)."""
            a = np.concatenate(parts)
            a = a[np.lexsort((a[:, 3], -a[:, 2], a[:, 1], a[:, 0]))]
            new = np.flatnonzero(np.r_[True, (a[1:, :2] != a[:-1, :2]).any(axis=1)])
            return a[np.arange(len(a)) - new[np.searchsorted(new, np.arange(len(a)), side="right") - 1] < k]

        def out(a: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(a[:, c]) for c in range(4)), pa.array(a[:, 4] == 1)], schema=schema)

        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # rows are large
                if row["side"] == 0:
                    labels, ids = read(row["labels"], "<i8"), read(row["ids"], "<i8")
                    x = read(row["vectors"], "<i4", dim).astype(np.float64)
                    square = (x**2).sum(axis=1)
                    continue
                q, own = read(row["qs"], "<i8"), read(row["q_labels"], "<i8")
                a = read(row["q_vectors"], "<i4", dim).astype(np.float64)
                owner, wanted = read(row["owners"], "<i8"), read(row["wanted"], "<i8", 3)
                score = a @ x.T
                ok = (own[:, None] == labels[None, :]) == same
                twin = (a**2).sum(axis=1)[:, None] + square[None, :] == 2 * score
                for lo in range(0, len(owner), 256):
                    o, w = owner[lo : lo + 256], wanted[lo : lo + 256]
                    s = score[o]
                    r, c = _best(s, ok[o] & (s >= w[:, 1:2]) & (s <= w[:, 2:3]), ids, k)
                    held.append(np.stack([q[o][r], w[r, 0], s[r, c].astype(np.int64), ids[c], twin[o[r], c].astype(np.int64)], axis=1))
                    size += len(r)
                if size > 500_000:
                    held = [merged(held)]
                    size = len(held[0])
                    if size > 250_000:
                        yield out(held[0])
                        held, size = [], 0
        if held:
            yield out(merged(held))

    return rows.mapInArrow(scan, HIT)


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, **index) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors, rows (id, label, v) with an id divisible by
    `every`: of each of the `positives` best others of the label the `negatives` best rows of other labels with scores of `low` to
    `high` hundredths of the positive's."""
    rows = staged(rows.select("id", "label", "v"), "rows")
    found = Index(reduced(rows, positives + 1), **index)
    anchors = rows.filter((F.col("id") != NO_ID) & (F.col("id") % every == 0)).distinct()
    askers = staged(anchors.select("label", "v").distinct().withColumn("q", F.monotonically_increasing_id()), "anchors")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("t"), F.lit(-(1 << 53)).cast("long").alias("lo"), F.lit(1 << 53).cast("long").alias("hi")))
    first = staged(found.search(askers.withColumn("tasks", whole), positives + 1, True), "positives")
    of = anchors.join(askers.select(F.col("label").alias("_l"), F.col("v").alias("_v"), "q"), (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v"))).select(F.col("id").alias("anchor_id"), "q")
    near = of.join(first.select(F.col("q").alias("_q"), "id", "score", "copy"), F.col("q") == F.col("_q")).filter(~(F.col("copy") & (F.col("id") == F.col("anchor_id"))))
    nth = F.row_number().over(Window.partitionBy("anchor_id", "q").orderBy(F.desc("score"), "id"))
    near = near.withColumn("n", nth).filter(F.col("n") <= positives).select("anchor_id", "q", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = staged(near, "pairs")
    s = F.col("positive_score")
    task = F.struct(s.alias("t"), F.expr(f"(positive_score * {low} + 99) div 100").alias("lo"), F.expr(f"positive_score * {high} div 100").alias("hi"))
    tasks = near.filter(s >= 0).select("q", task.alias("task")).distinct().groupBy(F.col("q").alias("_q")).agg(F.collect_list("task").alias("tasks"))
    hard = found.search(askers.join(tasks, F.col("q") == F.col("_q")), negatives, False)
    hard = hard.select(F.col("q").alias("_q"), F.col("t").alias("_t"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = near.join(hard, (F.col("q") == F.col("_q")) & (F.col("positive_score") == F.col("_t")))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "q", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")
