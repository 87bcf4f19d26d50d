"""Vector distances, nearest-neighbour search exact and by an index of cells, and comparisons within a time band.

Comparisons of many with many go by pairs of blocks: a time bucket is cut into blocks of about `block` rows by a hash, and each
pair of blocks of one bucket, or of neighbouring ones, is one group of rows, whose distances are a matrix product in an Arrow batch.
Each pair of rows is compared once; what leaves a group is its local best, or sums. A crowded bucket makes more groups, not a larger
one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def decode_vector(text: str | Column) -> Column:
    """Numbers of a vector written as "[1,2,3]"; an error for anything else, not-a-number and infinity included."""
    col = F.col(text) if isinstance(text, str) else text
    number = r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*"
    ok = col.rlike(rf"^\[({number}(,{number})*)?\]$")
    inner = F.regexp_replace(col, r"[\[\]\s]", "")
    cells = F.when(inner == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(inner, ","), lambda x: x.try_cast("double")))
    return F.when(col.isNull(), None).when(ok & F.forall(cells, lambda x: F.abs(x) < float("inf")), cells).otherwise(F.raise_error(F.concat(F.lit("not a vector: "), col)).cast("array<double>"))


def encode_vector(array: str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(array, lambda x: x.cast("string")), ","), F.lit("]"))


def search(items: DataFrame, query: list[float], limit: int = 20) -> DataFrame:
    """The `limit` (1 to 100) rows of `items` nearest to `query` by negative inner product, exactly; ties by id.

    One scan and a bounded top-k; no shuffle of the vectors."""
    limit = max(1, min(100, limit))
    if not query:
        return items.withColumn("distance", F.lit(None).cast("double")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    near = items.where("embedding IS NOT NULL").withColumn("distance", F.round(-dot("embedding", q), 6))
    return near.orderBy(F.asc("distance"), F.asc("id")).limit(limit)


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows of doubles; an error unless all are of one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = flat.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(f"vectors of {int(sizes.min())} and of {int(sizes.max())} numbers can't be compared")
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) and len(b) and a.shape[1] != b.shape[1]:
        raise ValueError(f"vectors of {a.shape[1]} and of {b.shape[1]} numbers can't be compared")
    return a @ b.T


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles of length 1."""
    x = _rows(column)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


Block = dict[str, np.ndarray]


def by_block_pairs(rows: DataFrame, hours: int, compare: Callable[[Block, Block | None, np.ndarray, np.ndarray], Iterator[dict]], schema: str, block: int = 1024) -> DataFrame:
    """What compare(a, b, distances, near) gives for each pair of blocks of `rows` (id, at in microseconds, embedding, and columns of numbers).

    b is null where a block meets itself. distances are cosine distances, rounded to 6 places; near tells which pairs are at most `hours` apart."""
    width, kind = hours * 3600 * 1_000_000, T.StructType.fromDDL(schema)
    own = rows.withColumn("_b", F.floor(F.col("at") / width))
    sizes = own.groupBy("_b").agg(F.ceil(F.count("*") / block).cast("int").alias("_m"))  # a row a bucket
    shifted = lambda k, name: sizes.select((F.col("_b") + k).alias("_b"), F.col("_m").alias(name))
    sizes = sizes.join(shifted(1, "_before"), "_b", "left").join(shifted(-1, "_after"), "_b", "left")
    b, i = F.col("_b"), F.col("_i")
    upto = lambda m: F.when(F.coalesce(F.col(m), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(m) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda b1, i1, b2, i2, side: F.struct(b1.alias("b1"), i1.alias("i1"), b2.alias("b2"), i2.alias("i2"), side.alias("side"))
    partners = F.concat(
        F.transform(upto("_m"), lambda j: pair(b, F.least(i, j), b, F.greatest(i, j), F.when(i <= j, 0).otherwise(1))),
        F.transform(upto("_after"), lambda j: pair(b, i, b + 1, j, F.lit(0))),
        F.transform(upto("_before"), lambda j: pair(b - 1, j, b, i, F.lit(1))),
    )
    own = own.join(sizes, "_b").withColumn("_i", F.pmod(F.xxhash64("id"), F.col("_m")).cast("int")).withColumn("_p", F.explode(partners))
    key = ["b1", "i1", "b2", "i2"]
    dealt = own.select("_p.*", *rows.columns).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key, "side")
    names, arrow = rows.columns, to_arrow_schema(kind)

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        side = t["side"].to_numpy()
        same = t["b1"][0].as_py() == t["b2"][0].as_py() and t["i1"][0].as_py() == t["i2"][0].as_py()
        x = _matrix(t["embedding"])
        cols = {c: t[c].to_numpy() for c in names if c != "embedding"}
        part = lambda at: {c: v[at] for c, v in cols.items()}
        left, right = (np.arange(len(side)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        if not len(left) or not len(right):
            return
        a, other = part(left), part(right)
        distances = np.round(1.0 - x[left] @ x[right].T, 6)
        near = np.abs(a["at"][:, None] - other["at"][None, :]) <= width
        for out in compare(a, None if same else other, distances, near):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                now = tuple(keys[lo])
                if held and now != last:
                    yield from solve(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = now
        if held:
            yield from solve(held)

    return dealt.mapInArrow(run, kind)


def nearest(rows: DataFrame, hours: int, k: int, most: float | None = None, block: int = 1024) -> DataFrame:
    """(id, kind, o_id, distance): for each row that asks, its `k` nearest of each kind within `hours`, and within `most` if given.

    `rows` has id, at (microseconds), embedding, asks (boolean), kind (int). Ties go to the lesser id."""

    def best(a: Block, b: Block, d: np.ndarray) -> Iterator[dict]:
        for kind in np.unique(b["kind"]).tolist():
            asks, there = np.flatnonzero(a["asks"]), np.flatnonzero(b["kind"] == kind)
            own = d[np.ix_(asks, there)]
            if not own.size:
                continue
            bound = np.partition(own, min(k, own.shape[1]) - 1, axis=1)[:, min(k, own.shape[1]) - 1]
            r, c = np.nonzero((own <= bound[:, None]) & np.isfinite(own))
            if not len(r):
                continue
            ids = b["id"][there][c]
            order = np.lexsort((ids, own[r, c], r))
            r, c, ids = r[order], c[order], ids[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            top = place < k
            yield {"id": a["id"][asks][r[top]], "kind": np.full(int(top.sum()), kind, dtype=np.int32), "o_id": ids[top], "distance": own[r[top], c[top]]}

    def compare(a: Block, b: Block | None, d: np.ndarray, near: np.ndarray) -> Iterator[dict]:
        use = near if most is None else near & (d <= most)
        other = a if b is None else b
        use = use & (a["id"][:, None] != other["id"][None, :])
        d = np.where(use, d, np.inf)
        yield from best(a, other, d)
        if b is not None:
            yield from best(b, a, d.T)

    local = by_block_pairs(rows, hours, compare, "id long, kind int, o_id long, distance double", block)
    rank = F.row_number().over(Window.partitionBy("id", "kind").orderBy("distance", "o_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k)


def timed(items: DataFrame, at: str = "published_at") -> Column:
    return F.unix_micros(F.col(at).cast("timestamp")).alias("at")


def neighbours(items: DataFrame, hours: int, k: int, block: int = 1024) -> DataFrame:
    """For each embedded item its `k` nearest others within `hours`: id, o_id, distance, rank, and their dates, events and sources."""
    have = items.where("embedding IS NOT NULL")
    near = nearest(have.select("id", timed(have), "embedding", F.lit(True).alias("asks"), F.lit(0).alias("kind")), hours, k, block=block)
    about = have.select("id", "published_at", "cluster_id", "source_id")
    other = about.select(*[F.col(c).alias(f"o_{c}") for c in about.columns])
    return near.drop("kind").join(about, "id").join(other, "o_id").select(*about.columns, *other.columns, "distance", "rank")


def search_all(items: DataFrame, queries: DataFrame, k: int = 20, block: int = 4096) -> DataFrame:
    """(q_id, id, distance, rank): for each of `queries` (q_id, vector) the `k` rows of `items` (id, embedding) nearest by negative inner
    product, exactly; ties by id.

    The queries are a stated set: they are broadcast in blocks of at most `block` vectors, and every block takes one scan of the items with a
    local top-k in each batch, so that only k rows a query and batch are shuffled."""
    queries = queries.where("vector IS NOT NULL")
    n = queries.count()
    parts = -(-n // block) or 1
    sc, out = items.sparkSession.sparkContext, []
    arrow = to_arrow_schema(T.StructType.fromDDL("q_id long, id long, distance double"))
    for p in range(parts):
        some = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("q_id"), F.lit(parts)) == p)
        got = some.select("q_id", "vector").collect()  # at most about `block` vectors
        if not got:
            continue
        sent = sc.broadcast((np.array([r["q_id"] for r in got], dtype=np.int64), _rows(pa.array([list(r["vector"]) for r in got], pa.list_(pa.float64())))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    part = batch.slice(lo, 2048)
                    ids = part.column(0).to_numpy()
                    d = np.round(-_product(q, _rows(part.column(1))), 6)
                    bound = np.partition(d, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                    r, c = np.nonzero(d <= bound[:, None])
                    order = np.lexsort((ids[c], d[r, c], r))
                    r, c = r[order], c[order]
                    top = np.arange(len(r)) - np.searchsorted(r, r) < k
                    r, c = r[top], c[top]
                    yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(ids[c]), pa.array(d[r, c])], schema=arrow)

        out.append(items.where("embedding IS NOT NULL").select("id", "embedding").mapInArrow(run, "q_id long, id long, distance double"))
    if not out:
        return items.sparkSession.createDataFrame([], "q_id long, id long, distance double, rank int")
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def fit_cells(items: DataFrame, cells: int = 64, sample: int = 10_000, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Centres of an index: k-means over at most `sample` vectors, chosen by a hash of their id."""
    got = items.where("embedding IS NOT NULL").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("embedding").collect()
    if not got:
        return np.empty((0, 0))
    x = _matrix(pa.array([list(r["embedding"]) for r in got], pa.list_(pa.float64())))
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: min(cells, len(x))]]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 0, total / np.maximum(length, 1e-300), centres)
    return centres


def with_cells(rows: DataFrame, vector: str, centres: np.ndarray, most: int, name: str) -> DataFrame:
    """`rows` with a vector, and the `most` nearest cells of each, the nearest first, as `name`."""
    rows = rows.where(F.col(vector).isNotNull())
    sent = rows.sparkSession.sparkContext.broadcast(centres)  # at most `cells` vectors

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = _product(_rows(pa.array([list(v) for v in vectors], pa.list_(pa.float64()))), sent.value)
        return pd.Series(list(np.argsort(-x, axis=1, kind="stable")[:, :most].astype(np.int32)))

    return rows.withColumn(name, cells(vector))


def indexed(items: DataFrame, centres: np.ndarray) -> DataFrame:
    """Every embedded row with the number of its cell, to be written partitioned by it."""
    return with_cells(items, "embedding", centres, 1, "_cells").withColumn("cell", F.explode("_cells")).drop("_cells")


AT_ONCE = 1 << 20  # distances of a part's rows and some of its askers: 8 MB of doubles


def in_cells(stored: DataFrame, asked: DataFrame, k: int, cosine: bool, hours: int | None = None, block: int = 65_536, groups: int = 8) -> DataFrame:
    """(q_id, id, distance, rank): the `k` rows of `stored` (id, at, embedding, cell) nearest to each of `asked` (q_id, at, vector, cells) among
    those of its cells, and with `hours` among those at most so many hours away; a row isn't compared with an asker of its own id then.

    The cells of a time bucket are dealt over `groups` groups. Rows are shuffled once by bucket, group and, where a group of a bucket holds more than
    `block` rows, by a hash in it; an asker once for each such part of its cells' groups, with the cells that it asks there. A part's rows are held, its
    askers stream by, and their local best are shuffled: rows times groups, never rows times cells or rows times rows.
    Vectors of floats are shuffled as they are and compared as doubles."""
    width = None if hours is None else hours * 3600 * 1_000_000
    bucket = F.lit(0).cast("long") if width is None else F.floor(F.col("at") / width)
    group = lambda cell: F.pmod(cell.cast("int"), F.lit(groups))
    stored = stored.where("embedding IS NOT NULL").select("id", "at", "embedding", F.array(F.col("cell").cast("int")).alias("cells"), group(F.col("cell")).alias("g"), bucket.alias("b"))
    sizes = stored.groupBy("b", "g").agg(F.ceil(F.count("*") / block).cast("int").alias("m"))
    near = F.array(bucket) if width is None else F.array(bucket - 1, bucket, bucket + 1)
    asks = asked.where("vector IS NOT NULL").select("q_id", "at", "vector", F.col("cells").cast("array<int>").alias("cells"), near.alias("bs"), F.explode(F.array_distinct(F.transform("cells", group))).alias("g"))
    asks = asks.select("q_id", "at", "vector", "g", F.filter("cells", lambda c: group(c) == F.col("g")).alias("cells"), F.explode("bs").alias("b"))
    asks = asks.join(sizes, ["b", "g"]).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    held = stored.join(sizes, ["b", "g"]).withColumn("p", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    floats = all(t == T.ArrayType(T.FloatType(), t.containsNull) for t in (stored.schema["embedding"].dataType, asked.schema["vector"].dataType))
    vector = lambda c: F.col(c).cast("array<float>" if floats else "array<double>").alias("v")
    rows = held.select("b", "g", "p", F.lit(0).alias("side"), "id", "at", vector("embedding"), "cells").unionByName(asks.select("b", "g", "p", F.lit(1).alias("side"), F.col("q_id").alias("id"), "at", vector("vector"), "cells"))
    key = ["b", "g", "p"]
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key, "side")
    out = "q_id long, id long, distance double"
    arrow = to_arrow_schema(T.StructType.fromDDL(out))

    def place(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Ids, times and vectors of a part's rows by cell, and each cell with its first row and the row after its last."""
        t = pa.Table.from_batches(parts)
        cell = t["cells"].combine_chunks().flatten().to_numpy()
        order = np.argsort(cell, kind="stable")
        known, first = np.unique(cell[order], return_index=True)
        return t["id"].to_numpy()[order], t["at"].to_numpy()[order], (_matrix if cosine else _rows)(t["v"])[order], list(zip(known.tolist(), first.tolist(), [*first[1:].tolist(), len(cell)], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, last = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                some, at = batch.slice(lo, hi - lo), tuple(keys[lo, :3])
                if keys[lo, 3] == 0:
                    if at != last:
                        parts = []
                    parts.append(some)
                    own, last = None, at
                    continue
                if at != last:
                    continue  # askers of a part without rows
                if own is None:
                    own, parts = place(parts), []
                ids, times, x, cells = own
                few = max(1, AT_ONCE // len(ids))
                for s in range(0, some.num_rows, few):
                    part = some.slice(s, few)
                    q, when, y = part.column(4).to_numpy(), part.column(5).to_numpy(), (_matrix if cosine else _rows)(part.column(6))
                    asking, wanted = np.repeat(np.arange(len(q)), part.column(7).value_lengths().to_numpy()), part.column(7).flatten().to_numpy()
                    d = np.full((len(q), len(ids)), np.inf)
                    for cell, first, end in cells:
                        r = asking[wanted == cell]
                        if len(r):
                            d[r, first:end] = np.round((1.0 if cosine else 0.0) - _product(y[r], x[first:end]), 6)
                    if width is not None:
                        d = np.where((np.abs(when[:, None] - times[None, :]) <= width) & (q[:, None] != ids[None, :]), d, np.inf)
                    kth = min(k, len(ids)) - 1
                    r, c = np.nonzero((d <= np.partition(d, kth, axis=1)[:, kth][:, None]) & np.isfinite(d))
                    order = np.lexsort((ids[c], d[r, c], r))
                    r, c = r[order], c[order]
                    top = np.arange(len(r)) - np.searchsorted(r, r) < k
                    yield pa.RecordBatch.from_arrays([pa.array(q[r[top]]), pa.array(ids[c[top]]), pa.array(d[r[top], c[top]])], schema=arrow)

    local = dealt.mapInArrow(run, out)
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k)


def probes_for(exact: DataFrame, stored: DataFrame, asked: DataFrame, cells: int, recall: float) -> int:
    """The number of nearest cells of an asker that hold this share of `exact` (q_id, id), measured on it. `asked` has all cells in order."""
    place = exact.join(stored.select("id", "cell"), "id").join(asked.select("q_id", "cells"), "q_id").select(F.array_position("cells", F.col("cell").cast("int")).alias("place"))
    by = place.groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()  # a row a cell at most
    total, seen = sum(r["n"] for r in by), 0
    for r in by:
        seen += r["n"]
        if seen >= recall * total:
            return int(r["place"])
    return max(1, cells)


class Index:
    """Vectors (id, embedding) in cells, each row indexed; how many cells a search takes is measured on bounded samples.

    `recall` is the aim over the sample of askers for tuning (at most `tuning` rows by a hash of the id, other ones than `apart` says):
    the searches' own recall is to be measured on other askers."""

    def __init__(self, items: DataFrame, path: str, k: int = 20, recall: float = 0.95, cells: int = 64, tuning: int = 256, apart: str = "true"):
        rows = items.where("embedding IS NOT NULL").select("id", "embedding")
        self.k, self.centres = k, fit_cells(rows, cells)
        indexed(rows, self.centres).write.partitionBy("cell").parquet(path)
        self.stored = rows.sparkSession.read.schema("id long, embedding array<double>, cell int").parquet(path).withColumn("at", F.lit(0).cast("long"))
        tried = rows.where(apart).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(tuning).select(F.col("id").alias("q_id"), F.col("embedding").alias("vector"))
        order = with_cells(tried, "vector", self.centres, max(1, len(self.centres)), "cells")
        self.probes = probes_for(search_all(rows, tried, k), self.stored, order, len(self.centres), recall)

    def search(self, queries: DataFrame, k: int | None = None, probes: int | None = None) -> DataFrame:
        """(q_id, id, distance, rank) as search_all(), from the nearest cells of each query."""
        if not len(self.centres):
            return queries.sparkSession.createDataFrame([], "q_id long, id long, distance double, rank int")
        asked = with_cells(queries.select("q_id", "vector"), "vector", self.centres, probes or self.probes, "cells").withColumn("at", F.lit(0).cast("long"))
        return in_cells(self.stored, asked, k or self.k, cosine=False)


def nearest_of(rows: DataFrame, some: DataFrame, hours: int, k: int) -> DataFrame:
    """(q_id, id): exactly the `k` nearest of `rows` within `hours` for each of `some` (id, at, embedding), a bounded number of them: one scan."""
    one = F.lit(0)
    held = some.select("id", "at", "embedding", one.alias("cell"))
    return in_cells(rows.select("id", "at", "embedding", one.alias("cell")), held.select(F.col("id").alias("q_id"), "at", F.col("embedding").alias("vector"), F.array("cell").alias("cells")), k, cosine=True, hours=hours, block=8192)


def neighbours_in_cells(items: DataFrame, hours: int, k: int, recall: float = 0.95, cells: int = 64, tuning: int = 256, apart: str = "true") -> DataFrame:
    """(q_id, id, distance, rank): as neighbours(), but each item is only compared with those within `hours` that lie in its nearest cells.

    How many cells that takes is measured exactly for at most `tuning` items (by a hash of the id, where `apart` holds); recall is below 1."""
    have = items.where("embedding IS NOT NULL")
    rows = have.select("id", timed(have), "embedding")
    centres = fit_cells(rows, cells)
    if not len(centres):
        return rows.sparkSession.createDataFrame([], "q_id long, id long, distance double, rank int")
    stored = indexed(rows, centres)
    tried = rows.where(apart).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(tuning)
    order = with_cells(tried, "embedding", centres, len(centres), "cells").select(F.col("id").alias("q_id"), "cells")
    probes = probes_for(nearest_of(rows, tried, hours, k), stored, order, len(centres), recall)
    asked = with_cells(rows, "embedding", centres, probes, "cells").select(F.col("id").alias("q_id"), "at", F.col("embedding").alias("vector"), "cells")
    return in_cells(stored, asked, k, cosine=True, hours=hours)
