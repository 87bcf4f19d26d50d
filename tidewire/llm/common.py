"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_WHOLE = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new one in local mode, where all is one
    machine (tests), else an error: files in a folder of one machine are lost to the others."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tidewire-")
        spark.conf.set("spark.checkpoint.dir", known)
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ids(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """The id column as long. An id that is no whole number is an error: a cast would make it null."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers, not {docs.schema[id_col].dataType.simpleString()}")
    return docs[id_col].cast("long")


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string)."""
    return docs.select(ids(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string, th long): th tells rows apart that repeat a doc_id with another text."""
    return plain(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Null-safe equality of the key of keyed()."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have: `name`, or `name` and a number."""
    known = {c.lower() for c in df.columns}
    return next(n for n in (f"{name}{k or ''}" for k in count()) if n.lower() not in known)


def with_found(docs: DataFrame, found: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """All rows and columns of `docs`, and `columns` of `found` (doc_id, th, ...) by the key of keyed(), under names that `docs` hasn't."""
    names = []
    for c in ("th", "of", *columns):
        names.append(fresh(docs, f"_{c}"))
    th, of, *rest = names
    rows = docs.withColumn(th, F.xxhash64(F.col("text").cast("string")))
    other = fresh(rows, "_th_of")
    found = found.select(F.col("doc_id").alias(of), F.col("th").alias(other), *(F.col(c).alias(n) for c, n in zip(columns, rest, strict=True)))
    rows = rows.join(found, ids(rows).eqNullSafe(found[of]) & (rows[th] == found[other]), "left")
    return rows.select(*docs.columns, *rest), rest


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of `column` each, or one longer row: memory doesn't follow the row count."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    edge = [0, *(np.flatnonzero(np.diff(total // size)) + 1).tolist(), len(total)]
    for a, b in zip(edge, edge[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _give_back() -> None:
    """Freed memory goes back to the system at the end of a task: idle Python workers live on beside those of the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of `rows` rows, unless the session has its own setting: the default of 10,000 takes tens of
    megabytes of each task's memory on either side."""
    if spark.conf.get(ARROW_ROWS, None) is None:
        spark.conf.set(ARROW_ROWS, rows)


def mapped(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, column: str | None = None, size: int = 4_000_000) -> DataFrame:
    """As df.mapInPandas(run, schema), but whole numbers come as nullable integers, so that ids beyond 2 ** 53 stay exact beside nulls.

    With `column`, `run` gets slices of about `size` bytes of that column."""
    small_arrow_batches(df.sparkSession)
    kind = T.StructType.fromDDL(schema)
    names, arrow = kind.names, to_arrow_schema(kind)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frames() -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part in slices(batch, column, size) if column else [batch]:
                    if part.num_rows:
                        yield part.to_pandas(types_mapper=_WHOLE.get)

        try:
            for pdf in run(frames()):
                if len(pdf):
                    yield pa.RecordBatch.from_pandas(pdf[names], schema=arrow, preserve_index=False)
        finally:
            _give_back()

    return df.mapInArrow(over, kind)


def edited(rows: DataFrame, docs: DataFrame, edit: Callable[..., tuple[list[str | None], list[bool] | None]], columns: tuple[str, ...] = (), size: int = 4_000_000) -> DataFrame:
    """The columns of `docs` from `rows`, with edited texts; all other columns stay in Arrow as they are.

    edit(texts, *columns) gives the new texts and, unless all rows stay, which do. n_chars, if there, is counted anew
    where a text changed."""
    small_arrow_batches(docs.sparkSession)
    names, kind = docs.columns, docs.schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", size):
                old = part.column(part.schema.get_field_index("text")).to_pylist()
                new, stay = edit(old, *(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns))
                out = {n: part.column(part.schema.get_field_index(n)) for n in names}
                if any(a is not b for a, b in zip(old, new, strict=True)):
                    out["text"] = pa.array(new, arrow.field("text").type)
                    if "n_chars" in out:
                        had = out["n_chars"].to_pylist()
                        out["n_chars"] = pa.array([h if a is b else len(b) for h, a, b in zip(had, old, new, strict=True)], arrow.field("n_chars").type)
                done = pa.RecordBatch.from_arrays([c.cast(arrow.field(n).type) for n, c in out.items()], schema=arrow)
                yield done if stay is None else done.filter(pa.array(stay, pa.bool_()))
        _give_back()

    return rows.mapInArrow(run, kind)
