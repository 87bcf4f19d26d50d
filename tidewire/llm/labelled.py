"""A bounded sample of labelled documents for training, and the fold rule of the labelled queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed


def held_out(doc_id: Column) -> Column:
    """True for the rows that no label is learned from: crc32 of the id as text, modulo 5, is 0. Null ids count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, chars: int = 12_000_000) -> list[tuple[str | None, int]]:
    """Up to `most` (text, label) rows outside the held-out fold, up to half of them of each label, with up to `chars` characters in all,
    in an order by a hash of doc_id.

    Rows are chosen by (doc_id, hash, length): those longer than a twentieth of `chars` are passed over, and so is what no longer fits; a
    label has half of `chars`, and what the other one leaves. Only the chosen rows' texts are read. Rows that repeat a doc_id and
    text count once. A label without any row gives none; one whose rows are all too long is an error.
    `most` and `chars` bound what comes to the driver whatever the size of the tables."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = keyed(docs)
    sizes = rows.select("doc_id", "th", F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(own, "doc_id").groupBy("doc_id", "th", "y").agg(F.max("n").alias("n"))
    rank = [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id"), F.col("th")]
    found = []
    for y in (0, 1):  # numbers only: at most `most` rows
        some = [tuple(r) for r in sizes.filter((F.col("y") == y) & (F.col("n") <= chars // 20)).orderBy(*rank).limit(most // 2).select("doc_id", "th", "n").collect()]
        if not some and not sizes.filter(F.col("y") == y).isEmpty():
            raise ValueError(f"all rows with {label} = {y} are longer than {chars // 20} characters")
        found.append(some)
    total = [sum(n for *_, n in some) for some in found]
    chosen = []
    for y, some in enumerate(found):
        left = max(chars // 2, chars - total[1 - y])
        for doc_id, th, n in some:
            if n <= left:
                left -= n
                chosen.append((doc_id, th, y))
    if not chosen:
        return []
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame(chosen, "doc_id long, _th long, y int"))  # at most `most` rows
    order = [F.xxhash64(F.col("doc_id"), F.lit(18)), F.col("doc_id"), F.col("th"), F.col("text")]
    texts = rows.join(picked.withColumnRenamed("doc_id", "_id"), (F.col("doc_id") == F.col("_id")) & (F.col("th") == F.col("_th")))
    return [(r["text"], r["y"]) for r in texts.dropDuplicates(["doc_id", "th"]).orderBy(*order).select("text", "y").collect()]
