"""Which price a model name takes: an ordered ladder of looser and looser matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROVIDERS = r"(?i)^(azure/|openai/|anthropic/|google/|vertex_ai/)"


def resolve(models: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, price_key, level) of each distinct name of `models.model`; null key and level where nothing fits.

    prices: (price_key, fallback, place). Levels: 1 the name, 2 the name without its provider, 3 a listed key that it starts
    with, 4 a fallback key, 5 a fallback key that it starts with; the first by place wins. Price lists are small and so are
    distinct names: the usage rows themselves are only grouped, never compared.
    """
    names = models.select("model").distinct().withColumn("bare", F.regexp_replace("model", PROVIDERS, ""))
    key, starts = F.col("price_key"), F.startswith("bare", "price_key")
    level = (
        F.when(~F.col("fallback") & (key == F.col("model")), 1)
        .when(~F.col("fallback") & (key == F.col("bare")), 2)
        .when(~F.col("fallback") & starts & (F.contains(key, F.lit("-")) | (F.length(key) >= 6)), 3)
        .when(F.col("fallback") & ((key == F.col("bare")) | (key == F.col("model"))), 4)
        .when(F.col("fallback") & starts, 5)
    )
    best = Window.partitionBy("model").orderBy("level", "place")
    fits = names.join(prices, starts | (key == F.col("model"))).withColumn("level", level).filter("level IS NOT NULL")
    first = fits.withColumn("r", F.row_number().over(best)).filter("r = 1").select(F.col("model").alias("m"), "price_key", "level")
    return names.join(first, F.col("model").eqNullSafe(F.col("m")), "left").select("model", "price_key", "level")
