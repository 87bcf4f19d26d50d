"""Writing: insert-ignore and upserts on Parquet tables, and exports as RSS, Markdown, CSV and JSON lines.

Parquet has no MERGE: an upsert is a join of the table with the changes that gives the new table, which the caller writes to
a new place. Inserts of new keys only append.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.text import xml_escape
from tidewire.sources.archive import rfc822


def unseen(rows: DataFrame, table: DataFrame | None, *keys: str) -> DataFrame:
    """Rows whose keys the table doesn't have, one of each key; null keys are equal to each other."""
    fresh = rows.dropDuplicates(list(keys))
    if table is None:
        return fresh
    known = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    test = F.lit(True)
    for k in keys:
        test &= fresh[k].eqNullSafe(known[f"_k_{k}"])
    return fresh.join(known, test, "left_anti")


def append_unseen(rows: DataFrame, path: str, *keys: str) -> int:
    """Insert-ignore into the Parquet table at `path`, which may be new; the number of rows inserted."""
    spark = rows.sparkSession
    table = spark.read.schema(rows.schema).parquet(path) if exists(spark, path) else None
    before = 0 if table is None else table.count()
    unseen(rows, table, *keys).write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).count() - before


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def upserted(table: DataFrame, changes: DataFrame, *keys: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """The table after changes, at most one for each key: changed rows take the change's columns, others stay, new ones come.

    `rules` give columns by old_<name> and new_<name>; old_* are null for new keys. Columns that the changes lack keep their old value."""
    rules = rules or {}
    old = table.select(*[F.col(c).alias(f"old_{c}") for c in table.columns])
    new = changes.select(*[F.col(c).alias(f"new_{c}") for c in changes.columns], F.lit(True).alias("_new"))
    test = F.lit(True)
    for k in keys:
        test &= old[f"old_{k}"] == new[f"new_{k}"]
    both = old.join(new, test, "full")
    out = []
    for c in table.columns:
        if c in keys:
            value = F.coalesce(f"new_{c}", f"old_{c}")
        elif c in rules:
            value = F.when(F.col("_new"), rules[c]).otherwise(F.col(f"old_{c}"))
        elif c in changes.columns:
            value = F.when(F.col("_new"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}"))
        else:
            value = F.col(f"old_{c}")
        out.append(value.cast(table.schema[c].dataType).alias(c))
    return both.select(*out)


def seeded(table: DataFrame, catalog: DataFrame, *keys: str) -> DataFrame:
    """The table with the catalog's rows in place of its own of the same keys."""
    return table.join(catalog.select(*keys), list(keys), "left_anti").unionByName(catalog)


def health_after(health: DataFrame, fetches: DataFrame) -> DataFrame:
    """Source health after one fetch of some sources: (source_id, ok, at, inserted, newest, error).

    A success clears the failures, adds to the total and moves the cursor if something newer was seen; a failure counts up."""
    ok = F.col("new_ok")
    rules = {
        "status": F.when(ok, "ok").otherwise("error"),
        "consecutive_failures": F.when(ok, 0).otherwise(F.coalesce("old_consecutive_failures", F.lit(0)) + 1),
        "total_items_count": F.coalesce("old_total_items_count", F.lit(0)) + F.when(ok, F.coalesce("new_inserted", F.lit(0))).otherwise(0),
        "last_fetched_at": F.col("new_at"),
        "last_success_at": F.when(ok, F.col("new_at")).otherwise(F.col("old_last_success_at")),
        "last_external_id": F.when(ok, F.coalesce("new_newest", "old_last_external_id")).otherwise(F.col("old_last_external_id")),
        "last_error": F.when(~ok, F.col("new_error")),
    }
    return upserted(health, fetches, "source_id", rules=rules)


def _row(items: DataFrame, content: str | None, category: str | None) -> Column:
    part = lambda tag, value: F.concat(F.lit(f"      <{tag}>"), F.coalesce(value, F.lit("")), F.lit(f"</{tag.split()[0]}>\n"))
    cat = F.coalesce(F.concat(F.lit("      <category>"), xml_escape(category), F.lit("</category>\n")), F.lit("")) if category else F.lit("")
    whole = F.lit("")
    if content:
        safe = F.replace(F.col(content), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
        whole = F.coalesce(F.concat(F.lit("      <content:encoded><![CDATA["), safe, F.lit("]]></content:encoded>\n")), F.lit(""))
    return F.concat(
        F.lit("    <item>\n"), part("title", xml_escape("title")), part("link", xml_escape("link")), part("description", xml_escape("description")),
        part("pubDate", rfc822("published_at")), part('guid isPermaLink="false"', xml_escape("guid")), cat, whole, F.lit("    </item>"),
    )


def rss_channel(items: DataFrame, title: str, link: str, description: str, built: str, language: str = "zh-CN", self_link: str | None = None, content: str | None = None, category: str | None = None, most: int = 50) -> DataFrame:
    """One row, one column xml: an RSS 2.0 document of the `most` latest items (title, link, description, published_at, guid), ids settling ties.

    It is cut to `most` items before they come together."""
    latest = items.orderBy(F.desc("published_at"), F.desc("guid")).limit(most).select("published_at", "guid", _row(items, content, category).alias("xml"))
    last = F.reverse(F.array_sort(F.collect_list(F.struct("published_at", "guid", "xml"))))
    body = latest.agg(last.alias("rows"))
    escaped = lambda text: text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&apos;")
    head = (
        '<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:atom="http://www.w3.org/2005/Atom">\n  <channel>\n'
        f"    <title>{escaped(title)}</title>\n    <link>{escaped(link)}</link>\n    <description>{escaped(description)}</description>\n    <language>{language}</language>\n    <lastBuildDate>"
    )
    date = F.coalesce(F.date_format(F.col("rows")[0]["published_at"], "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.date_format(F.lit(built).cast("timestamp_ntz"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    own = f'</lastBuildDate>\n    <atom:link href="{escaped(self_link or link)}" rel="self" type="application/rss+xml" />\n'
    return body.select(F.concat(F.lit(head), date, F.lit(own), F.array_join(F.transform("rows", lambda r: r["xml"]), "\n"), F.lit("\n  </channel>\n</rss>")).alias("xml"))


def saved_markdown(saved: DataFrame) -> DataFrame:
    """(place, markdown): each saved item as a section. From title, publisher, day, importance, collection, url, summary, editor_note."""
    line = lambda *parts: F.concat(*parts)
    optional = lambda c, before: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"\n{before}"), F.col(c), F.lit("\n"))).otherwise("")
    text = F.concat(
        line(F.lit("## "), F.col("title"), F.lit("\n\n- **"), F.col("publisher"), F.lit("** · "), F.col("day"), F.lit(" · score `"), F.col("importance").cast("string"), F.lit("` · `#"), F.coalesce(F.col("collection"), F.lit("inbox")), F.lit("`\n- "), F.col("url"), F.lit("\n")),
        optional("summary", ""), optional("editor_note", "> **Editor note**: "), F.lit("\n---\n"),
    )
    return saved.select("place", text.alias("markdown"))


def csv_cell(value: Column) -> Column:
    """A cell in quotes where it holds a quote, a comma or a line break; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*columns: str | Column) -> Column:
    return F.concat_ws(",", *[csv_cell(F.col(c) if isinstance(c, str) else c) for c in columns])


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    """One column as text files in the shared store, a line a row."""
    rows.select(column).write.mode("overwrite").text(path)


def snapshot(rows: DataFrame, path: str) -> DataFrame:
    """The rows as JSON lines, and read back: what a reset could be undone from."""
    rows.write.mode("overwrite").json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
