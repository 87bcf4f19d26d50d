"""Registered queries of what comes in and what goes out: parsing, normalising, inserting, texts, details, search, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import content, text
from tidewire.functions.diffs import line_diff
from tidewire.operators import detail, digest, feed, normalize, search, stats, vectors
from tidewire.plans.base import DAY, add
from tidewire.plans.views import NOW, Views
from tidewire.sources import archive, backfill, feeds, sinks
from tidewire.sources import fixtures as fx
from tidewire.sources.shared import shared_dir
from tidewire.streaming import jobs

STAMP = "yyyy-MM-dd HH:mm:ss"
_AT = "(TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(n % 720 AS INT), 0, 0))"
_DUCK_AT = "(TIMESTAMP '2024-01-01' + to_hours(CAST(n % 720 AS INT)))"


def texts(v: Views) -> DataFrame:
    return v.table("documents").select(F.col("doc_id").alias("n"))


# -- feeds ------------------------------------------------------------------------------------------------------------


def feed_documents(v: Views) -> DataFrame:
    """An RSS or an Atom document for each number, with every shape of entry."""
    rss = f"""concat('<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title>',
        '<item><title><![CDATA[A & B ', n, ']]></title><link> https://a.example/', n, ' </link><guid isPermaLink="false">g-', n, '</guid><pubDate>', date_format({_AT}, 'EEE, dd MMM yyyy HH:mm:ss'), ' GMT</pubDate><description>d &lt;b&gt; ', n, '</description></item>',
        '<item><link>https://a.example/b/', n, '</link><dc:date>', date_format({_AT}, 'yyyy-MM-dd'), 'T', date_format({_AT}, 'HH:mm:ss'), 'Z</dc:date></item>',
        '<item><title>no address</title></item>',
        CASE WHEN n % 4 = 0 THEN concat('<item><title>only a guid</title><guid>u-', n, '</guid><pubDate>some day</pubDate></item>') ELSE '' END, '</channel></rss>')"""
    atom = f"""concat('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i-', n, '</id><title type="html">t ', n, '</title><link rel="self" href="https://self.example/"/><link rel="alternate" href="https://b.example/', n, '"/><published>', date_format({_AT}, 'yyyy-MM-dd'), 'T', date_format({_AT}, 'HH:mm:ss'), '+01:00</published><summary>s ', n, '</summary></entry>',
        CASE WHEN n % 3 = 0 THEN concat('<entry><link href="https://b.example/c/', n, '"/><title> </title><updated>', date_format({_AT}, 'yyyy-MM-dd'), 'T00:00:00Z</updated></entry>') ELSE '' END, '<entry><title>neither</title></entry></feed>')"""
    return texts(v).select("n", F.expr(f"CASE WHEN n % 2 = 0 THEN {rss} ELSE {atom} END").alias("payload"))


add(
    "feed_parse",
    "n long, external_id string, url string, title string, published_at string, body string",
    lambda v: feeds.parse_feed(feed_documents(v)).withColumn("published_at", F.date_format("published_at", STAMP)),
    f"""WITH d AS (SELECT doc_id AS n FROM documents), s AS (SELECT n, strftime({_DUCK_AT}, '%Y-%m-%d %H:%M:%S') AS t FROM d)
        SELECT n, 'g-' || n AS external_id, 'https://a.example/' || n AS url, 'A & B ' || n AS title, t AS published_at, 'd <b> ' || n AS body FROM s WHERE n % 2 = 0
        UNION ALL SELECT n, 'https://a.example/b/' || n, 'https://a.example/b/' || n, '(untitled)', t, NULL FROM s WHERE n % 2 = 0
        UNION ALL SELECT n, 'u-' || n, 'u-' || n, 'only a guid', NULL, NULL FROM s WHERE n % 4 = 0
        UNION ALL SELECT n, 'i-' || n, 'https://b.example/' || n, 't ' || n, strftime({_DUCK_AT} - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S'), 's ' || n FROM d WHERE n % 2 = 1
        UNION ALL SELECT n, 'https://b.example/c/' || n, 'https://b.example/c/' || n, '(untitled)', strftime(date_trunc('day', {_DUCK_AT}), '%Y-%m-%d %H:%M:%S'), NULL FROM d WHERE n % 6 = 3""",
)


def posts(v: Views) -> DataFrame:
    body = """to_json(named_struct('id', CAST(1000 + n AS STRING), 'text', CASE WHEN n % 11 = 0 THEN '  ' ELSE concat('post ', n) END, 'created_at', concat(date_format({at}, 'yyyy-MM-dd'), 'T', date_format({at}, 'HH:mm:ss'), '.000Z'),
        'note_tweet', CASE WHEN n % 5 = 0 THEN named_struct('text', concat(' long ', n, '\\nmore ')) END, 'referenced_tweets', CASE WHEN n % 7 = 0 THEN array(named_struct('type', 'replied_to')) WHEN n % 7 = 1 THEN array(named_struct('type', 'retweeted')) WHEN n % 7 = 2 THEN array(named_struct('type', 'quoted')) END))""".format(at=_AT)
    return texts(v).select("n", F.expr("concat('user', n % 10)").alias("handle"), F.expr(body).alias("payload"))


POSTS = f"""SELECT n, 'user' || (n % 10) AS handle, CAST(1000 + n AS VARCHAR) AS external_id, 'https://x.com/user' || (n % 10) || '/status/' || (1000 + n) AS url,
    CASE WHEN n % 5 = 0 THEN 'long ' || n ELSE 'post ' || n END AS title, strftime({_DUCK_AT}, '%Y-%m-%d %H:%M:%S') AS published_at, CASE WHEN n % 5 = 0 THEN 'long ' || n || chr(10) || 'more' ELSE 'post ' || n END AS body
    FROM (SELECT doc_id AS n FROM documents) WHERE n % 7 > 1 AND (n % 11 <> 0 OR n % 5 = 0)"""
add("tweet_parse", "n long, external_id string, url string, title string, published_at string, body string", lambda v: feeds.parse_tweets(posts(v), "handle", now=fx.NOW).withColumn("published_at", F.date_format("published_at", STAMP)), POSTS)


def cursors(v: Views) -> DataFrame:
    """What was seen of each account but the last two."""
    return v.spark.range(8).select(F.expr("concat('user', id)").alias("source_id"), F.expr("CAST(1100 + 7 * id AS STRING)").alias("last_external_id"))


def seen(v: Views) -> DataFrame:
    return feeds.parse_tweets(posts(v), "handle", now=fx.NOW).withColumnRenamed("handle", "source_id")


_CURSOR = "(SELECT 'user' || i AS source_id, 1100 + 7 * i AS last FROM range(8) r(i))"
add("cursor_fetch", "source_id string, external_id string", lambda v: feeds.after_cursor(seen(v), cursors(v), most=20), f"""SELECT source_id, external_id FROM (SELECT handle AS source_id, external_id, row_number() OVER (PARTITION BY handle ORDER BY CAST(external_id AS BIGINT) DESC) AS k
    FROM ({POSTS}) p LEFT JOIN {_CURSOR} c ON p.handle = c.source_id WHERE last IS NULL OR CAST(external_id AS BIGINT) > last) WHERE k <= 20""")
add("cursor_advance", "source_id string, last_external_id string", lambda v: feeds.advanced(cursors(v), feeds.after_cursor(seen(v), cursors(v))), f"""SELECT coalesce(c.source_id, p.handle) AS source_id, CAST(greatest(coalesce(last, 0), coalesce(top, 0)) AS VARCHAR) AS last_external_id
    FROM {_CURSOR} c FULL JOIN (SELECT handle, max(CAST(external_id AS BIGINT)) AS top FROM ({POSTS}) GROUP BY handle) p ON p.handle = c.source_id""")
add("due_sources", "id string, cadence string, pending boolean", lambda v: feeds.due_sources(v.sources, "hourly", "weekly"), "SELECT id, cadence, kind = 'api' AS pending FROM sources WHERE enabled AND cadence IN ('hourly', 'weekly')", "sources")
add(
    "arxiv_category",
    "n long, category string, kept boolean",
    lambda v: _arxiv(v),
    f"""SELECT n, CASE n % 3 WHEN 0 THEN 'cs.' || (n % 9) WHEN 1 THEN 'stat.ML' END AS category, n % 5 = 0 OR {_DUCK_AT} BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' AS kept FROM (SELECT doc_id AS n FROM documents)""",
)


def _arxiv(v: Views) -> DataFrame:
    url = "CASE n % 3 WHEN 0 THEN concat('https://rss.arxiv.org/rss/cs.', n % 9) WHEN 1 THEN 'http://export.example/api?search_query=cat:stat.ML&max=9' ELSE 'https://a.example/rss/x' END"
    rows = texts(v).select("n", F.expr(url).alias("url"), F.expr(f"CASE WHEN n % 5 <> 0 THEN {_AT} END").alias("at"))
    return rows.select("n", feeds.category("url").alias("category"), feeds.in_window("at", "2024-01-10", "2024-01-20").alias("kept"))


def _index(v: Views) -> DataFrame:
    rows = """concat('[["urlkey","timestamp","original","mimetype","statuscode","digest"],["k","', date_format({at}, 'yyyyMMddHHmmss'), '","https://a.example/', n, '","text/xml","200","D', n, '"]', CASE WHEN n % 2 = 0 THEN ',["k","2024","https://a.example/","text/xml","-","E"]' ELSE '' END, ']')""".format(at=_AT)
    return texts(v).select("n", F.expr(f"CASE WHEN n % 10 = 9 THEN 'no json' ELSE {rows} END").alias("payload"))


add(
    "archive_index",
    "n long, taken_at string, original string, statuscode string, digest string",
    lambda v: archive.parse_index(_index(v)).withColumn("taken_at", F.date_format(feeds.compact_timestamp("timestamp"), STAMP)),
    f"""SELECT n, strftime({_DUCK_AT}, '%Y-%m-%d %H:%M:%S') AS taken_at, 'https://a.example/' || n AS original, '200' AS statuscode, 'D' || n AS digest FROM (SELECT doc_id AS n FROM documents) WHERE n % 10 <> 9
        UNION ALL SELECT doc_id, NULL, 'https://a.example/', '-', 'E' FROM documents WHERE doc_id % 2 = 0""",
)

WINDOW = ("2024-01-05", "2024-01-20T12:00:00")


def _paged(v: Views) -> dict[str, str]:
    v.spark.dataSource.register(backfill.Paged)
    return {"path": f"{v.sf_dir}/events.parquet", "key": "event_id", "size": "5000", "at": "ts", "since": WINDOW[0], "until": WINDOW[1]}


_IN_WINDOW = f"SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS taken, event_type, props FROM events WHERE event_id IS NOT NULL AND (ts IS NULL OR ts BETWEEN TIMESTAMP '{WINDOW[0]}' AND TIMESTAMP '{WINDOW[1]}')"
add(
    "paged_backfill",
    "event_id long, taken string, event_type string, props string",
    lambda v: v.spark.read.format("paged").options(**_paged(v)).load().withColumn("taken", F.date_format("ts", STAMP)),
    _IN_WINDOW,
)
add(
    "stream_backfill",
    "event_id long, taken string, event_type string, props string",
    lambda v: jobs.drain(v.spark.readStream.format("paged").options(**_paged(v)).load(), "append").withColumn("taken", F.date_format("ts", STAMP)),
    _IN_WINDOW,
)

# -- normalising ------------------------------------------------------------------------------------------------------


def fetched(v: Views) -> DataFrame:
    """Pages as fetched rows: bodies under each name of a payload, some without address, title or date, some twice."""
    page = v.table("pages").select(F.col("page_id").alias("p"), "url", "html")
    rows = page.withColumn("twice", F.explode(F.when(F.col("p") % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    payload = """CASE p % 4 WHEN 0 THEN to_json(map('content:encoded', html)) WHEN 1 THEN to_json(map('content', named_struct('#text', html))) WHEN 2 THEN to_json(map('content:encoded', '', 'description', html)) ELSE to_json(map('other', html)) END"""
    return rows.select(
        F.expr("p * 2 + twice").alias("id"), F.lit("s").alias("source_id"), F.expr("CASE WHEN p % 9 <> 4 THEN concat(' ', url, ' ') END").alias("url"),
        F.expr("CASE p % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE concat(' page ', p, ' ') END").alias("title"), F.expr("CASE WHEN p % 7 <> 0 THEN TIMESTAMP_NTZ '2024-01-02 03:04:05' END").alias("published_at"), F.expr(payload).alias("payload"),
    )


_EDGE = "'^[\\s ]+|[\\s ]+$'"
_trim = lambda c: f"regexp_replace({c}, {_EDGE}, '', 'g')"
_ENTITIES = (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&apos;", "''"), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))


def _decoded(c: str) -> str:
    for name, char in _ENTITIES:
        c = f"replace({c}, '{name}', '{char}')"
    return c


def stripped(c: str) -> str:
    """strip_markup() in DuckDB, for the entities that the pages hold."""
    t = _trim(f"coalesce({c}, '')")
    bare = _trim(_decoded(f"regexp_replace(regexp_replace({t}, '(?s)<!--.*?-->', '', 'g'), '</?[a-zA-Z][^>]*>|<![^>]*>|<[^>\\s][^>]*>', '', 'g')"))
    return f"CASE WHEN NOT regexp_matches({t}, '<[a-zA-Z!/]') THEN {t} WHEN {bare} <> '' THEN {bare} ELSE {_trim(f'regexp_replace({t}, {chr(39)}<[^>]+>{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')} END"


_U = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$'"


def canonical(c: str) -> str:
    """canonical_url() in DuckDB."""
    p = f"regexp_extract({c}, {_U}, 3)"
    q = f"array_to_string(list_filter(string_split(substr(regexp_extract({c}, {_U}, 4), 2), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '{text.TRACKING_PATTERN}')), '&')"
    return f"""CASE WHEN regexp_matches({c}, {_U}) THEN lower(regexp_extract({c}, {_U}, 1)) || '://' || lower(regexp_extract({c}, {_U}, 2)) || CASE WHEN {p} = '' AND {q} <> '' THEN '/' WHEN {p} = '/' AND {q} = '' THEN '' ELSE {p} END
        || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END ELSE {c} END"""


NORMAL = f"""WITH f AS (SELECT page_id AS p, page_id * 2 + k AS id, CASE WHEN page_id % 9 <> 4 THEN {_trim("coalesce(url, '')")} ELSE '' END AS u, CASE WHEN page_id % 5 < 2 THEN '(untitled)' ELSE 'page ' || page_id END AS title,
        CASE WHEN page_id % 4 = 3 THEN '' ELSE {stripped("html")} END AS body FROM pages, LATERAL (SELECT unnest(CASE WHEN page_id % 6 = 0 THEN [0, 1] ELSE [0] END) AS k)),
    h AS (SELECT *, CASE WHEN u <> '' THEN sha256({canonical("u")} || chr(10) || chr(10) || title || chr(10) || chr(10) || body) END AS content_hash FROM f)
    SELECT id, title, md5(body) AS body, content_hash, CASE WHEN u = '' THEN 'skipped' WHEN id = min(id) OVER (PARTITION BY content_hash) THEN 'created' ELSE 'deduped' END AS outcome FROM h"""
add("normalize", "id long, title string, body string, content_hash string, outcome string", lambda v: normalize.normalize(fetched(v), fx.NOW).withColumn("body", F.md5("body")), NORMAL)
add("normalize_outcomes", "outcome string, n long", lambda v: normalize.outcomes(normalize.normalize(fetched(v), fx.NOW)), f"SELECT outcome, count(*) AS n FROM ({NORMAL}) GROUP BY outcome")
add("strip_markup", "id long, digest string", lambda v: v.raw.select("id", F.md5(content.strip_markup("payload")).alias("digest")), f"SELECT page_id AS id, md5({stripped('html')}) AS digest FROM pages")


def readable_pages(v: Views) -> DataFrame:
    page = """concat('<html><head><title>Site &amp; page ', n, '</title>', CASE WHEN n % 2 = 0 THEN concat('<meta name="author" content="A. ', n, '"><meta property="og:title" content="Own ', n, '">') ELSE '' END, '</head><body><nav>menu</nav>',
        CASE WHEN n % 3 = 0 THEN concat('<article><h1>H</h1><p>First ', n, '</p><script>var x = 1;</script><p>Second</p></article>') WHEN n % 3 = 1 THEN concat('<main><p>Main ', n, '</p></main>') ELSE '' END, '<footer>foot</footer></body></html>')"""
    return texts(v).select("n", F.expr(page).alias("html"))


add(
    "readable",
    "n long, title string, body string, author string, excerpt string",
    lambda v: readable_pages(v).select("n", content.readable("html").alias("r")).select("n", "r.*"),
    """SELECT doc_id AS n, CASE WHEN doc_id % 2 = 0 THEN 'Own ' || doc_id ELSE 'Site & page ' || doc_id END AS title, CASE doc_id % 3 WHEN 0 THEN 'H' || chr(10) || 'First ' || doc_id || chr(10) || 'Second' WHEN 1 THEN 'Main ' || doc_id ELSE '' END AS body,
       CASE WHEN doc_id % 2 = 0 THEN 'A. ' || doc_id END AS author, CASE doc_id % 3 WHEN 0 THEN 'First ' || doc_id WHEN 1 THEN 'Main ' || doc_id END AS excerpt FROM documents""",
)


def _unmarked(v: Views) -> DataFrame:
    """The pages with their <article> as a plain <div>: what is read is the main block."""
    pages = v.table("pages").select("page_id", F.regexp_replace("html", r"<(/?)(article|main)\b[^>]*>", "<$1div>").alias("html"))
    return pages.select("page_id", content.readable("html").alias("r")).select("page_id", "r.title", "r.body", "r.excerpt")


add("readable_blocks", "page_id long, title string, body string, excerpt string", _unmarked)


def appended(v: Views) -> DataFrame:
    """The table after three inserts of overlapping rows, repeats within them included."""
    path = f"{shared_dir(v.spark)}/raw-{uuid.uuid4().hex}"
    rows = seen(v).select("source_id", F.expr("CAST(CAST(external_id AS BIGINT) DIV 3 AS STRING)").alias("external_id"))
    for test in ("CAST(external_id AS BIGINT) % 2 = 0", "CAST(external_id AS BIGINT) % 3 < 2", "true"):
        sinks.append_unseen(rows.where(test), path, "source_id", "external_id")
    return v.spark.read.schema(rows.schema).parquet(path)


add("raw_append", "source_id string, external_id string", appended, f"SELECT DISTINCT handle AS source_id, CAST(CAST(external_id AS BIGINT) // 3 AS VARCHAR) AS external_id FROM ({POSTS})")


def fetches(v: Views) -> DataFrame:
    """A fetch of two of three sources, every fourth failing, some finding nothing newer; and a source that was never fetched."""
    s = v.sources.select("id", F.expr("CAST(substring(id, 4) AS INT)").alias("s")).where("s % 3 <> 1")
    return s.select(F.col("id").alias("source_id"), F.expr("s % 4 <> 0").alias("ok"), F.expr(fx.NOW_SQL).alias("at"), F.expr("s * 2").alias("inserted"), F.expr("CASE WHEN s % 2 = 0 THEN concat('n', s) END").alias("newest"), F.expr("concat('http_5xx: s', s)").alias("error"))


def health_table(v: Views) -> DataFrame:
    return v.health.withColumn("last_external_id", F.expr("concat('o', source_id)")).withColumn("last_error", F.lit("old"))


add(
    "health_upsert",
    "source_id string, status string, consecutive_failures int, total_items_count int, last_success_at string, last_external_id string, last_error string",
    lambda v: sinks.health_after(health_table(v), fetches(v)).withColumn("last_success_at", F.date_format("last_success_at", STAMP)),
    f"""SELECT * FROM (WITH f AS (SELECT id AS source_id, s, s % 4 <> 0 AS ok FROM (SELECT id, CAST(substr(id, 4) AS INT) AS s FROM sources) WHERE s % 3 <> 1)
        SELECT coalesce(h.source_id, f.source_id) AS source_id, CASE WHEN f.source_id IS NULL THEN status WHEN ok THEN 'ok' ELSE 'error' END AS status, CASE WHEN f.source_id IS NULL THEN consecutive_failures WHEN ok THEN 0 ELSE coalesce(consecutive_failures, 0) + 1 END AS consecutive_failures,
          CASE WHEN f.source_id IS NULL THEN total_items_count ELSE coalesce(total_items_count, 0) + CASE WHEN ok THEN s * 2 ELSE 0 END END AS total_items_count,
          strftime(CASE WHEN ok THEN {NOW} ELSE last_success_at END, '%Y-%m-%d %H:%M:%S') AS last_success_at,
          CASE WHEN ok AND s % 2 = 0 THEN 'n' || s WHEN h.source_id IS NOT NULL THEN 'o' || h.source_id END AS last_external_id, CASE WHEN f.source_id IS NULL THEN 'old' WHEN NOT ok THEN 'http_5xx: s' || s END AS last_error
        FROM health h FULL JOIN f ON h.source_id = f.source_id)""",
    "health",
)


def reseeded(v: Views) -> DataFrame:
    catalog = v.sources.where("priority < 3").withColumn("name_en", F.concat(F.lit("New "), F.col("id")))
    return sinks.seeded(v.sources, catalog.unionByName(catalog.limit(1).withColumn("id", F.lit("extra")).withColumn("name_en", F.lit("Extra"))), "id")


add("seed_upsert", "id string, name_en string", reseeded, "SELECT id, CASE WHEN priority < 3 THEN 'New ' || id ELSE name_en END AS name_en FROM sources UNION ALL SELECT 'extra', 'Extra'", "sources")

# -- texts ------------------------------------------------------------------------------------------------------------


def _addresses(v: Views) -> DataFrame:
    ip = "CASE n % 8 WHEN 0 THEN concat('10.', n % 256, '.0.1') WHEN 1 THEN concat('172.', n % 64, '.1.1') WHEN 2 THEN concat(n % 256, '.8.8.8') WHEN 3 THEN concat('192.168.', n % 256, '.9') WHEN 4 THEN concat('::ffff:100.', n % 256, '.1.1') WHEN 5 THEN 'FE80::1' WHEN 6 THEN '2001:db8::5' ELSE concat('300.1.1.', n) END"
    return texts(v).select("n", F.expr(ip).alias("ip"))


add("private_address", "n long, ip string, blocked boolean", lambda v: _addresses(v).withColumn("blocked", content.private_address("ip")), """SELECT n, CASE n % 8 WHEN 0 THEN '10.' || (n % 256) || '.0.1' WHEN 1 THEN '172.' || (n % 64) || '.1.1' WHEN 2 THEN (n % 256) || '.8.8.8' WHEN 3 THEN '192.168.' || (n % 256) || '.9' WHEN 4 THEN '::ffff:100.' || (n % 256) || '.1.1' WHEN 5 THEN 'FE80::1' WHEN 6 THEN '2001:db8::5' ELSE '300.1.1.' || n END AS ip,
    CASE n % 8 WHEN 0 THEN true WHEN 1 THEN n % 64 BETWEEN 16 AND 31 WHEN 2 THEN n % 256 IN (0, 10, 127) OR n % 256 >= 224 WHEN 3 THEN true WHEN 4 THEN n % 256 BETWEEN 64 AND 127 WHEN 5 THEN true ELSE false END AS blocked FROM (SELECT doc_id AS n FROM documents)""")
_VIDEO = "CASE n % 7 WHEN 0 THEN concat('https://www.youtube.com/watch?a=1&v=abcdefgh', 100 + n % 900, '&t=5') WHEN 1 THEN concat('https://youtu.be/abcdefgh', 100 + n % 900, '?s=1') WHEN 2 THEN concat('https://youtube.com/shorts/abcdefgh', 100 + n % 900) WHEN 3 THEN concat('https://m.youtube.com/embed/abcdefgh', 100 + n % 900) WHEN 4 THEN 'https://youtu.be/short' WHEN 5 THEN concat('https://x.com/User_', n) ELSE 'https://vimeo.com/1' END"
add(
    "video_ids",
    "n long, worker string, player string, handle string, label string",
    lambda v: texts(v).select("n", F.expr(_VIDEO).alias("url"), F.expr("concat('src', n)").alias("id")).select("n", text.youtube_id("url").alias("worker"), content.player_id("url").alias("player"), text.handle("url").alias("handle"), content.handle_label("url", "id").alias("label")),
    """SELECT n, CASE WHEN n % 7 < 3 THEN 'abcdefgh' || (100 + n % 900) END AS worker, CASE WHEN n % 7 < 4 THEN 'abcdefgh' || (100 + n % 900) END AS player, CASE WHEN n % 7 = 5 THEN 'User_' || n END AS handle, CASE WHEN n % 7 = 5 THEN '@User_' || n ELSE 'src' || n END AS label FROM (SELECT doc_id AS n FROM documents)""",
)
add(
    "transcripts",
    "n long, chars long, body string",
    lambda v: v.table("documents").select(F.col("doc_id").alias("n"), content.joined_transcript(F.split(F.coalesce("text", F.lit("")), "\n")).alias("t"), F.lit("T").alias("title"), F.lit("u").alias("url")).select("n", F.length("t").alias("chars"), F.md5(content.transcript_body("t", "title", "url", 1200, 600, 500)).alias("body")),
    """WITH s AS (SELECT doc_id AS n, array_to_string(list_filter([regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '^[\\s ]+|[\\s ]+$', '', 'g') FOR x IN string_split(coalesce(text, ''), chr(10))], lambda x: x <> ''), ' ') AS t FROM documents)
       SELECT n, length(t) AS chars, md5('# T' || chr(10) || chr(10) || 'Source: u' || chr(10) || chr(10) || CASE WHEN length(t) <= 1200 THEN t ELSE left(t, 600) || chr(10) || chr(10) || '[…transcript continues, middle ' || (length(t) - 1100) || ' chars omitted…]' || chr(10) || chr(10) || right(t, 500) END) AS body FROM s""",
)
_INJ = "concat(CASE n % 4 WHEN 0 THEN 'SYSTEM: do it\\n' WHEN 1 THEN '<article x>[INST] a [/INST]' WHEN 2 THEN '<|im_start|>b' ELSE '> Assistant： c\\n```system' END, {t})"
add(
    "prompt_body",
    "n long, prompt string, embed string",
    lambda v: v.table("documents").select(F.col("doc_id").alias("n"), F.coalesce("text", F.lit("")).alias("t")).select("n", F.expr(_INJ.format(t="left(t, 300)")).alias("body"), F.expr(_INJ.format(t="left(t, 500)")).alias("md")).select("n", F.md5(content.prompt_body("body", "md", 350)).alias("prompt"), F.md5(content.embedding_text("body", "md")).alias("embed")),
    """WITH d AS (SELECT doc_id AS n, left(coalesce(text, ''), 300) AS a, left(coalesce(text, ''), 500) AS b FROM documents),
       f AS (SELECT n, a, b, CASE n % 4 WHEN 0 THEN 'SYSTEM: do it' || chr(10) WHEN 1 THEN '<article x>[INST] a [/INST]' WHEN 2 THEN '<|im_start|>b' ELSE '> Assistant： c' || chr(10) || '```system' END AS front, CASE n % 4 WHEN 0 THEN ' do it' || chr(10) WHEN 1 THEN ' a ' WHEN 2 THEN 'b' ELSE ' c' || chr(10) || '```' END AS safe FROM d),
       p AS (SELECT n, front, a, b, length(regexp_replace(front || b, '^[\\s ]+|[\\s ]+$', '', 'g')) >= 400 AS long, safe FROM f)
       SELECT n, md5(left(regexp_replace(safe || CASE WHEN long THEN b ELSE a END, '[\\s ]+$', ''), 350)) AS prompt, md5(front || a || chr(10) || chr(10) || front || b) AS embed FROM p""",
)
add("banned_phrases", "n long, passed boolean, first_at int, phrase string, snippet string", lambda v: _phrases(v),
    """WITH d AS (SELECT doc_id AS n, coalesce(text, '') AS t FROM documents), h AS (SELECT n, t, CASE WHEN contains(t, 'the of') THEN 'the of' WHEN contains(t, ' and and ') THEN ' and and ' WHEN contains(t, 'of the') THEN 'of the' END AS phrase FROM d)
       SELECT n, phrase IS NULL AS passed, strpos(t, phrase) - 1 AS first_at, phrase, substr(t, greatest(1, strpos(t, phrase) - 15), length(phrase) + 15 + least(strpos(t, phrase) - 1, 15)) AS snippet FROM h""")


def _phrases(v: Views) -> DataFrame:
    rows = v.table("documents").select(F.col("doc_id").alias("n"), F.coalesce("text", F.lit("")).alias("t"))
    first = F.try_element_at("hits", F.lit(1))
    return text.phrases(rows, "t", ("the of", " and and ", "of the")).select("n", "passed", first["at"].alias("first_at"), first["phrase"].alias("phrase"), first["snippet"].alias("snippet"))


_MD = "concat(n % 30, '. **Bold** claim [#', n, '](u) and [#', n + 1, '] `x`', repeat(' word', CAST(n % 60 AS INT)), '\\nsecond line')"
add(
    "markdown_text",
    "n long, preview string, linked string, html string",
    lambda v: texts(v).select("n", F.expr(_MD).alias("md")).select("n", text.summary_preview("md").alias("preview"), text.linkify("md", "/items/").alias("linked"), content.simple_html("md").alias("html")),
    """WITH d AS (SELECT doc_id AS n, (doc_id % 30) || '. **Bold** claim [#' || doc_id || '](u) and [#' || (doc_id + 1) || '] `x`' || repeat(' word', CAST(doc_id % 60 AS INT)) AS l FROM documents), p AS (SELECT n, l, 'Bold claim  and  x' || repeat(' word', CAST(n % 60 AS INT)) AS s FROM d)
       SELECT n, CASE WHEN length(s) > 160 THEN trim(left(s, 160)) || '…' ELSE s END AS preview, regexp_replace(l, '\\[#(\\d+)\\] ', '[#\\1](/items/\\1) ') || chr(10) || 'second line' AS linked, '<p>' || l || chr(10) || 'second line</p>' AS html FROM p""",
)
_BAG = "CASE n % 5 WHEN 0 THEN concat('{\"openai\":{\"cachedPromptTokens\":', n, ',\"reasoningTokens\":', n % 7, '}}') WHEN 1 THEN concat('{\"openai\":{\"cached_tokens\":', n, '}}') WHEN 2 THEN concat('{\"anthropic\":{\"cacheReadInputTokens\":', n, '}}') WHEN 3 THEN concat('{\"google\":{\"thoughtsTokenCount\":', n, '}}') END"
add("token_bags", "n long, cached long, reasoning long", lambda v: texts(v).select("n", F.expr(_BAG).alias("bag")).select("n", content.cached_tokens("bag").alias("cached"), content.reasoning_tokens("bag").alias("reasoning")), "SELECT n, CASE WHEN n % 5 < 3 THEN n ELSE 0 END AS cached, CASE n % 5 WHEN 0 THEN n % 7 WHEN 3 THEN n ELSE 0 END AS reasoning FROM (SELECT doc_id AS n FROM documents)")
add(
    "labels_of_time",
    "n long, ago string, uptime string, age string",
    lambda v: texts(v).select("n", F.expr(f"CASE WHEN n % 10 <> 0 THEN {fx.NOW_SQL} - make_interval(0, 0, 0, 0, 0, 0, n * n % 900000) END").alias("at")).select("n", content.ago("at", fx.NOW).alias("ago"), content.uptime("at", fx.NOW).alias("uptime"), content.version_age("at", fx.NOW).alias("age")),
    """WITH d AS (SELECT doc_id AS n, CASE WHEN doc_id % 10 <> 0 THEN doc_id * doc_id % 900000 END AS s FROM documents), t AS (SELECT n, s, floor(s / 60 + 0.5) AS m, floor(floor(s / 60 + 0.5) / 60 + 0.5) AS h, floor(s / 3600 + 0.5) AS ah, s // 3600 AS wh FROM d)
       SELECT n, CASE WHEN s IS NULL THEN 'never' WHEN s < 60 THEN s || 's ago' WHEN m < 60 THEN CAST(m AS INT) || 'm ago' WHEN h < 24 THEN CAST(h AS INT) || 'h ago' ELSE CAST(floor(h / 24 + 0.5) AS INT) || 'd ago' END AS ago,
         CASE WHEN s IS NULL THEN '—' WHEN wh >= 24 THEN (wh // 24) || 'd ' || (wh % 24) || 'h' ELSE wh || 'h' END AS uptime,
         CASE WHEN ah < 1 THEN 'just now' WHEN ah < 24 THEN CAST(ah AS INT) || ' hrs ago' WHEN ah >= 24 THEN CAST(floor(ah / 24 + 0.5) AS INT) || ' d ago' END AS age FROM t""",
)
add(
    "mirrors",
    "id string, kind string, url string, hash string",
    lambda v: v.sources.select("id", "kind", F.concat(F.lit("https://rsshub.example/x/"), F.col("id"), F.lit("?a=1")).alias("url")).select("id", "kind", content.mirrored("url", "kind", "http://mirror.example:8080/base/").alias("url"), content.short_hash("id").alias("hash")),
    "SELECT id, kind, CASE WHEN kind = 'rsshub' THEN 'http://mirror.example:8080/base' ELSE 'https://rsshub.example' END || '/x/' || id || '?a=1' AS url, left(sha256(id), 8) AS hash FROM sources",
    "sources",
)
add(
    "vector_codec",
    "n long, size int, same boolean",
    lambda v: v.table("embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").cast("array<double>").alias("e")).withColumn("d", vectors.decode_vector(vectors.encode_vector("e"))).select("n", F.size("d").alias("size"), (F.col("d") == F.col("e")).alias("same")),
    "SELECT vec_id AS n, len(embedding) AS size, true AS same FROM embeddings",
)
add(
    "writer_prompt",
    "id long, line string",
    lambda v: v.plain.where("tier IS NOT NULL").select(
        "id", content.digest_line("id", F.concat_ws(", ", F.concat(F.lit("tier="), F.col("tier")), F.concat(F.lit("imp="), F.coalesce(F.col("importance").cast("string"), F.lit("?")))), F.concat(F.lit("t"), F.col("id")), F.array_join(feed.flat_tags("entities", "topics", "capabilities", 5), ", "), F.coalesce("summary_zh", F.lit("")), F.col("editor_note_en")).alias("line")
    ),
    """SELECT id, rtrim('[#' || id || '] (tier=' || tier || ', imp=' || coalesce(CAST(importance AS VARCHAR), '?') || ') t' || id || chr(10) || '  tags: ' || array_to_string(list_slice(list_concat(list_concat(entities, topics), capabilities), 1, 5), ', ') || chr(10) || '  summary: ' || coalesce(summary_zh, '')
       || CASE WHEN editor_note_en IS NOT NULL THEN chr(10) || '  editor_note: ' || editor_note_en ELSE '' END) AS line FROM items WHERE tier IS NOT NULL""",
    "items",
)


def _versions(v: Views) -> DataFrame:
    """Each text, and a version of it without every third line and with a new one behind every fifth."""
    own = F.split(F.coalesce("text", F.lit("")), "\n")
    after = F.flatten(
        F.transform(
            own,
            lambda x, i: F.concat(
                F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(x)),
                F.when(i % 5 == 0, F.array(F.concat(F.lit("new "), F.col("doc_id"), F.lit(" "), i))).otherwise(F.array().cast("array<string>")),
            ),
        )
    )
    return v.table("documents").select(F.col("doc_id").alias("n"), F.array_join(own, "\n").alias("x"), F.array_join(after, "\n").alias("y"))


def _diffs(v: Views) -> DataFrame:
    """Numbers of lines, and both texts as the whole diff gives them back."""
    of = lambda *kinds: F.filter("d", lambda r: r["kind"].isin(*kinds))
    back = lambda *kinds: F.md5(F.array_join(F.transform(of(*kinds), lambda r: r["content"]), "\n").cast("binary"))
    whole = _versions(v).select("n", line_diff("x", "y", None).alias("d"))
    return whole.select("n", *[F.size(of(k)).alias(k) for k in ("context", "remove", "add")], back("context", "remove").alias("before"), back("context", "add").alias("after"))


# the new lines stand nowhere else, so that the lines that were left are a longest common subsequence
add(
    "line_diffs",
    "n long, context int, remove int, add int, before string, after string",
    _diffs,
    r"""WITH t AS (SELECT doc_id AS n, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
    l AS (SELECT n, x, len(x) AS size, flatten(list_transform(range(len(x)), lambda i: list_concat(CASE WHEN i % 3 = 0 THEN [] ELSE [x[i + 1]] END, CASE WHEN i % 5 = 0 THEN ['new ' || n || ' ' || i] ELSE [] END))) AS y FROM t)
    SELECT n, CAST(size - (size + 2) // 3 AS INTEGER) AS context, CAST((size + 2) // 3 AS INTEGER) AS remove, CAST((size + 4) // 5 AS INTEGER) AS add,
        md5(array_to_string(x, chr(10))) AS before, md5(array_to_string(y, chr(10))) AS after FROM l""",
)
_DAYS = "transform(sequence(1, CAST(n % 3 AS INT)), i -> named_struct('item', concat('it', i), 'reason', 'r'))"
add(
    "narrative_diffs",
    "n long, digest string",
    lambda v: texts(v).select("n", F.expr("concat('one ', n, ' \\r\\n\\ntwo')").alias("c"), F.expr(f"CASE WHEN n % 3 = 0 THEN array() ELSE {_DAYS} END").alias("h")).select("n", content.narrative_diff("c", "h", "Changes", "Held").alias("d")).select("n", F.array_join(F.transform("d", lambda r: F.concat(r["kind"], F.lit(":"), r["content"])), "|").alias("digest")),
    """SELECT doc_id AS n, 'meta:### Changes|context:|add:one ' || doc_id || '|context:|add:two' || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '|context:|meta:### Held|context:|remove:- it1（r）' ELSE '|context:|meta:### Held|context:|remove:- it1（r）|remove:- it2（r）' END AS digest FROM documents""",
)

# -- details and the interface ----------------------------------------------------------------------------------------

add(
    "item_detail",
    "id long, publisher string, locale string, featured boolean, title string, summary string, tags string, importance int, tier string, published_at string, editor_note string, body_md5 string",
    lambda v: detail.details(v.plain, v.sources).withColumn("body_md5", F.md5("body_md")),
    """SELECT i.id, name_en AS publisher, coalesce(locale, 'multi') AS locale, coalesce(tier IN ('featured', 'p1'), false) AS featured, coalesce(title_en, title_zh, title) AS title, coalesce(summary_en, summary_zh, '') AS summary,
       array_to_string(list_slice(list_concat(list_concat(capabilities, entities), topics), 1, 6), ',') AS tags, coalesce(importance, 0) AS importance, coalesce(tier, 'all') AS tier, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at,
       coalesce(editor_note_en, editor_note_zh) AS editor_note, md5(body_md) AS body_md5 FROM items i JOIN sources s ON i.source_id = s.id WHERE enriched_at IS NOT NULL AND (tier IS NULL OR tier <> 'excluded')""",
    "items",
    "sources",
)
add(
    "item_page",
    "id long, source string, title_raw string, title_zh string, summary_en string, capabilities string, tier string, enriched_at string, event_id long, coverage long, event_tier string, event_title string, members_url string, event_note string",
    lambda v: detail.pages(v.items, v.sources, v.clusters).select(
        "id", F.col("source.id").alias("source"), F.col("title.raw").alias("title_raw"), F.col("title.zh").alias("title_zh"), F.col("summary.en").alias("summary_en"), F.array_join("tags.capabilities", ",").alias("capabilities"), "tier", "enriched_at", F.col("event.cluster_id").alias("event_id"),
        F.col("event.coverage").alias("coverage"), F.col("event.tier").alias("event_tier"), F.col("event.canonical_title.en").alias("event_title"), F.col("event.members_url").alias("members_url"), F.col("event.editor_note.zh").alias("event_note"),
    ),
    """SELECT id, source_id AS source, title AS title_raw, title_zh, summary_en, array_to_string(capabilities, ',') AS capabilities, tier, strftime(enriched_at, '%Y-%m-%d %H:%M:%S') AS enriched_at, CASE WHEN c_n > 1 THEN cluster_id END AS event_id, CASE WHEN c_n > 1 THEN c_n END AS coverage,
       CASE WHEN c_n > 1 THEN (SELECT event_tier FROM clusters c WHERE c.id = cluster_id) END AS event_tier, CASE WHEN c_n > 1 THEN c_ten END AS event_title, CASE WHEN c_n > 1 THEN '/api/v1/events/' || cluster_id || '/members' END AS members_url, CASE WHEN c_n > 1 THEN c_nzh END AS event_note FROM j""",
    "j",
)
API = "id long, title string, publisher string, source_group string, source_kind string, tier string, importance int, has_commentary boolean, cross_source_count long, cluster_id long, coverage long, canonical_title string, first_seen_at string, latest_member_at string, still_developing boolean"


def interface(v: Views, **parts) -> DataFrame:
    q = feed.FeedQuery(now=fx.NOW, **parts)
    return detail.interface_items(feed.ranked(feed.joined(v.items, v.sources, v.clusters), q), q)


def as_interface(source: str) -> str:
    return f"""SELECT id, coalesce(c_ten, title_en, title_zh, title) AS title, s_name_en AS publisher, s_grp AS source_group, s_kind AS source_kind, coalesce(eff_tier, 'all') AS tier, coalesce(eff, 0) AS importance,
        coalesce(c_nen, c_nzh, editor_note_en, editor_note_zh) IS NOT NULL AS has_commentary, CASE WHEN c_n > 1 THEN c_n - 1 END AS cross_source_count, cluster_id, CASE WHEN c_n > 1 THEN c_n END AS coverage, CASE WHEN c_n > 1 THEN c_ten END AS canonical_title,
        strftime(c_first, '%Y-%m-%d %H:%M:%S') AS first_seen_at, strftime(c_last, '%Y-%m-%d %H:%M:%S') AS latest_member_at, CASE WHEN c_first < date_trunc('day', {NOW}) AND c_last > {NOW} - INTERVAL 24 HOURS THEN true END AS still_developing FROM ({source})"""


_BASE = "enriched_at IS NOT NULL AND importance IS NOT NULL AND (cluster_id IS NULL OR c_lead = id)"
add("api_feed", API, lambda v: interface(v, tier="all", limit=100), as_interface(f"SELECT * FROM j WHERE {_BASE} AND eff_tier <> 'excluded' ORDER BY published_at DESC, eff DESC, id DESC LIMIT 100"), "j")
add("source_picker", "id string, name_en string", lambda v: detail.pick_sources(v.sources, " SRC1 "), "SELECT id, name_en FROM sources WHERE contains(lower(name_en), 'src1') OR contains(lower(name_zh), 'src1') OR contains(id, 'src1') ORDER BY id LIMIT 60", "sources")
add(
    "preset_feed",
    "preset string, total long",
    lambda v: _presets(v),
    f"""SELECT p AS preset, (SELECT count(*) FROM j WHERE {_BASE} AND eff_tier <> 'excluded' AND (s_grp = g OR s_kind = k)) AS total FROM (VALUES ('official', 'vendor-official', NULL), ('newsletter', 'newsletter', NULL), ('media', 'media', NULL), ('research', 'research', NULL), ('x', NULL, 'x-api')) t(p, g, k)""",
    "j",
)


def _presets(v: Views) -> DataFrame:
    rows = feed.joined(v.items, v.sources, v.clusters)
    base = feed.FeedQuery(now=fx.NOW, tier="all")
    counts = [F.count_if(feed.where(feed.preset(base, name))).alias(name) for name in feed.PRESETS]
    return rows.agg(*counts).unpivot([], list(feed.PRESETS), "preset", "total")


# -- search -----------------------------------------------------------------------------------------------------------


def asked(v: Views) -> DataFrame:
    """The stated queries: every vector whose id is divisible by 50."""
    return v.table("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vector"))


_NEAR = """SELECT q_id, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, id) AS rank FROM
    (SELECT q.vec_id AS q_id, r.id, round(-list_dot_product(r.embedding, CAST(q.embedding AS DOUBLE[])), 6) AS distance FROM ({}) r, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)) WHERE rank <= 20"""
add("semantic_search", "q_id long, id long, distance double, rank int", lambda v: vectors.search_all(v.found(), asked(v), 20), _NEAR.format("SELECT * FROM j WHERE embedding IS NOT NULL AND enriched_at IS NOT NULL AND eff_tier <> 'excluded' AND (cluster_id IS NULL OR c_lead = id)"), "j")
add("semantic_search_all", "q_id long, id long, distance double, rank int", lambda v: vectors.search_all(v.found(include_excluded=True), asked(v), 20), _NEAR.format("SELECT * FROM j WHERE embedding IS NOT NULL AND enriched_at IS NOT NULL AND (cluster_id IS NULL OR c_lead = id)"), "j")
add(
    "semantic_search_filtered",
    "q_id long, id long, distance double, rank int",
    lambda v: vectors.search_all(v.found(source_group="media", date_from="2024-01-05", date_to="2024-01-25"), asked(v), 20),
    _NEAR.format("SELECT * FROM j WHERE embedding IS NOT NULL AND enriched_at IS NOT NULL AND eff_tier <> 'excluded' AND (cluster_id IS NULL OR c_lead = id) AND s_grp = 'media' AND published_at >= TIMESTAMP '2024-01-05' AND published_at < TIMESTAMP '2024-01-25'"),
    "j",
)


def _vector_index(v: Views) -> vectors.Index:
    """Tuned on other vectors than the stated queries."""
    rows = v.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.Index(rows, f"{shared_dir(v.spark)}/cells-{uuid.uuid4().hex}", apart="id % 50 <> 0")


def recalled(exact: DataFrame, near: DataFrame) -> DataFrame:
    """How many rows (q_id, id) there are, and whether 0.9 of them are in `near`."""
    found = exact.select("q_id", "id").join(near.select("q_id", "id", F.lit(True).alias("hit")), ["q_id", "id"], "left")
    return found.agg(F.count("*").alias("n"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


def _recall(v: Views) -> DataFrame:
    rows = v.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return recalled(vectors.search_all(rows, asked(v), 20), _vector_index(v).search(asked(v)))


add("search_index", "q_id long, id long, distance double, rank int", lambda v: _vector_index(v).search(asked(v)))
add("search_index_recall", "n long, enough boolean", _recall, "SELECT count(*) * least(20, (SELECT count(*) FROM embeddings)) AS n, true AS enough FROM embeddings WHERE vec_id % 50 = 0")


def _in_cells(v: Views) -> DataFrame:
    return vectors.neighbours_in_cells(v.vectors, 72, 3, apart="id % 50 <> 0")


def _band_recall(v: Views) -> DataFrame:
    """Over the items with an id divisible by 50, against their exact neighbours."""
    have = v.vectors.where("embedding IS NOT NULL")
    rows = have.select("id", vectors.timed(have), "embedding")
    exact = vectors.nearest_of(rows, rows.where("id % 50 = 0"), 72, 3)
    return recalled(exact, _in_cells(v))


add("knn_cells", "q_id long, id long, distance double, rank int", _in_cells)
add(
    "knn_cells_recall",
    "n long, enough boolean",
    _band_recall,
    """SELECT sum(least(3, k))::BIGINT AS n, true AS enough FROM (SELECT a.id, count(*) AS k FROM items a JOIN items b ON a.id <> b.id AND abs(epoch(a.published_at) - epoch(b.published_at)) <= 72 * 3600
        WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND a.id % 50 = 0 GROUP BY a.id)""",
    "items",
)


def _found_items(v: Views) -> DataFrame:
    return search.results(search.by_vectors("words", asked(v), v.found(include_excluded=True), 20), v.items, v.sources)


add(
    "semantic_items",
    "q_id long, rank int, id long, distance double, title string, publisher string, tier string, importance int, tags string, url string, commented boolean",
    lambda v: _found_items(v).withColumn("tags", F.array_join("tags", ",")),
    "SELECT f.q_id, f.rank, f.id, f.distance, coalesce(title_en, title_zh, title) AS title, s_name_en AS publisher, coalesce(tier, 'all') AS tier, coalesce(importance, 0) AS importance, "
    "array_to_string(list_slice(list_concat(list_concat(capabilities, entities), topics), 1, 4), ',') AS tags, url, coalesce(editor_note_en, editor_note_zh) IS NOT NULL AS commented "
    "FROM (" + _NEAR.format("SELECT * FROM j WHERE embedding IS NOT NULL AND enriched_at IS NOT NULL AND (cluster_id IS NULL OR c_lead = id)") + ") f JOIN j ON f.id = j.id",
    "j",
)
add(
    "search_modes",
    "mode string, n long",
    lambda v: v.feed(tier="all", search="event 1", limit=500).agg(F.lit("lexical").alias("mode"), F.count("*").alias("n")).unionByName(vectors.search_all(v.found(include_excluded=True), asked(v).where("q_id = 0"), 50).agg(F.lit("semantic").alias("mode"), F.count("*").alias("n"))),
    f"""SELECT 'lexical' AS mode, least(500, count(*)) AS n FROM j WHERE {_BASE} AND eff_tier <> 'excluded' AND (title ILIKE '%event 1%' OR coalesce(title_zh ILIKE '%event 1%', false) OR coalesce(title_en ILIKE '%event 1%', false) OR coalesce(summary_zh ILIKE '%event 1%', false) OR coalesce(summary_en ILIKE '%event 1%', false) OR coalesce(c_tzh ILIKE '%event 1%', false) OR coalesce(c_ten ILIKE '%event 1%', false))
        UNION ALL SELECT 'semantic', least(50, count(*)) FROM j WHERE embedding IS NOT NULL AND enriched_at IS NOT NULL AND (cluster_id IS NULL OR c_lead = id)""",
    "j",
)

# -- exports ----------------------------------------------------------------------------------------------------------

_X = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&apos;')"
_ITEM = f"""'    <item>' || chr(10) || '      <title>' || {_X("title")} || '</title>' || chr(10) || '      <link>' || {_X("url")} || '</link>' || chr(10) || '      <description>' || {_X("d")} || '</description>' || chr(10) || '      <pubDate>' || strftime(published_at, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate>' || chr(10)
    || '      <guid isPermaLink="false">' || g || '</guid>' || chr(10) || '      <category>' || {_X("tier")} || '</category>' || chr(10) || '      <content:encoded><![CDATA[' || replace(d || ']]>', ']]>', ']]]]><![CDATA[>') || ']]></content:encoded>' || chr(10) || '    </item>'"""
_HEAD = """'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:atom="http://www.w3.org/2005/Atom">' || chr(10) || '  <channel>' || chr(10) || '    <title>A &amp; B</title>' || chr(10) || '    <link>https://a.example/</link>' || chr(10) || '    <description>all</description>' || chr(10) || '    <language>zh-CN</language>' || chr(10) || '    <lastBuildDate>'"""
add(
    "rss_channel",
    "xml string",
    lambda v: sinks.rss_channel(v.plain.where("tier = 'p1'").select("title", F.col("url").alias("link"), F.coalesce("summary_en", F.lit("")).alias("description"), "published_at", F.lpad(F.col("id").cast("string"), 9, "0").alias("guid"), "tier", F.concat(F.coalesce("summary_en", F.lit("")), F.lit("]]>")).alias("full")), "A & B", "https://a.example/", "all", fx.NOW, content="full", category="tier"),
    f"""SELECT {_HEAD} || strftime(max(published_at), '%a, %d %b %Y %H:%M:%S GMT') || '</lastBuildDate>' || chr(10) || '    <atom:link href="https://a.example/" rel="self" type="application/rss+xml" />' || chr(10) || string_agg({_ITEM}, chr(10) ORDER BY published_at DESC, g DESC) || chr(10) || '  </channel>' || chr(10) || '</rss>' AS xml
        FROM (SELECT *, coalesce(summary_en, '') AS d, lpad(CAST(id AS VARCHAR), 9, '0') AS g FROM items WHERE tier = 'p1' ORDER BY published_at DESC, lpad(CAST(id AS VARCHAR), 9, '0') DESC LIMIT 50)""",
    "items",
)
add(
    "saved_export",
    "place int, markdown string",
    lambda v: sinks.saved_markdown(_saved(v)),
    """SELECT place, '## ' || t || chr(10) || chr(10) || '- **' || name_en || '** · ' || day || ' · score `' || coalesce(importance, 0) || '` · `#' || coalesce('c' || collection_id, 'inbox') || '`' || chr(10) || '- ' || url || chr(10)
       || CASE WHEN summary_zh IS NOT NULL THEN chr(10) || summary_zh || chr(10) ELSE '' END || CASE WHEN editor_note_en IS NOT NULL THEN chr(10) || '> **Editor note**: ' || editor_note_en || chr(10) ELSE '' END || chr(10) || '---' || chr(10) AS markdown FROM
       (SELECT i.*, v.collection_id, name_en, coalesce(title_en, title_zh, title) AS t, strftime(published_at, '%Y-%m-%d') AS day, row_number() OVER (ORDER BY v.created_at DESC, v.id DESC) AS place FROM votes v JOIN items i ON v.item_id = i.id JOIN sources s ON i.source_id = s.id WHERE vote = 'save') WHERE place <= 500""",
    "votes",
    "items",
    "sources",
)


def _saved(v: Views) -> DataFrame:
    votes = v.votes.where("vote = 'save'").select(F.col("id").alias("v_id"), "item_id", F.col("collection_id").alias("c"), F.col("created_at").alias("v_at"))
    rows = votes.join(v.plain, F.col("item_id") == v.plain["id"]).join(F.broadcast(v.sources.select(F.col("id").alias("source_id"), "name_en")), "source_id")
    top = rows.orderBy(F.desc("v_at"), F.desc("v_id")).limit(500)  # what one export holds
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("v_at"), F.desc("v_id")))).select(
        "place", F.coalesce("title_en", "title_zh", "title").alias("title"), F.col("name_en").alias("publisher"), F.date_format("published_at", "yyyy-MM-dd").alias("day"), F.coalesce("importance", F.lit(0)).alias("importance"),
        F.when(F.col("c").isNotNull(), F.concat(F.lit("c"), F.col("c"))).alias("collection"), "url", F.col("summary_zh").alias("summary"), F.col("editor_note_en").alias("editor_note"),
    )


def written_csv(v: Views) -> DataFrame:
    """Titles written as CSV lines into files, and read back as lines."""
    path = f"{shared_dir(v.spark)}/csv-{uuid.uuid4().hex}"
    rows = v.plain.select(sinks.csv_line("id", "source_id", F.regexp_replace(F.concat(F.col("title"), F.when(F.col("id") % 3 == 0, ', "x"').otherwise("")), "\r", "")).alias("line"))
    sinks.write_lines(rows, "line", path)
    return v.spark.read.text(path).select(F.col("value").alias("line"))


add("csv_export", "line string", written_csv, """SELECT id || ',' || source_id || ',' || CASE WHEN contains(t, ',') OR contains(t, '"') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS line FROM (SELECT id, source_id, replace(title || CASE WHEN id % 3 = 0 THEN ', "x"' ELSE '' END, chr(13), '') AS t FROM items)""", "items")
add("jsonl_snapshot", "id long, lead_item_id long, member_count long, canonical_title_zh string", lambda v: sinks.snapshot(v.clusters.select("id", "lead_item_id", "member_count", "canonical_title_zh"), f"{shared_dir(v.spark)}/snapshot-{uuid.uuid4().hex}"), "SELECT id, lead_item_id, member_count, canonical_title_zh FROM clusters", "clusters")

# -- counts that only these need --------------------------------------------------------------------------------------

add("podcast_channels", "id string, name_en string, n long", lambda v: stats.source_counts(v.sources, v.plain, v.health, fx.NOW).join(v.sources.where("enabled").select("id", "name_en"), "id").where("grp = 'podcast'").select("id", "name_en", F.col("total").alias("n")), "SELECT s.id, name_en, count(i.id) AS n FROM sources s LEFT JOIN items i ON i.source_id = s.id WHERE grp = 'podcast' AND enabled GROUP BY s.id, name_en", "items", "sources")
add("top_sources", "source_id string, n long", lambda v: v.plain.where(F.col("published_at").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-25").cast("timestamp_ntz"))).groupBy("source_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_id").limit(20), "SELECT source_id, count(*) AS n FROM items WHERE published_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' GROUP BY source_id ORDER BY n DESC, source_id LIMIT 20", "items")
add(
    "data_state",
    "total long, enriched long, with_body long, curated long, enabled long, disabled long",
    lambda v: v.plain.agg(F.count("*").alias("total"), F.count("enriched_at").alias("enriched"), F.count_if(F.coalesce("body_md", F.lit("")) != "").alias("with_body"), F.count_if(F.col("tier").isin("featured", "p1")).alias("curated")).crossJoin(v.sources.agg(F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("disabled"))),  # one row each
    "SELECT * FROM (SELECT count(*) AS total, count(enriched_at) AS enriched, count(*) FILTER (coalesce(body_md, '') <> '') AS with_body, count(*) FILTER (tier IN ('featured', 'p1')) AS curated FROM items), (SELECT count(*) FILTER (enabled) AS enabled, count(*) FILTER (NOT enabled) AS disabled FROM sources)",
    "items",
    "sources",
)
add("reset_tiers", "tier string, n long", lambda v: v.plain.where("tier IN ('featured', 'p1', 'all') AND enriched_at IS NOT NULL").groupBy("tier").agg(F.count("*").alias("n")), "SELECT tier, count(*) AS n FROM items WHERE tier IN ('featured', 'p1', 'all') AND enriched_at IS NOT NULL GROUP BY tier", "items")
add("source_groups", "grp string, n long, ids string, ok long, failing long", lambda v: v.sources.join(F.broadcast(v.health.select("source_id", "status")), F.col("id") == F.col("source_id"), "left").groupBy("grp").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("failing")), "SELECT grp, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS failing FROM sources s LEFT JOIN health h ON s.id = h.source_id GROUP BY grp", "health")


def errors(v: Views) -> DataFrame:
    """The latest errors of enabled sources: level, code and message."""
    rows = health_table(v).withColumn("last_error", F.expr("CASE WHEN status <> 'ok' THEN concat(CASE WHEN consecutive_failures % 2 = 0 THEN 'http_5xx: ' ELSE '' END, 'went wrong ', source_id, '\\nat line 1') END"))
    parts = content.error_parts("last_error")
    both = v.sources.where("enabled").select("id").join(F.broadcast(rows.where("last_error IS NOT NULL")), F.col("id") == F.col("source_id"))
    top = both.orderBy(F.desc("last_fetched_at"), "id").limit(20)
    return top.select("id", F.when(F.col("consecutive_failures") >= 3, "error").otherwise("warn").alias("level"), parts["code"].alias("code"), parts["message"].alias("message"))


add("error_log", "id string, level string, code string, message string", errors, """SELECT id, CASE WHEN consecutive_failures >= 3 THEN 'error' ELSE 'warn' END AS level, CASE WHEN consecutive_failures % 2 = 0 THEN 'http_5xx' ELSE 'error' END AS code, 'went wrong ' || id AS message
    FROM (SELECT s.id, h.consecutive_failures, CAST(substr(s.id, 4) AS INT) AS k FROM sources s JOIN health h ON s.id = h.source_id WHERE enabled AND status <> 'ok') ORDER BY k, id LIMIT 20""", "health")
add("transcript_queue", "id long, rank int", lambda v: digest.transcript_queue(v.plain.withColumn("url", F.expr("CASE id % 4 WHEN 0 THEN concat('https://www.youtube.com/watch?v=', id) WHEN 1 THEN concat('https://youtu.be/', id) ELSE url END"))), "SELECT id, CASE tier WHEN 'featured' THEN 0 WHEN 'p1' THEN 1 WHEN 'all' THEN 2 WHEN 'excluded' THEN 3 ELSE 4 END AS rank FROM items WHERE body_md IS NULL AND id % 4 < 2 ORDER BY rank, published_at DESC, id LIMIT 50", "items")
def _windows(v: Views) -> DataFrame:
    """The windows of digests that are run 37 minutes into each hour that has events."""
    hours = v.table("events").where("ts IS NOT NULL").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).distinct()
    now = F.col("h") + F.expr("INTERVAL 37 MINUTES")
    hour, day = F.date_trunc("hour", now).cast("timestamp_ntz"), F.date_trunc("day", now).cast("timestamp_ntz")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    row = lambda kind, since, until: F.struct(F.lit(kind).alias("kind"), text(since).alias("since"), text(until).alias("until"))
    both = F.array(row("daily", hour - F.expr("INTERVAL 24 HOURS"), hour), row("monthly", day - F.expr("INTERVAL 30 DAYS"), day))
    return hours.select(text("h").alias("hour"), F.explode(both).alias("w")).select("hour", "w.*")


_HOURS = "(SELECT DISTINCT date_trunc('hour', ts) AS h FROM events WHERE ts IS NOT NULL)"
_text = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M')"
add(
    "digest_window",
    "hour string, kind string, since string, until string",
    _windows,
    f"""SELECT {_text("h")} AS hour, 'daily' AS kind, {_text("h - INTERVAL 24 HOURS")} AS since, {_text("h")} AS until FROM {_HOURS}
        UNION ALL SELECT {_text("h")}, 'monthly', {_text("date_trunc('day', h) - INTERVAL 30 DAYS")}, {_text("date_trunc('day', h)")} FROM {_HOURS}""",
)


add("items_by_day", "day string, n int, ids string", lambda v: v.plain.where("tier = 'p1'").groupBy(F.date_format("published_at", "yyyy-MM-dd").alias("day")).agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("t"), "id"))).alias("l")).select("day", F.size("l").alias("n"), F.array_join(F.transform("l", lambda r: r["id"].cast("string")), ",").alias("ids")), "SELECT strftime(published_at, '%Y-%m-%d') AS day, count(*) AS n, string_agg(id, ',' ORDER BY published_at DESC, id) AS ids FROM items WHERE tier = 'p1' GROUP BY day", "items")
