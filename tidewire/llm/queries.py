"""The registered queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, decontaminate, forest, gif, lines, negatives, pii, quality, repeats, tokenpack, toxicity, urls
from .common import shared_dir, table

TOKENIZER, VOCAB = "word_bpe_49k.json", 49_408


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"), run=lines.RUN)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op3_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.join(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenpack.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), VOCAB, end_id=1)
    return tokenpack.read(spark, path)


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.read_back(gif.media(table(spark, sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"), passage=50)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.quantised(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", F.when(F.col("id") == negatives.NO_ID, F.col("label")).otherwise(moved)))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(docs, pii.train(pii.sampled(docs)))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (op1_lines, op2_decontaminate, op3_jaccard_forest, op4_toxicity, op5_token_output, op6_gif, op7_quality, op8_suffix_repeats, op9_url_filter, op10_bpe, op11_hard_negatives, op12_personal_data, op13_conversation_repair)
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    # lines by their text; sentences likewise, and islands of neighbours that all stand earlier
    "op1_lines": r"""
WITH p AS (SELECT doc_id, i, ps[i] AS piece FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i
             FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n]+\n?|\n') AS ps FROM documents))),
u AS (SELECT doc_id, i, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
             lower(trim(regexp_replace(piece, '\s+', ' ', 'g'))) AS norm FROM p),
w AS (SELECT *, a + length(piece) AS b, norm <> '' AS counts, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, a) > 1 AS gone FROM u),
q AS (SELECT doc_id, i, ps[i] AS piece FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i
             FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n.!?]+[.!?]*|[\n.!?]') AS ps FROM documents))),
v AS (SELECT doc_id, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
             lower(trim(regexp_replace(piece, '\s+', ' ', 'g'))) AS norm, NOT regexp_matches(piece, '^[\n.!?]$') AS whole FROM q),
s AS (SELECT doc_id, a, a + length(piece) AS b, len(string_split(norm, ' ')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k,
             row_number() OVER (PARTITION BY norm ORDER BY doc_id, a) > 1 AS gone FROM v WHERE norm <> '' AND whole),
g AS (SELECT s.*, s.k - row_number() OVER (PARTITION BY s.doc_id ORDER BY s.k) AS island FROM s ASOF JOIN w ON s.doc_id = w.doc_id AND s.a >= w.a WHERE s.gone AND NOT w.gone),
runs AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM g GROUP BY doc_id, island HAVING sum(n) >= 20),
spans AS (SELECT doc_id, a, b, true AS line FROM w WHERE gone UNION ALL SELECT doc_id, a, b, false FROM runs),
cuts AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS last FROM spans),
r AS (SELECT c.doc_id, count(*) FILTER (line) AS n_removed, count(*) FILTER (NOT line) AS n_runs, sum(b - a) AS chars_removed, max(b) AS upto,
             string_agg(CAST(a AS BIGINT) || '-' || CAST(b AS BIGINT), ',' ORDER BY a) AS removed,
             string_agg(substring(text, CAST(last + 1 AS BIGINT), CAST(a - last AS BIGINT)), '' ORDER BY a) AS kept FROM cuts c JOIN documents d ON c.doc_id = d.doc_id GROUP BY c.doc_id),
n AS (SELECT doc_id, count(*) FILTER (counts) AS n_units FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, CAST(coalesce(chars_removed, 0) AS BIGINT) AS chars_removed,
       coalesce(removed, '') AS removed, sha256(coalesce(kept, '') || substring(coalesce(text, ''), CAST(coalesce(upto, 0) + 1 AS BIGINT))) AS kept_sha256, r.doc_id IS NOT NULL AS changed
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN r ON d.doc_id = r.doc_id""",
    "op2_decontaminate": rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover ON d.doc_id = cover.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
    "op11_hard_negatives": """
WITH x AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.id AS a, a.v AS av, o.id AS o, o.label = a.label AS same, o.id = a.id AND o.v = a.v AND o.label = a.label AS own, list_dot_product(a.v, o.v)::BIGINT AS score
  FROM x a, x o WHERE a.id % 50 = 0),
p AS (SELECT a, av, o, score FROM s WHERE same AND NOT own QUALIFY row_number() OVER (PARTITION BY a, av ORDER BY score DESC, o) <= 5),
n AS (SELECT p.a, p.o AS pos, p.score AS ps, s.o AS neg, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.av, p.o, p.score ORDER BY s.score DESC, s.o) AS rank
  FROM p JOIN s ON p.a = s.a AND p.av = s.av AND NOT same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, pos AS positive_id, rank::INTEGER AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3""",
    # crc32 by its table; costs to go backward, row by row, as [start, system, user, assistant]; then one edit a step forward
    "op13_conversation_repair": r"""
WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS c FROM conversations, tab),
rows0 AS (SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN c = 1 THEN '' WHEN c = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN c = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE c <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM rows0),
judged AS (SELECT *, left(role, 1) AS r, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed),
f AS (SELECT *, CASE WHEN seen = '' THEN 'b' WHEN again THEN 'd' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'f' END AS fault,
    lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS after FROM judged),
g AS (SELECT *, fault IN ('b', 'd') AS dead, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS m FROM f),
sizes AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (r || after NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
bw AS (SELECT conv_id, n + 1 AS i, [0, 6, 3, 0]::BIGINT[] AS v FROM sizes
  UNION ALL SELECT conv_id, i, [least(w[1], 3 + w[3], 6 + w[4]), least(w[2], 3 + w[3], 6 + w[4]), least(w[3], 3 + w[4]), least(w[4], 3 + w[3])]
  FROM (SELECT b.conv_id, g.i, CASE WHEN dead THEN [4 + v[1], 4 + v[2], 4 + v[3], 4 + v[4]] ELSE [
      least(4 + v[1], CASE WHEN r = 's' THEN m + v[2] ELSE 999999999 END, CASE WHEN r = 'u' THEN m ELSE 3 + m END + v[3]),
      least(4 + v[2], CASE WHEN r = 'u' THEN m ELSE 3 + m END + v[3]),
      least(4 + v[3], CASE WHEN r = 'a' THEN m ELSE 3 + m END + v[4]),
      least(4 + v[4], CASE WHEN r = 'u' THEN m ELSE 3 + m END + v[3])] END AS w
    FROM bw b JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id AND g.i = b.i - 1)),
fw AS (SELECT conv_id, 1::BIGINT AS i, 1 AS s, '' AS audit, []::VARCHAR[] AS turns, false AS over FROM sizes
  UNION ALL SELECT conv_id, CASE WHEN e IN ('I', 'E') THEN i ELSE i + 1 END,
    CASE WHEN e = 'E' OR e = 'D' THEN s WHEN e = 'K' AND s = 1 AND r = 's' THEN 2 WHEN s = 3 THEN 4 ELSE 3 END,
    CASE WHEN e = 'E' THEN audit ELSE audit || e END,
    CASE e WHEN 'I' THEN list_append(turns, CASE WHEN s = 3 THEN 'assistant:' ELSE 'user:' END) WHEN 'K' THEN list_append(turns, role || ':' || text)
           WHEN 'R' THEN list_append(turns, CASE WHEN s = 3 THEN 'assistant:' ELSE 'user:' END || text) ELSE turns END, e = 'E'
  FROM (SELECT p.*, g.role, g.text, g.r, CASE WHEN g.i IS NULL AND s IN (1, 4) THEN 'E' WHEN here.v[s] = 4 + next.v[s] THEN 'D'
      WHEN here.v[s] = 3 + here.v[CASE WHEN s = 3 THEN 4 ELSE 3 END] THEN 'I'
      WHEN s = 1 AND r = 's' AND here.v[1] = m + next.v[2] OR r = CASE WHEN s = 3 THEN 'a' ELSE 'u' END THEN 'K' ELSE 'R' END AS e
    FROM fw p JOIN bw here ON here.conv_id IS NOT DISTINCT FROM p.conv_id AND here.i = p.i LEFT JOIN bw next ON next.conv_id IS NOT DISTINCT FROM p.conv_id AND next.i = p.i + 1
    LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.i = p.i WHERE NOT p.over))
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.v[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN bw b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 1 LEFT JOIN fw ON fw.conv_id IS NOT DISTINCT FROM c.conv_id AND over""",
}
