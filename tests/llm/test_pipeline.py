"""The stages of the corpus pipeline and the whole of it against brute force, and the SQL of the corpus queries."""

import hashlib
import random

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.engine.test_oracle import TABLES, rows
from tidewire.llm import decontaminate, queries, toxicity

from .conftest import key, prose
from .test_words import lines_by_force, sha, without

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(3)


def grams(text):
    w = decontaminate.words(text)
    n = min(5, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def one_of_each_group(rows):
    """(doc_id, text, source) that stay: all without words, and one row for each component of pairs at 0.8 or more."""
    sets, group = [grams(t) for _, t, _ in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return [(r, group[n]) for n, r in enumerate(rows)], sets


def near(seed, n=60):
    """A text and one that shares most of its grams."""
    text = prose(seed, n)
    return text, text + " tail"


def test_near_duplicates(spark):
    a, a2 = near(1)
    b, b2 = near(2)
    c, c2 = near(3)
    given = [(1, a, "y"), (1, a, "x"), (1, a, "x"), (2, a2, "x"), (4, b, "x"), (3, c, "x"), (4, c2, "x"), (None, b2, "x"), (None, prose(9, 50), "x")]
    given += [(None, prose(8, 50), "x"), (None, prose(8, 50) + " tail", "x"), (7, "", "x"), (7, "", "x"), (8, None, "x"), (9, "...", "x")]
    got = [(r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, given), "").collect()]
    grouped, sets = one_of_each_group(given)
    for g in {g for _, g in grouped}:
        members = [r for r, own in grouped if own == g]
        stay = [r for r in got if r in members]
        assert len(stay) == (1 if grams(members[0][1]) else len([r for r in got if r == members[0]]))
        assert stay[0][0] == min((r[0] for r in members), key=lambda i: (i is None, i or 0))
    assert (1, a, "x") in got and (1, a, "y") not in got
    assert len(got) == len({g for n, (_, g) in enumerate(grouped) if sets[n]}) + sum(not s for s in sets)
    assert corpus_pipeline.drop_near_duplicates(spark, frame(spark, given).limit(0), "").count() == 0


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of documents, labels and benchmark with work for each stage."""
    d, r = str(tmp_path_factory.mktemp("small")), random.Random(5)
    passage = " ".join(f"word{k}" for k in range(0, 240, 20))
    docs = [(i, f"{prose(1000 + i, 6 + i % 40)} {'vileword' if i % 3 == 0 else 'flower'} {prose(2000 + i, 8)}", f"s{i % 3}") for i in range(240)]
    docs += [(250 + i, docs[i + 1][1] + " tail", "s") for i in range(0, 30, 3)]
    docs += [(300 + i, f"{prose(500 + i, 9)}\nof was oran.\nthis line of words stands in all of them.\n{prose(600 + i, 9)}", "s") for i in range(12)]
    docs += [(400, f"{prose(700, 12)} {passage} {prose(701, 8)}", "s"), (401, passage, "s"), (402, "", "s"), (403, None, "s")]
    r.shuffle(docs)
    frame(spark, docs).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0 and i < 240)) for i in [*range(240), *range(300, 312)]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs


def test_pipeline(spark, small):
    d, docs = small
    stages = dict(corpus_pipeline.STAGES)
    now = spark.read.parquet(f"{d}/documents.parquet")

    now = stages["toxicity"](spark, now, d).cache()
    crf = toxicity.model(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    assert {r["doc_id"] for r in now.collect()} == {i for i, t, _ in docs if crf.score([t], toxicity.Emissions(crf))[0][0] < 0.5}
    assert {(r["doc_id"], r["text"]) for r in now.collect()} == {(i, t) for i, t, _ in docs if "vileword" not in (t or "")}
    have = [(r["doc_id"], r["text"], r["source"]) for r in now.collect()]
    now = stages["near_duplicates"](spark, now, d).cache()
    grouped, sets = one_of_each_group(have)
    least = {}
    for (i, *_), g in grouped:
        least[g] = min(i, least.get(g, i))
    want = {i for n, ((i, *_), g) in enumerate(grouped) if not sets[n] or i == least[g]}
    assert {r["doc_id"] for r in now.collect()} == want and len(want) < len(have)

    have = sorted((r["doc_id"], r["text"]) for r in now.collect())
    now = stages["repeated_units"](spark, now, d).cache()
    texts = [None if t is None else without(t, gone) for (_, t), (_, gone) in zip(have, lines_by_force(have), strict=True)]
    assert key((r["doc_id"], r["text"], r["n_chars"]) for r in now.collect()) == key((i, t, len(t or "")) for (i, _), t in zip(have, texts, strict=True))
    now = stages["decontamination"](spark, now, d).cache()
    got = {r["doc_id"]: r["text"] for r in now.collect()}
    assert set(got) == {i for i, _ in have} - {401} and "word80 word100 word120" not in got[400]
    assert {i: t for i, t in got.items() if i != 400} == {i: t for (i, _), t in zip(have, texts, strict=True) if i not in (400, 401)}

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in got.items()}
    want = key((i, len(x), sha(" ".join(map(str, x))), hashlib.sha256(tok.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in ids.items())
    assert key(stages["bpe"](spark, now, d).collect()) == want
    assert key(corpus_pipeline.run(spark, d).collect()) == want


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, sf_dir), con.execute(queries.SQL[name])
    assert rows(df.columns, df.collect()) == rows([x[0] for x in want.description], want.fetchall())
