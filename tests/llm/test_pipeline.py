import os
import random

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
KIND = "doc_id long, text string, lang string, source string, n_chars long, h string"


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(-1, None, None, None, None), (-2, "!?", None, None, 2), (None, "words without an id", None, None, 3), (-3, "", "en", "s", 0), (-4, "a long text " * 5000, "en", "s", 60_000)]
    real = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return real.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long")).withColumn("h", F.lit("clash")).cache()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_language_stage(spark, docs):
    """What is rejected has no letter; rows stay as they were, with columns of any name."""
    from urlatlas.llm import pipeline as p

    kept = p.language(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert rows_of(kept) == sorted((tuple(r) for r in docs.collect() if r["text"] and any(map(str.isalpha, r["text"]))), key=str)


def test_toxicity_stage(spark, docs):
    """The stage rejects what the operator calls toxic, and nothing else."""
    from urlatlas.llm import pipeline as p
    from urlatlas.llm import toxicity

    graded = toxicity.grade_toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()
    assert len(graded) == docs.count()
    kept = p.toxic(spark, docs, DATA)
    assert kept.columns == docs.columns and kept.count() == sum(not r["toxic"] for r in graded)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in graded if not r["toxic"]}


def test_exact_stage(spark, docs):
    from urlatlas.llm import pipeline as p

    twice = docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000))
    kept = p.exact(spark, twice, DATA)
    least = {}
    for r in twice.collect():
        text = r["text"] or ""
        if text not in least or (r["doc_id"] is not None and (least[text] is None or r["doc_id"] < least[text])):
            least[text] = r["doc_id"]
    assert kept.columns == docs.columns and sorted(map(str, least.values())) == sorted(str(r["doc_id"]) for r in kept.collect())


def test_near_stage(spark):
    """Against all pairs of sets of five words, one by one."""
    from test_operators import brute_components

    from urlatlas.llm import pipeline as p

    rng = random.Random(6)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)] for _ in range(6)]
    texts = {}
    for k in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 50)}"
        texts[k] = " ".join(words)
    rows = [(k, t, None, None, len(t), "clash") for k, t in texts.items()] + [(None, texts[0], None, None, 0, "clash")]
    kept = p.near(spark, spark.createDataFrame(rows, KIND), DATA)
    want = {k for k, (_, first) in brute_components(texts, 5, 80).items() if first == k}
    assert kept.columns == KIND.replace(" long", "").replace(" string", "").split(", ")
    assert {r["doc_id"] for r in kept.collect()} - {None} == want and kept.where("doc_id is null").count() == 1


def test_run(spark):
    """All stages after each other, and the thin module that the driver looks for."""
    import corpus_pipeline as c

    assert [name for name, _ in c.STAGES] == ["language_id", "toxicity", "exact_dedup", "near_duplicates", "packing"] and c.ORACLE_SQL is None
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, DATA).checkpoint()
    assert docs.select("text").distinct().count() == docs.count()
    packed = c.run(spark, DATA).cache()
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}
    lengths = [r["n"] for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths)
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("want"))
    assert whole.where("n <> want").count() == 0


def test_stages_take_empty_tables(spark, docs):
    import corpus_pipeline as c

    for _, stage in c.STAGES:
        assert stage(spark, docs.where("doc_id = 12345678"), DATA).count() == 0


def test_queries_match_sql(spark):
    import duckdb

    from urlatlas.llm import queries as q

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in q.oracle_sql().items():
        want, got = con.sql(sql), q.queries()[name](spark, DATA)
        columns = sorted(got.columns)
        at = [want.columns.index(x) for x in columns]
        assert sorted(str([r[x] for x in columns]) for r in got.collect()) == sorted(str([r[k] for k in at]) for r in want.fetchall()), name


COLUMNS = {
    "op3": "doc_id n_shingles component_id", "op4": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op5": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6": "doc_id size text_crc32 law shard slot grown_shard", "op7": "doc_id held_out n_tokens n_known train_tokens base_score score", "op8": "doc_id held_out lang_pred score",
    "op9": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op10": "doc_id severity grade toxic",
}


@pytest.mark.parametrize("number", list(COLUMNS))
def test_queries_have_their_columns(spark, number):
    """Every query over a whole table, once: a row for each document at least, and the columns that were agreed on."""
    from urlatlas.llm import queries as q

    (run,) = [f for name, f in q.queries().items() if name.startswith(f"{number}_")]
    got = run(spark, DATA).cache()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    assert set(COLUMNS[number].split()) <= set(got.columns) and {r["doc_id"] for r in got.collect()} == ids
    if number != "op4":
        assert got.count() == len(ids)
    if number == "op8":
        held = got.where("held_out").join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null")
        assert held.where("lang_pred = lang").count() >= 0.95 * held.count()


def test_language_stage_keeps_letters_when_nothing_is_learned(spark):
    from urlatlas.llm import pipeline as p

    docs = spark.createDataFrame([(1, "some text", None, "s", 9), (2, "日本", None, "s", 2), (3, "?! 1", None, "s", 4), (4, None, None, "s", None), (5, "", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in p.language(spark, docs, DATA).collect()) == [1, 2]
