"""The corpus pipeline: odd rows, clashing names and empty tables through every stage."""

import time
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from foldstone.llm import chatformat
from foldstone.llm import queries as q
from test_llm import ODD, SF

CLASH = {"size": 7, "target": 8, "copies": 9, "score": 10, "noise": 11, "lang_pred": 12, "n_lines": 13, "dropped_lines": 14, "host": 15, "source_size": 16, "keep": 17, "raw": 18, "root": 19, "node": 20}


def clashing(spark):
    words = "the cat sat on the mat and went home with her friend to drink some tea "
    rows = [(i, t, g, s) for i, t, g, s in ODD] + [(100 + k, words * 3 + f"number {k}", "en", "a") for k in range(30)] + [(200, None, None, None), (None, None, None, None), (None, words * 9, "en", "z"), (300, "w " * 300_000, "en", "b")]
    df = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars int")
    return df.withColumns({c: F.lit(v) for c, v in CLASH.items()})


def test_every_stage_keeps_columns_and_takes_odd_rows(spark):
    docs = clashing(spark)
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert sorted(docs.columns) == sorted(columns), name
        assert 0 < docs.count() <= n, name
        kept = {c: v for c, v in CLASH.items() if name != "mixing sources" or c != "copies"}
        assert docs.select(*kept).distinct().collect() == [tuple(kept.values())], name


def test_every_stage_takes_an_empty_table(spark):
    docs = clashing(spark).where("doc_id = -1")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_language_stage_without_languages_rejects_none(spark):
    docs = clashing(spark).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, docs, SF).count() == docs.count()


def test_chat_of_many_turns_is_linear(spark):
    turns = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text é ', id) as text")
    began = time.time()
    row = chatformat.digest(chatformat.format_chat(turns)).first()
    assert row["n_turns"] == 20_000 and row["loss_chars"] == sum(len(f"text é {i}") for i in range(1, 20_000, 2)) and time.time() - began < 60


def test_chat_mask_lies_over_the_bodies(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    for r in chatformat.format_chat(turns).withColumn("turns", chatformat.read_back(F.col("formatted"))).collect():
        for m in r["loss_mask"]:
            body = r["formatted"][m["start"] : m["start"] + m["length"]]
            assert r["turns"][m["turn"]]["role"] == "assistant" and body.replace("&lt;", "<").replace("&amp;", "&") == r["turns"][m["turn"]]["text"]


def test_chat_ties_follow_the_plain_text(spark):
    rows = [(1, 0, "user", "ab!"), (1, 0, "user", "ab"), (1, None, "user", "z")]
    out = chatformat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("turns", chatformat.read_back(F.col("formatted"))).first()
    assert [t["text"] for t in out["turns"]] == ["z", "ab", "ab!"]


def test_op4_is_the_sum_of_its_turns(spark):
    want = Counter({r["conv_id"]: r["count"] for r in spark.read.parquet(f"{SF}/conversations.parquet").groupBy("conv_id").count().collect()}) + Counter({-1: 2})
    assert {r["conv_id"]: r["n_turns"] for r in q.op4(spark, SF).collect()} == want
