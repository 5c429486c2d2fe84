"""The stages against plain Python, on a small made corpus and on the smallest tables."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docspark.llm import quality_gam
from docspark.llm.common import written

DATA = "/root/testdata/sf0.001"


def made(spark, folder):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 7)))
    good = lambda n=80: " ".join(word() for _ in range(n))
    item = good(30)
    docs, labels = {}, []
    for i in range(300):
        docs[i] = good()
    for i in range(300, 400):
        docs[i] = " ".join(word().upper() + "$$$" for _ in range(80))
    docs[400] = docs[5]
    docs[401] = docs[6] + " extra words here"
    docs[402] = good() + " " + item + " " + good()
    docs[403] = good() + " write a.b@c.org " + good()
    docs[404] = None
    labels = [(i, int(i < 300), 0) for i in range(400)]
    rows = [(i, t, "en", "s", len(t or ""), "more") for i, t in docs.items()] + [(None, good(), None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_each_stage_takes_effect(spark, tmp_path):
    texts = made(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        seen.append(docs)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert set(range(300)) | {400, 401, 402, 403, None} <= ids[0] and not ids[0] & set(range(300, 400))
    assert ids[0] - ids[1] == {400, 401}
    assert ids[1] - ids[2] == {402}
    assert ids[2] == ids[3] == ids[4]
    red = seen[3].where("doc_id = 403").first()
    assert red.text == re.sub(r"a\.b@c\.org", "[EMAIL]", texts[403]) and red.n_chars == len(red.text)
    same = seen[3].join(seen[2].withColumnRenamed("text", "before"), "doc_id").where("doc_id <> 403").where(~F.col("text").eqNullSafe(F.col("before")))
    assert same.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_gam.score(docs, quality_gam.fit_quality(docs, labels)).join(labels, "doc_id")
    held = got.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    assert held.where("predicted = quality").count() >= 0.95 * held.count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_run(spark):
    got = corpus_pipeline.run(spark, DATA).agg(F.sum("length").alias("n"), F.max("sequence_id").alias("s"), F.count("*").alias("c")).first()
    assert got.c > 100 and got.n <= (got.s + 1) * 1024 < got.n + 1024


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
