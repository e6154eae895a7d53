"""Every stage after another on odd input: nulls, repeats, clashing columns, nothing at all."""

import corpus_pipeline
from pyspark.sql import functions as F

from quire.llm import toxicity

BODY = " ".join(f"Word{k} runs by line{k} and" for k in range(40))
ROWS = [
    (1, BODY, "en", "a", 10), (1, BODY, "en", "a", 10), (2, BODY + " more", None, None, None), (3, None, "en", "a", 0), (4, "", "en", "b", 0), (None, BODY.replace("Word", "Wort"), "de", None, 3),
    (6, BODY.replace("Word", "Long") + " " + " ".join(f"x{k} y{k}" for k in range(4000)), "fr", "b", 4), (7, "é漢字 " + BODY[::-1], "fr", "c", 9), (8, "Mr. Roe wrote to x@y.org. " + BODY, "en", "c", 9),
]
CLASHING = ["row", "stats", "kept", "size", "place", "bucket", "copy", "print", "component", "found", "gaps", "entities", "whole", "mark", "parts", "length", "rank", "share", "piece", "start", "sequence_id", "offset", "ids_crc32", "lang_0", "limits", "level", "metric", "weight"]


def test_stages_on_odd_input(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit("x"))
    for given in (docs, docs.limit(0), docs.where("text is null or text = ''")):
        now, columns = given, given.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, "none")
            n = now.count()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == columns, name
            assert n <= 3 * len(ROWS) * 40, name
            assert n > 0 or given is not docs, name


def test_toxicity_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, words string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).count() == 0
    some = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.score for r in toxicity.score(some, labels).collect()} == {0.0} and toxicity.score(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0
