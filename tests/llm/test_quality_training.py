"""All trusted rows train or set thresholds, however many there are."""

import pytest
from pyspark.sql import functions as F
from test_models import Dictionaries

from assetlake.llm import quality_classifier
from assetlake.llm.scratch import written


def test_every_trusted_row_trains_but_the_fifth_that_is_held(spark):
    spread = F.conv(F.xxhash64("id", F.lit(1)).cast("string"), 10, 36)
    rows = spark.range(24_000).select(F.when(F.col("id") % 100 > 0, F.col("id")).alias("doc_id"), F.substring(spread, 2, 3).alias("text"), F.lit("en").alias("lang"))
    docs = written(rows.union(rows.limit(50)).repartition(4), "docs")
    labels = spark.range(24_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, 1).otherwise(0).alias("quality"))
    held = {r.doc_id for r in labels.filter("quality = 1 AND pmod(xxhash64(doc_id, 5), 5) = 0").collect()}
    plain = Dictionaries([r.text for r in docs.collect() if r.doc_id is not None and r.doc_id % 7 and r.doc_id not in held])
    got = quality_classifier.quality_classifier(docs, labels).collect()
    assert len(got) == 24_050 and len({r.threshold for r in got}) == 1
    for r in got[::40]:
        assert r.perplexity == pytest.approx(plain.perplexity(r.text), rel=1e-9)
    for r in got[::40]:
        assert r.keep == (r.perplexity <= r.threshold)


def test_a_table_that_is_dealt_out_otherwise_is_an_error(spark):
    docs = written(spark.range(10).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text")).repartition(2), "docs")
    learns = quality_classifier._learning(docs.select("doc_id"), spark.range(4).select(F.col("id").alias("doc_id")))
    assert sum(n for n, _ in learns.values()) == 10 and sum(bin(x).count("1") for _, bits in learns.values() for x in bits) == 4
    with pytest.raises(Exception, match="dealt out otherwise"):
        quality_classifier._listed(docs.limit(9).repartition(1).select("text"), learns).count()
