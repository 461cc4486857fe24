import os

import pytest
from pyspark.sql import functions as F

from peerlume.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_terms_late_in_a_long_text_are_found(spark, tmp_path):
    for f in os.listdir(SF):
        if f != "articles.parquet":
            os.symlink(f"{SF}/{f}", tmp_path / f)
    a = spark.read.parquet(f"{SF}/articles.parquet")
    with_concerns = spark.read.parquet(f"{SF}/concerns.parquet").where("not coalesce(requires_figure_reading, false) and trim(concern_text) <> ''").select("entry_no")
    doc = a.join(with_concerns, "entry_no", "left_semi").where("entry_no % 20 <> 0").agg(F.min("entry_no")).first()[0]
    long = F.concat(F.repeat(F.lit("filler "), 6000), F.lit("zzqxterm"))
    changed = a.withColumn("abstract", F.when(F.col("entry_no") == doc, long).when(F.col("entry_no") == 20, F.lit("zzqxterm")).otherwise(F.col("abstract")))
    changed = changed.withColumn("title", F.when(F.col("entry_no") == 20, F.lit("zzqxterm")).otherwise(F.col("title"))).withColumn("paper_text_sections", F.when(F.col("entry_no") != 20, F.col("paper_text_sections")))
    changed.write.parquet(str(tmp_path / "articles.parquet"))
    assert doc in {r.doc for r in catalogue.QUERIES["bm25_topk"](spark, str(tmp_path)).where("query = 20").collect()}
