"""Streaming scoring equals batch scoring; sinks and the ingest helpers work."""
import os
import tempfile

from pyspark.sql import functions as F

from sieve.operators import models as md
from sieve.sources import adapters as ad
from sieve.sources.sinks import text_blocks, write_table, write_text_report
from sieve.sources.tables import materialize_once, read_sheet, rename_by_position, strip_column_names
from sieve.streaming.scoring import score_with_linear, score_with_pipeline
from tests.conftest import SMALL


def test_stream_scores_equal_batch(spark):
    v = ad.vectors(spark, SMALL)
    tr = v.filter(F.col("split") == "train")
    te = v.filter(F.col("split") == "test").select("record_id", "embedding", "y")
    model = md.fit_pipeline(tr)
    batch = {r["record_id"]: r["p"] for r in score_with_pipeline(te, model, 0.39).collect()}
    d = tempfile.mkdtemp(prefix="sieve-stream-")
    te.write.mode("overwrite").parquet(os.path.join(d, "in"))
    stream = spark.readStream.schema(te.schema).parquet(os.path.join(d, "in"))
    q = (score_with_pipeline(stream, model, 0.39).writeStream.format("memory").queryName("scored_stream")
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = {r["record_id"]: r["p"] for r in spark.sql("SELECT * FROM scored_stream").collect()}
    assert got.keys() == batch.keys()
    assert max(abs(got[k] - batch[k]) for k in got) < 1e-12
    lin = md.fit_linear_many(tr.withColumn("key", F.lit(1)), ["key"])
    s2 = score_with_linear(te, lin, 0.39).collect()
    assert len(s2) == len(batch)


def test_sinks_and_ingest(spark):
    d = tempfile.mkdtemp(prefix="sieve-sink-")
    df = spark.createDataFrame([(1, " a "), (2, "b")], "k long, ` name ` string")
    df = strip_column_names(df)
    assert df.columns == ["k", "name"]
    assert rename_by_position(df, {1: "label"}).columns == ["k", "label"]
    write_table(df, os.path.join(d, "t"), "csv")
    assert spark.read.option("header", "true").csv(os.path.join(d, "t")).count() == 2
    blocks = text_blocks(df.withColumn("rank", F.lit(1)), "k", F.lit("head"),
                         [(F.col("rank"), F.lit(0), F.col("name"))])
    assert {r["report"] for r in blocks.collect()} == {"head\n a ", "head\nb"}
    write_text_report(blocks, os.path.join(d, "rep"))
    assert spark.read.text(os.path.join(d, "rep")).count() >= 4
    built = materialize_once(spark, os.path.join(d, "cache"), lambda: df)
    again = materialize_once(spark, os.path.join(d, "cache"), lambda: 1 / 0)
    assert built.count() == again.count() == 2


def test_read_sheet_banner_and_newlines(spark):
    d = tempfile.mkdtemp(prefix="sieve-sheet-")
    with open(os.path.join(d, "s.csv"), "w") as f:
        f.write('Banner line,,\nSPECIES,REGION,TARGET\n"Foo (x)","multi\nline",1\nBar,NA,\n,,\n')
    df = read_sheet(spark, d, ["SPECIES", "REGION"], "TARGET")
    rows = sorted((r["SPECIES"], r["REGION"], r["TARGET"]) for r in df.collect())
    assert rows == [("Bar", None, None), ("Foo (x)", "multi\nline", "1")]
