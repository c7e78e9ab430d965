"""Scoring new records as they arrive (Structured Streaming).

Scoring is stateless: the fitted standardise -> PCA -> classifier pipeline is a
row-wise transform, so a streaming DataFrame passes through it unchanged.  The
collapsed linear form (``u``, ``b`` from the small-fit path) is a fitted model of
dim + 1 numbers; it is read once and inlined as literals, as Spark ML does with
model coefficients.  No join, watermark or state is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import decide
from ..functions.vectors import dot


def score_with_pipeline(stream: DataFrame, model, threshold: float, vec: str = "embedding") -> DataFrame:
    from ..operators.models import positive_score
    return positive_score(model, stream, vec).withColumn("call", decide("p", threshold))


def score_with_linear(stream: DataFrame, linear_model: DataFrame, threshold: float,
                      vec: str = "embedding") -> DataFrame:
    """``linear_model`` holds one row (u, b): dim + 1 numbers, bounded by the
    model, not by the data."""
    row = linear_model.select("u", "b").first()
    u = F.array(*[F.lit(float(x)) for x in row["u"]])
    z = dot(vec, u) + F.lit(float(row["b"]))
    out = stream.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    return out.withColumn("call", decide("p", threshold))


def start_file_scoring(spark, in_dir: str, schema, model, threshold: float, out_dir: str,
                       checkpoint_dir: str, trigger_once: bool = True):
    """Score Parquet files landing in ``in_dir`` into ``out_dir`` (exactly-once
    through the checkpoint folder, which must be on shared storage)."""
    stream = spark.readStream.schema(schema).parquet(in_dir)
    scored = score_with_pipeline(stream, model, threshold)
    w = (scored.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    return w.trigger(availableNow=True).start() if trigger_once else w.start()
