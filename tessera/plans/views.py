"""Views of the supplied tables in the shape of frames, detections, metrics and chunks; integer arithmetic, so that all engines agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import KIND_ORDER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten thousand orders are a source of a thousand frames."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    return rows.select(
        F.expr("l_orderkey div 10000").alias("source"),
        (F.col("l_orderkey") % 1000).alias("frame_index"),
        (F.col("l_suppkey") % 3).cast("int").alias("class_id"),
        (F.col("l_partkey") % 40).cast("double").alias("cx"),
        (F.col("l_suppkey") % 30).cast("double").alias("cy"),
        (20 + F.col("l_quantity")).alias("w"),
        (20 + F.col("l_quantity")).alias("h"),
        (0.2 + 8 * F.col("l_discount")).alias("confidence"),
    )


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source per user; every seventh reported time goes back, every eleventh is missing."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    rows = rows.withColumns({"frame_index": (F.row_number().over(order) - 1).cast("long"), "first": F.min("us").over(Window.partitionBy("user_id"))})
    ms = (F.col("us") - F.col("first")) / F.lit(1000.0)
    told = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 7 == 0, ms - 5000.0).otherwise(ms)
    fps = F.when(F.col("user_id") % 2 == 0, F.lit(25.0))
    return rows.select(F.col("user_id").alias("source"), "frame_index", told.alias("reported_ms"), fps.alias("fps"), "event_id", ms.alias("ms"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    v = F.col("value")
    return e.select(
        F.col("user_id").alias("source"), F.col("event_id").alias("frame_index"),
        (v * 1.0).alias("decode_ms"), (v * 0.5 + F.col("event_id") % 5).alias("preprocess_ms"), (v * 2.0).alias("inference_ms"), (v * 0.25).alias("tracking_ms"), (v * 0.125).alias("render_ms"),
        (F.col("event_id") % 3).alias("depth"), F.lit(2).alias("capacity"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    kind = F.element_at(F.array(*[F.lit(k) for k in KIND_ORDER]), (F.col("doc_id") % 9 + 1).cast("int"))
    return docs.join(vectors, "doc_id", "left").select(
        F.col("doc_id").alias("pos"), F.concat("source", F.lit("/"), "lang").alias("path"), F.get(F.split("text", " "), F.lit(0)).alias("symbol"), kind.alias("kind"), F.lit("").alias("signature"), F.lit("").alias("doc"),
        F.col("text").alias("body"), F.col("lang").alias("module_path"), F.array().cast("array<string>").alias("neighbors"), F.lit(None).cast("string").alias("task_id"), "embedding", F.lit(1).alias("line_start"), F.lit(1).alias("line_end"),
    )
