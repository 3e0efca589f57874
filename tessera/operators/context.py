"""What a task needs to see: its documents, the symbols and files it names, and search results to fill up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import SCORE_FLOOR, Query, rank_chunks

# Fixed values of the assembly.
ANCHORS = ("Shutdown", "RunStats", "FrameMetrics", "QueueDepths", "StageTimings", "METRICS_AREA_BOTTOM", "DecodedFrame", "TrackedFrame")
PATH_KINDS = ("mod", "struct", "fn", "const", "impl", "enum", "script", "plan_ref")
PASSED_OVER = ("BLOCKED", "Send")
OTHER_FILES, FILL_SYMBOLS = 4, 10
SHOWN = ("path", "symbol", "kind", "line_start", "line_end", "pos")


def _place(values, column):
    """The place of a column's value among the given ones; others come last."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]).cast("array<string>"), column)
    return F.when(at > 0, at - 1).otherwise(len(values) + 1)


def best_of_paths(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """The chunk that stands for each path: by kind, then by line."""
    order = Window.partitionBy("path").orderBy(_place(PATH_KINDS, F.col("kind")), "line_start", "pos")
    return chunks.join(paths, "path").withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def symbol_chunks(chunks: DataFrame, wanted: DataFrame, preferred: list[str]) -> DataFrame:
    """wanted: s_at, symbol. The chunk of each symbol: on a preferred path, else real code, else any; first in corpus order."""
    at = F.array_position(F.array(*[F.lit(p) for p in preferred]).cast("array<string>"), F.col("path"))
    tier = F.when((at > 0) & (F.col("kind") != "plan_ref"), 0).when(~F.col("kind").isin("plan_ref", "doc"), 1).otherwise(2)
    rows = chunks.join(wanted, "symbol").withColumn("_tier", tier).withColumn("_at", F.when(F.col("_tier") == 0, at).otherwise(0))
    order = Window.partitionBy("s_at", "symbol").orderBy("_tier", "_at", "pos")
    return rows.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k", "_tier", "_at")


def doc_headers(chunks: DataFrame, task: str) -> DataFrame:
    """The first section of the spec, and of the plan the section on interfaces, else the first."""
    docs = chunks.filter((F.col("kind") == "doc") & (F.col("task_id") == task))
    group = F.when(F.contains(F.col("path"), F.lit("/specs/")), 0).when(F.contains(F.col("path"), F.lit("/plans/")), 1)
    rows = docs.withColumn("at", group).filter("at is not null")
    lead = ((F.col("at") == 1) & (F.col("symbol") == "interfaces_produced")).cast("int")
    order = Window.partitionBy("at").orderBy(F.desc(lead), "path", "line_start")
    return rows.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def task_context(chunks: DataFrame, artifacts: DataFrame, task: str, top_k: int = 8, vector: list[float] | None = None) -> DataFrame:
    """Rows in order (place) with score, match_reasons and these joined (reason), each path and symbol once, top_k at most.

    The task's own artifact row is bounded by one document and steers the plan from the driver; all
    chunk look-ups are joins. The order in which stages give rows decides, not the scores.
    """
    spark = chunks.sparkSession
    own = artifacts.filter(F.col("task_id") == task).select("files", "symbols").first()
    files, symbols = (list(own["files"]), list(own["symbols"])) if own else ([], [])

    def staged(rows: DataFrame, stage: int, at, score: float, reason) -> DataFrame:
        return rows.select(*SHOWN, F.lit(stage).alias("stage"), at.cast("int").alias("at"), F.lit(score).alias("score"), F.array(reason).alias("match_reasons"))

    parts = [staged(doc_headers(chunks, task), 0, F.col("at"), 1.0, F.lit("task_doc"))]
    names = [s for s in symbols if s not in PASSED_OVER]
    if names:
        wanted = spark.createDataFrame(list(enumerate(names)), "s_at int, symbol string")
        found = symbol_chunks(chunks, wanted, files)
        order = F.when(F.col("symbol").isin(*ANCHORS), _place(ANCHORS, F.col("symbol"))).when(F.col("kind") == "struct", 100).otherwise(200)
        # a name without a chunk still takes its place
        ordered = wanted.join(found, ["s_at", "symbol"], "left").withColumn("at", F.row_number().over(Window.orderBy(order, "s_at"))).filter("pos is not null")
        slots = max(3, top_k // 2)
        reason = F.concat(F.lit("task_symbol:"), F.col("symbol"))
        parts.append(staged(ordered.filter(F.col("at") <= slots), 1, F.col("at"), 0.9, reason))
        parts.append(staged(ordered.filter(F.col("at") > slots), 4, F.col("at"), 0.88, reason))
    for stage, score, label, some in ((2, 0.93, "task_script:", [f for f in files if f.startswith("scripts/")]), (3, 0.95, "task_file:", [f for f in files if not f.startswith("scripts/")][:OTHER_FILES])):
        if not some:
            continue
        paths = spark.createDataFrame(list(enumerate(some)), "at int, path string")
        rows = best_of_paths(chunks, paths)
        if stage == 3 and names:
            wanted = spark.createDataFrame(list(enumerate(names)), "s_at int, symbol string")
            here = chunks.filter("kind <> 'plan_ref'").join(wanted, "symbol").join(paths, "path")
            first = Window.partitionBy("path").orderBy("s_at", "pos")
            here = here.withColumn("_k", F.row_number().over(first)).filter("_k = 1")
            rows = here.select(*SHOWN, "at").unionByName(rows.join(here.select("path"), "path", "left_anti").select(*SHOWN, "at"))
        parts.append(staged(rows, stage, F.col("at"), score, F.concat(F.lit(label), F.col("path"))))
    if names:
        fill = rank_chunks(chunks.filter(~F.col("kind").isin("doc", "plan_ref")), Query(" ".join(symbols[:FILL_SYMBOLS]), vector), top_k + 2, SCORE_FLOOR)
        parts.append(fill.withColumn("at", F.row_number().over(Window.orderBy(F.desc("score"), "kind_order", "symbol", "pos"))).select(*SHOWN, F.lit(5).alias("stage"), F.col("at").cast("int").alias("at"), "score", F.concat(F.array(F.lit(f"task:{task}")), "match_reasons").alias("match_reasons")))
    else:
        found = rank_chunks(chunks, Query(task, vector), top_k, SCORE_FLOOR)
        parts.append(found.withColumn("at", F.row_number().over(Window.orderBy(F.desc("score"), "kind_order", "symbol", "pos"))).select(*SHOWN, F.lit(6).alias("stage"), F.col("at").cast("int").alias("at"), "score", "match_reasons"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    fallback = F.min("stage").over(Window.partitionBy(F.lit(0)))
    every = every.withColumn("_least", fallback).filter("stage < 6 or _least = 6")
    once = every.withColumn("_k", F.row_number().over(Window.partitionBy("path", "symbol").orderBy("stage", "at"))).filter("_k = 1")
    # the search that fills up is asked for what is missing and two more
    before = F.count_if(F.col("stage") < 5).over(Window.partitionBy(F.lit(0)))
    once = once.withColumn("_before", before).filter((F.col("stage") != 5) | (F.col("at") <= top_k - F.col("_before") + 2))
    shown = ("path", "symbol", "kind", "line_start", "line_end", "stage", "at", F.round("score", 4).alias("score"), F.array_join("match_reasons", " ").alias("reason"), "match_reasons", "pos")
    return once.orderBy("stage", "at").limit(max(0, top_k)).select(*shown)
