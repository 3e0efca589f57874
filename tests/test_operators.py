import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import text as T
from tessera.functions import numeric
from tessera.functions.labels import label_text
from tessera.operators import chunks, clock, context, detect, inference, overlay, retrieval, stats
from tessera.plans import queries
from tessera.sources import files


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_clock_fallbacks_and_regression(spark):
    rows = [(1, 0, 100.0, 30.0), (1, 1, 50.0, 30.0), (2, 0, None, 25.0), (2, 1, None, 25.0), (3, 1, float("nan"), None)]
    got = clock.stamp(spark.createDataFrame(rows, "source long, frame_index long, reported_ms double, fps double")).orderBy("source", "frame_index").collect()
    assert [(r.media_ms, r.time_source, r.adjusted) for r in got[:4]] == [(100.0, "reported", False), (100.0, "reported", True), (0.0, "derived_from_frame_rate", False), (40.0, "derived_from_frame_rate", False)]
    assert got[4].time_source == "derived_from_index" and abs(got[4].media_ms - 1000 / 30) < 1e-9


def test_failed_reads(spark):
    rows = spark.createDataFrame([("a", 0, True, False), ("a", 1, False, False), ("a", 2, True, False)], "source string, frame_index long, read_ok boolean, is_empty boolean")
    assert clock.classify_reads(rows).count() == 1
    with pytest.raises(Exception, match="can't be decoded"):
        clock.classify_reads(rows.filter("frame_index = 1")).collect()


def test_letterbox_and_restore(spark):
    for w, h, scale, left, top in ((1280, 720, 0.5, 0, 140), (720, 1280, 0.5, 140, 0), (640, 640, 1.0, 0, 0), (1279, 719, None, 0, 140)):
        g = one(spark, F.struct(*[c.alias(k) for k, c in G.letterbox(F.lit(w), F.lit(h)).items()]))
        assert (g.pad_left, g.pad_top) == (left, top) and (scale is None or g.scale == scale)
    b = G.restored(G.from_center(F.lit(320.0), F.lit(360.0), F.lit(80.0), F.lit(60.0)), F.lit(0.5), F.lit(0.0), F.lit(140.0), F.lit(1280.0), F.lit(720.0))
    assert list(one(spark, F.array(*b))) == [560, 380, 720, 500]


def test_suppression(spark):
    rows = [(0, 0, 0, 0.9, 10.0, 10.0, 50.0, 50.0), (0, 0, 0, 0.8, 12.0, 12.0, 48.0, 48.0), (0, 1, 0, 0.9, 10.0, 10.0, 50.0, 50.0), (0, 1, 1, 0.8, 12.0, 12.0, 48.0, 48.0)]
    found = detect.suppressed(spark.createDataFrame(rows, "source long, frame_index long, class_id int, confidence double, x_min double, y_min double, x_max double, y_max double"))
    assert {r["frame_index"]: r["n"] for r in found.groupBy("frame_index").agg(F.count("*").alias("n")).collect()} == {0: 1, 1: 2}


def test_assoc_cost_of_each_group(spark, tmp_path):
    # two tracks and a detection of one class, overlapping by a third and by a ninth; a box without a partner; another frame's pair
    rows = [(1, 10, 3, 0.08), (1, 30, 3, 0.07), (1, 10, 27, 0.06), (1, 10, 4, 0.05), (2, 10, 3, 0.08), (2, 30, 3, 0.07)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_discount double").withColumn("l_quantity", F.lit(20.0))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = queries.QUERIES["assoc_cost"](spark, str(tmp_path))
    assert got.columns == ["source", "frame_index", "class_id", "n", "cost"]
    assert sorted(map(tuple, got.collect())) == [(0, 1, 0, 2, 2.666667), (0, 2, 0, 1, 0.666667)]


def test_best_class_ties_and_nan(spark):
    nan = float("nan")
    rows = spark.createDataFrame([([0.1, 0.5, 0.5],), ([0.1, nan, 0.3],), ([nan, 0.9, 0.1],)], "s array<double>")
    got = [r["b"] for r in rows.select(detect.best_class("s").alias("b")).collect()]
    assert (got[0].class_id, got[1].class_id, got[1].confidence) == (1, 2, 0.3)
    assert got[2].class_id == 0 and math.isnan(got[2].confidence)


def test_percentile_slowest_and_rolling(spark):
    got = spark.range(1, 101).select(F.col("id").cast("double").alias("x")).agg(stats.nearest_rank("x", 0.95).alias("p")).first()["p"]
    assert got == 95
    stages = spark.createDataFrame([("a", "decode", 1.0), ("a", "render", 3.0), ("a", "inference", 3.0)], "source string, stage string, mean_ms double")
    assert stats.slowest_stage(stages).first()["slowest_stage"] == "render"
    frames = spark.createDataFrame([(0, k, 50.0 * k) for k in range(41)], "source long, frame_index long, media_ms double")
    assert [r["fps"] for r in stats.rolling_fps(frames).orderBy("frame_index").collect()] == [20.0, 20.0]


def test_labels_and_formats(spark):
    assert one(spark, label_text(F.lit("confirmed"), F.lit(0), F.lit(42), F.lit(91))) == "person #42 0.91"
    assert one(spark, label_text(F.lit("tentative"), F.lit(0), F.lit(42), F.lit(91))) == "person ?"
    assert one(spark, overlay.format_ms(F.lit(float("nan")))) == "--" and one(spark, overlay.format_ms(F.lit(0.25))) == "0.2"
    values = [0.15, 0.35, 2.5, 0.05, 1.005, 99.95, 1e-9, 123456.75, 0.45, -0.04, -1.25, 7.0, *[k / 200 for k in range(1, 400, 2)]]
    table = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (0, 1, 2, 3):
        assert [r[0] for r in table.select(numeric.fixed(F.col("x"), digits)).collect()] == [f"{x:.{digits}f}" for x in values]
    assert one(spark, numeric.fixed(F.lit(float("inf")), 1)) is None


def test_dump_line(spark):
    row = (0, 7, 233.333, 42, 0, "confirmed", 10.0, 20.0, 110.0, 220.0, 0.91)
    tracks = spark.createDataFrame([row], "source long, " + "frame_index long, media_ms double, track_id long, class_id int, state string, x_min double, y_min double, x_max double, y_max double, confidence double")
    assert files.dump_lines(tracks).first()["line"] == "7,233.333,42,0,confirmed,10.000,20.000,110.000,220.000,0.9100"


def test_tokens(spark):
    assert one(spark, T.tokenize(F.lit("DecodeStage next bounded_queue"))) == ["decode", "stage", "next", "bounded", "queue"]
    assert T.tokens_of("DecodeStage next bounded_queue") == ["decode", "stage", "next", "bounded", "queue"]
    assert one(spark, T.slug(F.lit(" Interfaces produced! "))) == "interfaces_produced"
    assert one(spark, T.module_path(F.lit("src/pipeline/mod.rs"))) == "pipeline"


def test_inference_fit_and_decode():
    image = np.random.default_rng(0).integers(0, 255, (72, 128, 3), np.uint8)
    tensor, transform = inference.prepared(image)
    assert tensor.shape == (1, 3, 640, 640) and abs(float(tensor[0, 0, 0, 0]) - 114 / 255) < 1e-6
    out = np.zeros(inference.OUTPUT_SHAPE, np.float32)
    out[0, :4, 0] = (320, 320, 80, 60)
    out[0, 4 + 5, 0] = 0.25
    out[0, :4, 1] = (320, 320, 80, 60)
    out[0, 4, 1] = 0.24
    found = inference.decoded(out, transform)
    assert len(found) == 1 and found.class_id.iloc[0] == 5 and abs(found.x_min.iloc[0] - 56) < 1e-3


def test_inference_on_spark(spark):
    rows = [("a", 0, 0.0, 4, 6, bytes(range(72)))]
    frames = spark.createDataFrame(rows, "source string, frame_index long, media_ms double, height int, width int, data binary")

    def model(tensor):
        out = np.zeros((1, 84, 8400), np.float32)
        out[0, :4, 3], out[0, 7, 3] = (320, 320, 100, 100), 0.5
        return out

    got = inference.candidates_of(frames, model).collect()
    assert [(r.class_id, r.source) for r in got] == [(3, "a")]


SOURCE = '''/// Opens it.
pub struct Shutdown { flag: bool }

impl Shutdown {
    pub fn request(&self) -> bool { true }
}

pub const LIMIT: usize = 4;

pub fn send(x: u32) -> u32 {
    if x > 1 { x } else { 2 }
}

#[cfg(test)]
mod tests { fn hidden() {} }
'''
PLAN = "# Plan\n\nintro\n\n## Interfaces produced\n\nUse `Shutdown` and `send_all` in src/pipeline/queue.rs\n\n```rust\npub fn send(x: u32) -> u32\n```\n"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("src/pipeline/queue.rs", SOURCE), ("scripts/run.sh", "#!/bin/bash\necho 1\n"), ("docs/development/plans/VE-014-x.md", PLAN), ("docs/development/specs/VE-014-y.md", "## Goal\n\nbounded queue, see run.sh\n")]
    table = spark.createDataFrame(rows, "path string, content string")
    return table, chunks.corpus(table).cache()


def test_chunks(corpus):
    _, found = corpus
    got = {(r["kind"], r["symbol"]) for r in found.collect()}
    assert {("struct", "Shutdown"), ("impl", "Shutdown"), ("fn", "send"), ("const", "LIMIT"), ("fn", "request"), ("script", "run"), ("doc", "interfaces_produced"), ("doc", "goal"), ("plan_ref", "Shutdown")} <= got
    assert not any(s == "hidden" for _, s in got)


def test_artifacts_and_context(corpus):
    table, found = corpus
    art = chunks.artifacts(table.filter("path like '%.md'"))
    row = art.first()
    assert row["task_id"] == "VE-014" and row["files"] == ["scripts/run.sh", "src/pipeline/queue.rs"] and row["symbols"] == ["Shutdown", "send_all", "send"]
    ranked = found.withColumn("embedding", F.array().cast("array<double>"))
    got = context.task_context(ranked, art, "VE-014").collect()
    assert [r["reason"] for r in got][:2] == ["task_doc", "task_doc"] and "task_symbol:Shutdown" in [r["reason"] for r in got]
    assert len({(r["path"], r["symbol"]) for r in got}) == len(got) <= 8


def test_hybrid_rank_prefers_the_named_symbol(spark):
    base = ("src/pipeline/queue.rs", "fn", "", "", "", "pipeline::queue", [], None, [1.0, 0.0], 1, 1)
    rows = [(k, base[0], s, *base[1:4], f"fn {s} queue", *base[5:]) for k, s in enumerate(("recv", "send"))]
    table = spark.createDataFrame(rows, "pos long, path string, symbol string, kind string, signature string, doc string, body string, module_path string, neighbors array<string>, task_id string, embedding array<double>, line_start int, line_end int")
    assert retrieval.search(table, "queue send", vector=[1.0, 0.0]).first()["symbol"] == "send"
    assert retrieval.rank_chunks(table, retrieval.Query("queue"), 0).count() == 0


def test_index_round_trip(spark, tmp_path, corpus):
    table, found = corpus
    listed = table.withColumn("mtime_us", F.lit(5).cast("long"))
    built = files.refreshed(spark, str(tmp_path / "index"), listed, lambda f: found)
    assert built.count() == found.count()
    assert files.staleness(spark.read.parquet(str(tmp_path / "index/files")), listed).count() == 0
    later = listed.withColumn("mtime_us", F.when(F.col("path").endswith(".sh"), 50).otherwise(5).cast("long"))
    assert [r["change"] for r in files.staleness(listed, later).collect()] == ["changed"]
    assert files.read_index(spark, str(tmp_path / "none")) is None


def test_golden_reader(spark, tmp_path):
    rows = [{"phase": p, "query": "q", "expected": [{"path": "a", "symbol": None}]} for p in (1, 2, 5)]
    (tmp_path / "q.json").write_text(json.dumps(rows))
    assert files.read_golden(spark, str(tmp_path / "q.json"), 1).count() == 1
    assert files.read_golden(spark, str(tmp_path / "q.json"), 3).count() == 3


def test_test_code_by_spans():
    from tessera.operators.chunks import without_tests

    source = "fn a() {}\n#[cfg(test)]\nimpl X { fn t() { {} } }\nfn b() {}\n#[cfg(test)]\nimpl Y {\n fn open() {\n"
    assert without_tests(source) == "fn a() {}\n\nfn b() {}\n{\n fn open() {\n"
    assert without_tests("fn a() {}\n#[cfg(test)]\nmod tests {\n}\nfn late() {}") == "fn a() {}\n"
    assert without_tests("#[cfg(test)]\nimpl Z;") == "" and without_tests("fn c() {}") == "fn c() {}"


def test_words_are_those_of_two_steps():
    import re

    from tessera.functions.text import tokens_of

    for text in ("DecodeStage next bounded_queue", "HTTPServer2X a1B2C", "x::y--z__w", "éA1é", "", "ABC", "aB9c D"):
        split = re.sub("([a-z0-9])([A-Z])", r"\1 \2", text)
        assert tokens_of(text) == [t.lower() for t in re.findall("[A-Za-z0-9]+", split)]


def test_median_and_percentile_leave_nan_out(spark):
    from tessera.operators import stats

    rows = spark.createDataFrame([(1, float("nan")), (1, 3.0), (1, 1.0), (1, 2.0), (2, None)], "source int, fps double")
    assert [tuple(r) for r in stats.median_of_runs(rows, "fps").collect()] == [(1, 3, 2.0)]
    assert {r.source: r.p for r in rows.groupBy("source").agg(stats.nearest_rank("fps", 0.95).alias("p")).collect()} == {1: 3.0, 2: 0.0}
