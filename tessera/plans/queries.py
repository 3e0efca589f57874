"""Registered queries: each applies one operator to a view of the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import text as T
from tessera.functions.labels import class_name, label_text
from tessera.operators import clock, context, detect, embedding, overlay, retrieval, stats, tracking
from tessera.plans import views as V
from tessera.sources import files

ASKED = "the runtime and of pipeline threads"
KEY = ["source", "frame_index", "class_id"]
WORDS = ["the", "and", "of", "tion"]


def r6(x) -> F.Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def candidate_filter(s: SparkSession, d: str) -> DataFrame:
    return detect.candidates(V.raw_candidates(s, d)).select("source", "frame_index", "class_id", "confidence", *G.SIDES)


def nms(s: SparkSession, d: str) -> DataFrame:
    return detect.suppressed(candidate_filter(s, d)).select("source", "frame_index", "det_idx", "class_id", "confidence", *G.SIDES)


def nms_counts(s: SparkSession, d: str) -> DataFrame:
    return nms(s, d).groupBy("source", "frame_index").agg(F.count("*").alias("n"), r6(F.sum("confidence")).alias("total"))


def det_sort_rank(s: SparkSession, d: str) -> DataFrame:
    return detect.ranked(candidate_filter(s, d)).select("source", "frame_index", "det_idx", "class_id", "confidence", *G.SIDES)


def frame_clock(s: SparkSession, d: str) -> DataFrame:
    return clock.stamp(V.stamps(s, d)).select("source", "frame_index", r6("media_ms").alias("media_ms"), "time_source", "adjusted")


def clock_summary(s: SparkSession, d: str) -> DataFrame:
    return clock.summary(clock.stamp(V.stamps(s, d))).withColumn("last_ms", r6("last_ms"))


def loop_replay(s: SparkSession, d: str) -> DataFrame:
    return clock.replay(clock.stamp(V.stamps(s, d)), 3).select("source", "frame_index", "pass", F.round("media_ms", 3).alias("media_ms"))


def frame_bound(s: SparkSession, d: str) -> DataFrame:
    return clock.bounded(V.stamps(s, d), 20).select("source", "frame_index", "event_id")


def letterbox_geometry(s: SparkSession, d: str) -> DataFrame:
    rows = V.table(s, d, "part").select("p_partkey", (F.col("p_size") * 37 + 1).alias("w"), (F.col("p_partkey") % 1080 + 1).cast("int").alias("h"))
    g = G.letterbox(F.col("w"), F.col("h"))
    return rows.select("p_partkey", *[(r6(c.cast("double")) if k == "scale" else c).alias(k) for k, c in g.items()])


def restore_boxes(s: SparkSession, d: str) -> DataFrame:
    rows = candidate_filter(s, d)
    sides = G.restored(G.box(), F.lit(0.5), F.lit(0.0), F.lit(14.0), F.lit(100.0), F.lit(60.0))
    out = rows.select("source", "frame_index", "class_id", "confidence", *G.named(sides))
    return out.filter(G.valid(G.box()))


def bbox_metrics(s: SparkSession, d: str) -> DataFrame:
    b = G.box()
    x, y = G.center(b)
    return candidate_filter(s, d).select("source", "frame_index", "class_id", "confidence", G.width(b).alias("w"), G.height(b).alias("h"), G.area(b).alias("area"), x.alias("cx"), y.alias("cy"), r6(G.aspect(b)).alias("aspect"))


def bbox_valid(s: SparkSession, d: str) -> DataFrame:
    rows = V.raw_candidates(s, d).select("source", "frame_index", F.col("cx").alias("x_min"), F.col("cy").alias("y_min"), (F.col("w") - 30).alias("x_max"), (F.col("h") - 30).alias("y_max"))
    return rows.groupBy("source").agg(F.count_if(G.valid(G.box())).alias("valid"), F.count("*").alias("n"))


def bbox_clamp(s: SparkSession, d: str) -> DataFrame:
    rows = candidate_filter(s, d).withColumn("c", G.clamped_or_null(G.box(), F.lit(30.0), F.lit(25.0)))
    return rows.select("source", "frame_index", "class_id", "confidence", F.col("c").isNotNull().alias("inside"), *[F.col(f"c.{x}").alias(x) for x in G.SIDES])


def _frame_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two alternating sets of kept boxes, as tracks and detections of one frame."""
    kept = nms(s, d)
    return kept.filter("det_idx % 2 = 0"), kept.filter("det_idx % 2 = 1")


def iou_pairs(s: SparkSession, d: str) -> DataFrame:
    a, b = _frame_tables(s, d)
    return detect.iou_pairs(a, b, 0.30, KEY).select("source", "frame_index", "class_id", "det_idx", "det_idx_b", r6("iou").alias("iou"))


def assoc_cost(s: SparkSession, d: str) -> DataFrame:
    a, b = _frame_tables(s, d)
    pairs = detect.iou_pairs(a, b, -1.0, KEY)
    return pairs.groupBy(*KEY).agg(F.count("*").alias("n"), r6(F.sum(detect.association_cost(F.col("iou")))).alias("cost"))


def unmatched_anti(s: SparkSession, d: str) -> DataFrame:
    return detect.unmatched(*_frame_tables(s, d), 0.30, KEY)


def nearest_track(s: SparkSession, d: str) -> DataFrame:
    tracks, found = _frame_tables(s, d)
    return detect.nearest_track(found, tracks, KEY).withColumn("distance", r6("distance"))


def best_class(s: SparkSession, d: str) -> DataFrame:
    rows = V.table(s, d, "embeddings").withColumn("b", detect.best_class("embedding"))
    return rows.select("vec_id", F.col("b.class_id").alias("class_id"), r6(F.col("b.confidence").cast("double")).alias("confidence"))


def label_lookup(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 90).cast("int").alias("class_id")).withColumn("class_name", class_name(F.col("class_id")))


def track_color(s: SparkSession, d: str) -> DataFrame:
    b, g, r = G.track_color(F.col("c_custkey"))
    return V.table(s, d, "customer").select("c_custkey", *[r6(c).alias(n) for n, c in (("blue", b), ("green", g), ("red", r))])


def label_text_query(s: SparkSession, d: str) -> DataFrame:
    state = F.element_at(F.array(F.lit("confirmed"), F.lit("tentative"), F.lit("lost")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return V.table(s, d, "part").select("p_partkey", label_text(state, (F.col("p_partkey") % 90), F.col("p_partkey"), F.col("p_partkey") % 101).alias("label"))


def label_origin(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("int")
    x, y = G.label_origin(k * 7 % 800, k * 13 % 450, k * 13 % 450 + 40, F.lit(90), F.lit(18), F.lit(768), F.lit(432))
    return V.table(s, d, "part").select("p_partkey", x.alias("label_left"), y.alias("label_top"))


def stage_stats(s: SparkSession, d: str) -> DataFrame:
    return stats.stage_stats(V.metrics(s, d)).select("source", "stage", r6("mean_ms").alias("mean_ms"), r6("p95_ms").alias("p95_ms"))


def slowest_stage(s: SparkSession, d: str) -> DataFrame:
    return stats.slowest_stage(stats.stage_stats(V.metrics(s, d)))


def queue_stats(s: SparkSession, d: str) -> DataFrame:
    return stats.queue_stats(V.metrics(s, d)).select("source", r6("mean_depth").alias("mean_depth"), r6("fraction_at_capacity").alias("fraction_at_capacity"), "peak_depth")


def alloc_share(s: SparkSession, d: str) -> DataFrame:
    return stats.allocation_share(V.metrics(s, d)).withColumn("share_percent", r6("share_percent"))


def _track_view(s: SparkSession, d: str) -> DataFrame:
    o = V.table(s, d, "orders")
    state = F.when(F.col("o_orderkey") % 3 == 0, "tentative").otherwise("confirmed")
    return o.select((F.col("o_custkey") % 10).alias("source"), (F.col("o_orderkey") % 500).alias("frame_index"), F.col("o_custkey").alias("track_id"), state.alias("state"))


def identity_churn(s: SparkSession, d: str) -> DataFrame:
    return stats.identity_churn(_track_view(s, d)).withColumn("churn", r6("churn"))


def confirmed_counts(s: SparkSession, d: str) -> DataFrame:
    frames = s.range(10).select(F.col("id").alias("source")).crossJoin(s.range(600).select(F.col("id").alias("frame_index")))
    return stats.confirmed_per_frame(frames, _track_view(s, d))


def soak_verdict(s: SparkSession, d: str) -> DataFrame:
    e = V.table(s, d, "events")
    at = Window.partitionBy("user_id").orderBy("event_id")
    rows = e.select(F.col("user_id").alias("run"), ((F.row_number().over(at) - 1) * 30 + F.col("event_id") % 4).cast("double").alias("elapsed_s"), (100000 + F.col("event_id") % 20000).alias("rss_kb"), (F.col("event_id") % 7).alias("live"))
    return stats.soak_verdict(rows)


def gap_sessions(s: SparkSession, d: str) -> DataFrame:
    rows = V.stamps(s, d).select("source", "ms")
    out = stats.gap_sessions(rows, "source", "ms", 7200000.0)
    return out.select("source", "session", r6("first_ms").alias("first_ms"), r6("last_ms").alias("last_ms"), "n")


def rolling_fps(s: SparkSession, d: str) -> DataFrame:
    return stats.rolling_fps(clock.stamp(V.stamps(s, d)))


def run_summary(s: SparkSession, d: str) -> DataFrame:
    out = stats.run_summary(V.metrics(s, d))
    return out.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def median_runs(s: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    runs = V.table(s, d, "events").select(F.col("user_id").alias("source"), value.alias("fps"))
    return stats.median_of_runs(runs, "fps").withColumn("median", r6("median"))


def queue_depths(s: SparkSession, d: str) -> DataFrame:
    change = F.when(F.col("event_id") % 5 < 3, 1).otherwise(-1)
    rows = V.table(s, d, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("frame_index"), change.alias("change"))
    return stats.queue_depths(rows, 8)


def loop_for(s: SparkSession, d: str) -> DataFrame:
    looped = clock.replay(clock.stamp(V.stamps(s, d)), 3)
    return clock.bounded_time(looped, 3.6e9).groupBy("source").agg(F.count("*").alias("frames"), F.max("frame_index").alias("last_frame"), F.max("pass").alias("passes"))


def dump_parity(s: SparkSession, d: str) -> DataFrame:
    o = V.table(s, d, "orders")
    left = o.select(F.col("o_orderkey").alias("line_no"), F.col("o_orderpriority").alias("line"))
    right = o.filter("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("line_no"), F.when(F.col("o_orderkey") % 40 == 0, "other").otherwise(F.col("o_orderpriority")).alias("line"))
    return stats.dump_differences(left, right)


def staleness_diff(s: SparkSession, d: str) -> DataFrame:
    c = V.table(s, d, "customer").select(F.col("c_name").alias("path"), F.col("c_custkey"))
    was = c.filter("c_custkey % 10 <> 0").select("path", (F.col("c_custkey") * 100).alias("mtime_us"))
    now = c.filter("c_custkey % 10 <> 1").select("path", (F.col("c_custkey") * 100 + F.when(F.col("c_custkey") % 7 == 0, 50).otherwise(0)).alias("mtime_us"))
    return files.staleness(was, now)


def hit_rate(s: SparkSession, d: str) -> DataFrame:
    o = V.table(s, d, "orders")
    want = o.select((F.col("o_orderkey") % 100).alias("query_id"), (F.col("o_custkey") % 20).cast("string").alias("path"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("symbol"), F.col("o_orderkey").alias("e"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    got = V.table(s, d, "lineitem").withColumn("query_id", F.col("l_orderkey") % 100).withColumn("rank", rank)
    got = got.select("query_id", "rank", (F.col("l_partkey") % 20).cast("string").alias("path"), F.col("l_linestatus").alias("symbol"))
    return stats.hit_rate(want, got, 40).select("queries", r6("rate").alias("rate"), "ok")


def _tokenized(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "documents").select(F.col("doc_id").alias("pos"), T.tokenize(F.col("text")).alias("tokens"))


def tokenize(s: SparkSession, d: str) -> DataFrame:
    return _tokenized(s, d).select(F.col("pos").alias("doc_id"), F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"), F.size(F.array_distinct("tokens")).alias("n_distinct"))


def bm25_stats(s: SparkSession, d: str) -> DataFrame:
    rows = _tokenized(s, d)
    corpus = retrieval.bm25_corpus(rows)
    return retrieval.bm25_terms(rows, corpus).select("term", "df", r6("idf").alias("idf"))


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    scores = retrieval.bm25_scores(_tokenized(s, d), WORDS).select(F.col("pos").alias("doc_id"), r6("bm25").alias("score"))
    return scores.orderBy(F.desc("score"), "doc_id").limit(50)


def _vector(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "embeddings").filter("vec_id = 7").select(F.col("embedding").alias("q")).limit(1)


def cosine_topk(s: SparkSession, d: str) -> DataFrame:
    rows = V.table(s, d, "embeddings").join(F.broadcast(_vector(s, d)))
    return rows.select("vec_id", r6(retrieval.cosine("embedding", "q")).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


def minmax_norm(s: SparkSession, d: str) -> DataFrame:
    rows = V.table(s, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n"), F.lit(0.0).alias("same"), F.lit(2.0).alias("high"))
    return retrieval.normalized(rows, "n", "same", "high").select("doc_id", r6("n").alias("n"), "same", "high")


def symbol_score(s: SparkSession, d: str) -> DataFrame:
    return V.chunks(s, d).select(F.col("pos").alias("doc_id"), r6(retrieval.symbol_score(retrieval.Query("the src1/en ndblere erth"))).alias("score"))


def body_overlap(s: SparkSession, d: str) -> DataFrame:
    q = retrieval.Query(ASKED)
    rows = V.chunks(s, d).withColumn("tokens", T.tokenize(T.search_text()))
    return rows.select(F.col("pos").alias("doc_id"), r6(retrieval.body_overlap(q)).alias("score"))


def _query(s: SparkSession, d: str) -> retrieval.Query:
    found = _vector(s, d).first()
    return retrieval.Query(ASKED, [float(x) for x in found["q"]] if found else None)


def hybrid_rank(s: SparkSession, d: str) -> DataFrame:
    best = retrieval.rank_chunks(V.chunks(s, d), _query(s, d), 40)
    return best.select("path", "symbol", "kind", r6("score").alias("score"))


def filtered_rank(s: SparkSession, d: str) -> DataFrame:
    """The path and kind filters come before all statistics of the corpus."""
    q = _query(s, d)
    best = retrieval.rank_chunks(V.chunks(s, d), retrieval.Query(ASKED, q.vector, "src", "struct"), 40, None)
    return best.select("path", "symbol", "kind", r6("score").alias("score"))


def search_results(s: SparkSession, d: str) -> DataFrame:
    found = retrieval.search(V.chunks(s, d), ASKED, 8, vector=_query(s, d).vector)
    return found.select("path", "symbol", "function", "kind", "line_start", "line_end", "score", "task_id")


def _sizes(texts: list[str]) -> list[list[float]]:
    """Stands for a model."""
    return [[len(t), t.count("e")] for t in texts]


def embed_texts(s: SparkSession, d: str) -> DataFrame:
    rows = V.chunks(s, d).withColumn("asked", T.embedding_text())
    v = embedding.with_embeddings(rows, _sizes).select("pos", F.md5("asked").alias("text_md5"), "embedding")
    return v.select("pos", "text_md5", F.get("embedding", F.lit(0)).alias("n_chars"), F.get("embedding", F.lit(1)).alias("n_e"))


def path_chunks(s: SparkSession, d: str) -> DataFrame:
    chunks = V.chunks(s, d).withColumn("line_start", (F.col("pos") * 7 % 11).cast("int"))
    return context.best_of_paths(chunks, chunks.select("path").distinct()).select("path", "symbol", "kind", "line_start", "pos")


def symbol_chunks(s: SparkSession, d: str) -> DataFrame:
    chunks = V.chunks(s, d)
    wanted = chunks.filter("pos < 200").groupBy("symbol").agg(F.min("pos").cast("int").alias("s_at"))
    return context.symbol_chunks(chunks, wanted, ["src1/en", "src2/de"]).select("s_at", "symbol", "path", "kind", "pos")


def track_dump(s: SparkSession, d: str) -> DataFrame:
    rows = nms(s, d).select("*", (F.col("frame_index") * 33.3).alias("media_ms"), F.col("det_idx").alias("track_id"), F.when(F.col("det_idx") % 2 == 0, "confirmed").otherwise("tentative").alias("state"))
    return files.dump_lines(rows)


def draw_list(s: SparkSession, d: str) -> DataFrame:
    state = F.element_at(F.array(F.lit("confirmed"), F.lit("tentative"), F.lit("lost")), F.col("det_idx") % 3 + 1)
    rows = overlay.draw_list(nms(s, d).withColumn("track_id", F.col("det_idx")).withColumn("state", state), 60, 50)
    return rows.withColumns({c: r6(c) for c in ("blue", "green", "red")})


def panel_lines(s: SparkSession, d: str) -> DataFrame:
    depths = {f"{name}_depth": F.col("depth") + k for k, name in enumerate(("decoded", "prepared", "detected", "tracked"))}
    rest = {"render_ms": F.when(F.col("frame_index") % 9 > 0, F.col("render_ms")), "fps": F.col("tracking_ms") * 3, "confirmed_tracks": F.col("depth")}
    rows = V.metrics(s, d).withColumns({**depths, **{c.replace("depth", "capacity"): F.col("capacity") for c in depths}, **rest})
    return overlay.panel_lines(rows).select("source", "frame_index", F.array_join("lines", "\n").alias("lines"))


def match_reasons(s: SparkSession, d: str) -> DataFrame:
    rows = retrieval.scored(V.chunks(s, d), _query(s, d))
    return rows.select(F.col("pos").alias("doc_id"), F.array_join("match_reasons", " ").alias("reasons"))


def chunk_sections(s: SparkSession, d: str) -> DataFrame:
    from tessera.operators.chunks import doc_chunks

    marked = F.regexp_replace("text", r"\n(?=[A-M])", "\n## ")
    pages = V.table(s, d, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), marked.alias("content"))
    return doc_chunks(pages).select("path", "line_start", "line_end", "symbol", F.md5("body").alias("body_md5"))


def slugify(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


def regex_paths(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("see src/"), F.col("lang"), F.lit("/a_"), F.col("doc_id").cast("string"), F.lit(".rs, pipeline/x.rs and run-"), (F.col("doc_id") % 7).cast("string"), F.lit(".sh; src/pipeline/x.rs"))
    return V.table(s, d, "documents").select("doc_id", F.array_join(T.paths(text), ",").alias("paths"))


def _detections(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = nms(s, d).withColumn("media_ms", F.col("frame_index") * 40.0)
    frames = found.groupBy("source").agg(F.max("frame_index").alias("last")).select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("frame_index"))
    return found, frames.withColumn("media_ms", F.col("frame_index") * 40.0)


def track_batch(s: SparkSession, d: str) -> DataFrame:
    found, frames = _detections(s, d)
    return tracking.track(found, frames)


def assignment(s: SparkSession, d: str) -> DataFrame:
    a, b = _frame_tables(s, d)
    key = ["source", "frame_index", "class_id"]
    w = Window.partitionBy(*key).orderBy("det_idx")
    a, b = a.withColumn("row_idx", F.row_number().over(w) - 1), b.withColumn("col_idx", F.row_number().over(w) - 1)
    pairs = detect.iou_pairs(a, b, -1.0, key)
    costs = pairs.select(*key, "row_idx", F.col("col_idx_b").alias("col_idx"), detect.association_cost(F.col("iou")).alias("cost"))
    return tracking.assignments(costs, key)


def assignment_cost(s: SparkSession, d: str) -> DataFrame:
    """What the assignment of each class in each frame costs, rows or columns left over at the pad's price."""
    a, b = _frame_tables(s, d)
    pairs = detect.iou_pairs(a, b, -1.0, KEY)
    w = Window.partitionBy(*KEY)
    place = lambda x: F.dense_rank().over(w.orderBy(x)) - 1
    cells = pairs.select(*KEY, place("det_idx").alias("row_idx"), place("det_idx_b").alias("col_idx"), detect.association_cost(F.col("iou")).alias("cost"))
    chosen = tracking.assignments(cells, KEY).join(cells, [*KEY, "row_idx", "col_idx"])
    return chosen.groupBy(*KEY).agg(F.count("*").alias("pairs"), r6(F.sum("cost")).alias("cost"))


def track_rules(s: SparkSession, d: str) -> DataFrame:
    return tracking.broken_rules(track_batch(s, d))


def track_births(s: SparkSession, d: str) -> DataFrame:
    """In a source's first frame every detection is a live tentative track with an id of its own."""
    first = Window.partitionBy("source").orderBy("frame_index")
    live = tracking.live_tracks(track_batch(s, d)).withColumn("k", F.row_number().over(first)).filter("k = 1")
    return live.select("source", "frame_index", "live", "confirmed", "last_id")


QUERIES = {
    "frame_clock": frame_clock, "clock_summary": clock_summary, "loop_replay": loop_replay, "frame_bound": frame_bound, "letterbox_geometry": letterbox_geometry, "restore_boxes": restore_boxes,
    "bbox_metrics": bbox_metrics, "bbox_valid": bbox_valid, "bbox_clamp": bbox_clamp, "candidate_filter": candidate_filter, "iou_pairs": iou_pairs, "best_class": best_class,
    "det_sort_rank": det_sort_rank, "nms": nms, "nms_counts": nms_counts, "assoc_cost": assoc_cost, "unmatched_anti": unmatched_anti, "label_lookup": label_lookup, "track_color": track_color,
    "label_text": label_text_query, "label_origin": label_origin, "stage_stats": stage_stats, "slowest_stage": slowest_stage, "queue_stats": queue_stats, "alloc_share": alloc_share,
    "identity_churn": identity_churn, "confirmed_counts": confirmed_counts, "soak_verdict": soak_verdict, "gap_sessions": gap_sessions, "rolling_fps": rolling_fps, "dump_parity": dump_parity,
    "staleness_diff": staleness_diff, "hit_rate": hit_rate, "tokenize": tokenize, "bm25_stats": bm25_stats, "bm25_topk": bm25_topk, "cosine_topk": cosine_topk, "minmax_norm": minmax_norm,
    "symbol_score": symbol_score, "body_overlap": body_overlap, "hybrid_rank": hybrid_rank, "match_reasons": match_reasons, "chunk_sections": chunk_sections, "slugify": slugify,
    "regex_paths": regex_paths, "track_batch": track_batch, "assignment": assignment,
    "nearest_track": nearest_track, "run_summary": run_summary, "median_runs": median_runs, "queue_depths": queue_depths, "loop_for": loop_for, "filtered_rank": filtered_rank,
    "search_results": search_results, "path_chunks": path_chunks, "embed_texts": embed_texts, "symbol_chunks": symbol_chunks, "track_dump": track_dump, "assignment_cost": assignment_cost, "track_rules": track_rules,
    "track_births": track_births, "draw_list": draw_list, "panel_lines": panel_lines,
}
