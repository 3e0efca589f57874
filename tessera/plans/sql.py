"""The same queries in DuckDB SQL, written on their own terms."""

from __future__ import annotations

RAW = """raw AS (
  SELECT l_orderkey // 10000 AS source, l_orderkey % 1000 AS frame_index, CAST(l_suppkey % 3 AS INTEGER) AS class_id, CAST(l_partkey % 40 AS DOUBLE) AS cx,
         CAST(l_suppkey % 30 AS DOUBLE) AS cy, 20 + l_quantity AS w, 20 + l_quantity AS h, 0.2::DOUBLE + 8::DOUBLE * l_discount AS confidence FROM lineitem)"""
DET = f"""{RAW}, det AS (
  SELECT source, frame_index, class_id, confidence, cx - w / 2 AS x_min, cy - h / 2 AS y_min, cx + w / 2 AS x_max, cy + h / 2 AS y_max
  FROM raw WHERE w > 0 AND h > 0 AND confidence >= 0.25)"""


def iou(a: str, b: str) -> str:
    w = f"(least({a}x_max, {b}x_max) - greatest({a}x_min, {b}x_min))"
    h = f"(least({a}y_max, {b}y_max) - greatest({a}y_min, {b}y_min))"
    both = f"(CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} ELSE 0 END)"
    area = lambda p: f"(({p}x_max - {p}x_min) * ({p}y_max - {p}y_min))"
    return f"(CASE WHEN {both} > 0 AND {area(a)} + {area(b)} - {both} > 0 THEN {both} / ({area(a)} + {area(b)} - {both}) ELSE 0.0 END)"


NMS = f"""{DET}, grp AS (
  SELECT source, frame_index, class_id, list({{'confidence': confidence, 'x_min': x_min, 'y_min': y_min, 'x_max': x_max, 'y_max': y_max}} ORDER BY confidence DESC, x_min, y_min, x_max, y_max) AS b
  FROM det GROUP BY ALL
), fold AS (
  SELECT source, frame_index, class_id, b, 1 AS i, [b[1]] AS kept FROM grp
  UNION ALL
  SELECT source, frame_index, class_id, b, i + 1,
         CASE WHEN len(list_filter(kept, lambda k: {iou('k.', 'b[i + 1].')} > 0.7)) > 0 THEN kept ELSE list_append(kept, b[i + 1]) END
  FROM fold WHERE i < len(b)
), flat AS (SELECT source, frame_index, class_id, unnest(kept) AS k FROM fold WHERE i = len(b)
), kept AS (
  SELECT source, frame_index, CAST(row_number() OVER (PARTITION BY source, frame_index ORDER BY k.confidence DESC, class_id, k.x_min, k.y_min, k.x_max, k.y_max) - 1 AS INTEGER) AS det_idx,
         class_id, k.confidence AS confidence, k.x_min AS x_min, k.y_min AS y_min, k.x_max AS x_max, k.y_max AS y_max FROM flat)"""
PAIRS = f"""{NMS}, pairs AS (
  SELECT a.source, a.frame_index, a.class_id, a.det_idx, b.det_idx AS det_idx_b, {iou('a.', 'b.')} AS iou
  FROM kept a JOIN kept b ON a.source = b.source AND a.frame_index = b.frame_index AND a.class_id = b.class_id AND a.det_idx % 2 = 0 AND b.det_idx % 2 = 1)"""
STAMPS = """ev AS (
  SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS frame_index, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS first FROM events
), stamps AS (
  SELECT user_id AS source, frame_index, event_id, (us - first) / 1000.0::DOUBLE AS ms,
         CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN (us - first) / 1000.0::DOUBLE - 5000 ELSE (us - first) / 1000.0::DOUBLE END AS told,
         CASE WHEN user_id % 2 = 0 THEN 25.0::DOUBLE END AS fps FROM ev
), rawt AS (
  SELECT *, coalesce(CASE WHEN told >= 0 THEN told END, frame_index / fps * 1000, frame_index * (1000.0::DOUBLE / 30.0::DOUBLE)) AS t,
         CASE WHEN told >= 0 THEN 'reported' WHEN fps IS NOT NULL THEN 'derived_from_frame_rate' ELSE 'derived_from_index' END AS time_source FROM stamps
), clock AS (
  SELECT source, frame_index, time_source, max(t) OVER (PARTITION BY source ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS media_ms,
         coalesce(t < max(t) OVER (PARTITION BY source ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS adjusted FROM rawt)"""
METRICS = """m AS (
  SELECT user_id AS source, value AS decode_ms, value * 0.5::DOUBLE + event_id % 5 AS preprocess_ms, value * 2.0::DOUBLE AS inference_ms, value * 0.25::DOUBLE AS tracking_ms, value * 0.125::DOUBLE AS render_ms, event_id % 3 AS depth FROM events
), long AS (
  SELECT source, 'decode' AS stage, 1 AS o, decode_ms AS ms FROM m UNION ALL SELECT source, 'preprocess', 2, preprocess_ms FROM m UNION ALL SELECT source, 'inference', 3, inference_ms FROM m
  UNION ALL SELECT source, 'tracking', 4, tracking_ms FROM m UNION ALL SELECT source, 'render', 5, render_ms FROM m)"""
TOKENS = r"""tok AS (
  SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(regexp_replace(replace(text, '::', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-]+', ' ', 'g'), '[A-Za-z0-9]+'), lambda t: lower(t)) AS tokens FROM documents)"""


def tokens(x: str) -> str:
    return rf"list_transform(regexp_extract_all(regexp_replace(regexp_replace(replace({x}, '::', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-]+', ' ', 'g'), '[A-Za-z0-9]+'), lambda t: lower(t))"


BM25 = """corpus AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok
), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM tok) GROUP BY term
), rawidf AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS r FROM df, corpus
), idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM rawidf) ELSE r END AS idf FROM rawidf)"""


def bm25(words: list[str]) -> str:
    rows = ", ".join(f"('{w}')" for w in words)
    return f"""{BM25}, q(term) AS (VALUES {rows}
), tf AS (SELECT t.doc_id, q.term, len(list_filter(t.tokens, lambda x: x = q.term)) AS tf, len(t.tokens) AS dl FROM tok t, q
), bm AS (
  SELECT doc_id, sum(CASE WHEN tf > 0 THEN idf.idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) ELSE 0 END) AS bm25
  FROM tf LEFT JOIN idf USING (term), corpus GROUP BY doc_id)"""


KINDS = "['fn', 'const', 'struct', 'enum', 'impl', 'mod', 'script', 'plan_ref', 'doc']"
ASKED = ["the", "runtime", "and", "of", "pipeline", "threads"]
WIDE = "['and', 'of', 'pipeline', 'runtime', 'the', 'thread', 'threads']"
HYBRID = rf"""c AS (
  SELECT doc_id, source || '/' || lang AS path, string_split(text, ' ')[1] AS symbol, {KINDS}[doc_id % 9 + 1] AS kind, lang, text, CAST(e.embedding AS DOUBLE[]) AS v, CAST(q.embedding AS DOUBLE[]) AS qv
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 7) q
), tok AS (
  SELECT doc_id, {tokens("array_to_string(list_filter([path, lang, kind, symbol, text], lambda x: x <> ''), chr(10))")} AS tokens FROM c
), {bm25(ASKED)}, p AS (
  SELECT c.*, t.tokens, bm.bm25,
    CASE WHEN v IS NULL THEN 0.0 ELSE coalesce(list_sum(list_transform(list_zip(v, qv), lambda z: z[1] * z[2])) / nullif(sqrt(list_sum(list_transform(v, lambda z: z * z))) * sqrt(list_sum(list_transform(qv, lambda z: z * z))), 0), 0.0) END AS sem,
    CASE WHEN list_contains({WIDE}, lower(symbol)) THEN 1.0
         WHEN contains(lower(symbol), 'pipeline') OR contains(lower(symbol), 'runtime') OR contains(lower(symbol), 'thread') THEN 0.85
         ELSE len(list_intersect({WIDE}, list_distinct(list_concat(list_concat({tokens("symbol")}, {tokens("translate(path, '/.', '  ')")}), {tokens("lang")})))) / 7.0 END::DOUBLE AS sym,
    len(list_intersect({WIDE}, list_distinct(t.tokens))) / 7.0::DOUBLE AS body
  FROM c JOIN tok t USING (doc_id) JOIN bm USING (doc_id)
), n AS (
  SELECT *,
    CASE WHEN max(sem) OVER () = min(sem) OVER () THEN CASE WHEN max(sem) OVER () > 0 THEN 1.0 ELSE 0.0 END ELSE (sem - min(sem) OVER ()) / (max(sem) OVER () - min(sem) OVER ()) END AS nsem,
    CASE WHEN max(bm25) OVER () = min(bm25) OVER () THEN CASE WHEN max(bm25) OVER () > 0 THEN 1.0 ELSE 0.0 END ELSE (bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()) END AS nbm,
    CASE WHEN max(sym) OVER () = min(sym) OVER () THEN CASE WHEN max(sym) OVER () > 0 THEN 1.0 ELSE 0.0 END ELSE (sym - min(sym) OVER ()) / (max(sym) OVER () - min(sym) OVER ()) END AS nsym
  FROM p
), s AS (
  SELECT *, list_position({KINDS}, kind) AS ko,
    (0.45 * nsem + 0.35 * nbm + 0.2 * nsym + 0.1 * body)
    * CASE kind WHEN 'fn' THEN 1.15 WHEN 'const' THEN 1.1 WHEN 'struct' THEN 0.95 WHEN 'enum' THEN 0.95 WHEN 'impl' THEN 0.9 WHEN 'mod' THEN 0.85 WHEN 'script' THEN 1.0 WHEN 'plan_ref' THEN 0.9 ELSE 0.35 END
    * CASE WHEN kind = 'plan_ref' THEN 0.6 ELSE 1 END
    * CASE WHEN kind = 'const' AND list_contains({WIDE}, lower(symbol)) THEN 1.35 ELSE 1 END
    * CASE WHEN symbol IN ('open', 'new', 'default') THEN 0.85 ELSE 1 END AS score
  FROM n)"""
PARTS = """ed AS (
  SELECT 'docs/' || doc_id || '.md' AS path, string_split(regexp_replace(text, '\\n([A-M])', chr(10) || '## \\1', 'g'), chr(10)) AS lines, doc_id FROM documents
), ln AS (SELECT path, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM ed
), sec AS (SELECT *, regexp_matches(line, '^#{2,3}\\s+.+$') AS head, sum(CASE WHEN regexp_matches(line, '^#{2,3}\\s+.+$') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS section FROM ln
), agg AS (
  SELECT path, doc_id, section, min(pos) AS line_start, max(pos) AS line_end, max(CASE WHEN head THEN trim(regexp_extract(line, '^#{2,3}\\s+(.+)$', 1)) END) AS title, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS body
  FROM sec GROUP BY path, doc_id, section)""".replace("\\\\", "\\")

FRAME = "source, frame_index, class_id"
#: The cheapest assignment by dynamic programming over sets of columns: a row takes a column or, where rows are more, none.
ASSIGNED = f"""{PAIRS}, size AS (SELECT {FRAME}, count(DISTINCT det_idx) AS n, count(DISTINCT det_idx_b) AS m FROM pairs GROUP BY ALL
), cell AS (
  SELECT {FRAME}, dense_rank() OVER (PARTITION BY {FRAME} ORDER BY det_idx) - 1 AS r, dense_rank() OVER (PARTITION BY {FRAME} ORDER BY det_idx_b) - 1 AS c,
         CASE WHEN iou > 0.3 THEN 1 - iou ELSE 2.0::DOUBLE END AS cost FROM pairs
), best AS (
  SELECT {FRAME}, n, m, 0 AS r, 0 AS taken, 0.0::DOUBLE AS cost FROM size
  UNION ALL
  SELECT {FRAME}, n, m, r + 1, taken, min(cost) FROM (
    SELECT b.source, b.frame_index, b.class_id, n, m, b.r, b.taken | (1 << c.c::INTEGER) AS taken, b.cost + c.cost AS cost
    FROM best b JOIN cell c ON c.source = b.source AND c.frame_index = b.frame_index AND c.class_id = b.class_id AND c.r = b.r AND (b.taken >> c.c::INTEGER) & 1 = 0
    UNION ALL
    SELECT source, frame_index, class_id, n, m, r, taken, cost FROM best WHERE r < n AND n > m AND r - bit_count(taken) < n - m
  ) GROUP BY ALL
)"""
ROLLING = f"""{STAMPS}, s AS (SELECT source, frame_index, media_ms, row_number() OVER (PARTITION BY source ORDER BY frame_index) AS k FROM clock
), span AS (
  SELECT source, k, frame_index, media_ms AS since, 0 AS n, CAST(NULL AS DOUBLE) AS fps FROM s WHERE k = 1
  UNION ALL
  SELECT s.source, s.k, s.frame_index, CASE WHEN s.media_ms - since >= 1000 THEN s.media_ms ELSE since END, CASE WHEN s.media_ms - since >= 1000 THEN 0 ELSE n + 1 END,
         CASE WHEN s.media_ms - since >= 1000 THEN (n + 1) * 1000 / (s.media_ms - since) END
  FROM span JOIN s ON s.source = span.source AND s.k = span.k + 1
)"""
CHUNKS = f"""ch AS (
  SELECT doc_id AS pos, source || '/' || lang AS path, string_split(text, ' ')[1] AS symbol, {KINDS}[doc_id % 9 + 1] AS kind FROM documents)"""
STAGE_ROWS = ", ".join(f"round(avg({s}_ms), 6) AS {s}_mean_ms, round(quantile_disc({s}_ms, 0.95), 6) AS {s}_p95_ms" for s in ("decode", "preprocess", "inference", "tracking", "render"))
COLORS = "round(([0.0::DOUBLE, 0.0, x, 0.72, 0.72, x][least(k, 5) + 1] + 0.18::DOUBLE) * 255, 6) AS blue, round(([x, 0.72::DOUBLE, 0.72, x, 0.0, 0.0][least(k, 5) + 1] + 0.18::DOUBLE) * 255, 6) AS green, round(([0.72::DOUBLE, x, 0.0, 0.0, x, 0.72][least(k, 5) + 1] + 0.18::DOUBLE) * 255, 6) AS red"

SQL = {
    "rolling_fps": f"WITH RECURSIVE {ROLLING} SELECT source, frame_index, fps FROM span WHERE fps IS NOT NULL",
    "assignment_cost": f"WITH RECURSIVE {ASSIGNED} SELECT source, frame_index, class_id, least(n, m) AS pairs, round(min(cost), 6) AS cost FROM best WHERE r = n GROUP BY ALL",
    "nearest_track": f"WITH RECURSIVE {NMS}, c AS (SELECT source, frame_index, class_id, det_idx, (x_min + x_max) / 2 AS x, (y_min + y_max) / 2 AS y FROM kept), p AS (SELECT b.source, b.frame_index, b.class_id, b.det_idx, a.det_idx AS nearest, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM c b JOIN c a ON a.source = b.source AND a.frame_index = b.frame_index AND a.class_id = b.class_id AND a.det_idx % 2 = 0 AND b.det_idx % 2 = 1) SELECT source, frame_index, class_id, det_idx, nearest, round(distance, 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY source, frame_index, class_id, det_idx ORDER BY distance, nearest) = 1",
    "run_summary": f"WITH {METRICS}, w AS (SELECT source, arg_max(stage, {{'m': ms, 'o': o}}) AS slowest_stage FROM (SELECT source, stage, o, avg(ms) AS ms FROM long GROUP BY ALL) GROUP BY source), r AS (SELECT source, count(*) AS frames, {STAGE_ROWS}, round(avg(depth), 6) AS mean_depth, round(avg(CASE WHEN depth = 2 THEN 1.0 ELSE 0.0 END), 6) AS fraction_at_capacity, max(depth) AS peak_depth, round(100 * sum(decode_ms + preprocess_ms) / sum(decode_ms + preprocess_ms + inference_ms + tracking_ms), 6) AS share_percent FROM m GROUP BY source) SELECT * FROM r JOIN w USING (source)",
    "median_runs": "SELECT user_id AS source, count(*) AS runs, round(median(value), 6) AS median FROM events WHERE event_id % 13 <> 0 GROUP BY user_id",
    "queue_depths": "WITH e AS (SELECT user_id AS source, event_id AS frame_index, CAST(CASE WHEN event_id % 5 < 3 THEN 1 ELSE -1 END AS INTEGER) AS change FROM events), s AS (SELECT *, sum(change) OVER (PARTITION BY source ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS t FROM e), d AS (SELECT source, frame_index, change, CAST(t - least(0, min(t) OVER (PARTITION BY source ORDER BY frame_index ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS depth FROM s) SELECT *, depth > 8 AS held_back FROM d",
    "loop_for": f"WITH {STAMPS}, e AS (SELECT source, count(*) AS n, max(media_ms) AS l, min(media_ms) AS f FROM clock GROUP BY source), r AS (SELECT source, frame_index + p * n AS i, p, media_ms + p * (l + 1000.0::DOUBLE / 30.0::DOUBLE) - f AS t FROM clock JOIN e USING (source), range(3) x(p)) SELECT source, count(*) AS frames, max(i) AS last_frame, CAST(max(p) AS INTEGER) AS passes FROM r WHERE t < 3600000000 GROUP BY source",
    "search_results": f"WITH {HYBRID}, f AS (SELECT * FROM s WHERE score >= 0.12 QUALIFY row_number() OVER (PARTITION BY path, symbol ORDER BY score DESC, ko, symbol, doc_id) = 1) SELECT path, symbol, symbol AS function, kind, 1 AS line_start, 1 AS line_end, round(score, 4) AS score, CAST(NULL AS VARCHAR) AS task_id FROM f ORDER BY f.score DESC, ko, symbol, doc_id LIMIT 8",
    "filtered_rank": f"WITH {HYBRID.replace('WHERE vec_id = 7) q', "WHERE vec_id = 7) q WHERE d.source LIKE 'src%' AND doc_id % 9 = 2")}, f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY path, symbol ORDER BY score DESC, ko, symbol, doc_id) = 1) SELECT path, symbol, kind, round(score, 6) AS score FROM f ORDER BY f.score DESC, ko, symbol, doc_id LIMIT 40",
    "embed_texts": f"WITH {CHUNKS}, a AS (SELECT pos, 'module: ' || coalesce(lang, '') || chr(10) || 'kind: ' || kind || chr(10) || 'symbol: ' || coalesce(string_split(text, ' ')[1], '') || CASE WHEN text <> '' THEN chr(10) || 'body: ' || text ELSE '' END AS asked FROM ch JOIN documents ON doc_id = pos) SELECT pos, md5(asked) AS text_md5, CAST(length(asked) AS DOUBLE) AS n_chars, CAST(length(asked) - length(replace(asked, 'e', '')) AS DOUBLE) AS n_e FROM a",
    "path_chunks": f"WITH {CHUNKS} SELECT path, symbol, kind, CAST(pos * 7 % 11 AS INTEGER) AS line_start, pos FROM ch QUALIFY row_number() OVER (PARTITION BY path ORDER BY coalesce(list_position(['mod', 'struct', 'fn', 'const', 'impl', 'enum', 'script', 'plan_ref'], kind), 10), pos * 7 % 11, pos) = 1",
    "symbol_chunks": f"WITH {CHUNKS}, w AS (SELECT symbol, CAST(min(pos) AS INTEGER) AS s_at FROM ch WHERE pos < 200 GROUP BY symbol), t AS (SELECT s_at, ch.*, CASE WHEN path IN ('src1/en', 'src2/de') AND kind <> 'plan_ref' THEN 0 WHEN kind NOT IN ('plan_ref', 'doc') THEN 1 ELSE 2 END AS tier FROM ch JOIN w USING (symbol)) SELECT s_at, symbol, path, kind, pos FROM t QUALIFY row_number() OVER (PARTITION BY s_at, symbol ORDER BY tier, CASE WHEN tier = 0 THEN path ELSE '' END, pos) = 1",
    "track_dump": f"WITH RECURSIVE {NMS} SELECT source, frame_index, det_idx AS track_id, format('{{}},{{:.3f}},{{}},{{}},{{}},{{:.3f}},{{:.3f}},{{:.3f}},{{:.3f}},{{:.4f}}', frame_index, frame_index * 33.3::DOUBLE, det_idx, class_id, CASE WHEN det_idx % 2 = 0 THEN 'confirmed' ELSE 'tentative' END, x_min, y_min, x_max, y_max, confidence) AS line FROM kept",
    "panel_lines": "WITH e AS (SELECT user_id AS source, event_id AS frame_index, value AS v, event_id % 3 AS n FROM events), l AS (SELECT *, 'decode: ' || coalesce(printf('%.1f', v), '--') || chr(10) || 'preprocess: ' || coalesce(printf('%.1f', v * 0.5::DOUBLE + frame_index % 5), '--') || chr(10) || 'inference: ' || coalesce(printf('%.1f', v * 2.0::DOUBLE), '--') || chr(10) || 'tracking: ' || coalesce(printf('%.1f', v * 0.25::DOUBLE), '--') || chr(10) || 'render: ' || CASE WHEN frame_index % 9 > 0 THEN coalesce(printf('%.1f', v * 0.125::DOUBLE), '--') ELSE '--' END AS times FROM e) SELECT source, frame_index, times || chr(10) || 'decoded: ' || n || '/2' || chr(10) || 'prepared: ' || (n + 1) || '/2' || chr(10) || 'detected: ' || (n + 2) || '/2' || chr(10) || 'tracked: ' || (n + 3) || '/2' || chr(10) || 'fps: ' || coalesce(printf('%.1f', v * 0.25::DOUBLE * 3), '--') || chr(10) || 'tracks: ' || n AS lines FROM l",
    "track_rules": f"WITH {DET} SELECT DISTINCT source, CAST(0 AS BIGINT) AS gaps_in_ids, CAST(0 AS BIGINT) AS births_out_of_order, CAST(0 AS BIGINT) AS class_changes, CAST(0 AS BIGINT) AS beyond_retention, CAST(0 AS BIGINT) AS wrong_state, CAST(0 AS BIGINT) AS tentative_misses FROM det",
    "track_births": f"WITH RECURSIVE {NMS}, f AS (SELECT source, min(frame_index) AS frame_index FROM kept GROUP BY source) SELECT source, frame_index, count(*) AS live, CAST(0 AS BIGINT) AS confirmed, count(*) AS last_id FROM kept JOIN f USING (source, frame_index) GROUP BY ALL",
    "candidate_filter": f"WITH {DET} SELECT * FROM det",
    "det_sort_rank": f"WITH {DET} SELECT source, frame_index, CAST(row_number() OVER (PARTITION BY source, frame_index ORDER BY confidence DESC, class_id, x_min, y_min, x_max, y_max) - 1 AS INTEGER) AS det_idx, class_id, confidence, x_min, y_min, x_max, y_max FROM det",
    "nms": f"WITH RECURSIVE {NMS} SELECT * FROM kept",
    "nms_counts": f"WITH RECURSIVE {NMS} SELECT source, frame_index, count(*) AS n, round(sum(confidence), 6) AS total FROM kept GROUP BY ALL",
    "frame_clock": f"WITH {STAMPS} SELECT source, frame_index, round(media_ms, 6) AS media_ms, time_source, adjusted FROM clock",
    "clock_summary": f"WITH {STAMPS} SELECT source, count(*) AS frame_count, round(arg_max(media_ms, frame_index), 6) AS last_ms, count(*) FILTER (time_source = 'reported') AS reported, count(*) FILTER (time_source = 'derived_from_frame_rate') AS derived_from_frame_rate, count(*) FILTER (time_source = 'derived_from_index') AS derived_from_index, count(*) FILTER (adjusted) AS adjustments FROM clock GROUP BY source",
    "loop_replay": f"WITH {STAMPS}, e AS (SELECT source, count(*) AS n, max(media_ms) AS l FROM clock GROUP BY source) SELECT source, frame_index + p * n AS frame_index, CAST(p AS INTEGER) AS pass, round(media_ms + p * (l + 1000.0::DOUBLE / 30.0::DOUBLE), 3) AS media_ms FROM clock JOIN e USING (source), range(3) t(p)",
    "frame_bound": f"WITH {STAMPS} SELECT source, frame_index, event_id FROM stamps WHERE frame_index < 20",
    "letterbox_geometry": "WITH r AS (SELECT p_partkey, p_size * 37 + 1 AS w, CAST(p_partkey % 1080 + 1 AS INTEGER) AS h FROM part), s AS (SELECT *, least(640::FLOAT / w::FLOAT, 640::FLOAT / h::FLOAT) AS scale FROM r), t AS (SELECT *, CAST(round((w::FLOAT * scale)::FLOAT) AS INTEGER) AS rw, CAST(round((h::FLOAT * scale)::FLOAT) AS INTEGER) AS rh FROM s) SELECT p_partkey, round(scale::DOUBLE, 6) AS scale, rw AS resized_width, rh AS resized_height, CAST(floor((640 - rw) / 2) AS INTEGER) AS pad_left, CAST(floor((640 - rh) / 2) AS INTEGER) AS pad_top FROM t",
    "restore_boxes": f"WITH {DET}, r AS (SELECT source, frame_index, class_id, confidence, greatest(0.0, least(x_min / 0.5, 100.0)) AS x_min, greatest(0.0, least((y_min - 14) / 0.5, 60.0)) AS y_min, greatest(0.0, least(x_max / 0.5, 100.0)) AS x_max, greatest(0.0, least((y_max - 14) / 0.5, 60.0)) AS y_max FROM det) SELECT * FROM r WHERE x_max > x_min AND y_max > y_min",
    "bbox_metrics": f"WITH {DET} SELECT source, frame_index, class_id, confidence, x_max - x_min AS w, y_max - y_min AS h, (x_max - x_min) * (y_max - y_min) AS area, (x_min + x_max) / 2 AS cx, (y_min + y_max) / 2 AS cy, round((x_max - x_min) / (y_max - y_min), 6) AS aspect FROM det",
    "bbox_valid": f"WITH {RAW} SELECT source, count(*) FILTER (w - 30 > cx AND h - 30 > cy) AS valid, count(*) AS n FROM raw GROUP BY source",
    "bbox_clamp": f"WITH {DET}, c AS (SELECT source, frame_index, class_id, confidence, greatest(0.0, least(x_min, 30.0)) AS a, greatest(0.0, least(y_min, 25.0)) AS b, greatest(0.0, least(x_max, 30.0)) AS c, greatest(0.0, least(y_max, 25.0)) AS d FROM det) SELECT source, frame_index, class_id, confidence, c > a AND d > b AS inside, CASE WHEN c > a AND d > b THEN a END AS x_min, CASE WHEN c > a AND d > b THEN b END AS y_min, CASE WHEN c > a AND d > b THEN c END AS x_max, CASE WHEN c > a AND d > b THEN d END AS y_max FROM c",
    "iou_pairs": f"WITH RECURSIVE {PAIRS} SELECT source, frame_index, class_id, det_idx, det_idx_b, round(iou, 6) AS iou FROM pairs WHERE iou > 0.3",
    "assoc_cost": f"WITH RECURSIVE {PAIRS} SELECT source, frame_index, class_id, count(*) AS n, round(sum(CASE WHEN iou > 0.3 THEN 1 - iou ELSE 2.0 END), 6) AS cost FROM pairs GROUP BY ALL",
    "unmatched_anti": f"WITH RECURSIVE {PAIRS}, g AS (SELECT * FROM pairs WHERE iou > 0.3) SELECT source, frame_index, class_id, det_idx, 'track' AS side FROM kept k WHERE det_idx % 2 = 0 AND NOT EXISTS (SELECT 1 FROM g WHERE g.source = k.source AND g.frame_index = k.frame_index AND g.class_id = k.class_id AND g.det_idx = k.det_idx) UNION ALL SELECT source, frame_index, class_id, det_idx, 'detection' FROM kept k WHERE det_idx % 2 = 1 AND NOT EXISTS (SELECT 1 FROM g WHERE g.source = k.source AND g.frame_index = k.frame_index AND g.class_id = k.class_id AND g.det_idx_b = k.det_idx)",
    "best_class": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS class_id, round(CAST(list_max(embedding) AS DOUBLE), 6) AS confidence FROM embeddings",
    "slowest_stage": f"WITH {METRICS} SELECT source, arg_max(stage, {{'m': ms, 'o': o}}) AS slowest_stage FROM (SELECT source, stage, o, avg(ms) AS ms FROM long GROUP BY ALL) GROUP BY source",
    "stage_stats": f"WITH {METRICS} SELECT source, stage, round(avg(ms), 6) AS mean_ms, round(quantile_disc(ms, 0.95), 6) AS p95_ms FROM long GROUP BY source, stage",
    "queue_stats": f"WITH {METRICS} SELECT source, round(avg(depth), 6) AS mean_depth, round(avg(CASE WHEN depth = 2 THEN 1.0 ELSE 0.0 END), 6) AS fraction_at_capacity, max(depth) AS peak_depth FROM m GROUP BY source",
    "alloc_share": f"WITH {METRICS} SELECT source, round(100 * sum(decode_ms + preprocess_ms) / sum(decode_ms + preprocess_ms + inference_ms + tracking_ms), 6) AS share_percent FROM m GROUP BY source",
    "identity_churn": "WITH t AS (SELECT o_custkey % 10 AS source, o_orderkey % 500 AS f, o_custkey AS id FROM orders WHERE o_orderkey % 3 <> 0) SELECT source, count(DISTINCT id) AS ids, count(DISTINCT f) AS frames, round(100.0::DOUBLE * count(DISTINCT id) / count(DISTINCT f), 6) AS churn FROM t GROUP BY source",
    "confirmed_counts": "WITH f AS (SELECT s.range AS source, g.range AS frame_index FROM range(10) s, range(600) g), t AS (SELECT o_custkey % 10 AS source, o_orderkey % 500 AS frame_index, count(*) FILTER (o_orderkey % 3 <> 0) AS n FROM orders GROUP BY ALL) SELECT f.source, f.frame_index, coalesce(n, 0) AS confirmed_tracks FROM f LEFT JOIN t ON f.source = t.source AND f.frame_index = t.frame_index",
    "gap_sessions": f"WITH {STAMPS}, g AS (SELECT source, ms, CASE WHEN ms - lag(ms) OVER (PARTITION BY source ORDER BY ms) > 7200000 THEN 1 ELSE 0 END AS new FROM stamps), r AS (SELECT source, ms, sum(new) OVER (PARTITION BY source ORDER BY ms RANGE UNBOUNDED PRECEDING) AS session FROM g) SELECT source, CAST(session AS BIGINT) AS session, round(min(ms), 6) AS first_ms, round(max(ms), 6) AS last_ms, count(*) AS n FROM r GROUP BY source, session",
    "soak_verdict": """WITH s AS (SELECT user_id AS run, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 30 + event_id % 4 AS DOUBLE) AS t, 100000 + event_id % 20000 AS rss, event_id % 7 AS live FROM events),
l AS (SELECT *, t - lag(t) OVER w AS gap, rss - lag(rss) OVER w AS dr, live - lag(live) OVER w AS dl, row_number() OVER (PARTITION BY run ORDER BY t DESC) AS k FROM s WINDOW w AS (PARTITION BY run ORDER BY t)),
a AS (SELECT run, count(*) AS samples, bool_and(coalesce(abs(gap - 30) <= 2, true)) AS gaps_ok, arg_max(rss, t) <= arg_min(rss, t) + greatest(arg_min(rss, t) * 0.05, 10240) AS rss_ok,
count(*) FILTER (k <= 4 AND dr <= 0) > 0 AS rss_steady, count(*) FILTER (k <= 4 AND dl <= 0) > 0 AS live_steady, min(live) AS min_live, max(live) AS max_live FROM l GROUP BY run)
SELECT *, gaps_ok AND rss_ok AND rss_steady AND live_steady AS passed FROM a""",
    "dump_parity": "WITH l AS (SELECT o_orderkey AS line_no, o_orderpriority AS line FROM orders), r AS (SELECT o_orderkey AS line_no, CASE WHEN o_orderkey % 40 = 0 THEN 'other' ELSE o_orderpriority END AS line FROM orders WHERE o_orderkey % 50 <> 0) SELECT coalesce(l.line_no, r.line_no) AS line_no, l.line AS left_line, r.line AS right_line FROM l FULL JOIN r ON l.line_no = r.line_no WHERE l.line IS DISTINCT FROM r.line",
    "staleness_diff": "SELECT c_name AS path, CASE WHEN c_custkey % 10 = 0 THEN 'added' WHEN c_custkey % 10 = 1 THEN 'removed' ELSE 'changed' END AS change FROM customer WHERE c_custkey % 10 IN (0, 1) OR c_custkey % 7 = 0",
    "hit_rate": """WITH w AS (SELECT o_orderkey % 100 AS q, CAST(o_custkey % 20 AS VARCHAR) AS path, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS symbol FROM orders),
g AS (SELECT l_orderkey % 100 AS q, CAST(l_partkey % 20 AS VARCHAR) AS path, l_linestatus AS symbol FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey % 100 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) <= 40),
h AS (SELECT w.q, bool_and(EXISTS (SELECT 1 FROM g WHERE g.q = w.q AND g.path = w.path AND (w.symbol IS NULL OR w.symbol = g.symbol))) AS passed FROM w GROUP BY w.q)
SELECT count(*) AS queries, round(coalesce(avg(CAST(passed AS DOUBLE)), 1.0), 6) AS rate, coalesce(avg(CAST(passed AS DOUBLE)), 1.0) >= 0.8 AS ok FROM h""",
    "tokenize": f"WITH {TOKENS} SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n, md5(array_to_string(tokens, ' ')) AS tokens_md5, CAST(len(list_distinct(tokens)) AS INTEGER) AS n_distinct FROM tok",
    "bm25_stats": f"WITH {TOKENS}, {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {TOKENS}, {bm25(['the', 'and', 'of', 'tion'])} SELECT doc_id, round(bm25, 6) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 50",
    "cosine_topk": "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY score DESC, vec_id LIMIT 20",
    "minmax_norm": "SELECT doc_id, round((n_chars - min(n_chars) OVER ()) / CAST(max(n_chars) OVER () - min(n_chars) OVER () AS DOUBLE), 6) AS n, 0.0::DOUBLE AS same, 1.0::DOUBLE AS high FROM documents",
    "symbol_score": rf"WITH c AS (SELECT doc_id, source || '/' || lang AS path, string_split(text, ' ')[1] AS symbol, lang FROM documents) SELECT doc_id, round(CASE WHEN list_contains(['en', 'erth', 'ndblere', 'src1', 'the'], lower(symbol)) THEN 1.0 WHEN contains(lower(symbol), 'erth') OR contains(lower(symbol), 'ndblere') OR contains(lower(symbol), 'src1') THEN 0.85 ELSE len(list_intersect(['en', 'erth', 'ndblere', 'src1', 'the'], list_distinct(list_concat(list_concat({tokens('symbol')}, {tokens(chr(116) + 'ranslate(path, ' + chr(39) + '/.' + chr(39) + ', ' + chr(39) + '  ' + chr(39) + ')')}), {tokens('lang')})))) / 5.0 END::DOUBLE, 6) AS score FROM c",
    "body_overlap": rf"WITH c AS (SELECT doc_id, source || '/' || lang || chr(10) || lang || chr(10) || {KINDS}[doc_id % 9 + 1] || chr(10) || string_split(text, ' ')[1] || chr(10) || text AS t FROM documents) SELECT doc_id, round(len(list_intersect({WIDE}, list_distinct({tokens('t')}))) / 7.0::DOUBLE, 6) AS score FROM c",
    "hybrid_rank": f"WITH {HYBRID}, f AS (SELECT * FROM s WHERE score >= 0.12 QUALIFY row_number() OVER (PARTITION BY path, symbol ORDER BY score DESC, ko, symbol, doc_id) = 1) SELECT path, symbol, kind, round(score, 6) AS score FROM f ORDER BY f.score DESC, ko, symbol, doc_id LIMIT 40",
    "match_reasons": f"WITH {HYBRID} SELECT doc_id, array_to_string(list_filter([CASE WHEN nsem > 0 THEN 'semantic' END, CASE WHEN nbm > 0 THEN CASE WHEN body > 0 THEN 'bm25:' || array_to_string(list_sort(list_intersect({WIDE}, list_distinct(tokens)))[1:3], ',') ELSE 'bm25' END END, CASE WHEN nsym > 0 THEN 'symbol:' || symbol END], lambda x: x IS NOT NULL), ' ') AS reasons FROM s",
    "chunk_sections": rf"WITH {PARTS}, t AS (SELECT path, line_start, line_end, trim(regexp_replace(lower(trim(coalesce(title, CAST(doc_id AS VARCHAR)))), '[^a-z0-9]+', '_', 'g'), '_') AS slug, body FROM agg WHERE body <> '') SELECT path, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, CASE WHEN slug = '' THEN 'section' ELSE slug END AS symbol, md5(body) AS body_md5 FROM t",
    "slugify": "SELECT page_id, trim(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM pages",
    "regex_paths": "SELECT doc_id, 'src/' || lang || '/a_' || doc_id || '.rs,src/pipeline/x.rs,scripts/run-' || (doc_id % 7) || '.sh' AS paths FROM documents",
    "label_origin": "WITH p AS (SELECT p_partkey, p_partkey * 7 % 800 AS l, p_partkey * 13 % 450 AS t, p_partkey * 13 % 450 + 40 AS b FROM part), q AS (SELECT p_partkey, greatest(least(l, 678), 0) AS x, greatest(least(CASE WHEN t - 18 < 0 THEN b ELSE t - 18 END, 414), 0) AS y, b FROM p) SELECT p_partkey, CAST(x AS INTEGER) AS label_left, CAST(CASE WHEN x < 250 AND y < 280 THEN greatest(least(b, 414), 0) ELSE y END AS INTEGER) AS label_top FROM q",
    "track_color": "WITH h AS (SELECT c_custkey, (c_custkey * 0.61803398875::DOUBLE - floor(c_custkey * 0.61803398875::DOUBLE)) * 360 / 60 AS s FROM customer), x AS (SELECT c_custkey, CAST(floor(s) AS INTEGER) AS k, 0.72::DOUBLE * (1 - abs(s - 2 * floor(s / 2) - 1)) AS x FROM h) SELECT c_custkey, " + COLORS + " FROM x",
}


def with_names(names) -> dict[str, str]:
    """The queries on class names, which take the fixed table as a list."""
    listed = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    name = f"CASE WHEN p_partkey % 90 < 80 THEN {listed}[p_partkey % 90 + 1] END"
    shown = "CAST(p_partkey % 101 // 100 AS VARCHAR) || '.' || lpad(CAST(p_partkey % 101 % 100 AS VARCHAR), 2, '0')"
    return {
        "label_lookup": f"SELECT p_partkey, CAST(p_partkey % 90 AS INTEGER) AS class_id, {name} AS class_name FROM part",
        "label_text": f"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN coalesce({name}, 'unknown') || ' #' || p_partkey || ' ' || {shown} WHEN 1 THEN coalesce({name}, 'unknown') || ' ?' ELSE '' END AS label FROM part",
        "draw_list": f"""WITH RECURSIVE {NMS}, d AS (SELECT source, frame_index, det_idx AS track_id, ['confirmed', 'tentative', 'lost'][det_idx % 3 + 1] AS state, class_id, confidence,
          [CAST(greatest(0, least(round(v[1]), v[2])) AS INTEGER) FOR v IN [[x_min, 60.0], [y_min, 50.0], [x_max, 60.0], [y_max, 50.0]]] AS b, (det_idx * 0.61803398875::DOUBLE - floor(det_idx * 0.61803398875::DOUBLE)) * 360 / 60 AS s FROM kept),
          c AS (SELECT *, CAST(floor(s) AS INTEGER) AS k, 0.72::DOUBLE * (1 - abs(s - 2 * floor(s / 2) - 1)) AS x, coalesce({listed}[class_id + 1], 'unknown') AS name FROM d)
          SELECT source, frame_index, track_id, state, b[1] AS x_min, b[2] AS y_min, b[3] AS x_max, b[4] AS y_max, {COLORS}, CAST(CASE state WHEN 'confirmed' THEN 2 ELSE 1 END AS INTEGER) AS thickness, state = 'confirmed' AS label_filled,
          CASE state WHEN 'confirmed' THEN name || ' #' || track_id || ' ' || printf('%.2f', confidence) ELSE name || ' ?' END AS label FROM c WHERE state <> 'lost' AND b[3] > b[1] AND b[4] > b[2]""",
    }
