"""Hybrid retrieval over a chunk table: BM25, vector similarity and symbol match, fused and boosted."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import expanded, search_text, tokenize, tokens_of

# Fixed values of the ranking.
SEMANTIC, BM25, SYMBOL, BODY = 0.45, 0.35, 0.20, 0.1
K1, B, EPSILON = 1.5, 0.75, 0.25
SCORE_FLOOR = 0.12
KIND_WEIGHTS = {"fn": 1.15, "struct": 0.95, "enum": 0.95, "impl": 0.9, "const": 1.1, "mod": 0.85, "script": 1.0, "plan_ref": 0.9, "doc": 0.75}
KIND_ORDER = ("fn", "const", "struct", "enum", "impl", "mod", "script", "plan_ref", "doc")
SPEC_HINTS = ("ve-", "spec", "plan", "requirement", "milestone")
CODE_HINTS = ("opencv", "mat", "struct", "enum", "impl", "ownership", "thread", "threaded", "runtime", "spawn", "join", "cascade", "orchestrat", "send", "recv", "bounded", "frame")
ORCHESTRATION = ("thread", "threaded", "stage", "cascade", "spawn", "join", "runtime", "orchestrat", "next", "pipeline", "serial", "loop")
INSTRUMENTATION = ("overlay", "metrics", "instrument", "queue_depth", "queue", "depth", "runstats", "percentile", "summary", "throughput", "fps")
MESSAGE = ("message", "messages", "timings", "stamp")


@dataclass(frozen=True)
class Boost:
    """A factor for chunks that meet all of the given conditions, where the query meets all of its own."""

    factor: float
    kind: str = ""
    ends: str = ""
    symbols: tuple[str, ...] = ()
    symbol_asked: bool = False
    lower_symbol_asked: bool | None = None
    any_of: tuple[str, ...] = ()
    code_hint: bool = False
    prefix: str = ""
    not_message: bool = False
    least_tokens: int = 0


BOOSTS = (
    Boost(0.6, kind="plan_ref", code_hint=True),
    Boost(1.35, kind="const", lower_symbol_asked=True),
    Boost(1.2, kind="script", prefix="scripts/"),
    Boost(1.25, ends="metrics.rs", any_of=INSTRUMENTATION),
    Boost(1.15, ends="render.rs", any_of=INSTRUMENTATION),
    Boost(1.2, symbols=("draw_metrics_overlay", "log_playback_summary", "log_instrumentation_summary", "RunStats", "QueueDepths", "METRICS_AREA_BOTTOM"), any_of=INSTRUMENTATION),
    Boost(1.35, ends="runtime.rs", any_of=ORCHESTRATION, not_message=True),
    Boost(1.2, kind="fn", symbols=("spawn", "join", "next_tracked", "request_shutdown"), any_of=ORCHESTRATION, not_message=True),
    Boost(1.1, kind="struct", symbols=("Pipeline", "FaultConfig"), any_of=ORCHESTRATION, not_message=True),
    Boost(1.35, kind="struct", symbols=("Pipeline",), any_of=("pipeline",), not_message=True),
    Boost(1.2, ends="queue.rs", symbol_asked=True),
    Boost(0.85, symbols=("request",), any_of=("send", "recv", "shutdown")),
    Boost(1.25, symbols=("Shutdown",), any_of=("shutdown",)),
    Boost(1.15, symbols=("StageTimings",), any_of=("timings",)),
    Boost(1.5, symbols=("DecodedFrame",), any_of=("mat",)),
    Boost(1.1, ends="message.rs", any_of=("mat",)),
    Boost(1.2, ends="message.rs", any_of=MESSAGE),
    Boost(1.15, symbols=("StageTimings", "TrackedFrame", "DecodedFrame"), any_of=MESSAGE),
    Boost(0.85, symbols=("open", "new", "default"), lower_symbol_asked=False, least_tokens=2),
)


@dataclass
class Query:
    text: str
    vector: list[float] | None = None
    path_prefix: str | None = None
    kind: str | None = None
    tokens: list[str] = field(init=False)
    wide: list[str] = field(init=False)

    def __post_init__(self):
        self.tokens = tokens_of(self.text)
        self.wide = expanded(self.tokens)

    def has(self, words) -> bool:
        return bool(set(words) & set(self.wide))

    def hints(self, words) -> bool:
        return any(w in self.text.lower() for w in words)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def kind_weight(q: Query) -> Column:
    out = F.lit(1.0)
    for kind, weight in KIND_WEIGHTS.items():
        if kind == "doc":
            weight = 1.0 if q.hints(SPEC_HINTS) else 0.35 if q.hints(CODE_HINTS) else weight
        if kind == "script" and "scripts/" in q.text.lower():
            weight = 1.2
        out = F.when(F.col("kind") == kind, F.lit(weight)).otherwise(out)
    return out


def boost(q: Query, rules=BOOSTS) -> Column:
    """The product of the rules that apply, in their order."""
    out = F.lit(1.0)
    for r in rules:
        if (r.any_of and not q.has(r.any_of)) or (r.code_hint and not q.hints(CODE_HINTS)) or (r.not_message and q.has(MESSAGE)) or len(q.wide) < r.least_tokens:
            continue
        if r.prefix and not (q.path_prefix or "").startswith(r.prefix):
            continue
        meets = F.lit(True)
        if r.kind:
            meets = meets & (F.col("kind") == r.kind)
        if r.ends:
            meets = meets & F.col("path").endswith(r.ends)
        if r.symbols:
            meets = meets & F.col("symbol").isin(*r.symbols)
        if r.symbol_asked:
            meets = meets & F.array_contains(_strings(q.wide), F.col("symbol"))
        if r.lower_symbol_asked is not None:
            meets = meets & (F.array_contains(_strings(q.wide), F.lower("symbol")) == r.lower_symbol_asked)
        out = out * F.when(meets, F.lit(r.factor)).otherwise(1.0)
    return out


def filtered(chunks: DataFrame, q: Query) -> DataFrame:
    """Path and kind filters; they come before all corpus statistics."""
    if q.path_prefix:
        chunks = chunks.filter(F.col("path").startswith(q.path_prefix))
    return chunks.filter(F.col("kind") == q.kind) if q.kind else chunks


def bm25_corpus(tokenized: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row: documents n and their mean length avgdl."""
    return tokenized.agg(F.count("*").alias("n"), F.avg(F.size(tokens)).alias("avgdl"))


def bm25_terms(tokenized: DataFrame, corpus: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Term frequencies over documents, with the inverse ones; a negative one becomes a share of their mean."""
    df = tokenized.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(corpus)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def with_bm25(rows: DataFrame, query_tokens: list[str], tokens: str = "tokens") -> DataFrame:
    """Adds bm25 to rows of a corpus: query tokens count as often as they are given.

    Term counts of a row come from its own array in one pass, so only the query's terms leave the scan; corpus
    statistics (one row, and a map of the query's terms) are broadcast.
    """
    times = {t: query_tokens.count(t) for t in dict.fromkeys(query_tokens)}
    if not times:
        return rows.withColumn("bm25", F.lit(0.0))
    corpus = bm25_corpus(rows, tokens=tokens)
    terms = bm25_terms(rows, corpus, tokens).filter(F.col("term").isin(*times))
    idf = terms.agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("_idf"))
    found = F.filter(tokens, lambda x: x.isin(*times))
    out = rows.crossJoin(F.broadcast(corpus)).crossJoin(F.broadcast(idf)).withColumn("_found", found)
    norm = K1 * (1 - B + B * F.size(tokens) / F.when(F.col("avgdl") > 0, F.col("avgdl")))
    total = F.lit(0.0)
    for t, n in times.items():
        tf = F.size(F.filter("_found", lambda x: x == t))
        weight = F.coalesce(F.try_element_at("_idf", F.lit(t)), F.lit(0.0))
        total = total + n * weight * F.when(tf > 0, tf * (K1 + 1) / (tf + norm)).otherwise(0.0)
    return out.withColumn("bm25", total).drop("_idf", "_found", "n", "avgdl")


def bm25_scores(tokenized: DataFrame, query_tokens: list[str], pos: str = "pos", tokens: str = "tokens") -> DataFrame:
    """pos, bm25 of every row."""
    return with_bm25(tokenized.select(pos, tokens), query_tokens, tokens).select(pos, "bm25")


def cosine(a, b) -> Column:
    """0 for empty vectors, other lengths and zero norms."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    both = norm(a) * norm(b)
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(ok, F.when(both > 0, dot / F.when(both > 0, both)).otherwise(0.0)).otherwise(0.0)


def symbol_score(q: Query) -> Column:
    if not q.wide:
        return F.lit(0.0)
    symbol, wide = F.lower("symbol"), _strings(q.wide)
    part = F.lit(False)
    for t in q.wide:
        if len(t) > 3:
            part = part | F.contains(symbol, F.lit(t))
    path = F.translate("path", "/.", "  ")
    have = F.array_union(F.array_union(tokenize(F.col("symbol")), tokenize(path)), tokenize(F.col("module_path")))
    shared = F.size(F.array_intersect(wide, have)) / F.lit(float(len(q.wide)))
    return F.when(F.array_contains(wide, symbol), 1.0).when(part, 0.85).otherwise(shared)


def body_overlap(q: Query, tokens: str = "tokens") -> Column:
    if not q.wide:
        return F.lit(0.0)
    return F.size(F.array_intersect(_strings(q.wide), F.col(tokens))) / F.lit(float(len(q.wide)))


def normalized(rows: DataFrame, *columns: str) -> DataFrame:
    """Columns scaled from their least to their largest value over all rows; equal values become 1 if positive, else 0."""
    ends = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = rows.join(F.broadcast(ends))
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out = out.withColumn(c, F.when(hi == lo, F.when(hi > 0, 1.0).otherwise(0.0)).otherwise((F.col(c) - lo) / F.when(hi != lo, hi - lo)))
    return out.drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def match_reasons(q: Query) -> Column:
    shared = F.slice(F.array_sort(F.array_intersect(_strings(q.wide), F.col("tokens"))), 1, 3)
    words = F.when(F.size(shared) > 0, F.concat(F.lit("bm25:"), F.array_join(shared, ","))).otherwise("bm25")
    return F.array_compact(F.array(F.when(F.col("semantic") > 0, "semantic"), F.when(F.col("bm25") > 0, words), F.when(F.col("symbol_part") > 0, F.concat(F.lit("symbol:"), F.col("symbol")))))


def scored(chunks: DataFrame, q: Query) -> DataFrame:
    """Chunks that pass the filters with score, match_reasons and the rank's kind_order.

    chunks: pos (corpus order), path, symbol, kind, signature, doc, body, module_path, neighbors, task_id, embedding.
    """
    rows = filtered(chunks, q).withColumn("tokens", tokenize(search_text()))
    vector = F.lit(q.vector).cast("array<double>") if q.vector else F.array().cast("array<double>")
    parts = rows.withColumns({"semantic": cosine(F.col("embedding"), vector), "symbol_part": symbol_score(q), "overlap": body_overlap(q)})
    parts = with_bm25(parts, q.tokens)
    parts = normalized(parts, "semantic", "bm25", "symbol_part")
    fused = SEMANTIC * F.col("semantic") + BM25 * F.col("bm25") + SYMBOL * F.col("symbol_part") + BODY * F.col("overlap")
    place = F.array_position(_strings(KIND_ORDER), F.col("kind"))
    return parts.withColumns({"score": fused * kind_weight(q) * boost(q), "match_reasons": match_reasons(q), "kind_order": F.when(place > 0, place - 1).otherwise(9)})


def rank_order() -> list[Column]:
    return [F.desc("score"), F.asc("kind_order"), F.asc("symbol"), F.asc("pos")]


def rank_chunks(chunks: DataFrame, q: Query, top_k: int, floor: float | None = SCORE_FLOOR) -> DataFrame:
    """The best chunks: floor, then the first of each path and symbol, then the first top_k."""
    rows = scored(chunks, q)
    if floor is not None:
        rows = rows.filter(F.col("score") >= floor)
    first = Window.partitionBy("path", "symbol").orderBy(*rank_order())
    rows = rows.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k", "tokens")
    return rows.orderBy(*rank_order()).limit(max(0, top_k))


def search(chunks: DataFrame, text: str, top_k: int = 8, path_prefix: str | None = None, kind: str | None = None, vector: list[float] | None = None) -> DataFrame:
    """Result rows as a caller sees them: scores with four digits."""
    from tessera.functions.text import display_code

    best = rank_chunks(chunks, Query(text, vector, path_prefix, kind), top_k)
    return best.select("path", "symbol", F.col("symbol").alias("function"), "kind", "line_start", "line_end", display_code().alias("code"), F.round("score", 4).alias("score"), "match_reasons", "task_id", "pos", "kind_order")
