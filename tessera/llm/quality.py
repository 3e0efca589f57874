"""Quality rules by robust multivariate outliers; DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, table, text_or_empty

BLANKS = r"[\x20\x09-\x0D]"
BLANK_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: Share of a group's rows that the covariance is determined from.
SUBSET = 0.75
#: Concentration goes on until no determinant changes; that many steps without an end are an error.
MOST_STEPS = 200
#: Steps in one job: the tables are small, so jobs cost more than steps.
STEPS_AT_ONCE = 3
#: Rows that an estimate counts for in the one below it: of all rows in a language's, of a language in a source's.
PRIOR_ROWS = 200
#: Probability that a row of the group's own normal distribution is kept.
KEEP = 0.999999
#: The transformed statistics are whole numbers of such parts.
GRID = 64
#: The transformed statistics and the deviation that is added to each, so that those without spread, as most clean
#: documents have no symbol and no repeated line, don't reject a document by one of them.
FEATURES = {"x_length": 0.12, "x_symbols": 0.35, "x_lines": 0.2, "x_repeats": 0.15}
#: Rows of group estimates up to which they are broadcast: a row is some hundred bytes.
BROADCAST_ROWS = 50_000


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text; a null text has no words.

    n_repeat_words: windows of three words are hashed and sorted with their places; the places of equal
    neighbours, in order, each cover three words or up to the next place.
    """
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_or_empty().cast("string").alias("text"))
    rows = rows.select("doc_id", "lang", "source", "text", F.filter(F.split(text, BLANKS + "+"), lambda w: w != "").alias("w"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^\x20\x09-\x0D]"))
    windows = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate(text, BLANK_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.sort_array(windows).alias("s"),
    )
    same = lambda x, k: F.coalesce(F.get("s", k)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    rows = rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").alias("n_lines"), places.alias("at"))
    covered = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", covered.alias("n_repeat_words"))


def chi_square_below(x: float, k: int) -> float:
    """The chi-square distribution function, by the series of the incomplete gamma function."""
    a, half = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= half / (a + n)
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a))


def chi_square_point(p: float, k: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_below(mid, k) < p else (lo, mid)
    return hi


def _pairs(names: list[str]):
    return [(i, j) for i in range(len(names)) for j in range(i + 1)]


def _factored(estimates: DataFrame, names: list[str]) -> DataFrame:
    """Estimates with l_i_j, the Cholesky factor of the covariance c_i_j, and its determinant det."""
    out, det = estimates, F.lit(1.0)
    for i, j in _pairs(names):
        x = F.col(f"c_{i}_{j}")
        for k in range(j):
            x = x - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        out = out.withColumn(f"l_{i}_{j}", F.sqrt(x) if i == j else x / F.col(f"l_{j}_{j}"))
        det = det * F.pow(f"l_{i}_{j}", F.lit(2)) if i == j else det
    return out.withColumn("det", det)


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance, by forward substitution."""
    z: list[Column] = []
    for i, name in enumerate(names):
        x = F.col(name) - F.col(f"m_{i}")
        for j in range(i):
            x = x - F.col(f"l_{i}_{j}") * z[j]
        z.append(x / F.col(f"l_{i}_{i}"))
    total = z[0] * z[0]
    for x in z[1:]:
        total = total + x * x
    return total


def _with(rows: DataFrame, estimates: DataFrame, key: str, n: int, how: str = "inner") -> DataFrame:
    """Rows with their group's estimates, of which there are n: broadcast while they are few, for a group may hold most rows."""
    return rows.join(F.broadcast(estimates) if n <= BROADCAST_ROWS else estimates, key, how)


def _estimates(rows: DataFrame, names: list[str], weight: str, by: list[str], scale: float) -> DataFrame:
    """Weighted means m_i and covariances c_i_j, scaled and with the added deviations."""
    w, floors = F.col(weight), list(FEATURES.values())
    sums = [F.sum(w * F.col(x)).alias(f"s_{i}") for i, x in enumerate(names)]
    sums += [F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"q_{i}_{j}") for i, j in _pairs(names)]
    out = rows.groupBy(*by).agg(F.sum(w).alias("w"), *sums)
    mean = lambda i: F.col(f"s_{i}") / F.col("w")
    cov = lambda i, j: (F.col(f"q_{i}_{j}") / F.col("w") - mean(i) * mean(j)) * scale + (floors[i] ** 2 if i == j else 0.0)
    return out.select(*by, *[mean(i).alias(f"m_{i}") for i in range(len(names))], *[cov(i, j).alias(f"c_{i}_{j}") for i, j in _pairs(names)])


def _starts(cells: DataFrame, names: list[str], n: int) -> DataFrame:
    """Three estimates (s) to start from: median and median deviations, median and the added deviations, mean and covariance."""
    floors = list(FEATURES.values())
    medians = cells.groupBy("g").agg(*[F.expr(f"percentile({x}, 0.5, n)").alias(f"m_{i}") for i, x in enumerate(names)])
    medians = materialize(medians, "medians")
    away = _with(cells, medians, "g", n).groupBy("g").agg(*[F.expr(f"percentile(abs({x} - m_{i}), 0.5, n)").alias(f"d_{i}") for i, x in enumerate(names)])
    means = [f"m_{i}" for i in range(len(names))]
    diagonal = lambda of: [(of(i) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _pairs(names)]
    first = medians.join(away, "g").select("g", F.lit(0).alias("s"), *means, *diagonal(lambda i: F.pow(1.4826 * F.col(f"d_{i}"), 2) + floors[i] ** 2))
    second = medians.select("g", F.lit(1).alias("s"), *means, *diagonal(lambda i: F.lit(floors[i] ** 2)))
    third = _estimates(cells, names, "n", ["g"], 1.0).select("g", F.lit(2).alias("s"), *means, *[f"c_{i}_{j}" for i, j in _pairs(names)])
    return first.union(second).union(third)


def _concentrated(cells: DataFrame, factors: DataFrame, names: list[str], n: int, scale: float) -> DataFrame:
    """Estimates from each group's h nearest rows, exactly: the last cell counts in part. Cells at one distance go by their values."""
    near = _with(cells, factors.select("g", "s", *[c for c in factors.columns if c[:2] in ("m_", "l_")]), "g", n).withColumn("d", F.round(_distance(names), 9))
    nearer = Window.partitionBy("g", "s").orderBy("d", *names).rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("w", F.least(F.col("n"), F.col("h") - F.coalesce(F.sum("n").over(nearer), F.lit(0)))).filter("w > 0")
    return _estimates(near, names, "w", ["g", "s"], scale)


def determinant_estimates(cells: DataFrame, names: list[str]) -> DataFrame:
    """g, rows, and the m_i and c_i_j of least determinant, of cells (g, names, n).

    Concentration steps from each start run until no determinant changes; each step lowers it or leaves it.
    A group's cells are few whatever its rows, for the statistics are on a grid.
    """
    alpha = chi_square_point(SUBSET, len(names))
    scale = SUBSET / chi_square_below(alpha, len(names) + 2)
    totals = materialize(cells.groupBy("g").agg(F.sum("n").alias("rows")), "totals")
    n = totals.count()
    cells = materialize(_with(cells, totals, "g", n).withColumn("h", F.ceil(F.col("rows") * SUBSET)).drop("rows"), "cells")
    factors = materialize(_factored(_starts(cells, names, n), names), "starts")
    for _ in range(MOST_STEPS):
        last = factors.select("g", "s", F.col("det").alias("last"))
        step = factors
        for _ in range(STEPS_AT_ONCE):
            step = _factored(_concentrated(cells, step, names, n, scale), names)
        step = step.join(last, ["g", "s"])
        before, factors = factors, materialize(step.withColumn("moved", F.abs(F.col("det") - F.col("last")) > 1e-9 * F.col("last")).drop("last"), "factors")
        discard(before)
        if factors.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"determinants not settled after {MOST_STEPS} steps")
    kept = [c for c in factors.columns if c[:2] in ("m_", "c_")]
    best = factors.groupBy("g").agg(F.min(F.struct("det", "s", *kept)).alias("b")).select("g", *[f"b.{c}" for c in kept])
    out = materialize(best.join(totals, "g"), "estimates")
    discard(totals, cells, factors)
    return out


def _shrunk(own: DataFrame, above: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Estimates drawn to those above them, which count for PRIOR_ROWS rows."""
    columns = [f"m_{i}" for i in range(len(names))] + [f"c_{i}_{j}" for i, j in _pairs(names)]
    above = above.select(F.col("g").alias(key), *[F.col(c).alias(f"a_{c}") for c in columns])
    mixed = [((F.col("rows") * F.col(c) + PRIOR_ROWS * F.col(f"a_{c}")) / (F.col("rows") + PRIOR_ROWS)).alias(c) for c in columns]
    return own.join(above, key).select("g", "rows", *mixed)


def transformed(stats: DataFrame) -> DataFrame:
    """Rows of statistics() with base_failed, the transformed statistics, and own (language and source) and wide (language)."""
    words = F.greatest("n_words", F.lit(1))
    on_grid = lambda x: F.floor(x * GRID + 0.5) / GRID
    language = [F.coalesce("lang", F.lit("")).alias("l"), F.col("lang").isNull().alias("n")]
    source = [F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("m")]
    return stats.withColumns(
        {
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")),
            "x_length": on_grid(F.log(F.greatest("word_chars", F.lit(1)) / words)),
            "x_symbols": on_grid(F.log1p(100.0 * F.col("n_symbols") / words)),
            "x_lines": on_grid(F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)))),
            "x_repeats": on_grid(F.sqrt(F.col("n_repeat_words") / words)),
            "own": F.to_json(F.struct(*language, *source)),
            "wide": F.to_json(F.struct(*language)),
        }
    )


def judge(stats: DataFrame) -> DataFrame:
    """Rows of statistics() with base_failed, distance and kept.

    Minimum-covariance-determinant estimates are taken from the rows that pass the base rules: per language and
    source, per language, and of all rows. An estimate is drawn to the one above it by the formula of `_shrunk`,
    the same for all sizes, so that few rows judge mostly by their language's. A row is rejected if its squared
    Mahalanobis distance is beyond the chi-square point KEEP. Nulls of lang or source form groups of their own.
    Repeated rows count as often as they come; an empty table, or one without a row past the base rules, has no
    estimates.
    """
    names = list(FEATURES)
    rows = materialize(transformed(stats), "statistics")
    levels = F.explode(F.array(F.struct(F.lit("all").alias("of"), F.lit("").alias("g")), F.struct(F.lit("wide").alias("of"), F.col("wide").alias("g")), F.struct(F.lit("own").alias("of"), F.col("own").alias("g"))))
    single = materialize(rows.filter("not base_failed").groupBy("own", "wide", *names).agg(F.count("*").alias("n")), "single")
    cells = single.select(levels.alias("level"), *names, "n").withColumn("g", F.concat_ws(" ", "level.of", "level.g"))
    found = determinant_estimates(cells.groupBy("g", *names).agg(F.sum("n").alias("n")), names)
    level = lambda of: found.filter(F.col("g").startswith(f"{of} ")).withColumn("g", F.substring("g", len(of) + 2, 1 << 30))
    wide = _shrunk(level("wide").withColumn("up", F.lit("")), level("all"), "up", names)
    of = single.select(F.col("own").alias("g"), F.col("wide").alias("up")).distinct()
    own = materialize(_factored(_shrunk(level("own").join(of, "g"), wide, "up", names), names).withColumnRenamed("g", "own"), "own")
    placed = _with(rows, own.drop("rows", "det"), "own", own.count(), "left").withColumn("distance", F.round(_distance(names), 6))
    out = F.coalesce(F.col("distance") > chi_square_point(KEEP, len(names)), F.lit(False))
    discard(single, found)
    return placed.withColumn("kept", ~F.col("base_failed") & ~out).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(statistics(table(spark, sf_dir, "documents")))
