"""Near-duplicate documents by bottom-k sketches of word shingles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, discard, gather, map_arrow, materialize, mix64, release, table, text_key, words_of
from tessera.llm.components import components

#: Values kept of each set: its smallest hashes.
SKETCH = 64
#: Inverted lists up to this many sets are paired off; longer ones go by a pivot first, then in blocks.
SHORT_LIST = 24
#: Bytes of a block of sets, with so many for each set beside its values.
BLOCK_BYTES, SET_BYTES = 4 << 20, 1 << 10
#: A value in more than one of so many sets of two blocks is counted by matrix products, in slices of columns.
DENSE, COLUMNS = 32, 2048


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, A-Z lower-cased.

    Fewer words than the width make one shingle; no words make none.
    """
    codes, words, offsets = words_of(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    each = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    h = each[codes] if len(words) else np.zeros(0, np.uint64)
    n = max(0, len(h) - width + 1)
    rolled = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        rolled = mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    sets = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1].view(np.int64)))
        elif b > a:
            one = np.full(1, b - a, dtype=np.uint64)
            for x in h[a:b]:
                one = mix64(one * np.uint64(0x9E3779B97F4A7C15) + x)
            sets.append(one.view(np.int64))
        else:
            sets.append(np.zeros(0, np.int64))
    return sets


def needed(n: int, k: int, percent: int) -> int:
    """How many of a sketch of n values two linked sets share at least.

    All of a small set is in its sketch, so the bound is exact there. Else the shared part of a union
    sketch is binomial; five standard deviations below its mean are missed by fewer than one pair in 10^5.
    """
    j = percent / 100
    low = math.floor(k * j - 5 * math.sqrt(k * j * (1 - j)))
    return max(1, min(low, math.ceil(n * percent / 100)))


def text_hash():
    """Stands for a text: 128 bits; null texts have one of their own."""
    return F.coalesce(text_key(), F.lit(b""))


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, key (of the whole set), sketch of every row."""
    bound_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch):
        sets = shingle_sets(batch.column(2), width)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([s[:k] for s in sets], pa.list_(pa.int64())),
            ],
            ["doc_id", "th", "n_shingles", "key", "sketch"],
        )

    rows = docs.select(F.col("doc_id").cast("long"), text_hash().alias("th"), F.col("text").cast("string"))
    return map_arrow(rows, run, "doc_id long, th binary, n_shingles long, key binary, sketch array<long>")


def full_sets(docs: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(key, members) of the texts whose hash is among keys.th, computed from the whole texts."""

    def run(batch: pa.RecordBatch):
        sets = shingle_sets(batch.column(0), width)
        yield pa.RecordBatch.from_arrays(
            [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
            ["key", "members"],
        )

    texts = docs.select(text_hash().alias("th"), F.col("text").cast("string").alias("text"))
    once = texts.join(keys.select("th").distinct(), "th", "left_semi").groupBy("th").agg(F.first("text").alias("text"))
    return map_arrow(once.select("text"), run, "key binary, members binary").dropDuplicates(["key"])


def prefixes(sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Inverted lists (v, key, n, central, p): of each sketch the rarest values, so many that linked sets meet in one.

    Values that one set alone holds come first in the order and take places, but make no lists. A set
    whose retained values are frequent altogether is central. p has all lists of the set, in that order.
    """
    bounds = F.array(*[F.lit(needed(n, k, percent)) for n in range(k + 1)])
    entries = sets.select("key", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    shared = entries.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1")
    found = entries.join(shared, "v").groupBy("key").agg(F.first("n").alias("n"), F.first("s").alias("s"), F.array_sort(F.collect_list(F.struct("c", "v"))).alias("found"))
    take = F.col("s") - F.element_at(bounds, F.col("s") + 1) + 1 - (F.col("s") - F.size("found"))
    central = F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["c"])
    prefix = F.transform(F.slice("found", 1, F.greatest(take, F.lit(0))), lambda x: x["v"])
    return found.filter(take > 0).select("key", "n", central.alias("central"), prefix.alias("p")).select(F.explode("p").alias("v"), "key", "n", "central", "p")


def _fits(percent: int, a: str, b: str):
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _first_common():
    """Whether v is the first list that both sets are in, so that a pair comes up in one list only."""
    return F.element_at(F.array_intersect("p", "p2"), 1) == F.col("v")


def estimated(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose union sketch, the k smallest values of both, has enough values that both hold."""
    side = sets.select("key", "sketch")
    both = pairs.join(side.select(F.col("key").alias("a"), F.col("sketch").alias("x")), "a").join(side.select(F.col("key").alias("b"), F.col("sketch").alias("y")), "b")
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, k)
    common = F.size(F.array_intersect(F.array_intersect("x", "y"), F.col("u")))
    low = needed(k, k, percent) / k
    return both.withColumn("u", union).filter(common >= F.floor(F.lit(low) * F.size("u"))).select("a", "b")


def verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on their whole sets."""

    def run(batch: pa.RecordBatch):
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(members.select(F.col("key").alias("a"), F.col("members").alias("x")), "a").join(members.select(F.col("key").alias("b"), F.col("members").alias("y")), "b")
    return map_arrow(joined.select("a", "b", "x", "y"), run, "a binary, b binary")


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each set of x with each of y: float32, exact below 2^24.

    Frequent values are counted by matrix products, the others through their inverted lists.
    """
    sizes = np.array([len(s) for s in x] + [len(s) for s in y])
    values, ids, counts = np.unique(np.concatenate(x + y), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(x), len(y)), np.float32)
    often = counts * DENSE > len(sizes)
    column = np.cumsum(often) - 1
    dense = often[ids]
    for low in range(0, int(often.sum()), COLUMNS):
        at = dense & (column[ids] >= low) & (column[ids] < low + COLUMNS)
        cells = np.zeros((len(sizes), COLUMNS), np.float32)
        cells[owner[at], column[ids[at]] - low] = 1
        out += cells[: len(x)] @ cells[len(x) :].T
    rare = ~dense & (counts[ids] > 1)
    left, right = rare & (owner < len(x)), rare & (owner >= len(x))
    by = np.argsort(ids[right], kind="stable")
    there, sets = ids[right][by], owner[right][by] - len(x)
    lo, hi = (np.searchsorted(there, ids[left], side) for side in ("left", "right"))
    bounds = np.searchsorted(owner[left], np.arange(len(x) + 1))
    for i in range(len(x)):
        part = slice(bounds[i], bounds[i + 1])
        met = gather(sets, lo[part], hi[part] - lo[part])
        if len(met):
            out[i] += np.bincount(met, minlength=len(y))
    return out


def forest(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Links (row, column) that hold together what `linked` does, at most one for each row and column."""
    rows, columns = np.zeros(linked.shape[0], bool), np.zeros(linked.shape[1], bool)
    a: list[int] = []
    b: list[int] = []
    for first in np.flatnonzero(linked.any(axis=1)).tolist():
        todo = [] if rows[first] else [first]
        rows[first] = True
        while todo:
            x = todo.pop()
            for y in np.flatnonzero(linked[x] & ~columns).tolist():
                columns[y] = True
                a.append(x)
                b.append(y)
                more = np.flatnonzero(linked[:, y] & ~rows)
                rows[more] = True
                a += more.tolist()
                b += [y] * len(more)
                todo += more.tolist()
    return a, b


def in_blocks(docs: DataFrame, sets: DataFrame, open_lists: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between sets of one list but several components, confirmed on whole sets.

    Lists that share members are put together where that takes fewer comparisons. The sets of such a
    group are dealt over blocks of bounded bytes, and each two blocks meet in one task, which counts
    intersections exactly and gives no more links than hold its sets together: pairs never become rows.
    """
    weight = F.col("n") * 8 + SET_BYTES
    least = open_lists.groupBy("key").agg(F.min("v").alias("least"))
    labels = open_lists.join(least, "key").groupBy("v").agg(F.min("least").alias("label"), F.sum(weight).cast("double").alias("w"))
    apart = labels.groupBy("label").agg(F.sum(F.col("w") * F.col("w")).alias("apart"))
    labelled = open_lists.join(labels.select("v", "label"), "v")
    together = labelled.select("label", "key", "n").distinct().groupBy("label").agg(F.sum(weight).cast("double").alias("w"))
    chosen = together.join(apart, "label").select("label", (F.col("w") * F.col("w") <= F.col("apart")).alias("joined"))
    grouped = labelled.join(chosen, "label").select(F.when(F.col("joined"), F.col("label")).otherwise(F.col("v")).alias("g"), "key", "n", "root").distinct()
    grouped = materialize(grouped, "grouped")
    blocks = grouped.groupBy("g").agg(F.ceil(F.sum(weight) / BLOCK_BYTES).cast("int").alias("blocks"))
    members = full_sets(docs, sets.join(grouped.select("key").distinct(), "key", "left_semi"), width)
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    rows = grouped.join(members, "key").join(blocks, "g").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "members", "root")

    def run(block: pa.Table) -> pa.Table:
        keys, roots = block.column("key").to_pylist(), block.column("root").to_pylist()
        values = [np.frombuffer(v, np.int64) for v in block.column("members").to_pylist()]
        own = block.column("own").to_numpy()
        i, j = block.column("i")[0].as_py(), block.column("j")[0].as_py()
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a: list[int] = []
        b: list[int] = []
        if len(x) and len(y):
            sizes = np.array([len(s) for s in values])
            number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
            root = np.array([number[r] for r in roots])
            both = shared_counts([values[k] for k in x], [values[k] for k in y]).astype(np.int64)
            linked = 100 * both >= percent * (sizes[x][:, None] + sizes[y][None, :] - both)
            a, b = forest(linked & (root[x][:, None] != root[y][None, :]))
            release()
        return pa.table({"a": pa.array([keys[x[k]] for k in a], pa.binary()), "b": pa.array([keys[y[k]] for k in b], pa.binary())})

    found = rows.groupBy("g", "i", "j").applyInArrow(run, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(docs: DataFrame, sets: DataFrame, width: int, k: int, percent: int) -> DataFrame:
    """Links between different sets that hold their components together, each confirmed on whole sets.

    Short lists are paired off. In a long list every set is first compared with a central pivot of the
    list. Pairs of one component need no further link; lists of several components are compared in blocks.
    """
    lists = prefixes(sets, k, percent)
    lists = materialize(lists.join(lists.groupBy("v").agg(F.count("*").alias("m")).filter("m > 1"), "v"), "lists")
    short, long = lists.filter(F.col("m") <= SHORT_LIST), lists.filter(F.col("m") > SHORT_LIST)
    other = short.select("v", F.col("key").alias("b"), F.col("n").alias("n2"), F.col("p").alias("p2"))
    pairs = short.select("v", F.col("key").alias("a"), "n", "p").join(other, "v").filter("a < b").filter(_fits(percent, "n", "n2")).filter(_first_common()).select("a", "b")

    def compared(pairs: DataFrame) -> DataFrame:
        chosen = materialize(estimated(pairs, sets, k, percent), "pairs")
        ends = chosen.select(F.col("a").alias("key")).union(chosen.select("b")).distinct()
        members = full_sets(docs, sets.join(ends, "key", "left_semi"), width)
        out = materialize(verified(chosen, members, percent), "verified")
        discard(chosen)
        return out

    if long.isEmpty():
        done = compared(pairs)
        discard(lists)
        return done

    def to_pivots(open_lists: DataFrame) -> DataFrame:
        pivots = open_lists.groupBy("v").agg(F.max(F.struct("central", "key", "n")).alias("p")).select("v", F.col("p.key").alias("b"), F.col("p.n").alias("n2"))
        return open_lists.join(pivots, "v").filter(F.col("key") != F.col("b")).filter(_fits(percent, "n", "n2")).select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct()

    done = compared(pairs.union(to_pivots(long)).distinct())
    roots = components(done)
    rooted = long.select("v", "key", "n").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    many = rooted.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("v")
    open_lists = materialize(rooted.join(many, "v", "left_semi"), "open")
    discard(lists)
    if open_lists.isEmpty():
        return done
    return materialize(done.union(in_blocks(docs, sets, open_lists, width, percent)).distinct(), "done")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """One row per document: doc_id, th (hash of its text), n_shingles, component_id, kept.

    Documents of one shingle set collapse first, so copies cost one row each. component_id is the
    smallest doc_id of the documents that links reach. Null or wordless texts link with nothing and are
    their own component. A null doc_id takes part in links, but is never the smallest; a component of
    null ids alone has a null id, and its rows are kept. Of repeated doc_ids all rows are returned.
    """
    sketched = materialize(sketches(docs, width, k), "sketches")
    sets = sketched.filter("n_shingles > 0").groupBy("key").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min("th").alias("th"))
    sets = materialize(sets, "sets")
    rows = materialize(sketched.drop("sketch"), "rows")
    discard(sketched)
    full = rows.filter("n_shingles > 0")
    found = links(docs, sets, width, k, percent)
    discard(sets)
    roots = components(found)
    discard(found)
    keyed = full.groupBy("key").agg(F.min("doc_id").alias("least"))
    rooted = keyed.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("key", "component_id")
    out = rows.select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("key")).otherwise(F.xxhash64("doc_id").cast("string").cast("binary")).alias("key"))
    out = out.join(named, "key", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "th", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).drop("th")
