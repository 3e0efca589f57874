"""Removal of long byte strings that occur more than once, by bounded interval expansion on a BWT."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, discard, key_bits, map_arrow, marked, materialize, mix64, partitions, release, table, text_key

#: Bytes of a repeated string at least.
LENGTH = 400
#: Bytes of the grams whose least hash deals a string to its group.
GRAM = 32
#: Groups of more bytes than this are indexed in parts, and what is left of them is dealt anew by longer grams; a worker
#: holds a group or part at a time.
GROUP_BYTES = 1 << 19
#: Strings of a run at most.
RUN = 1 << 18
#: How much longer the grams of the next level are.
LONGER = 4
#: Bytes of groups that are indexed together.
INDEX_BYTES = 1 << 19
#: A byte that UTF-8 never uses; it ends each segment in the index.
END = 0xFF


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the gram at each position. gram is 8 at least."""
    words = np.ndarray(len(data) - 7, dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)
    out = mix64(words[: len(data) - gram + 1])
    for at in range(8, gram, 8):
        at = min(at, gram - 8)
        out = mix64(out ^ (words[at : at + len(out)] * np.uint64(0x9E3779B97F4A7C15)))
    return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, from running minima of blocks in both directions."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def levels(length: int) -> list[int]:
    """Lengths of the grams that deal strings: each level splits the groups that the one before leaves too large.

    At the last level a gram is the whole string, so a group there is one string and its places.
    """
    first = min(GRAM, max(8, length // 2))
    found = [first]
    while found[-1] * LONGER <= length - first:
        found.append(found[-1] * LONGER)
    return [*found, *([length - first] if found[-1] < length - first else []), length]


def runs_of(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings of `length` bytes that share their least gram hash: hash, first, last, whether it recurs.

    Equal strings have equal hashes, so they meet in the group of that hash, wherever they start.
    """
    h = gram_hashes(data, gram)
    if gram == length:
        at = np.arange(len(h))
        return h.view(np.int64), at, at, np.zeros(len(h), bool)
    wide = length - gram + 1
    least = sliding_least(h, wide)
    starts = np.concatenate(([True], least[1:] != least[:-1]))
    starts[::RUN] = True
    first = np.flatnonzero(starts)
    last = np.concatenate((first[1:] - 1, [len(least) - 1]))
    value = least[first]
    again = np.array([np.count_nonzero(h[a : b + wide] == v) > 1 for a, b, v in zip(first.tolist(), last.tolist(), value)])
    return value.view(np.int64), first, last, again


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, over the end to the start, as ordered numbers."""
    return np.ndarray(len(data), dtype=">u8", buffer=np.concatenate((data, np.resize(data, 8))), strides=(1,)).astype(np.uint64)


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of data in the order of their first `depth` bytes at least, by doubling and tripling."""
    n = len(data)
    rank = eight_bytes(data)
    done = 8
    order = np.argsort(rank)
    while True:
        key = rank[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        top = int(rank[order[-1]])
        if done >= depth or top == n - 1:
            return order
        wide = top + 1
        if wide < 1 << 20 and 2 * done < depth:  # three ranks fit one key
            rank = (rank * wide + np.roll(rank, -done)) * wide + np.roll(rank, -2 * done)
            done *= 3
        else:
            rank = rank * wide + np.roll(rank, -done)
            done *= 2
        order = np.argsort(rank)


def repeated_starts(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the string of `length` bytes at each position starts elsewhere in data too; one such position for each string.

    Beller, Gog, Ohlebusch and Schnattinger's way from a Burrows-Wheeler transform to common prefixes:
    intervals of suffixes with a common prefix of l bytes are extended backward by each byte before
    them, breadth first, so the boundaries of intervals come up by increasing common prefix. It stops
    at `length`: boundaries not met by then lie between suffixes with `length` common bytes or more.
    Positions whose string would go over the end of data come out false.
    """
    n = len(data)
    if n < length:
        return np.zeros(n, bool), np.zeros(n, bool)
    order = suffix_order(data, length)
    bwt = data[order - 1]
    stable = np.argsort(bwt, kind="stable")
    before = np.empty(n, np.int64)
    before[stable] = np.arange(n)
    met = np.zeros(n + 1, bool)
    met[0] = met[n] = True
    lo, hi = np.array([0]), np.array([n])
    start = 0
    if length >= 8:  # the intervals of eight bytes are plain from the sorted keys
        key = eight_bytes(data)[order]
        lo = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        hi = np.concatenate((lo[1:], [n]))
        met[lo] = True
        start = 8
    for _ in range(start, length):
        size = hi - lo
        ends = np.cumsum(size)
        if not len(ends):
            break
        at = np.arange(ends[-1]) + np.repeat(lo - (ends - size), size)
        to = before[at]
        owner = np.repeat(np.arange(len(lo)), size)
        by = np.argsort(to)
        to, owner, byte = to[by], owner[by], bwt[at[by]]
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (byte[1:] != byte[:-1]) | (to[1:] != to[:-1] + 1)))
        starts = np.flatnonzero(new)
        lo, hi = to[starts], to[np.concatenate((starts[1:] - 1, [len(to) - 1]))] + 1
        fresh = ~met[hi]
        lo, hi = lo[fresh], hi[fresh]
        met[hi] = True
    same = ~met[1:n]
    found = np.zeros(n, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    one = np.zeros(n, bool)
    one[order[:-1][same & ~np.concatenate(([False], same[:-1]))]] = True
    found[n - length + 1 :] = one[n - length + 1 :] = False
    return found, one


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last positions of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _array(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8)


RUNS = "tid binary, v long, sid binary, first int, last int, again boolean"


def _digests(data: bytes, first: np.ndarray, last: np.ndarray, length: int) -> list[bytes]:
    return [xxhash.xxh3_128_digest(data[a : b + length]) for a, b in zip(first.tolist(), last.tolist())]


def _runs(texts: DataFrame, length: int) -> DataFrame:
    """The runs of every text: tid, v (least gram hash), sid (hash of the run's bytes), first, last, again."""

    gram = levels(length)[0]

    def run(batch: pa.RecordBatch):
        seen: set = set()
        tids, sids, columns = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if key not in seen:
                seen.add(key)
                value, first, last, again = runs_of(_array(text), length, gram)
                columns.append((value, first.astype(np.int32), last.astype(np.int32), again))
                sids += _digests(text.as_buffer().to_pybytes(), first, last, length)
                tids += [key] * len(value)
        if seen:
            value, first, last, again = (pa.array(np.concatenate(c)) for c in zip(*columns))
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), value, pa.array(sids, pa.binary()), first, last, again], ["tid", "v", "sid", "first", "last", "again"])

    return map_arrow(texts.select("tid", F.col("text").cast("binary")), run, RUNS)


def _contents(runs: DataFrame, place) -> DataFrame:
    """The distinct contents of runs: v, sid, many (it has several places), again, and one place (tid, first, last)."""
    several = F.min(place) != F.max(place)
    if "many" in runs.columns:
        several = several | F.max("many")
    return runs.groupBy("v", "sid").agg(several.alias("many"), F.max("again").alias("again"), F.min(F.struct("tid", "first", "last")).alias("at")).select("v", "sid", "many", "again", "at.*")


def _wanted(texts: DataFrame, wants: DataFrame) -> DataFrame:
    """One row per text that something is taken from: tid, text, wants. Other texts are not moved."""
    own = [c for c in wants.columns if c != "tid"]
    once = marked(texts, "tid", key_bits(wants.select("tid"), "tid")).groupBy("tid").agg(F.first("text").alias("text"))
    wants = wants.groupBy("tid").agg(F.collect_list(F.struct(*own)).alias("wants"))
    return once.join(wants, "tid").select("tid", F.col("text").cast("binary").alias("text"), "wants")


def _indexed(texts: DataFrame, groups: DataFrame, length: int, parts: int) -> DataFrame:
    """(sid, lo, hi, kind): runs of strings in the contents of groups (with `blocks`), by an index of each group or block of it.

    Kind 0: repeated strings of a content that has one place. Of groups of several blocks also kind 1, strings
    that their block has once, and kind 2, one of each string that is repeated: these have to meet other blocks.
    """

    def cut(batch: pa.RecordBatch):
        rows: list[tuple] = []
        for text, wants in zip(batch.column(1), batch.column(2).to_pylist()):
            data = text.as_buffer().to_pybytes()
            rows += [(w["v"], w["block"], w["sid"], data[w["first"] : w["last"] + length], w["many"], w["parted"]) for w in wants]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["v", "block", "sid", "content", "many", "parted"])

    def flush(rows: list):
        out: list[tuple] = []
        data = np.full(sum(len(c) + 1 for _, c, *_ in rows), END, np.uint8)
        at, starts = 0, []
        for _, content, *_ in rows:
            data[at : at + len(content)] = np.frombuffer(content, np.uint8)
            starts.append(at)
            at += len(content) + 1
        found, one = repeated_starts(data, length)
        for start, (sid, content, many, parted) in zip(starts, rows):
            part = slice(start, start + len(content) - length + 1)
            if not many:
                out += [(sid, lo, hi, 0) for lo, hi in spans_of(found[part])]
            if parted:
                again = (~found[part] | one[part]) if many else one[part]
                out += [(sid, lo, hi, 2) for lo, hi in spans_of(again)]
                if not many:
                    out += [(sid, lo, hi, 1) for lo, hi in spans_of(~found[part])]
        kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["sid", "lo", "hi", "kind"])

    def run(batches):
        rows, held, current = [], 0, None
        for batch in batches:
            for v, block, *row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                # a block is indexed by itself, so that what it has once is known
                if (v, block) != current and (held > INDEX_BYTES or row[3] or rows and rows[-1][3]):
                    if rows:
                        yield flush(rows)
                    rows, held = [], 0
                current = (v, block)
                rows.append(row)
                held += len(row[1])
        if rows:
            yield flush(rows)
        release()

    wants = groups.select("v", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block"), "sid", "tid", "first", "last", "many", (F.col("blocks") > 1).alias("parted"))
    cuts = map_arrow(_wanted(texts, wants), cut, "v long, block int, sid binary, content binary, many boolean, parted boolean")
    return cuts.repartition(parts, "v", "block").sortWithinPartitions("v", "block").mapInArrow(run, "sid binary, lo int, hi int, kind int")


def _finer(texts: DataFrame, wants: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs by longer grams of wanted strings: parent (the content), off (place there), and the columns of runs, with many.

    Strings that are equal stay together: a finer group is part of a group.
    """

    def run(batch: pa.RecordBatch):
        for tid, text, wants in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data, plain = _array(text), text.as_buffer().to_pybytes()
            columns, parents, sids, many = [], [], [], []
            for w in wants:
                part = slice(w["first"], w["last"] + length)
                value, first, last, again = runs_of(data[part], length, gram)
                value = mix64(value.view(np.uint64) ^ np.uint64(w["v"] % (1 << 64))).view(np.int64)
                columns.append((first + w["off"], value, first + w["first"], last + w["first"], again))
                sids += _digests(plain[part], first, last, length)
                parents += [w["sid"]] * len(value)
                many += [w["many"]] * len(value)
            off, value, first, last, again = (np.concatenate(c) for c in zip(*columns))
            yield pa.RecordBatch.from_arrays(
                [pa.array(parents, pa.binary()), pa.array(off.astype(np.int32)), pa.array([tid] * len(off), pa.binary()), pa.array(value), pa.array(sids, pa.binary())]
                + [*(pa.array(x.astype(np.int32)) for x in (first, last)), pa.array(again), pa.array(many, pa.bool_())],
                ["parent", "off", "tid", "v", "sid", "first", "last", "again", "many"],
            )

    return map_arrow(_wanted(texts, wants), run, f"parent binary, off int, {RUNS}, many boolean")


def _found(texts: DataFrame, contents: DataFrame, length: int, parts: int, used: list[DataFrame], level: int = 0) -> DataFrame:
    """(sid, lo, hi): the runs of repeated strings in each content.

    A content of several places repeats as a whole. Others are indexed with their group. Groups over
    GROUP_BYTES are indexed in blocks; strings that a block has once, and one of each other string, are then
    dealt anew by the grams of the next level. At the last level a group is one string. `used` takes the tables
    that the result is read from.
    """
    grams = levels(length)
    contents = materialize(contents, "contents")
    sizes = contents.groupBy("v").agg(F.count("*").alias("m"), F.bool_and("many").alias("whole"), F.sum(F.col("last") - F.col("first") + length).alias("bytes"))
    blocks = F.least("m", F.ceil(F.col("bytes") / GROUP_BYTES)).cast("int") if level + 1 < len(grams) else F.lit(1)
    sizes = sizes.filter("not whole").select("v", "m", blocks.alias("blocks"))
    groups = contents.join(sizes, "v").filter("m > 1 or again")
    whole = contents.filter("many").select("sid", F.lit(0).alias("lo"), (F.col("last") - F.col("first")).alias("hi"))
    indexed = materialize(_indexed(texts, groups, length, parts), "indexed")
    used += [contents, indexed]
    found = whole.union(indexed.filter("kind = 0").select("sid", "lo", "hi"))
    left = indexed.filter("kind > 0")
    if left.isEmpty():
        return found
    places = [(F.col("first") + F.col(x)).alias(y) for x, y in (("lo", "first"), ("hi", "last"))]
    wants = left.join(contents.drop("many", "last"), "sid").select("v", "sid", "tid", F.col("lo").alias("off"), *places, (F.col("kind") == 2).alias("many"))
    finer = materialize(_finer(texts, wants, length, grams[level + 1]), "finer")
    place = F.xxhash64("parent", "off")
    often = finer.groupBy("v").agg(F.min(place).alias("least"), F.max(place).alias("most"), F.max("again").alias("again"), F.min("many").alias("known"))
    # groups of known strings alone have nothing to tell
    kept = materialize(finer.join(often.filter("(least <> most or again) and not known").select("v"), "v", "left_semi"), "kept")
    discard(finer)
    used.append(kept)
    below = _found(texts, _contents(kept, place), length, parts, used, level + 1)
    at = [(F.col("off") + F.col(x)).alias(x) for x in ("lo", "hi")]
    return found.union(kept.filter("not many").select("parent", "off", "sid").join(below, "sid").select(F.col("parent").alias("sid"), *at))


def _keyed(docs: DataFrame, length: int) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text")).filter(F.octet_length("text") >= length).withColumn("tid", text_key())


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """tid, spans (a, b: bytes, end exclusive, not overlapping, in order) of every distinct text with repeats.

    A text is known by half the SHA-256 of its bytes (tid). Strings are judged on the input. Texts that occur
    twice are repeats as a whole: one span. Null texts, and those of fewer than `length` bytes, have no string.
    """
    spark = docs.sparkSession
    bound_batches(spark, 500)
    parts = max(partitions(spark), 12)
    texts = _keyed(docs, length)
    runs = materialize(_runs(texts, length), "runs")
    # copies of a text give equal rows, so a hash of the place tells whether a group has two places
    place = F.xxhash64("tid", "first")
    often = runs.groupBy("v").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.max("again").alias("again")).filter("lo <> hi or again").select("v")
    kept = materialize(runs.join(often, "v", "left_semi"), "kept")
    discard(runs)
    used = [kept]
    found = _found(texts, _contents(kept, place), length, parts, used)
    spans = kept.select("sid", "tid", "first").join(found, "sid").select("tid", F.struct((F.col("first") + F.col("lo")).alias("a"), (F.col("first") + F.col("hi") + length).alias("b")).alias("span"))
    spans = spans.groupBy("tid").agg(F.collect_set("span").alias("spans"))
    twice = texts.groupBy("tid").agg(F.count("*").alias("n"), F.min(F.octet_length("text")).alias("b")).filter("n > 1").select("tid", F.array(F.struct(F.lit(0).alias("a"), "b")).alias("whole"))
    both = spans.join(twice, "tid", "full").select("tid", F.coalesce("whole", F.array_sort("spans")).alias("spans"))

    def merged(batch: pa.RecordBatch):
        rows = []
        for spans in batch.column(1).to_pylist():
            out: list[dict] = []
            for s in spans:
                if out and s["a"] <= out[-1]["b"]:
                    out[-1]["b"] = max(out[-1]["b"], s["b"])
                else:
                    out.append(s)
            rows.append(out)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, batch.column(1).type)], ["tid", "spans"])

    out = materialize(map_arrow(both, merged, "tid binary, spans array<struct<a:int,b:int>>"), "spans")
    discard(*used)
    return out


def without(data: bytes, spans: list[dict]) -> bytes:
    """The bytes outside of the spans."""
    return b"".join(data[a:b] for a, b in zip([0, *(s["b"] for s in spans)], [*(s["a"] for s in spans), len(data)]))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per distinct text with repeats: tid, n_removed, n_spans, kept (the remaining bytes), kept_sha256.

    All bytes that a repeated string of `length` bytes covers go, in the spans of repeated_spans.
    """
    spans = repeated_spans(docs, length)
    whole = "spans[0].a = 0 and spans[0].b = n"
    texts = marked(_keyed(docs, length), "tid", key_bits(spans, "tid")).withColumn("n", F.octet_length("text"))
    # a text that goes as a whole is not needed; of the others, copies have gone, so each is one row
    part = texts.join(spans, "tid").filter(f"not ({whole})").select("tid", F.col("text").cast("binary").alias("text"), "spans")
    gone = texts.select("tid", "n").join(spans, "tid").filter(whole).groupBy("tid").agg(F.min("n").cast("long").alias("n_removed"))

    def cut(batch: pa.RecordBatch):
        rows = []
        for tid, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            kept = without(text.as_buffer().to_pybytes(), spans)
            rows.append((tid, sum(s["b"] - s["a"] for s in spans), len(spans), kept, hashlib.sha256(kept).hexdigest()))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["tid", "n_removed", "n_spans", "kept", "kept_sha256"])

    rest = map_arrow(part, cut, "tid binary, n_removed long, n_spans long, kept binary, kept_sha256 string")
    nothing = [F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256")]
    return rest.union(gone.select("tid", "n_removed", *nothing))


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Null texts count as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), text_key().alias("tid"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    found = repeats(docs, length).drop("kept")
    return rows.join(found, "tid", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")
    )


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"))
