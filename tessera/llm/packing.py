"""Packing of documents into token sequences of bounded length, by swap-based local search."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, map_arrow, materialize, partitions, table
from tessera.llm.tokens import WordTokenizer, vocabulary

SEQUENCE_TOKENS = 2048
#: Bytes of texts that a worker tokenizes at a time.
TEXT_BYTES = 4 << 20
#: Classes of underfull bins up to which sums of two lengths are indexed all along; beyond, only when nothing simpler helps.
PAIRED_CLASSES = 400
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Tokenise every text (null: empty) and cut what is longer than the capacity.

    A document's ids end with id 0, so an empty text is one piece of one id. Null and repeated
    doc_ids are carried as they are; each row is a document of its own.
    """
    bound_batches(docs.sparkSession)

    def cut(batch: pa.RecordBatch):
        ids, offsets = WordTokenizer.load(tokenizer).encode(batch.column(1))
        keys = batch.column(0).to_pylist()
        rows: tuple[list, ...] = ([], [], [], [], [])
        for k, key in enumerate(keys):
            own = np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(0)).astype("<u4")
            for n, start in enumerate(range(0, len(own), capacity)):
                part = own[start : start + capacity]
                for column, value in zip(rows, (key, n, start, len(part), zlib.crc32(part.tobytes()))):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, PIECES, TEXT_BYTES)


Pattern = tuple[int, ...]  # the lengths in a bin, longest first


def apart(histogram: dict[int, int]) -> Counter:
    """Bins by pattern with their numbers, as a start: each document in a bin of its own."""
    return Counter({(length,): n for length, n in histogram.items()})


class Search:
    """Exchanges between underfull bins that raise the sum of squared fills, until bins empty.

    Bins with the same lengths are one class with a number, and an exchange is made by as many bins of two
    classes as there are, so the work follows the variety of lengths and not the documents. The fullest class
    takes from the emptiest that can give: a document for none (a move), one for one, two for one or one for
    two; the largest gain of the first kind that has one. A class that
    can't gain waits until nothing else can, and is then tried with all givers again.
    """

    def __init__(self, bins: Counter, capacity: int):
        self.capacity = capacity
        self.full: Counter[Pattern] = Counter()
        self.under: Counter[Pattern] = Counter()
        #: Underfull classes by a length, and by the sum of two lengths, in them.
        self.one: dict[int, set[Pattern]] = {}
        self.two: dict[int, set[Pattern]] | None = None
        #: Which lengths and sums there are.
        self.lengths, self.sums = bytearray(capacity + 1), bytearray(capacity + 1)
        self.exchanges: Counter[str] = Counter()
        self.fresh: list[tuple[int, Pattern]] = []
        for pattern, n in bins.items():
            self.add(pattern, n)

    def total(self) -> int:
        return sum(self.full.values()) + sum(self.under.values())

    def _index(self, pattern: Pattern, there: bool) -> None:
        kinds = [(self.one, self.lengths, dict.fromkeys(pattern))]
        if self.two is not None:
            kinds.append((self.two, self.sums, self._sums(pattern)))
        for table, marks, keys in kinds:
            for k in keys:
                if there:
                    table.setdefault(k, set()).add(pattern)
                    marks[k] = 1
                else:
                    table[k].discard(pattern)
                    if not table[k]:
                        del table[k]
                        marks[k] = 0

    def _pair(self) -> None:
        """Index the sums of two lengths from now on."""
        self.two = {}
        for p in self.under:
            for k in self._sums(p):
                self.two.setdefault(k, set()).add(p)
                self.sums[k] = 1

    @staticmethod
    def _sums(pattern: Pattern) -> dict[int, tuple[int, int]]:
        """A pair of lengths for each sum of two documents in a bin."""
        each = Counter(pattern)
        lengths = list(each)
        return {x + y: (x, y) for i, x in enumerate(lengths) for y in lengths[i:] if x != y or each[x] > 1}

    def add(self, pattern, n: int) -> None:
        pattern = tuple(sorted(pattern, reverse=True))
        if not pattern or not n:
            return
        table = self.full if sum(pattern) == self.capacity else self.under
        if table is self.under and n > 0 and not table[pattern]:
            self._index(pattern, True)
            heapq.heappush(self.fresh, (-sum(pattern), pattern))
        table[pattern] += n
        if not table[pattern]:
            del table[pattern]
            if table is self.under:
                self._index(pattern, False)

    def _giver(self, classes: set[Pattern], taker: Pattern) -> Pattern | None:
        """The emptiest class that isn't fuller than the taker."""
        most = sum(taker)
        return min((p for p in classes if sum(p) <= most and (p != taker or self.under[p] > 1)), key=lambda p: (sum(p), p), default=None)

    def _change(self, taker: Pattern):
        """(kind, giver, given, taken) of the best exchange for a class, or None."""
        free = self.capacity - sum(taker)
        if self.two is None and len(self.under) <= PAIRED_CLASSES:
            self._pair()
        back = [(0, ())] + [(y, (y,)) for y in dict.fromkeys(taker)]
        kinds = [("move", self.one, back[:1]), ("one for one", self.one, back[1:])]
        if self.two is not None:
            kinds += [("two for one", self.two, back[1:]), ("one for two", self.one, [(y, pair) for y, pair in self._sums(taker).items()])]
        for kind, table, taken in kinds:
            there = self.lengths if table is self.one else self.sums
            best = None
            for y, out in taken:
                # the largest gain that some giver allows, if it is above what is found already
                x = min(y + free, len(there) - 1)
                while (x := there.rfind(1, y + (best[0] if best else 0) + 1, x + 1)) >= 0:
                    giver = self._giver(table[x], taker)
                    if giver is not None:
                        best = (x - y, kind, giver, (x,) if table is self.one else self._sums(giver)[x], out)
                        break
                    x -= 1
                if best and best[0] == free:
                    break
            if best:
                return best[1:]
        return None

    def run(self) -> "Search":
        """Search to the end: no bin more can empty, or no exchange of any kind helps any class."""
        tokens = sum(sum(p) * n for t in (self.full, self.under) for p, n in t.items())
        least = -(-tokens // self.capacity)
        waiting: list[Pattern] = []
        moved = False
        while self.total() > least:
            if not self.fresh:
                if not moved and self.two is not None:
                    break
                if not moved and self.under:
                    # whatever the number of classes, all pairs take part in the last exchanges
                    self._pair()
                self.fresh = [(-sum(p), p) for p in dict.fromkeys(waiting) if p in self.under]
                heapq.heapify(self.fresh)
                waiting, moved = [], False
                if not self.fresh:
                    break
            taker = heapq.heappop(self.fresh)[1]
            if taker not in self.under:
                continue
            found = self._change(taker)
            if found is None:
                waiting.append(taker)
                continue
            kind, giver, given, taken = found
            n = self.under[taker] // 2 if giver == taker else min(self.under[taker], self.under[giver])
            a, b = Counter(giver), Counter(taker)
            a.subtract(given)
            a.update(taken)
            b.subtract(taken)
            b.update(given)
            self.add(giver, -n)
            self.add(taker, -n)
            self.add(a.elements(), n)
            self.add(b.elements(), n)
            if taker in self.under:
                heapq.heappush(self.fresh, (-sum(taker), taker))
            self.exchanges[kind] += n
            moved = True
        return self


def local_search(histogram: dict[int, int], capacity: int) -> Search:
    """Pack lengths with multiplicities: each document by itself at first, then exchanges."""
    return Search(apart(histogram), capacity).run()


def slots(bins: Counter) -> dict[int, tuple[np.ndarray, list]]:
    """For each length: the first numbers of its runs, and for each run (copies in a bin, first sequence, offsets)."""
    found: dict[int, tuple[list, list]] = {}
    taken: Counter[int] = Counter()
    sequence = 0
    for pattern in sorted(bins, reverse=True):
        n = bins[pattern]
        at, places = 0, {}
        for length in pattern:
            places.setdefault(length, []).append(at)
            at += length
        for length, offsets in places.items():
            firsts, runs = found.setdefault(length, ([], []))
            firsts.append(taken[length])
            runs.append((len(offsets), sequence, offsets))
            taken[length] += n * len(offsets)
        sequence += n
    return {k: (np.array(a, dtype=np.int64), b) for k, (a, b) in found.items()}


def pack(parts: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Give each piece a sequence and its place there.

    Only the histogram of lengths, of at most `capacity` rows, comes to the driver. The search packs
    lengths with multiplicities. Pieces of a length are numbered in salted groups, so that no group
    grows with one frequent length, and take the slots of their length in that order. Equal pieces
    are interchangeable. An empty table gives an empty table.
    """
    spark = parts.sparkSession
    salts = max(32, partitions(spark))
    parts = materialize(parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")), "pieces")
    counts = parts.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = local_search(histogram, capacity)
    places = slots(found.full + found.under)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        parts.withColumn("k", F.row_number().over(inside) - 1)
        .join(firsts, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("k") + F.col("first")).alias("number"))
    )

    def place(batch: pa.RecordBatch):
        lengths, numbers = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            firsts, runs = places[int(length)]
            rows = np.flatnonzero(lengths == length)
            which = np.searchsorted(firsts, numbers[rows], "right") - 1
            for run in np.unique(which):
                copies, base, offsets = runs[run]
                own = rows[which == run]
                into = numbers[own] - firsts[run]
                sequence[own] = base + into // copies
                offset[own] = np.array(offsets, np.int64)[into % copies]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return map_arrow(numbered, place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity), capacity)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
