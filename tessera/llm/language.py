"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, map_arrow, table

#: Labelled texts that a profile is learned from, at most, for each language.
SAMPLE = 600
#: N-grams of a language's profile, and of a document's.
PROFILE = 400
#: Lengths of the n-grams, in letters; words are padded with one blank on either side.
GRAMS = (1, 2, 3)
UNDETERMINED = "und"
#: Documents with a lower score are taken to be of no learned language.
LEAST_SCORE = 0.1
#: Bits of a letter in an n-gram's code; no letter of Unicode lies beyond them. The length stands above.
LETTER_BITS = 18
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point the lower-case letter it stands for, or 0."""
    global _letters
    if _letters is None:
        found = np.zeros(0x110000, np.uint64)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                found[c] = ord(low) if len(low) == 1 else c
        _letters = found
    return _letters


def grams_of(text: str) -> np.ndarray:
    """Codes of all n-grams of a whole text; empty if it has no letter."""
    letters = letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    blank = letters == 0
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    s = np.concatenate((np.zeros(1, np.uint64), letters[keep], np.zeros(1, np.uint64)))
    if not s.any():
        return s[:0]
    parts, code = [], s
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            code = (code[:-1] << np.uint64(LETTER_BITS)) | s[n - 1 :]
        if n in GRAMS:
            parts.append(code[code > 0] | np.uint64(n << 60))
    return np.concatenate(parts)


def profile_of(text: str, size: int) -> np.ndarray:
    """The most frequent n-grams, ties to the smaller code."""
    codes, counts = np.unique(grams_of(text), return_counts=True)
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Ranked n-grams of each language."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted(ranked)
        codes = np.unique(np.concatenate([np.array(ranked[k], np.uint64) for k in self.langs]) if self.langs else np.zeros(0, np.uint64))
        self.codes = codes
        self.ranks = np.full((len(self.langs), len(codes)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            own = np.array(ranked[lang], np.uint64)
            self.ranks[k, np.searchsorted(codes, own)] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of least out-of-place distance, ties to the smaller name, and a score from 0 to 1.

        The distance adds up how far each n-gram of the document lies from its place in the profile, and
        the full size for one that the profile lacks. The score is one less the share of the largest
        distance there can be.
        """
        own = profile_of(text, self.size) if text else np.zeros(0, np.uint64)
        if not len(own) or not self.langs:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == own
        ranks = self.ranks[:, at]
        away = np.abs(ranks - np.arange(len(own)))
        away[(ranks < 0) | ~known] = self.size
        total = np.minimum(away, self.size).sum(axis=1)
        best = int(np.argmin(total))
        return self.langs[best], float(1 - total[best] / (self.size * len(own)))


def learn(labelled: DataFrame, sample: int = SAMPLE, size: int = PROFILE) -> Profiles:
    """Profiles from at most `sample` texts of each language, those with the least hashes.

    Rows with a null text or lang are passed over. The driver gets `size` n-grams of each language.
    """
    spark = labelled.sparkSession
    bound_batches(spark)
    rows = labelled.filter("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text", "lang").alias("h"))
    # the threshold comes from hashes alone, so no text is sorted; ties at it are all in
    order = Window.partitionBy("lang", "salt").orderBy("h")
    salts = 16
    first = rows.select("lang", "h", F.pmod("h", F.lit(salts)).alias("salt")).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= max(1, sample // salts))
    # a few rows of a language, fewer than its profile, which comes to the driver anyway
    bound = first.groupBy("lang", "salt").agg(F.max("h").alias("most"))
    chosen = rows.withColumn("salt", F.pmod("h", F.lit(salts))).join(F.broadcast(bound), ["lang", "salt"]).filter("h <= most").dropDuplicates(["lang", "h"])

    def count(batch: pa.RecordBatch):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[list] = [[], [], []]
        for lang in sorted(set(langs)):
            codes, counts = np.unique(np.concatenate([grams_of(t) for k, t in zip(langs, texts) if k == lang]), return_counts=True)
            out[0] += [lang] * len(codes)
            out[1].append(codes.view(np.int64))
            out[2].append(counts)
        if langs:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2]).astype(np.int64))], ["lang", "gram", "n"])

    counted = map_arrow(chosen.select("lang", "text"), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("k") <= size)
    ranked: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["k"])):
        ranked.setdefault(r["lang"], []).append(r["gram"] % (1 << 64))
    return Profiles(ranked, size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """All columns of docs, with lang_pred and score. A null text, or one without a letter, is `und` with score 0.

    Columns of these two names are replaced.
    """
    bound_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*names)
    at = names.index("text")

    def run(batch: pa.RecordBatch):
        found = [profiles.predict(t) for t in batch.column(at).cast(pa.string()).to_pylist()]
        added = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs, run, f"{kinds}, lang_pred string, score double")


def held_out():
    """Documents that are not learned from: crc32 of the id's digits, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.filter(~held_out()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return identify(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")
