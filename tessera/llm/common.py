"""What the corpus operators share: table access, materialisation, batched word coding."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch at most; a batch of long texts is cut further by bytes in `slices`.
BATCH_BYTES = 8 << 20
#: Bits of the bitmaps that stand for sets of keys: 8 MB.
KEY_BITS = 1 << 26
#: Spark's own setting for removing the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one serves a single local JVM only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: a cut of lineage that outlives executors.

    The shuffles of the writing plan serve nothing else, so their files go as soon as the table is there.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no plan reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def key_bits(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of the keys' hashes, in rows of 4 KB (bucket, bits): of at most KEY_BITS bits however many keys there are."""
    at = F.pmod(F.xxhash64(key), F.lit(KEY_BITS))
    return keys.select(F.shiftright(at, 15).cast("int").alias("bucket"), at.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def marked(rows: DataFrame, key: str, bits: DataFrame, there: bool = True) -> DataFrame:
    """Rows whose key may be among those of key_bits (or, with there=False, those whose key certainly isn't).

    A filter before a shuffle, not a verdict: with very many keys the bitmap fills and lets all rows pass.
    The bitmap is broadcast; KEY_BITS bounds it.
    """
    at = F.pmod(F.xxhash64(rows[key]), F.lit(KEY_BITS))
    bit = at.bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring(bits["bits"], F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = (F.shiftright(at, 15).cast("int") == bits["bucket"]) & (F.expr("0") != byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(F.lit(7)))))
    return rows.join(F.broadcast(bits), hit, "left_semi" if there else "left_anti")


def release() -> None:
    """Give back what a worker's allocators hold unused; where the C library has no call for it, what Arrow holds."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn, schema: str, most: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow, with batches of bounded bytes: fn gets a RecordBatch and yields RecordBatches.

    Workers outlive their tasks, so what a task freed goes back at its end.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, most):
                yield from fn(part)
        release()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = BATCH_BYTES):
    """Cut a batch so that a part holds about `most` bytes, one row at least."""
    if batch.nbytes <= most or batch.num_rows < 2:
        yield batch
        return
    half = batch.num_rows // 2
    for part in (batch.slice(0, half), batch.slice(half)):
        yield from slices(part, most)


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of bounded rows and bytes: texts may be long, and a worker holds a batch at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{2 * BATCH_BYTES}b")


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words (runs of other than \\x20 and \\x09-\\x0D) of each text: codes, the distinct words, row offsets.

    A null text has no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.values.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary.to_pylist()
    codes = codes[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if "" in words:
        real = codes != words.index("")
        offsets = np.concatenate(([0], np.cumsum(real)))[offsets]
        codes = codes[real]
    return codes, words, offsets


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate pool[starts[i] : starts[i] + lengths[i]] for all i."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    step = np.repeat(starts - np.concatenate(([0], ends[:-1])), lengths)
    return pool[np.arange(ends[-1]) + step]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: a bijection whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where a column of df has one."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        found.append(name)
    return found


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text"):
    """Half of a text's SHA-256: 128 bits that stand for it."""
    return F.substring(F.unhex(F.sha2(F.col(column).cast("binary"), 256)), 1, 16)
