"""The operators as stages over a documents table: each takes and returns its columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, key_bits, marked, materialize, text_key
from tessera.llm.language import LEAST_SCORE, UNDETERMINED, held_out, identify, learn
from tessera.llm.near import near_duplicates, text_hash
from tessera.llm.packing import pack_documents
from tessera.llm.repeats import repeated_spans, without
from tessera.llm.secrets import find_secrets, redacted
from tessera.llm.tokens import vocabulary

#: Bytes of a repeated passage at least, where passages of fifty words and more are to go: words of five letters and a
#: blank make 300, and a passage may end within a word.
PASSAGE_BYTES = 200


def known_language(docs: DataFrame) -> DataFrame:
    """Documents of a learned language: those without a letter, or far from every profile, go."""
    profiles = learn(docs.filter(~held_out()))
    found = identify(docs, profiles).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return found.select(*docs.columns)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id.

    Of repeated doc_ids in a group the text of the least hash stays, and repeated rows become one. A
    group of null ids alone keeps its different texts.
    """
    found = near_duplicates(docs).filter("kept")
    doc, th = fresh(docs, "k_doc", "k_th")
    named = found.filter("doc_id is not null").groupBy("doc_id", F.col("n_shingles") > 0).agg(F.min("th").alias("th")).select("doc_id", "th")
    unnamed = found.filter("doc_id is null").select("doc_id", "th")
    keep = named.union(unnamed).distinct().select(F.col("doc_id").alias(doc), F.col("th").alias(th))
    rows = docs.withColumn(th, text_hash())
    out = rows.join(keep, (rows[th] == keep[th]) & rows["doc_id"].eqNullSafe(keep[doc]), "left_semi")
    return out.dropDuplicates(["doc_id", th]).select(*docs.columns)


def without_repeats(docs: DataFrame, length: int = PASSAGE_BYTES) -> DataFrame:
    """Texts without the bytes that repeated strings cover; what is left of a cut character goes too.

    Documents of which nothing is left go. n_chars is counted anew where a text changed. Texts without
    repeats are not moved. Null and empty texts stay as they are.
    """
    tid, cuts, kept = fresh(docs, "k_tid", "k_spans", "k_kept")
    spans = repeated_spans(docs, length).withColumnsRenamed({"tid": tid, "spans": cuts})
    rows = docs.withColumn(tid, text_key())
    bits = key_bits(spans, tid)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([without(t.as_buffer().to_pybytes(), s).decode("utf-8", "ignore") for t, s in zip(texts, spans.to_pylist())], pa.string())

    rest = marked(rows, tid, bits, there=False).select(*docs.columns)
    near = marked(rows, tid, bits).join(spans, tid, "left")
    same = near.filter(F.col(cuts).isNull()).select(*docs.columns)
    changed = near.filter(F.col(cuts).isNotNull()).withColumn(kept, cut(F.col("text").cast("binary"), F.col(cuts))).filter(F.col(kept) != "")
    own = {"text": F.col(kept), "n_chars": F.length(kept).cast("long")}
    return rest.union(same).union(changed.select(*[own[c].alias(c) if c in own else F.col(c) for c in docs.columns]))


def without_secrets(docs: DataFrame) -> DataFrame:
    """Texts with every secret masked; n_chars is counted anew where a text changed. No document goes.

    Null and empty texts stay as they are. Texts without a secret are not moved; copies of a text are masked alike.
    """
    tid, cuts, masked = fresh(docs, "k_tid", "k_spans", "k_text")
    spans = find_secrets(docs).filter("size(spans) > 0").select(F.col("tid").alias(tid), F.col("spans").alias(cuts))
    spans = materialize(spans.dropDuplicates([tid]), "masks")
    rows = docs.withColumn(tid, F.sha2(F.col("text").cast("binary"), 256))
    bits = key_bits(spans, tid)
    rest = marked(rows, tid, bits, there=False).select(*docs.columns)
    near = marked(rows, tid, bits).join(spans, tid, "left")
    changed = F.col(cuts).isNotNull()
    near = near.withColumn(masked, F.when(changed, redacted(F.col("text"), F.col(cuts))).otherwise(F.col("text")))
    own = {"text": F.col(masked), "n_chars": F.when(changed, F.length(masked).cast("long")).otherwise(F.col("n_chars"))}
    return rest.union(near.select(*[own[c].alias(c) if c in own else F.col(c) for c in docs.columns]))


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of all documents with their sequences; null texts are empty, repeated rows are documents of their own."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))
