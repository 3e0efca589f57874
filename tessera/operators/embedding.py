"""Embeddings by a pluggable model: any function from texts to vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import embedding_text

Embed = Callable[[list[str]], list[list[float]]]
#: Texts that the model gets at once.
BATCH = 64


def vectors(embed: Embed, texts: list[str], batch: int = BATCH) -> list[list[float]]:
    """The vectors of texts, in their order; the model is not asked for none, and an answer of another length is an error."""
    out: list[list[float]] = []
    for at in range(0, len(texts), batch):
        asked = texts[at : at + batch]
        found = embed(asked)
        if len(found) != len(asked):
            raise ValueError(f"model gave {len(found)} vectors for {len(asked)} texts")
        out += [[float(x) for x in v] for v in found]
    return out


def embedded(text: Column, embed: Embed, batch: int = BATCH) -> Column:
    """The vector of each text; that of a null text is null. The model runs in the workers, so embed must pickle."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            there = texts.notna()
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            out[there] = pd.Series(vectors(embed, texts[there].tolist(), batch), index=texts.index[there], dtype=object)
            yield out

    return run(text)


def with_embeddings(chunks: DataFrame, embed: Embed, batch: int = BATCH) -> DataFrame:
    """Chunks with the vector of each one's labelled text."""
    return chunks.withColumn("embedding", embedded(embedding_text(), embed, batch))
