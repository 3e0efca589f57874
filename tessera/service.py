"""What a caller of the retrieval side uses: search, task context and reindexing, answered as plain dictionaries."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import TASK_ID, display_code
from tessera.operators.chunks import artifacts, corpus
from tessera.operators.context import FILL_SYMBOLS, task_context
from tessera.operators.embedding import Embed, vectors, with_embeddings
from tessera.operators.retrieval import search
from tessera.sources.files import Index, load_index

# What an answer without results says, and the results asked for by default.
NO_HITS = "Query returned no hits. Try path_prefix (e.g. 'src/pipeline/') or grep for known symbols."
NO_HITS_AFTER_REFRESH = "Query returned no hits after index refresh. Try path_prefix (e.g. 'src/pipeline/') or grep for known symbols."
TOP_K = 8
FIELDS = ("path", "function", "symbol", "kind", "line_start", "line_end", "score", "match_reasons", "code", "task_id")


def index_state(index: Index) -> dict:
    return {"built_at": index.built_at, "chunk_count": index.chunk_count, "files_changed_since_index": index.files_changed, "reindexed": index.reindexed}


def answer(results: list[dict], index: Index, query: str | None, touchpoints: dict | None = None) -> dict:
    """Results with the state of the index, and a hint if a query found nothing."""
    out = {"results": results, "index": index_state(index)}
    if touchpoints is not None:
        out["touchpoints"] = touchpoints
    if query and not results:
        out["hint"] = NO_HITS_AFTER_REFRESH if index.files_changed else NO_HITS
    return out


def _listed(rows: DataFrame) -> list[dict]:
    """Result rows, of which there are top_k at most."""
    return [r.asDict(recursive=True) for r in rows.select(*FIELDS).collect()]


@dataclass(frozen=True)
class Tools:
    """The tools over one versioned index. sources gives path, content and mtime_us of the corpus' files at present.

    Without a model chunks have empty vectors, and retrieval goes by words and symbols.
    """

    spark: SparkSession
    index_path: str
    sources: Callable[[], DataFrame]
    embed: Embed | None = None

    def _index(self, force: bool = False) -> Index:
        return load_index(self.spark, self.index_path, self.sources(), self._chunks, force)

    def _chunks(self, files: DataFrame) -> DataFrame:
        found = corpus(files)
        if self.embed:
            return with_embeddings(found, self.embed)
        return found.withColumn("embedding", F.array().cast("array<double>"))

    def _vector(self, text: str) -> list[float] | None:
        return vectors(self.embed, [text])[0] if self.embed else None

    def search(self, query: str, top_k: int = TOP_K, path_prefix: str | None = None, kind: str | None = None) -> dict:
        """The best chunks for a query; none are looked for if top_k is below 1."""
        index = self._index()
        if top_k < 1:
            return answer([], index, query)
        return answer(_listed(search(index.chunks, query, top_k, path_prefix, kind, self._vector(query))), index, query)

    def task_context(self, task: str, top_k: int = TOP_K) -> dict:
        """Documents, symbols and files of a task, filled up by a search; an error if task names no task id."""
        found = re.search(TASK_ID, task or "")
        if not found:
            raise ValueError(f"no task id: {task}")
        name = found.group(0).upper()
        index = self._index()
        plans = artifacts(self.sources().filter(F.col("path").endswith(".md")))
        own = plans.filter(F.col("task_id") == name).select("files", "symbols").first()
        touchpoints = {"files": list(own["files"]) if own else [], "symbols": list(own["symbols"]) if own else []}
        vector = self._vector(" ".join(touchpoints["symbols"][:FILL_SYMBOLS]) or name)
        rows = task_context(index.chunks, plans, name, top_k, vector)
        texts = index.chunks.select("pos", F.col("symbol").alias("function"), display_code().alias("code"), "task_id")
        # top_k rows at most are broadcast; chunks of one pos are equal
        results = _listed(texts.join(F.broadcast(rows), "pos").dropDuplicates(["pos"]).orderBy("stage", "at"))
        if not results and top_k > 0:
            results = _listed(search(index.chunks, name, top_k, vector=vector))
        return answer(results, index, name, touchpoints)

    def reindex(self) -> dict:
        """Build the index anew."""
        return {"status": "ok", "index_path": self.index_path, "index": index_state(self._index(force=True)) | {"files_changed_since_index": 0}}
