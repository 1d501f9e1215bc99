"""Interactive substrate: one object over the tables, lazy results.

Methods take and return DataFrames, so chains of them become one plan; whole
query tables go in, not single queries.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import dense, filters, fusion, graph, lexical


class EvidenceEngine:
    """docs (doc_id, title, abstract, year, ..), chunks (pos, doc_id, text,
    section_type, ..), vectors (pos, vector) by model name, edges (src, dst)."""

    def __init__(self, docs: DataFrame, chunks: DataFrame, vectors: dict[str, DataFrame] | None = None, edges: DataFrame | None = None, index: lexical.Index | None = None):
        self.docs, self.chunks, self.vectors = docs, chunks, vectors or {}
        self._edges, self._index = edges, index

    @cached_property
    def index(self) -> lexical.Index:
        """Built by the first lexical search unless one was given."""
        return self._index or lexical.build(self.chunks)

    @cached_property
    def edges(self) -> DataFrame:
        return self._edges if self._edges is not None else graph.links(self.docs)

    def _documents(self, ranked: DataFrame, k: int) -> DataFrame:
        return fusion.first_per_document(ranked.join(self.chunks.select("pos", "doc_id"), "pos"), k)

    def search_lexical(self, queries: DataFrame, k: int = 20, oversample: int = 3, padded: bool = False) -> DataFrame:
        return self._documents(lexical.search(self.index, queries, k * oversample, padded=padded), k)

    def search_dense(self, queries: DataFrame, model: str, k: int = 20, oversample: int = 3) -> DataFrame:
        """queries has (query_id, vector); an unknown model gives no results."""
        if model not in self.vectors:
            spark: SparkSession = queries.sparkSession
            q, c = queries.schema["query_id"].dataType.simpleString(), self.chunks.schema["pos"].dataType.simpleString()
            return spark.createDataFrame([], f"query_id {q}, pos {c}, score double, rank int, doc_id {self.chunks.schema['doc_id'].dataType.simpleString()}")
        return self._documents(dense.search(self.vectors[model], queries, k, oversample), k)

    def search_hybrid(self, queries: DataFrame, model: str | None = None, k: int = 20, constant: int = 60) -> DataFrame:
        """Fusion by document; lexical only where queries have no vector."""
        lists = [self.search_lexical(queries, 3 * k)]
        if model is not None and "vector" in queries.columns:
            lists.append(self.search_dense(queries.select("query_id", "vector"), model, 3 * k))
        return fusion.reciprocal_rank(lists, "doc_id", k, constant)

    def filter_metadata(self, found: DataFrame, **bounds) -> DataFrame:
        return filters.by_metadata(found, self.docs, **bounds)

    def expand_citations(self, roots: DataFrame, direction: str = "both", most: int = 50) -> DataFrame:
        return graph.expand(roots, self.edges, direction, most)

    def grep_corpus(self, pattern: str, most: int = 20) -> DataFrame:
        return lexical.grep(self.chunks, pattern, most)

    def read_document(self, wanted: DataFrame) -> DataFrame:
        ids = wanted.select("doc_id").distinct()
        return filters.read_document(self.docs.join(ids, "doc_id", "left_semi"), self.chunks.withColumnRenamed("pos", "position").join(ids, "doc_id", "left_semi"))

    def estimate_confidence(self, ranked: DataFrame, queries: DataFrame, **limits) -> DataFrame:
        return filters.confidence(ranked, queries, **limits)

    def prune_evidence(self, evidence: DataFrame, dropped: DataFrame) -> DataFrame:
        return filters.prune(evidence, dropped)

    def tool(self, name: str) -> Callable[..., DataFrame] | None:
        """Method by name, as agents call them, or None."""
        return getattr(self, name, None) if name in TOOLS else None


TOOLS = ("search_lexical", "search_dense", "search_hybrid", "filter_metadata", "expand_citations", "grep_corpus", "read_document", "estimate_confidence", "prune_evidence")
