"""One entrance to indexing, search, feedback and suggestions."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, search, spelling
from ..operators.index import Index
from ..session import written


class QueryType(Enum):
    INTERSECTION = "intersection"
    UNION = "union"
    PHRASE = "phrase"
    RANKED = "ranked"


class Ranking(Enum):
    TF_IDF = "tf_idf"
    PAGERANK = "pagerank"
    COMBINATION = "combination"
    HITS = "hits"


class Normalization(Enum):
    WORDS = "n_tokens"
    EUCLIDEAN = "euclid_len"


class SearchEngine:
    """Searches an index for batches of queries.

    pagerank: (doc_id, pr) for PAGERANK and COMBINATION. links: (src, dst) for HITS,
    between document ids, or between nodes of titles (node, title) if these are given."""

    def __init__(self, index: Index, *, pagerank: DataFrame | None = None, links: DataFrame | None = None, titles: DataFrame | None = None):
        self.index, self.pagerank, self.links, self.titles = index, pagerank, links, titles
        self.spark: SparkSession = index.docs.sparkSession

    def _tokens(self) -> DataFrame:
        return self.index.postings.select("doc_id", F.explode("offsets").alias("pos"), "term")

    def _grams(self) -> DataFrame | None:
        """The saved k-gram index, if it is of the two characters that wildcards ask for."""
        return self.index.kgrams if self.index.k == 2 else None

    def search(self, queries: list[str] | DataFrame, kind: QueryType = QueryType.RANKED, ranking: Ranking = Ranking.TF_IDF, normalization: Normalization = Normalization.WORDS) -> DataFrame:
        """query_id, doc_id, and score (ranked, union) or offsets (phrase, union).

        queries: texts, or parsed query terms with weights. Terms with `*` are expanded."""
        q = search.parse_queries(self.spark, queries) if isinstance(queries, list) else queries
        x = self.index
        if kind is QueryType.INTERSECTION:
            return search.wildcard_intersection(q, x.postings, x.vocab, self._grams())
        if kind is QueryType.PHRASE:
            return search.wildcard_phrase(q, self._tokens(), x.vocab, self._grams())
        wide = written(search.expand_wildcards(q, x.vocab, self._grams()), "terms")
        if kind is QueryType.UNION:
            return search.union(wide, x.postings)
        tf = x.postings.select("term", "doc_id", "tf")
        if ranking is Ranking.PAGERANK:
            return search.by_pagerank(wide, tf, self._given(self.pagerank, "pagerank"))
        if ranking is Ranking.HITS:
            return self._hits(wide, tf)
        scores = search.tfidf(wide, tf, x.doc_stats, x.n, normalization.value)
        return search.combination(scores, self._given(self.pagerank, "pagerank")) if ranking is Ranking.COMBINATION else scores

    def _given(self, df: DataFrame | None, name: str) -> DataFrame:
        if df is None:
            raise ValueError(f"this ranking needs {name}")
        return df

    def _hits(self, q: DataFrame, tf: DataFrame) -> DataFrame:
        """Each query has a root set, and so a graph, of its own; all are iterated at once.

        With titles, documents are nodes by their file names (see `graph.document_nodes`);
        without, nodes are document ids. Nodes that are no documents fall out at the end."""
        links, found = self._given(self.links, "links"), search.matching(q, tf).select("query_id", "doc_id").distinct()
        if self.titles is None:
            known = self.index.docs.select("doc_id", F.col("doc_id").alias("node"))
            titled = known.select("node")
        else:
            known, titled = written(graph.document_nodes(self.index.docs, self.titles), "nodes"), self.titles.select("node")
        root = found.join(known, "doc_id").select("query_id", "node")
        scores = graph.hits_ranking(links, root, titled, by=("query_id",))
        return scores.join(known, "node").select("query_id", "doc_id", "score")

    def feedback(self, queries: list[str] | DataFrame, relevant: DataFrame) -> DataFrame:
        """Query terms with Rocchio weights from (query_id, doc_id) marked relevant; search() takes them."""
        q = search.parse_queries(self.spark, queries) if isinstance(queries, list) else queries
        return search.rocchio(q, relevant, self.index.postings, self.index.vocab, self.index.n)

    def suggest(self, queries: list[str], results: DataFrame, limit: int = 10) -> DataFrame:
        """query_id, rank, phrase, score for queries without results that have an unknown term."""
        q = search.parse_queries(self.spark, queries)
        ask = search.suggestions_needed(q, results, self.index.vocab)
        return spelling.correct(q.join(ask, "query_id", "left_semi"), self.index.vocab, limit=limit)
