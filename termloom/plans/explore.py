"""Interactive use of a finished model: the searches and the cluster report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import vectors
from termloom.functions.text import normalize_title
from termloom.operators import clusters, lsa, search
from termloom.operators.title_index import TitleIndex, title_index
from termloom.settings import stored
from termloom.sources import artifacts


@dataclass(frozen=True)
class ClusterReport:
    silhouettes: DataFrame
    best_k: int
    sizes: DataFrame
    strengths: DataFrame
    scatter: DataFrame


class Explorer:
    """Loads the result tables of a job once and answers questions about them.

    The tables are JSON as the job writes it. Rows without a key are numbered on load in the order of the part
    files and of the rows in them, and the tables are stored as parquet with their norms.
    """

    def __init__(self, spark: SparkSession, out: str, fmt: str = "json"):
        self.topics = artifacts.read_artifact(spark, out, artifacts.TOPICS, fmt)
        terms = artifacts.in_file_order(artifacts.read_artifact(spark, out, artifacts.TERMS, fmt), "file_order")
        docs = artifacts.in_file_order(artifacts.read_artifact(spark, out, artifacts.DOCS, fmt), "file_order")
        present = F.col("embedding").isNotNull()
        self.terms = stored(
            terms.filter(present & F.col("term").isNotNull()).select(
                F.coalesce(F.col("term_id").cast("long"), F.col("file_order")).alias("term_id"),
                "term",
                "embedding",
                vectors.l2_norm(F.col("embedding")).alias("norm"),
            ),
            "explorer_terms",
        )
        self.docs = stored(
            docs.filter(present & F.col("title").isNotNull()).select(
                F.coalesce(F.col("doc_id"), F.col("file_order")).alias("doc_id"),
                normalize_title(F.col("title")).alias("title"),
                "embedding",
                vectors.l2_norm(F.col("embedding")).alias("norm"),
            ),
            "explorer_docs",
        )

    def similar_terms(self, text: str, n: int = search.TOP_RESULTS) -> DataFrame:
        return search.similar_terms(self.terms, text, n)

    @cached_property
    def titles(self) -> TitleIndex:
        """Built by the first title search."""
        return title_index(self.docs)

    def find_document(self, text: str) -> DataFrame:
        return self.titles.candidates(text)

    def similar_docs(self, title: str, n: int = search.TOP_RESULTS) -> DataFrame:
        """Documents nearest to the first document of this title."""
        own = search.select_title(self.docs, title)
        return search.nearest(self.docs, own, "doc_id", "title", n, exclude_key="doc_id")

    def docs_for_term(self, text: str, n: int = search.TOP_RESULTS) -> DataFrame:
        return search.docs_for_term(self.terms, self.docs, text, n)

    def cluster_report(
        self, ks=clusters.SWEEP, k: int = clusters.DEFAULT_K, restarts: int = clusters.RESTARTS, mode: str = "fixed"
    ) -> ClusterReport:
        """Silhouettes of the raw vectors over `ks`, then k clusters of the normalised ones."""
        points = stored(
            clusters.last_per_term(self.terms).select("term", F.col("embedding").alias("features")), "cluster_points"
        )
        scores = clusters.silhouette_sweep(points, "term", ks, restarts)
        best_k = clusters.pick_k(scores, mode, k).first().k
        labeled, centers = clusters.final_clusters(points, "term", best_k, restarts)
        projection = clusters.Projection(clusters.normalized(points))
        return ClusterReport(
            silhouettes=scores,
            best_k=best_k,
            sizes=clusters.cluster_sizes(labeled),
            strengths=lsa.topic_strength(self.topics),
            scatter=clusters.scatter_table(labeled, centers, projection),
        )
