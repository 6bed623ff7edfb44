"""Statistics over graphs: degrees and label frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.graphs import PropertyGraph


def vertex_degree(g: PropertyGraph) -> DataFrame:
    degree = g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return g.vertices.select("id").join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree"))


def label_frequency(g: PropertyGraph) -> DataFrame:
    return g.vertices.groupBy("label").agg(F.count("*").alias("n"))


def edge_label_frequency(g: PropertyGraph) -> DataFrame:
    """Edges by the labels of their ends, in both directions."""
    return g.labelled_edges().groupBy("ls", "ld").agg(F.count("*").alias("n"))


def label_summary(g: PropertyGraph) -> DataFrame:
    """One row: number of labels and the greatest label frequency."""
    return label_frequency(g).agg(F.count("*").alias("n_labels"), F.coalesce(F.max("n"), F.lit(0).cast("bigint")).alias("max_frequency"))


def max_degree(g: PropertyGraph) -> DataFrame:
    return vertex_degree(g).agg(F.max("degree").alias("max_degree"))


def neighbour_labels(labelled: DataFrame) -> DataFrame:
    """(src, ls, ld, n): how many neighbours of each label a vertex has."""
    return labelled.groupBy("src", "ls", "ld").agg(F.count("*").alias("n"))
