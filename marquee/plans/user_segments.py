"""Interactions -> user features -> clusters, with all tables of the analysis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from marquee.operators import clustering, features
from marquee.scale import durable


@dataclass(frozen=True)
class Segmentation:
    """Named result tables, the chosen k and the report text."""

    tables: dict[str, DataFrame]
    best_k: int
    report: str


def prepared_features(clean: DataFrame) -> DataFrame:
    """Features per user, imputed and with logarithms of the counts."""
    return features.log_counts(features.impute_features(features.user_features(clean)))


def segment_users(interactions: DataFrame, ks: Sequence[int] = range(2, 9), seed: int = 42, n_init: int = 20,
                  metric: str = "squared") -> Segmentation:
    """The whole analysis on typed interactions (the fact, or a typed CSV)."""
    clean = features.clean_interactions(interactions)
    users = durable(prepared_features(clean))
    if users.isEmpty():
        raise ValueError("No interaction is complete: check that the catalogue has prices and dates.")
    columns = features.feature_columns(users)
    scaled = durable(clustering.scale_features(users, columns))
    metrics, centres = clustering.sweep_k(scaled, columns, ks, seed, n_init, metric)
    best_k = clustering.select_k(metrics)
    chosen = clustering.centroids_scaled(centres, best_k, columns)
    labels = clustering.assignments(chosen, scaled, columns).select("user_id", "label")
    labelled = durable(users.join(labels, "user_id"))

    sizes = clustering.cluster_sizes(labelled)
    traits = clustering.top_traits(labelled, columns)
    summary = clustering.report(metrics, sizes, traits, features.cleaning_report(interactions))
    spark = users.sparkSession
    tables = {
        "raw_interactions_snapshot": interactions,
        "clean_interactions": clean,
        "user_features": users.orderBy("user_id"),
        "scaled_user_features": scaled.orderBy("user_id"),
        "feature_list": spark.createDataFrame([(name,) for name in columns], "feature string"),
        "kmeans_metrics": metrics.orderBy("k"),
        "kmeans_assignments": labels.orderBy("user_id"),
        "kmeans_cluster_profiles": clustering.cluster_profiles(labelled, columns).orderBy("label"),
        "kmeans_cluster_sizes": sizes.orderBy("label"),
        "kmeans_cluster_centroids_scaled": chosen.orderBy("label"),
        "kmeans_cluster_top_traits": traits.orderBy("label", "direction", "rank"),
    }
    return Segmentation(tables, best_k, summary.first()["text"])
