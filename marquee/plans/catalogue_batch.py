"""One catalogue run: landed pages -> raw copy, dead letters, enriched documents and new warehouse rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import catalog, enrich
from marquee.scale import durable
from marquee.schemas import ARRIVAL_ADVICE, WAREHOUSE
from marquee.sources import readers, sinks
from marquee.sources.stored import KeyedTable


@dataclass(frozen=True)
class CatalogueStore:
    """Keyed tables that runs keep up to date: documents by `id`, venues by `venue_id`, attributes by `cache_id`."""

    documents: KeyedTable
    venues: KeyedTable
    semantics: KeyedTable

    def save(self, run: CatalogueRun, run_id: str) -> None:
        """Documents keep fields that a run lacks. Each table survives a stop by itself; a repeated run changes nothing."""
        self.documents.upsert(run.documents, F.col("starts_at").desc_nulls_last(), run_id)
        self.venues.upsert(run.venue_updates, F.col("expires_at").desc(), run_id)
        self.semantics.upsert(run.semantic_updates, F.col("cache_id"), run_id)


@dataclass(frozen=True)
class CatalogueRun:
    """Tables of a run: the enriched documents and the cache rows to add."""

    documents: DataFrame
    venue_updates: DataFrame
    semantic_updates: DataFrame


def run_catalogue_batch(spark: SparkSession, pages: str, raw_path: str, dead_letter_path: str, warehouse_path: str,
                        venue_cache: DataFrame, venue_answers: Callable[[DataFrame], DataFrame],
                        semantic_cache: DataFrame, semantic_answers: Callable[[DataFrame], DataFrame],
                        forecast: DataFrame, now: dt.datetime, store: CatalogueStore | None = None) -> CatalogueRun:
    """`now` stamps the run and decides which cached venues are still good. With a `store`, the run is saved there."""
    tagged = sinks.land_tagged(readers.tag_pages(spark, pages), raw_path, now)
    typed = durable(readers.typed_events(tagged))  # else the rules would parse the text once for each field that they read
    good, bad = catalog.split_valid(typed, catalog.raw_event_rules())
    rejected = bad.unionByName(readers.rejected_lines(tagged), allowMissingColumns=True)
    sinks.write_dead_letters(rejected, dead_letter_path, now)

    # Every step reads its rows several times (keys, hits, rows without a key), so each is stored: else all
    # that came before would run again for every combination of these. Two sinks read the last one.
    events = durable(catalog.drop_test_events(catalog.flatten_event(good)))
    placed, venue_updates = enrich.enrich_venue(events, venue_cache, venue_answers, F.lit(now))
    described, semantic_updates = enrich.enrich_semantic(durable(placed), semantic_cache, semantic_answers, ARRIVAL_ADVICE)
    documents = durable(enrich.enrich_weather(durable(described), forecast))
    sinks.append_new(documents, warehouse_path, WAREHOUSE, "event_date")
    run = CatalogueRun(documents, venue_updates, semantic_updates)
    if store is not None:
        store.save(run, f"run-{now:%Y%m%d_%H%M%S}")
    return run
