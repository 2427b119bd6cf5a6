"""Enrichment through keyed caches, forecasts and nearby places."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.geo import EARTH_RADIUS_M, haversine_m, round_key
from marquee.functions.instants import expiry
from marquee.functions.lookups import (DEFAULT_COORDINATES, LODGING_KINDS, city_table, lookup_weather_code)
from marquee.functions.text import cache_id, strip_accents_lower
from marquee.scale import durable, spread_join, top_per_key
from marquee.schemas import LODGING, RESTAURANT, SEMANTIC_FIELDS

def fields_complete(required: Sequence[str]) -> Column:
    """True where none of the fields is NULL."""
    return F.expr(" AND ".join(f"`{name}` IS NOT NULL" for name in required))


def merge_hits_misses(hits: DataFrame, misses: DataFrame) -> DataFrame:
    """Both branches of a cache lookup; columns only one of them has are NULL in the other."""
    return hits.unionByName(misses, allowMissingColumns=True)


def per_batch(setup: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: T.StructType | str
              ) -> Callable[[DataFrame], DataFrame]:
    """A function over pandas batches as an answer source: `setup` runs once per task, e.g. to open a client."""
    def answer(requests: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = setup()
            for batch in batches:
                yield call(batch)

        return requests.mapInPandas(run, schema)

    return answer


def cache_aside(df: DataFrame, cache: DataFrame, keys: list[str], valid: Column, fn: Callable[[DataFrame], DataFrame],
                out_schema: T.StructType, request: Sequence[str] = (), keep_request: bool = False) -> tuple[DataFrame, DataFrame]:
    """Look rows up in a cache and ask `fn` once per distinct missing key.

    `fn` takes one row per missing key (keys and `request` columns) and gives keys plus the columns of
    `out_schema`; a key it cannot answer is left out, or is NULL in all of them. Returns the enriched
    rows (rows with a NULL key or no answer have NULLs) and the answers to store.

    A key shared by many rows is asked for once, and only its answer travels to the rows. The answers are stored before
    they are used, so `fn` is not asked again for the updates. Of several valid cache rows of a key, or several answers,
    the greatest in the order of their other columns counts. `keep_request` adds the `request` columns to what is to store.
    """
    fields = out_schema.fieldNames()
    base = df.drop(*fields)
    any_null = F.expr(" OR ".join(f"`{key}` IS NULL" for key in keys))
    keyed = base.filter(~any_null)

    def unique(rows: DataFrame) -> DataFrame:
        others = [F.col(name).desc_nulls_last() for name, kind in rows.dtypes if name not in keys and "map<" not in kind]
        return top_per_key(rows, keys, others or [F.col(keys[0])])

    usable = unique(cache.filter(valid)).select(*keys, *fields)
    order = [F.col(name).asc_nulls_last() for name in request]
    wanted = keyed.select(*keys, *[name for name in request if name not in keys])
    missing = top_per_key(wanted, keys, order or [F.col(keys[0])]).join(usable.select(*keys), keys, "left_anti")
    answered = fn(missing).select(*keys, *[F.col(f.name).cast(f.dataType).alias(f.name) for f in out_schema.fields])
    something = F.expr(" OR ".join(f"`{name}` IS NOT NULL" for name in fields))
    new = unique(answered.filter(something))
    fresh = durable(new.join(missing, keys) if keep_request else new)

    answers = merge_hits_misses(usable, fresh.select(*keys, *fields))
    enriched = spread_join(keyed, answers, keys)
    # Rows without a key skip the join; they would all meet in one partition.
    passed = base.filter(any_null)
    return merge_hits_misses(enriched, passed), fresh


VENUE_ANSWER = T.StructType([
    T.StructField("nearby_restaurants", T.ArrayType(RESTAURANT)),
    T.StructField("nearby_lodgings", T.ArrayType(LODGING)),
])


def enrich_venue(df: DataFrame, cache: DataFrame, fn: Callable[[DataFrame], DataFrame], now: Column,
                 out_schema: T.StructType = VENUE_ANSWER) -> tuple[DataFrame, DataFrame]:
    """Nearby places of each event's venue. A cached venue is used until `expires_at`; fresh answers last two weeks.

    Events without a venue or coordinates pass through untouched. A row to store also has the venue's name, city and
    coordinates, those of its least event.
    """
    located = F.col("venue_id").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    request = ["venue_name", "city", "latitude", "longitude"]
    keyed = df.withColumn("_venue", F.when(located, F.col("venue_id")))
    stored = cache.withColumnRenamed("venue_id", "_venue")
    valid = F.coalesce(F.col("expires_at") > now, F.lit(False))

    def ask(missing: DataFrame) -> DataFrame:
        return fn(missing.withColumnRenamed("_venue", "venue_id")).withColumnRenamed("venue_id", "_venue")

    enriched, fresh = cache_aside(keyed, stored, ["_venue"], valid, ask, out_schema, request, keep_request=True)
    updates = fresh.withColumnRenamed("_venue", "venue_id").withColumns(
        {"created_at": now, "expires_at": expiry(now, 14)})
    return enriched.drop("_venue"), updates


def enrich_semantic(df: DataFrame, cache: DataFrame, fn: Callable[[DataFrame], DataFrame], advice: T.StructType
                    ) -> tuple[DataFrame, DataFrame]:
    """Semantic attributes by event name. A cached row counts only if all thirteen attributes are there.

    A name that cannot be answered leaves NULLs and nothing to store.
    """
    out = T.StructType([T.StructField("arrival_advice", advice), *SEMANTIC_FIELDS.fields])
    keyed = df.withColumn("cache_id", cache_id(F.col("name")))
    request = [name for name in ("name", "description", "segment", "genre", "subgenre", "venue_name", "event_time")
               if name in df.columns]
    enriched, fresh = cache_aside(
        keyed, cache, ["cache_id"], fields_complete(SEMANTIC_FIELDS.fieldNames()), fn, out, request)
    return enriched.drop("cache_id"), fresh


def enrich_weather(df: DataFrame, forecast: DataFrame) -> DataFrame:
    """Adds `weather` from a forecast table keyed by rounded coordinates and date.

    Rows without coordinates or date, or without a forecast, have a NULL struct.
    """
    table = forecast.select(
        F.col("latitude").alias("_lat"), F.col("longitude").alias("_lng"), F.col("event_date").alias("_date"),
        F.struct(
            "temp_max", "temp_min", "rain_mm", "weather_code",
            lookup_weather_code(F.col("weather_code")).alias("description"), "wind_max_kmh",
        ).alias("weather"))
    unique = top_per_key(table, ["_lat", "_lng", "_date"], [F.col("weather")])
    complete = F.expr("latitude IS NOT NULL AND longitude IS NOT NULL AND event_date IS NOT NULL")
    keyed = df.filter(complete).withColumns({
        "_lat": round_key(F.col("latitude"), 3), "_lng": round_key(F.col("longitude"), 3), "_date": F.col("event_date")})
    key = ["_lat", "_lng", "_date"]
    named = unique.join(keyed.select(*key).distinct(), key, "left_semi")  # only what the rows name is repeated
    found = spread_join(keyed, named, key).drop(*key)
    return merge_hits_misses(found, df.filter(~complete))


def resolve_home_location(users: DataFrame, cities: DataFrame | None = None,
                          default: tuple[float, float] = DEFAULT_COORDINATES) -> DataFrame:
    """Adds `home_lat`, `home_lng`: stored coordinates, else the city's, else the default."""
    known = cities if cities is not None else city_table(users.sparkSession)
    table = known.groupBy("city_key").agg(F.min(F.struct("lat", "lng")).alias("_at")).select(
        "city_key", F.col("_at.lat").alias("_lat"), F.col("_at.lng").alias("_lng"))
    stored = F.col("preferred_location_lat").isNotNull() & F.col("preferred_location_lng").isNotNull()
    # A user who has coordinates needs no city, so the key stays NULL and finds nothing.
    keyed = users.withColumn("city_key", F.when(~stored, strip_accents_lower(F.col("preferred_location"))))
    joined = keyed.join(table, "city_key", "left")
    lat = F.when(stored, F.col("preferred_location_lat")).otherwise(F.coalesce("_lat", F.lit(default[0])))
    lng = F.when(stored, F.col("preferred_location_lng")).otherwise(F.coalesce("_lng", F.lit(default[1])))
    return joined.withColumns({"home_lat": lat, "home_lng": lng}).drop("city_key", "_lat", "_lng")


def surviving_categories(selected: Column, available: Column) -> Column:
    """The selected categories that are still available, in their order."""
    return F.array_intersect(selected, available)


# Nearby places

METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180.0
BAND_DEGREES = 5.0
FINEST_CELL_M = 8.0  # cells stay well above the one metre that distances are rounded to


def top_k_places(pairs: DataFrame, k: int = 20, keys: Sequence[str] = ("venue_id",)) -> DataFrame:
    """The `k` nearest places of every venue."""
    return top_per_key(pairs, list(keys), [F.col("distance_m"), F.col("place_id")], k)


def nearby_places(venues: DataFrame, places: DataFrame, radius_m: float, types: Sequence[str], k: int = 20
                  ) -> DataFrame:
    """The `k` nearest places of the given types within a radius of every venue.

    `venues(venue_id, latitude, longitude)`, `places(place_id, latitude, longitude, types)`. Gives
    (venue_id, place_id, distance_m).

    The map is cut into cells at several sizes, each half the one before. A venue searches at the
    finest size at which its own cell already holds `k` places: these are at most one cell diagonal
    away, so the nearest `k` lie in the cells up to two away. Where places are dense a venue therefore
    looks at a small area, and only where they are sparse at the whole radius. Places at one spot are
    equally far from everything, so of each spot the first `k` suffice.
    """
    n_levels = max(1, int(math.log2(max(radius_m / FINEST_CELL_M, 1.0))) + 1)
    levels = F.sequence(F.lit(0), F.lit(n_levels - 1))

    def height(level: Column) -> Column:
        return F.lit(radius_m * 1.01 / METRES_PER_DEGREE) / F.pow(F.lit(2.0), level)

    def width(level: Column, band: Column) -> Column:
        """Degrees of longitude that are at least `height` metres everywhere in the band of latitudes."""
        edge = F.greatest(F.abs(band * BAND_DEGREES), F.abs((band + 1) * BAND_DEGREES)) + F.lit(0.2)
        return height(level) / F.cos(F.radians(F.least(edge, F.lit(89.9))))

    def band_of(lat: Column) -> Column:
        return F.floor(lat / F.lit(BAND_DEGREES)).cast("int")

    def with_cells(points: DataFrame, lat: str, lng: str) -> DataFrame:
        row = F.floor(F.col(lat) / height(F.col("level"))).cast("bigint")
        col = F.floor(F.col(lng) / width(F.col("level"), F.col("band"))).cast("bigint")
        return points.withColumns({"row": row, "col": col})

    cell = ["band", "level", "row", "col"]
    spots = (places.filter(F.arrays_overlap("types", F.array(*[F.lit(word) for word in types])))
             .filter("latitude IS NOT NULL AND longitude IS NOT NULL")
             .select("place_id", F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lng")))
    spots = top_per_key(spots, ["p_lat", "p_lng"], [F.col("place_id")], k)
    placed = with_cells(
        spots.withColumn("band", band_of(F.col("p_lat"))).select("*", F.explode(levels).alias("level")),
        "p_lat", "p_lng")

    sites = (venues.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
             .select(F.col("latitude").alias("v_lat"), F.col("longitude").alias("v_lng")).distinct())
    own = with_cells(
        sites.filter(F.abs("v_lat") < 79.0)  # nearer the poles cells get too wide for the diagonal bound
        .withColumn("band", band_of(F.col("v_lat"))).select("*", F.explode(levels).alias("level")),
        "v_lat", "v_lng")
    full = placed.groupBy(*cell).agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    finest = own.join(full, cell, "left_semi").groupBy("v_lat", "v_lng").agg(F.max("level").alias("level"))
    searching = sites.join(finest, ["v_lat", "v_lng"], "left").withColumn("level", F.coalesce("level", F.lit(0)))

    # Cells up to two away: in the venue's band and a near neighbouring one, on both sides of the antimeridian.
    reach = height(F.col("level")) * F.lit(3.0)
    bands = F.array_distinct(F.array(
        *[band_of(lat) for lat in (F.col("v_lat") - reach, F.col("v_lat"), F.col("v_lat") + reach)]))
    margin = width(F.col("level"), F.col("band")) * F.lit(3.0)
    turns = F.filter(F.array(F.lit(0.0), F.lit(-360.0), F.lit(360.0)),
                     lambda turn: F.abs(F.col("v_lng") + turn) <= F.lit(180.0) + margin)
    near = F.sequence(F.lit(-2), F.lit(2))
    around = (searching.select("*", F.explode(bands).alias("band"))
              .select("*", F.explode(turns).alias("turn"))
              .withColumn("x", F.col("v_lng") + F.col("turn")))
    cells = (with_cells(around, "v_lat", "x")
             .select("v_lat", "v_lng", "band", "level", "row", "col", F.explode(near).alias("up"))
             .select("v_lat", "v_lng", "band", "level", (F.col("row") + F.col("up")).alias("row"), "col",
                     F.explode(near).alias("right"))
             .select("v_lat", "v_lng", "band", "level", "row", (F.col("col") + F.col("right")).alias("col")))
    distance = haversine_m(F.col("v_lat"), F.col("v_lng"), F.col("p_lat"), F.col("p_lng"))
    pairs = (cells.join(placed, cell)
             .select("v_lat", "v_lng", "place_id", distance.alias("distance_m"))
             .filter(F.col("distance_m") <= radius_m))
    nearest = top_k_places(pairs, k, ["v_lat", "v_lng"])
    named = nearest.withColumnsRenamed({"v_lat": "latitude", "v_lng": "longitude"})
    return spread_join(venues.select("venue_id", "latitude", "longitude"), named, ["latitude", "longitude"], "inner").select(
        "venue_id", "place_id", "distance_m")


RESTAURANT_TYPES = ["restaurant"]
LODGING_TYPES = [*LODGING_KINDS, "lodging"]


def venue_surroundings(venues: DataFrame, places: DataFrame, k: int = 20) -> DataFrame:
    """Restaurants within 1 km and lodgings within 5 km of every venue, at most `k` each."""
    food = nearby_places(venues, places, 1000.0, RESTAURANT_TYPES, k).withColumn("kind", F.lit("restaurant"))
    beds = nearby_places(venues, places, 5000.0, LODGING_TYPES, k).withColumn("kind", F.lit("lodging"))
    return food.unionByName(beds)

