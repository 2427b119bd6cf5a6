"""Catalogue documents and catalogue queries.

Groups of occurrences are kept in long form (one row per occurrence, one row per group) and never
as one array per group: a single show may have any number of dates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.geo import in_box
from marquee.functions.instants import iso_text, parse_instant, sort_instant_text
from marquee.functions.lookups import lookup_price_level, place_type
from marquee.functions.text import identity_key, stripped
from marquee.functions.values import first_or_null, to_number
from marquee.scale import spread_join, top_per_key

NO_DATE = "—"


# Documents

def pick_image(images: Column, ratio: str, min_width: int = 0) -> Column:
    """URL of the widest image of that ratio and width, else of the widest one; ties go to the first."""
    # One pass: Spark would work out a list that several parts of an expression name once for each of them.
    ranked = F.transform(images, lambda image, i: F.struct(
        F.coalesce((image["ratio"] == ratio) & (F.coalesce(image["width"], F.lit(0)) >= min_width), F.lit(False)).alias("wanted"),
        F.coalesce(image["width"], F.lit(0)).alias("width"), (-i).alias("order"), image["url"].alias("url")))
    return F.array_max(ranked)["url"]


def _coordinate(text: Column) -> Column:
    return F.when(text != "", to_number(text))


def raw_event_rules() -> dict[str, Column]:
    """Reasons for which a raw document is rejected: each column is true where the rule is broken."""
    location = first_or_null(F.col("_embedded.venues"))["location"]
    start = F.col("dates.start.dateTime")
    return {
        "missing id": F.col("id").isNull(),
        "latitude is not a number": (location["latitude"] != "") & to_number(location["latitude"]).isNull(),
        "longitude is not a number": (location["longitude"] != "") & to_number(location["longitude"]).isNull(),
        "start is not an instant": (start != "") & parse_instant(start).isNull(),
    }


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that break no rule, rows that break one with the first reason in `error`)."""
    reason = F.coalesce(*[F.when(broken, F.lit(text)) for text, broken in rules.items()])
    judged = df.withColumn("error", reason)
    return judged.filter(F.col("error").isNull()).drop("error"), judged.filter(F.col("error").isNotNull())


def flatten_event(raw: DataFrame) -> DataFrame:
    """Nested document -> 26 flat columns."""
    kind = first_or_null(F.col("classifications"))
    venue = first_or_null(F.col("_embedded.venues"))
    artist = first_or_null(F.col("_embedded.attractions"))
    start = F.col("dates.start")
    return raw.select(
        "id",
        "name",
        "url",
        F.coalesce("test", F.lit(False)).alias("is_test"),
        start["localDate"].alias("event_date"),
        start["localTime"].alias("event_time"),
        parse_instant(start["dateTime"]).alias("starts_at"),
        F.col("dates.status.code").alias("status"),
        F.col("sales.public.startDateTime").alias("sale_start"),
        F.col("sales.public.endDateTime").alias("sale_end"),
        kind["segment"]["name"].alias("segment"),
        kind["genre"]["name"].alias("genre"),
        kind["subGenre"]["name"].alias("subgenre"),
        venue["id"].alias("venue_id"),
        venue["name"].alias("venue_name"),
        venue["city"]["name"].alias("city"),
        venue["address"]["line1"].alias("address"),
        venue["postalCode"].alias("postal_code"),
        _coordinate(venue["location"]["latitude"]).alias("latitude"),
        _coordinate(venue["location"]["longitude"]).alias("longitude"),
        artist["id"].alias("artist_id"),
        artist["name"].alias("artist_name"),
        pick_image(artist["images"], "3_2", 300).alias("artist_image"),
        pick_image(F.col("images"), "16_9", 1000).alias("event_image"),
        F.col("promoter.name").alias("promoter"),
        "description",
    )


def drop_test_events(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce("is_test", F.lit(False)))


def project_warehouse(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns, in its order; missing ones are NULL and NULL arrays are empty."""
    def column(field: T.StructField) -> Column:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        if isinstance(field.dataType, (T.DateType, T.TimestampType)) and field.name in df.columns:
            typed = value.try_cast(field.dataType)
        else:
            typed = value.cast(field.dataType)
        if isinstance(field.dataType, T.ArrayType):
            typed = F.coalesce(typed, F.array().cast(field.dataType))
        return typed.alias(field.name)

    return df.select(*[column(field) for field in schema.fields])


def sort_places(places: Column) -> Column:
    """Places by distance. An unknown distance and one of 0 m both come last, as 9999."""
    def rank(place: Column) -> Column:
        return F.coalesce(F.nullif(place["distance_m"], F.lit(0).cast("bigint")), F.lit(9999).cast("bigint"))

    keyed = F.transform(places, lambda place, i: F.struct(rank(place).alias("rank"), i.alias("i"), place.alias("p")))
    return F.transform(F.array_sort(keyed), lambda item: item["p"])


def field_mask_places(places: Column, distance: Column | None = None, lodging: bool = False) -> Column:
    """API places -> the kept fields under our names, with the price level as a symbol."""
    def convert(place: Column) -> Column:
        fields = [place["displayName"]["text"].alias("name")]
        if lodging:
            fields.append(place_type(F.coalesce(place["types"], F.array().cast("array<string>"))).alias("kind"))
        fields += [
            place["rating"].alias("rating"),
            lookup_price_level(place["priceLevel"]).alias("price"),
            place["formattedAddress"].alias("address"),
            (place["distance_m"] if distance is None else distance).alias("distance_m"),
        ]
        return F.struct(*fields)

    return F.transform(places, convert)


# Queries

def mappable_events(df: DataFrame) -> DataFrame:
    return df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def bbox_filter(df: DataFrame, lat_min: float | None, lat_max: float | None,
                lng_min: float | None, lng_max: float | None) -> DataFrame:
    """Rows inside the box. Unless all four bounds are given there is no box."""
    bounds = (lat_min, lat_max, lng_min, lng_max)
    if any(bound is None for bound in bounds):
        return df
    return df.filter(in_box(F.col("latitude"), F.col("longitude"), *bounds))


def catalog_page(df: DataFrame, n: int) -> DataFrame:
    """The first `n` events by start; events without one come first."""
    return df.orderBy(F.col("starts_at").asc_nulls_first(), F.col("id")).limit(n)


def _matching(df: DataFrame, city: str | None, segments: Sequence[str] | None, date: str | None) -> DataFrame:
    if city:
        df = df.filter(F.col("city") == city)
    if date:
        df = df.filter(F.col("event_date") == F.lit(date))
    if segments:
        df = df.filter(F.col("segment").isin(list(segments)))
    return df


def query_catalog(df: DataFrame, city: str | None = None, segments: Sequence[str] | None = None,
                  date: str | None = None, bbox: tuple | None = None, limit: int = 1000,
                  box_first: bool = True) -> DataFrame:
    """One page of the catalogue by start.

    `box_first=False` cuts the page before it applies the box, so it may return fewer rows than match.
    """
    if not 1 <= limit <= 5000:
        raise ValueError("limit must be between 1 and 5000")
    found = _matching(df, city, segments, date)
    if bbox is None:
        return catalog_page(found, limit)
    if box_first:
        return catalog_page(bbox_filter(found, *bbox), limit)
    return bbox_filter(catalog_page(found, limit), *bbox)


def get_event(df: DataFrame, event_id: str, key: str = "id") -> DataFrame:
    """The event with that document key; the key replaces a stored `id`."""
    return df.filter(F.col(key) == event_id).withColumn("id", F.col(key))


def list_categories(df: DataFrame, city: str | None = None, date: str | None = None,
                    bbox: tuple | None = None, cap: int | None = None) -> DataFrame:
    """Sorted non-empty segments. `cap` looks only at that many first events; the default looks at all."""
    found = _matching(df, city, None, date)
    if cap is not None:
        found = catalog_page(found, cap)
    if bbox is not None:
        found = bbox_filter(found, *bbox)
    return found.filter(F.col("segment") != "").select("segment").distinct().orderBy("segment")


def with_group_key(df: DataFrame) -> DataFrame:
    """Adds the show's identity and the text that its occurrences are sorted by."""
    return df.withColumns({
        "group_key": identity_key(F.col("name"), F.col("venue_name"), F.col("city")),
        "sort_instant": sort_instant_text(F.col("starts_at"), F.col("event_date"), F.col("event_time")),
    })


def group_occurrences(df: DataFrame) -> DataFrame:
    """One row per show: its first occurrence (`primary`) and the number of occurrences.

    The occurrences themselves are the rows of `with_group_key(df)`. The first one is a minimum, so
    it is found before the shuffle.
    """
    keyed = with_group_key(df)
    first = F.min(F.struct("sort_instant", "id", "latitude", "longitude", "name", "venue_name", "city"))
    return keyed.groupBy("group_key").agg(first.alias("primary"), F.count("*").alias("n_occurrences"))


def visible_groups(groups: DataFrame, bbox: tuple | None) -> DataFrame:
    """Shows whose first occurrence is inside the box."""
    if bbox is None:
        return groups
    return groups.filter(in_box(F.col("primary.latitude"), F.col("primary.longitude"), *bbox))


def first_per_identity(df: DataFrame, order_by: Sequence[Column] | None = None) -> DataFrame:
    """The first event of every show, by start unless another order is given."""
    order = list(order_by or [F.col("starts_at").asc_nulls_first(), F.col("id")])
    return top_per_key(with_group_key(df), ["group_key"], order).drop("group_key", "sort_instant")


def sibling_occurrences(df: DataFrame, event_ids: DataFrame) -> DataFrame:
    """All occurrences of the shows that the events in `event_ids(id)` belong to, each row once.

    Asking for several events of one show does not repeat its occurrences: `group_key` tells which
    show a row belongs to.
    """
    keyed = with_group_key(df)
    wanted = keyed.join(event_ids.select("id").distinct(), "id", "left_semi").select("group_key").distinct()
    return spread_join(keyed, wanted, ["group_key"], "left_semi")


def build_schedule(df: DataFrame) -> DataFrame:
    """Dates and times of every show: (group_key, date, time, url).

    A (date, time) has the URL of its first occurrence. A date that has no time at all is one row
    with a NULL time, and a blank date is written as a dash.
    """
    keyed = with_group_key(df)
    date = stripped(F.coalesce(F.col("event_date").cast("string"), F.lit("")))
    time = stripped(F.coalesce("event_time", F.lit("")))
    slots = keyed.select(
        "group_key",
        F.when(date == "", F.lit(NO_DATE)).otherwise(date).alias("date"),
        F.nullif(time, F.lit("")).alias("time"),
        F.struct("sort_instant", "id", "url").alias("slot"),
    )
    firsts = slots.groupBy("group_key", "date", "time").agg(F.min("slot").alias("slot"))
    # Of a date's slots the timeless one is kept only if it is the only one.
    latest = firsts.groupBy("group_key", "date").agg(F.max("time").alias("_any_time"))
    timed = firsts.filter(F.col("time").isNotNull()).select("group_key", "date", "time", F.col("slot.url").alias("url"))
    bare = latest.filter(F.col("_any_time").isNull()).select(
        "group_key", "date", F.lit(None).cast("string").alias("time"), F.lit(None).cast("string").alias("url"))
    return timed.unionByName(bare)


def exclude_saved(candidates: DataFrame, saved: DataFrame) -> DataFrame:
    """Candidates (user_id, event_id, ...) that the user has not saved yet."""
    return candidates.join(saved.select("user_id", "event_id"), ["user_id", "event_id"], "left_anti")


def deck(df: DataFrame, saved: DataFrame, user: str, n: int = 50) -> DataFrame:
    """The cards of one user: the first page of the catalogue, one per show, without saved ones."""
    cards = first_per_identity(catalog_page(df, n))
    mine = saved.filter(F.col("user_id") == user).select(F.col("event_id").alias("id"))
    return cards.join(mine, "id", "left_anti")


EVENT_FIELDS = [
    "id", "name", "url", "event_date", "event_time", "starts_at", "status", "sale_start", "sale_end", "segment",
    "genre", "subgenre", "venue_id", "venue_name", "city", "address", "latitude", "longitude", "artist_id",
    "artist_name", "artist_image", "event_image", "promoter", "nearby_restaurants", "nearby_lodgings",
    "arrival_advice",
]


def serialise_event(df: DataFrame) -> DataFrame:
    """(id, json): the API's document. Unknown columns are dropped, instants are ISO text, lists default to []."""
    kinds = dict(df.dtypes)

    def column(name: str) -> Column:
        if name not in kinds:
            empty = name.startswith("nearby_")
            return (F.array().cast("array<string>") if empty else F.lit(None).cast("string")).alias(name)
        value = F.col(name)
        if kinds[name].startswith("timestamp"):
            value = iso_text(value)
        elif kinds[name] == "date":
            value = value.cast("string")
        elif kinds[name].startswith("array"):
            value = F.coalesce(value, F.array().cast(kinds[name]))
        return value.alias(name)

    body = F.to_json(F.struct(*[column(name) for name in EVENT_FIELDS]), {"ignoreNullFields": "false"})
    return df.select("id", body.alias("json"))
