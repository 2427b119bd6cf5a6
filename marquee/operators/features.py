"""Interaction cleaning and per-user behaviour features, all as native aggregations."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.instants import days_between, elapsed_days
from marquee.functions.text import slugify
from marquee.scale import distinct_values, durable, top_per_key

CRITICAL = ["event_timestamp", "ingestion_timestamp", "event_date", "liked", "price_min", "price_max", "user_id"]
COUNT_FEATURES = ["total_swipes", "distinct_segments_liked", "distinct_genres_liked", "distinct_cities_liked",
                  "sessions_count", "events_seen"]
FIXED_FEATURES = [
    "total_swipes", "right_swipe_rate", "left_swipe_rate", "distinct_segments_liked", "distinct_genres_liked",
    "distinct_cities_liked", "avg_liked_price", "avg_disliked_price", "avg_days_until_event_liked",
    "avg_days_until_event_disliked", "genre_entropy_all", "genre_entropy_liked", "city_entropy_liked",
    "recency_days", "activity_span_days", "sessions_count", "events_seen",
]


# Cleaning

def dedupe_first(df: DataFrame, key: str, order_by: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_per_key(df, [key], order_by)


def only_swipes(df: DataFrame) -> DataFrame:
    return df.filter(F.lower("interaction_type") == "swipe")


def _liked_by_direction() -> Column:
    return F.when(F.col("swipe_direction") == "right", True).when(F.col("swipe_direction") == "left", False)


def liked_mismatch() -> Column:
    """True where the direction says one thing and `liked` another, or nothing."""
    wanted = _liked_by_direction()
    return wanted.isNotNull() & ~wanted.eqNullSafe(F.col("liked"))


def repair_liked(df: DataFrame) -> DataFrame:
    """`liked` follows the direction where there is one; `liked_repaired` marks the changed rows."""
    return df.withColumns({
        "liked_repaired": liked_mismatch(),
        "liked": F.coalesce(_liked_by_direction(), F.col("liked")),
    })


def price_swapped() -> Column:
    return F.coalesce(F.col("price_max") < F.col("price_min"), F.lit(False))


def repair_price_order(df: DataFrame) -> DataFrame:
    """Puts swapped prices in order; `price_repaired` marks the changed rows."""
    low, high, swapped = F.col("price_min"), F.col("price_max"), price_swapped()
    return df.withColumns({
        "price_repaired": swapped,
        "price_min": F.when(swapped, high).otherwise(low),
        "price_max": F.when(swapped, low).otherwise(high),
    })


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=CRITICAL)


def derive_interaction(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "days_until_event": days_between(F.to_date("event_timestamp"), F.col("event_date")),
        "avg_price": (F.col("price_min") + F.col("price_max")) / F.lit(2.0),
        "is_right_swipe": F.coalesce(F.col("swipe_direction") == "right", F.lit(False)).cast("int"),
    })


def _input_order(df: DataFrame) -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in df.columns if name != "interaction_id"]


def clean_interactions(df: DataFrame, order_by: Sequence[Column] | None = None) -> DataFrame:
    """All cleaning steps on typed interactions. Rows without prices are dropped, see `cleaning_report`."""
    unique = dedupe_first(df, "interaction_id", order_by or _input_order(df))
    repaired = repair_price_order(only_swipes(repair_liked(unique)))
    return derive_interaction(drop_incomplete(repaired)).drop("liked_repaired", "price_repaired")


def cleaning_report(df: DataFrame, order_by: Sequence[Column] | None = None) -> DataFrame:
    """One row with the eight counters of the cleaning steps, all taken in one aggregation."""
    unique = dedupe_first(df, "interaction_id", order_by or _input_order(df))
    judged = repair_price_order(repair_liked(unique))
    swipe = F.coalesce(F.lower("interaction_type") == "swipe", F.lit(False))
    complete = F.expr(" AND ".join(f"{column} IS NOT NULL" for column in CRITICAL))
    counts = judged.agg(
        F.count("*").alias("rows_after_dedup"),
        F.count_if("liked_repaired").alias("direction_liked_mismatches"),
        F.count_if(swipe).alias("rows_after_interaction_filter"),
        F.count_if(swipe & F.col("price_repaired")).alias("price_swaps"),
        F.count_if(swipe & ~complete).alias("rows_dropped_invalid"),
        F.count_if(swipe & complete).alias("clean_rows"),
        F.count_distinct(F.when(swipe & complete, F.col("user_id"))).alias("unique_users"),
    )
    # On a stored table this count comes from the files' metadata.
    return counts.select(df.agg(F.count("*")).scalar().alias("input_rows"), "*")


# Single feature groups, one row per user

def _rate(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def user_activity(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(
        F.count("*").alias("total_swipes"),
        _rate(F.col("liked")).alias("right_swipe_rate"),
        _rate(~F.col("liked")).alias("left_swipe_rate"),
        F.count_distinct("session_id").alias("sessions_count"),
        F.count_distinct("event_id").alias("events_seen"),
    )


def liked_diversity(df: DataFrame) -> DataFrame:
    def kinds(column: str) -> Column:
        return F.count_distinct(F.when(F.col("liked"), F.col(column)))

    return df.groupBy("user_id").agg(
        kinds("segment").alias("distinct_segments_liked"),
        kinds("genre").alias("distinct_genres_liked"),
        kinds("city").alias("distinct_cities_liked"),
    )


def price_lead_means(df: DataFrame) -> DataFrame:
    liked = F.col("liked")
    return df.groupBy("user_id").agg(
        F.avg(F.when(liked, F.col("avg_price"))).alias("avg_liked_price"),
        F.avg(F.when(~liked, F.col("avg_price"))).alias("avg_disliked_price"),
        F.avg(F.when(liked, F.col("days_until_event"))).alias("avg_days_until_event_liked"),
        F.avg(F.when(~liked, F.col("days_until_event"))).alias("avg_days_until_event_disliked"),
    )


def _entropy(count: Column) -> Column:
    """Base-2 entropy from the counts of a group's values; no values give 0."""
    total = F.sum(count).cast("double")
    spread = F.sum(count * F.log2(count.cast("double")))
    bits = F.greatest(F.log2(total) - spread / total, F.lit(0.0))
    return F.coalesce(F.when(total > 0, bits), F.lit(0.0)) + F.lit(0.0)


def entropy(df: DataFrame, by: Sequence[str], value: str, where: Column | None = None) -> DataFrame:
    """Entropy of the non-NULL values (where the condition holds) of every group."""
    counted = F.col(value).isNotNull() if where is None else F.col(value).isNotNull() & where
    counts = df.groupBy(*by, value).agg(F.count_if(counted).alias("n"))
    return counts.groupBy(*by).agg(_entropy(F.when(F.col("n") > 0, F.col("n"))).alias("entropy"))


def recency_span(df: DataFrame) -> DataFrame:
    """Whole days since the newest interaction of all users, and between a user's first and last."""
    newest = df.agg(F.max("event_timestamp")).scalar()
    spans = df.groupBy("user_id").agg(F.min("event_timestamp").alias("first"), F.max("event_timestamp").alias("last"))
    return spans.select(
        "user_id",
        elapsed_days(F.col("last"), newest).cast("double").alias("recency_days"),
        elapsed_days(F.col("first"), F.col("last")).cast("double").alias("activity_span_days"),
    )


def slug_names(df: DataFrame, values: Sequence[str]) -> dict[str, str]:
    """Value -> column-name part. Two values with the same part are an error."""
    if not values:
        return {}
    spark = df.sparkSession
    rows = spark.createDataFrame([(value,) for value in values], "value string").select(
        "value", slugify(F.col("value")).alias("slug")).collect()
    names = {row["value"]: row["slug"] for row in rows}
    if len(set(names.values())) < len(names):
        raise ValueError(f"values share a column name: {names}")
    return names


def segment_affinity(df: DataFrame, values: Sequence[str] | None = None) -> DataFrame:
    """Per segment: the like rate inside it (0 without rows) and its share of all rows, NULL segments included."""
    columns = []
    for value, slug in slug_names(df, values if values is not None else distinct_values(df, "segment")).items():
        inside = F.coalesce(F.col("segment") == value, F.lit(False))
        rate = F.avg(F.when(inside, F.col("liked").cast("double")))
        columns += [F.coalesce(rate, F.lit(0.0)).alias(f"{slug}_like_rate"),
                    _rate(inside).alias(f"{slug}_swipe_share")]
    return df.groupBy("user_id").agg(*columns) if columns else df.select("user_id").distinct()


def context_share(df: DataFrame, values: Sequence[str] | None = None) -> DataFrame:
    found = values if values is not None else distinct_values(df, "recommendation_context")
    columns = [_rate(F.coalesce(F.col("recommendation_context") == value, F.lit(False))).alias(f"{slug}_share")
               for value, slug in slug_names(df, found).items()]
    return df.groupBy("user_id").agg(*columns) if columns else df.select("user_id").distinct()


# All features

def user_features(df: DataFrame, segments: Sequence[str] | None = None, contexts: Sequence[str] | None = None
                  ) -> DataFrame:
    """All features of every user: 17 fixed ones, two per segment and one per context.

    Rows are counted once per (user, facet, value); that table is written, and all features,
    the segments and the contexts come from it. So the interactions are read once, both shuffles are
    pre-aggregated, and no user's rows ever meet in one task. An input without rows gives no users.
    """
    facets = ["segment", "genre", "city", "recommendation_context", "session_id", "event_id"]
    long = df.select(
        "user_id", "liked", "avg_price", "days_until_event", "event_timestamp",
        *[F.col(facet).cast("string").alias(facet) for facet in facets],
    ).unpivot(["user_id", "liked", "avg_price", "days_until_event", "event_timestamp"], facets, "facet", "value")

    liked = F.col("liked")
    cells = long.groupBy("user_id", "facet", "value").agg(
        F.count("*").alias("n"),
        F.count_if(liked).alias("likes"),
        F.sum(F.when(liked, F.col("avg_price"))).alias("liked_price"),
        F.sum(F.when(~liked, F.col("avg_price"))).alias("disliked_price"),
        F.sum(F.when(liked, F.col("days_until_event"))).alias("liked_lead"),
        F.sum(F.when(~liked, F.col("days_until_event"))).alias("disliked_lead"),
        F.min("event_timestamp").alias("first"),
        F.max("event_timestamp").alias("last"),
    )
    cells = durable(cells)

    def names(facet: str) -> dict[str, str]:
        return slug_names(df, distinct_values(cells.filter(F.col("facet") == facet), "value"))

    segment_names = names("segment") if segments is None else slug_names(df, segments)
    context_names = names("recommendation_context") if contexts is None else slug_names(df, contexts)

    n, likes, value = F.col("n"), F.col("likes"), F.col("value")

    def of(facet: str, amount: Column) -> Column:
        return F.when(F.col("facet") == facet, amount)

    # Every row appears once under each facet, so totals are taken from one of them.
    def total(amount: Column) -> Column:
        return F.sum(of("segment", amount))

    def kinds(facet: str, condition: Column) -> Column:
        return F.count_if((F.col("facet") == facet) & value.isNotNull() & condition)

    def bits(facet: str, amount: Column) -> Column:
        return _entropy(of(facet, F.when(value.isNotNull() & (amount > 0), amount)))

    def picked(facet: str, word: str, amount: Column) -> Column:
        return F.sum(F.when((F.col("facet") == facet) & (value == word), amount))

    aggregates = {
        "total_swipes": total(n), "likes": total(likes),
        "distinct_segments_liked": kinds("segment", likes > 0),
        "distinct_genres_liked": kinds("genre", likes > 0),
        "distinct_cities_liked": kinds("city", likes > 0),
        "liked_price": total(F.col("liked_price")), "disliked_price": total(F.col("disliked_price")),
        "liked_lead": total(F.col("liked_lead")), "disliked_lead": total(F.col("disliked_lead")),
        "genre_entropy_all": bits("genre", n), "genre_entropy_liked": bits("genre", likes),
        "city_entropy_liked": bits("city", likes),
        "first": F.min("first"), "last": F.max("last"),
        "sessions_count": kinds("session_id", F.lit(True)), "events_seen": kinds("event_id", F.lit(True)),
    }
    for i, word in enumerate(segment_names):
        aggregates[f"s{i}_n"] = picked("segment", word, n)
        aggregates[f"s{i}_likes"] = picked("segment", word, likes)
    for i, word in enumerate(context_names):
        aggregates[f"c{i}_n"] = picked("recommendation_context", word, n)
    users = cells.groupBy("user_id").agg(*[column.alias(name) for name, column in aggregates.items()])

    rows = F.col("total_swipes").cast("double")
    dislikes = F.col("total_swipes") - F.col("likes")
    newest = cells.agg(F.max("last")).scalar()

    def mean(amount: str, count: Column) -> Column:
        return F.when(count > 0, F.col(amount).cast("double") / count)

    def share(part: str, whole: Column) -> Column:
        return F.coalesce(F.when(whole > 0, F.col(part) / whole), F.lit(0.0))

    derived = {
        "right_swipe_rate": F.col("likes") / rows,
        "left_swipe_rate": dislikes / rows,
        "avg_liked_price": mean("liked_price", F.col("likes")),
        "avg_disliked_price": mean("disliked_price", dislikes),
        "avg_days_until_event_liked": mean("liked_lead", F.col("likes")),
        "avg_days_until_event_disliked": mean("disliked_lead", dislikes),
        "recency_days": elapsed_days(F.col("last"), newest).cast("double"),
        "activity_span_days": elapsed_days(F.col("first"), F.col("last")).cast("double"),
    }
    result = [derived.get(name, F.col(name)).alias(name) for name in FIXED_FEATURES]
    for i, slug in enumerate(segment_names.values()):
        result += [share(f"s{i}_likes", F.col(f"s{i}_n")).alias(f"{slug}_like_rate"),
                   share(f"s{i}_n", rows).alias(f"{slug}_swipe_share")]
    result += [share(f"c{i}_n", rows).alias(f"{slug}_share") for i, slug in enumerate(context_names.values())]
    return users.select("user_id", *result)


def feature_columns(features: DataFrame) -> list[str]:
    return [name for name in features.columns if name != "user_id"]


# Imputation

SMALL = 10_000


def _ranks(size: int) -> list[int]:
    """The middle ranks, counted from 1: one for an odd number of rows, two for an even one."""
    return sorted({(size + 1) // 2, size // 2 + 1})


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of numeric columns; NULL values do not count.

    Each wanted rank is narrowed down between approximate quantiles until few rows are left around it,
    whatever the size of the table. Every round is one aggregation for all columns together, and only
    counts and edges come back.
    """
    sizes = df.agg(*[F.count(name).alias(name) for name in columns]).first().asDict()
    found: dict[tuple[str, int], float] = {}
    # (column, rank) -> exclusive lower edge, exclusive upper edge, rows up to the lower edge, rows between
    open_: dict[tuple[str, int], tuple] = {
        (name, rank): (None, None, 0, size) for name, size in sizes.items() if size for rank in _ranks(size)}

    def inside(name: str, low: float | None, high: float | None) -> Column:
        value = F.col(name)
        condition = value.isNotNull()
        if low is not None:
            condition &= value > F.lit(low)
        return condition if high is None else condition & (value < F.lit(high))

    while wide := [request for request, state in open_.items() if state[3] > SMALL]:
        quantiles = []
        for name, rank in wide:
            low, high, below, between = open_[name, rank]
            middle = (rank - below) / between
            share = F.array(F.lit(max(middle - 0.005, 0.0)), F.lit(min(middle + 0.005, 1.0)))
            quantiles.append(F.percentile_approx(F.when(inside(name, low, high), F.col(name)), share, 10_000))
        edges = df.agg(*[q.alias(f"q{i}") for i, q in enumerate(quantiles)]).first()
        tallies = []
        for i, (name, _) in enumerate(wide):
            for edge in edges[i]:
                tallies += [F.count_if(F.col(name) < F.lit(edge)), F.count_if(F.col(name) <= F.lit(edge))]
        counts = df.agg(*[tally.alias(f"n{i}") for i, tally in enumerate(tallies)]).first()
        for i, (name, rank) in enumerate(wide):
            low, high, below, between = open_.pop((name, rank))
            (left, right), (under_left, upto_left, under_right, upto_right) = edges[i], counts[4 * i:4 * i + 4]
            if rank <= under_left:
                open_[name, rank] = (low, left, below, under_left - below)
            elif rank <= upto_left:
                found[name, rank] = left
            elif rank <= under_right:
                open_[name, rank] = (left, right, upto_left, under_right - upto_left)
            elif rank <= upto_right:
                found[name, rank] = right
            else:
                open_[name, rank] = (right, high, upto_right, below + between - upto_right)

    if open_:
        names = sorted({name for name, _ in open_})
        wanted = F.lit(False)
        for (name, _), (low, high, _, _) in open_.items():
            bounds = F.lit(True)
            if low is not None:
                bounds &= F.col("value") > F.lit(low)
            if high is not None:
                bounds &= F.col("value") < F.lit(high)
            wanted |= (F.col("feature") == name) & bounds
        long = df.select(*[F.col(name).cast("double").alias(name) for name in names]).unpivot(
            [], names, "feature", "value")
        rows = long.filter(F.col("value").isNotNull() & wanted).groupBy("feature", "value").count().collect()
        for (name, rank), (low, high, below, _) in open_.items():
            position = below
            for value, n in sorted((row["value"], row["count"]) for row in rows if row["feature"] == name
                                   and (low is None or row["value"] > low) and (high is None or row["value"] < high)):
                position += n
                if position >= rank:
                    found[name, rank] = value
                    break
    return {name: (sum(found[name, rank] for rank in _ranks(size)) / len(_ranks(size)) if size else None)
            for name, size in sizes.items()}


def impute_features(features: DataFrame) -> DataFrame:
    """Infinite values become NULL; then `avg_*` columns take their median over users and the others 0.

    The features are written first, as finding the medians reads them more than once.
    """
    columns, kinds = feature_columns(features), dict(features.dtypes)
    infinite = [float("inf"), float("-inf")]

    def finite(name: str) -> Column:
        value = F.col(name)
        return F.when(~value.isin(infinite) & ~F.isnan(value), value) if kinds[name] in ("double", "float") else value

    known = durable(features.select("user_id", *[finite(name).alias(name) for name in columns]))
    middle = medians(known, [name for name in columns if name.startswith("avg_")])
    return known.fillna({name: middle.get(name, 0.0) for name in columns if middle.get(name, 0.0) is not None})


def log_counts(features: DataFrame, columns: Sequence[str] = COUNT_FEATURES) -> DataFrame:
    return features.withColumns({name: F.log1p(name) for name in columns})


# Windows in time

def rolling_user_features(df: DataFrame, as_of: Sequence[dt.date], days: int = 30) -> DataFrame:
    """Features of every user over the `days` days before each date (that day excluded).

    `df` carries the user's home city as `home_city`. A row falls into at most one window per date, so
    it is multiplied by the number of dates that cover it, not by all of them.
    """
    dates = F.array(*[F.lit(day) for day in as_of])
    day = F.to_date("event_timestamp")
    covering = F.filter(dates, lambda date: (day < date) & (day >= F.date_sub(date, days)))
    rows = df.withColumn("as_of", F.explode(covering))
    keys = ["as_of", "user_id"]
    liked = F.col("liked")
    local = F.coalesce(F.col("city") == F.col("home_city"), F.lit(False))
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("total_swipes"),
        _rate(liked).alias("right_swipe_rate"),
        _rate(~liked).alias("left_swipe_rate"),
        F.count_distinct(F.when(liked, F.col("segment"))).alias("distinct_segments_liked"),
        F.count_distinct(F.when(liked, F.col("city"))).alias("distinct_cities_liked"),
        F.avg(F.when(liked, F.col("avg_price"))).alias("avg_liked_price"),
        F.avg(F.when(~liked, F.col("avg_price"))).alias("avg_disliked_price"),
        F.coalesce(F.avg(F.when(local, liked.cast("double"))), F.lit(0.0)).alias("same_city_like_rate"),
        F.avg(F.when(liked, F.col("days_until_event"))).alias("days_until_event_avg_liked"),
        F.max(F.when(liked, day)).alias("last_like"),
    )
    genres = rows.filter(F.col("genre").isNotNull()).groupBy(*keys, "genre").agg(
        F.count("*").alias("n"), F.count_if(liked).alias("likes"))
    top = top_per_key(genres, keys, [F.col("n").desc(), F.col("genre")]).select(
        *keys, (F.col("likes") / F.col("n")).alias("top_genre_like_rate"))
    return base.join(top, keys, "left").select(
        *keys, *[name for name in base.columns if name not in (*keys, "last_like")],
        F.coalesce("top_genre_like_rate", F.lit(0.0)).alias("top_genre_like_rate"),
        days_between(F.col("last_like"), F.col("as_of")).alias("days_since_last_right_swipe"),
    )


def daily_user_aggregate(df: DataFrame) -> DataFrame:
    """One row per user and day, in sums that add up over days."""
    liked = F.col("liked")
    return df.groupBy("user_id", F.to_date("event_timestamp").alias("day")).agg(
        F.count("*").alias("swipes"),
        F.count_if(liked).alias("likes"),
        F.count_if(~liked).alias("dislikes"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("event_id").alias("events_seen"),
        F.sum(F.when(liked, F.col("avg_price"))).alias("liked_price_sum"),
        F.sum(F.when(~liked, F.col("avg_price"))).alias("disliked_price_sum"),
    )
