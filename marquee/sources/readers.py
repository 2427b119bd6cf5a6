"""Readers for landed pages, interaction files, stored ids and operational snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.instants import parse_instant
from marquee.functions.values import parse_bool, to_number
from marquee.operators.quality import require_columns
from marquee.schemas import FACT, RAW_EVENT, RAW_PAGE, SAVED_EVENTS, USERS, with_english_names


def read_event_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed API pages (one JSON document per line) -> one row per event. Empty pages give no rows.

    The fastest way to the events alone. Lines of another shape are left out here; `malformed_pages` gives those, and
    `tag_pages` everything in one parse.
    """
    pages = spark.read.schema(RAW_PAGE).json(path)
    return pages.select(F.explode("_embedded.events").alias("event")).select("event.*")


#: Tags of landed lines and what is wrong with the rejected ones.
EVENT, EMPTY = "event", "empty_page"
REJECTED = {
    "no_json": "page is not JSON", "no_object": "page is not an object", "no_embedding": "page embeds no object",
    "no_list": "events of the page are no list", "no_event": "event is not an object",
}


def tag_pages(spark: SparkSession, path: str) -> DataFrame:
    """(tag, value): every line of landed pages in exactly one form, parsed once.

    A page gives its events, each as JSON text with all of its fields, tagged `event`; what is no object among them, or a page
    that has not the shape of one, is tagged by what is wrong (`REJECTED`) and keeps its text; a page without events is
    `empty_page`. Blank lines count as nothing.
    """
    lines = spark.read.text(path).filter("trim(value) <> ''").withColumn("page", F.try_parse_json("value"))

    def part(name: str, kind: str) -> Column:
        return F.expr(f"try_variant_get(page, '{name}', '{kind}')")

    def missing(name: str) -> Column:
        inner = part(name, "variant")
        return inner.isNull() | F.is_variant_null(inner)

    events = part("$._embedded.events", "array<variant>")
    wrong = (F.when(F.col("page").isNull(), "no_json").when(part("$", "map<string,variant>").isNull(), "no_object")
             .when(~missing("$._embedded") & part("$._embedded", "map<string,variant>").isNull(), "no_embedding")
             .when(~missing("$._embedded.events") & events.isNull(), "no_list")
             .when(F.coalesce(F.size(events), F.lit(0)) <= 0, EMPTY))
    one = F.array(F.struct(F.col("wrong").alias("tag"), F.col("value")))
    each = F.expr(f"""transform(try_variant_get(page, '$._embedded.events', 'array<variant>'), e -> struct(
        IF(try_variant_get(e, '$', 'map<string,variant>') IS NULL, 'no_event', '{EVENT}') AS tag, coalesce(to_json(e), 'null') AS value))""")
    tagged = lines.withColumn("wrong", wrong)
    return tagged.select(F.explode(F.when(F.col("wrong").isNotNull(), one).otherwise(each)).alias("line")).select("line.*")


def typed_events(tagged: DataFrame) -> DataFrame:
    """The events among tagged lines, with the fields that are read."""
    return tagged.filter(F.col("tag") == EVENT).select(F.from_json("value", RAW_EVENT).alias("event")).select("event.*")


def rejected_lines(tagged: DataFrame) -> DataFrame:
    """Rejected lines of landed pages: id (NULL), error, page (the text)."""
    error = F.element_at(F.create_map(*[F.lit(x) for pair in REJECTED.items() for x in pair]), F.col("tag"))
    return tagged.filter(F.col("tag").isin(*REJECTED)).select(F.lit(None).cast("string").alias("id"), error.alias("error"), F.col("value").alias("page"))


def read_page_documents(spark: SparkSession, path: str) -> DataFrame:
    """The event documents of landed pages as JSON text, with every field they have."""
    return tag_pages(spark, path).filter(F.col("tag") == EVENT).select("value")


def malformed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Lines of landed pages that are no pages, and events that are no objects, as rejected rows: id (NULL), error, page."""
    return rejected_lines(tag_pages(spark, path))


def read_raw_events(spark: SparkSession, path: str) -> DataFrame:
    """Raw documents landed by `land_raw`, of all runs."""
    return spark.read.schema(RAW_EVENT).json(path)


def event_window(df: DataFrame, now: dt.datetime, days: int = 12, country: str | None = None) -> DataFrame:
    """Events that start within the next days, in one country if the rows carry one."""
    until = now + dt.timedelta(days=days)
    inside = df.filter(F.col("starts_at").between(F.lit(now), F.lit(until)))
    return inside.filter(F.col("country") == country) if country else inside


def read_ids(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """Stored ids; only that column is read."""
    return spark.read.parquet(path).select(key)


def type_interactions(raw: DataFrame) -> DataFrame:
    """Text columns -> the fact's types. What cannot be parsed becomes NULL."""
    def column(field):
        value = F.col(field.name)
        kind = field.dataType.typeName()
        if kind == "timestamp":
            typed = parse_instant(value.cast("string"))
        elif kind == "date":
            typed = parse_instant(value.cast("string")).cast("date")
        elif kind == "boolean":
            typed = parse_bool(value)
        elif kind == "double":
            typed = to_number(value)
        else:
            typed = value.cast("string")
        return typed.alias(field.name)

    return raw.select(*[column(field) for field in FACT.fields])


def read_interactions_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Interaction CSV as text columns. Fails with the sorted names of missing columns.

    `multi_line` is for values that hold line ends; it makes every file one task, so large files need it off.
    """
    raw = with_english_names(spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path))
    require_columns(raw, FACT.fieldNames())
    return raw.select(*FACT.fieldNames())


OPERATIONAL_TABLES = {"users": USERS, "saved_events": SAVED_EVENTS}


def read_operational(spark: SparkSession, source: str | dict, table: str) -> DataFrame:
    """Users or saved events, from a Parquet snapshot folder or, with a dict of JDBC options, a database.

    For JDBC give `partitionColumn`, `lowerBound`, `upperBound` and `numPartitions` so that the read is split.
    """
    schema = OPERATIONAL_TABLES[table]
    if isinstance(source, dict):
        if lacking := {"partitionColumn", "lowerBound", "upperBound", "numPartitions"} - set(source):
            raise ValueError(f"options that split the read are missing: {', '.join(sorted(lacking))}")
        rows = spark.read.format("jdbc").options(**source, dbtable=table).load()
        known = set(rows.columns)
        return rows.select(*[
            (F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    return spark.read.schema(schema).parquet(f"{source.rstrip('/')}/{table}")
