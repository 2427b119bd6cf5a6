"""Users, saved events and plans: keyed inserts, identities, export, erasure, retention and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import slugify_handle, title_from_text
from marquee.scale import numbered_by_hash, running_count, spread_join, top_per_key

NEARLINE_DAYS, COLDLINE_DAYS = 30, 90
MESSAGES_PER_PAGE = 1000


# Saved events

def save_if_absent(saved: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, conflicting rows). One row per (user, event) may exist; of a batch the earliest wins.

    `rows` has a unique `id` and `created_at`. Rows without user or event are refused: they are among the conflicting ones.
    """
    key = ["user_id", "event_id"]
    first = top_per_key(rows.dropna(how="any", subset=key), key, [F.col("created_at").asc_nulls_last(), F.col("id")])
    fresh = first.join(saved.select(*key), key, "left_anti")
    return fresh, rows.join(fresh.select("id"), "id", "left_anti")


def saved_by_recency(saved: DataFrame) -> DataFrame:
    """Saved events of all users, every user's newest first."""
    return saved.orderBy(F.col("user_id"), F.col("created_at").desc_nulls_last(), F.col("event_id"))


# Identities

def unique_handles(new: DataFrame, existing: DataFrame) -> DataFrame:
    """A handle for every new user (id, name, email): the slug, or the slug with the first free `_2`, `_3`, ...

    Numbers taken by `existing(username)` and slugs of other new users are skipped. With t_1 < t_2 < ...
    the taken numbers of a slug, the r-th free number is r plus how many t_i have t_i - i < r, so no
    user waits for another.
    """
    slugged = new.withColumn("slug", slugify_handle(F.col("name"), F.col("email")))
    ranked = numbered_by_hash(slugged, ["slug"], [F.col("id")], "r")
    slugs = slugged.select("slug").distinct()

    def as_taken(handle: Column) -> list[Column]:
        """A handle blocks number n of the slug it extends."""
        number = F.regexp_extract(handle, r"_([1-9][0-9]*)$", 1)
        return [F.regexp_replace(handle, r"_[1-9][0-9]*$", "").alias("slug"), number.try_cast("bigint").alias("n")]

    numbered = (existing.select(*as_taken(F.col("username")))
                .union(slugs.select(*as_taken(F.col("slug"))))
                .filter("n >= 2"))
    bare = existing.select(F.col("username").alias("slug"), F.lit(1).cast("bigint").alias("n"))
    taken = numbered.union(bare).distinct().join(slugs, "slug", "left_semi")
    # running_count needs positions from 0 up; n is at least 1.
    placed = running_count(taken.withColumn("one", F.lit(1).cast("bigint")), ["slug"], "n", "one", "i")
    blocks = placed.groupBy("slug", (F.col("n") - F.col("i")).alias("free_before")).agg(F.count("*").alias("blocked"))

    # One line per slug: blocks at free_before + 0.5 and users at r, both counted in half steps.
    events = (ranked.select("slug", (F.col("r") * 2).alias("at"), F.lit(0).cast("bigint").alias("blocked"))
              .union(blocks.select("slug", (F.col("free_before") * 2 + 1).alias("at"), "blocked")))
    passed = running_count(events, ["slug"], "at", "blocked", "passed").filter(F.col("at") % 2 == 0)
    numbers = passed.select("slug", (F.col("at") / 2).cast("bigint").alias("r"), "passed")
    final = ranked.join(numbers, ["slug", "r"]).withColumn("number", F.col("r") + F.col("passed"))
    handle = F.when(F.col("number") == 1, F.col("slug")).otherwise(
        F.concat("slug", F.lit("_"), F.col("number").cast("string")))
    return final.select("id", handle.alias("username"))


def accepted_sign_ins(sign_ins: DataFrame) -> DataFrame:
    """Sign-ins with uid and e-mail; password sign-ins need a verified e-mail."""
    unverified = (F.col("provider") == "password") & ~F.coalesce("email_verified", F.lit(False))
    return sign_ins.filter("uid IS NOT NULL AND email IS NOT NULL").filter(~F.coalesce(unverified, F.lit(False)))


def _collapsed(sign_ins: DataFrame, key: str) -> DataFrame:
    """One row per key: first given name and picture, last verified flag and uid, and when the last sign-in was."""
    def first(column: str) -> Column:
        return F.min(F.when(F.col(column).isNotNull(), F.struct("signed_at", "uid", column)))[column].alias(column)

    latest = F.max(F.struct("signed_at", "uid", F.coalesce("email_verified", F.lit(False)).alias("email_verified")))
    grouped = sign_ins.groupBy(key).agg(
        first("name"), first("picture"), latest.alias("latest"),
        F.min(F.struct("signed_at", "uid", "email"))["email"].alias("first_email"))
    columns = [F.col(key), F.col("name"), F.col("picture"), F.col("latest.email_verified").alias("email_verified"),
               F.col("latest.signed_at").alias("signed_at")]
    columns.append(F.col("latest.uid").alias("uid") if key == "email" else F.col("first_email").alias("email"))
    return grouped.select(*columns)


def reconcile_identities(users: DataFrame, sign_ins: DataFrame) -> DataFrame:
    """Users after a batch of sign-ins: matched by uid, else by e-mail, else inserted.

    An e-mail match takes the new uid and fills name and picture only where they are NULL; every match
    takes the verified flag, the later one where uid and e-mail both match. `sign_ins(uid, email, email_verified, name, picture, provider, signed_at)`.
    """
    accepted = accepted_sign_ins(sign_ins)
    known = users.filter(F.col("auth_uid").isNotNull()).select(F.col("auth_uid").alias("uid"))
    by_uid = _collapsed(accepted.join(known, "uid", "left_semi"), "uid").select(
        F.col("uid").alias("auth_uid"), F.col("email_verified").alias("_uid_verified"), F.col("signed_at").alias("_uid_at"))
    unknown = accepted.join(known, "uid", "left_anti")
    # A new uid is one person, under the e-mail of the first sign-in, whatever e-mails follow.
    first_email = unknown.groupBy("uid").agg(F.min(F.struct("signed_at", "email"))["email"].alias("email"))
    rest = _collapsed(unknown.drop("email").join(first_email, "uid"), "email")
    by_email = rest.select("email", F.struct("uid", "name", "picture", "email_verified", "signed_at").alias("_mail"))

    joined = users.join(by_uid, "auth_uid", "left").join(by_email, "email", "left")
    mail = F.col("_mail")
    verified = F.when(mail["signed_at"] >= F.coalesce("_uid_at", mail["signed_at"]), mail["email_verified"]).otherwise(F.col("_uid_verified"))
    updated = joined.select(*[{
        "auth_uid": F.coalesce(mail["uid"], F.col("auth_uid")).alias("auth_uid"),
        "full_name": F.coalesce("full_name", mail["name"]).alias("full_name"),
        "avatar_url": F.coalesce("avatar_url", mail["picture"]).alias("avatar_url"),
        "is_verified": F.coalesce(verified, F.col("is_verified")).alias("is_verified"),
    }.get(name, F.col(name)) for name in users.columns])

    fresh = rest.join(users.select("email"), "email", "left_anti")
    handles = unique_handles(fresh.select(F.col("uid").alias("id"), "name", "email"), users.select("username"))
    inserted = fresh.join(handles.withColumnRenamed("id", "uid"), "uid").select(
        F.col("uid").alias("id"), F.col("uid").alias("auth_uid"), "email", "username",
        F.col("name").alias("full_name"), F.col("picture").alias("avatar_url"), F.lit(True).alias("is_active"),
        F.col("email_verified").alias("is_verified"))
    return updated.unionByName(inserted, allowMissingColumns=True)


# Privacy and retention

def export_user_data(users: DataFrame, saved: DataFrame, plans: DataFrame | None, ids: DataFrame) -> DataFrame:
    """Everything held on the requested users, as records (user_id, section, record_key, record).

    A record is one JSON text: the profile, a saved event, or (only if `plans` is given) a plan. One
    record per row keeps a user with very many saved events from becoming one giant document.
    """
    wanted = ids.select(F.col("id").alias("user_id")).distinct()
    keep_nulls = {"ignoreNullFields": "false"}

    def records(frame: DataFrame, section: str, key: str) -> DataFrame:
        body = F.to_json(F.struct(*[F.col(name) for name in frame.columns]), keep_nulls)
        rows = frame if "user_id" in frame.columns else frame.withColumn("user_id", F.col("id"))
        return spread_join(rows.withColumn("record", body), wanted, ["user_id"], "left_semi").select(
            F.col("user_id"), F.lit(section).alias("section"), F.col(key).cast("string").alias("record_key"), "record")

    result = records(users, "profile", "id").union(records(saved, "saved_event", "event_id"))
    return result if plans is None else result.union(records(plans, "plan", "plan_id"))


def erase_users(tables: dict[str, DataFrame], ids: DataFrame, keys: dict[str, str] | None = None
                ) -> dict[str, DataFrame]:
    """The tables without the requested users' rows: users by `id`, all others by `user_id`."""
    wanted = ids.select("id").distinct()

    def remaining(name: str, frame: DataFrame) -> DataFrame:
        key = (keys or {}).get(name, "id" if name == "users" else "user_id")
        return spread_join(frame, wanted.withColumnRenamed("id", key), [key], "left_anti").select(*frame.columns)

    return {name: remaining(name, frame) for name, frame in tables.items()}


def sweep_expired(df: DataFrame, expiry: Column, now: Column) -> DataFrame:
    """Rows that have not expired; rows without an expiry stay."""
    return df.filter(F.coalesce(expiry > now, F.lit(True)))


def tier_partitions(parts: DataFrame, now: Column) -> DataFrame:
    """Adds the age in days of every `day` partition and the storage tier it should be in."""
    age = F.datediff(now, F.col("day"))
    tier = F.when(age >= COLDLINE_DAYS, "coldline").when(age >= NEARLINE_DAYS, "nearline").otherwise("standard")
    return parts.withColumns({"age_days": age, "tier": tier})


def profile_completion(users: DataFrame) -> DataFrame:
    """Adds `completion_pct`: how many of picture, name, city and categories are filled."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name) != "", F.lit(False)).cast("int")

    steps = [filled("avatar_url"), filled("full_name"), filled("preferred_location"),
             F.coalesce(F.size("preferred_categories") > 0, F.lit(False)).cast("int")]
    return users.withColumn("completion_pct", F.round(sum(steps[1:], steps[0]) * 100.0 / len(steps)).cast("int"))


# Plans

def plan_view(plans: DataFrame, user: str) -> DataFrame:
    """Plans of one user with defaults for what a stored plan may lack."""
    kinds = dict(plans.dtypes)
    columns = [F.col("plan_id"), F.col("user_id")]
    for name in ("title", "created_at", "updated_at"):
        columns.append(F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name))
    columns.append(F.coalesce("messages", F.array().cast(kinds["messages"])).alias("messages"))
    itinerary = F.col("itinerary")
    columns.append(F.struct(
        F.coalesce(itinerary["stops"], F.array().cast("array<string>")).alias("stops"),
        F.coalesce(itinerary["budget"], F.lit(0)).alias("budget"),
        F.coalesce(itinerary["vibe_chaos"], F.lit(50)).alias("vibe_chaos"),
        F.coalesce(itinerary["vibe_hidden"], F.lit(50)).alias("vibe_hidden")).alias("itinerary"))
    return plans.filter(F.col("user_id") == user).select(*columns)


def plans_by_recency(plans: DataFrame) -> DataFrame:
    return plans.orderBy(F.col("user_id"), F.col("updated_at").desc_nulls_last(), F.col("plan_id"))


def latest_plan(plans: DataFrame) -> DataFrame:
    """The active plan of every user: the one updated last."""
    return top_per_key(plans, ["user_id"], [F.col("updated_at").desc_nulls_last(), F.col("plan_id")])


def plan_titles(turns: DataFrame) -> DataFrame:
    """(plan_id, title, n_messages): the title is the start of the first user message."""
    asked = F.when(F.col("role") == "user", F.struct("turn", "content"))
    return turns.groupBy("plan_id").agg(
        title_from_text(F.min(asked)["content"]).alias("title"), F.count("*").alias("n_messages"))


def plan_transcripts(turns: DataFrame, page: int = MESSAGES_PER_PAGE,
                     roles: Sequence[str] = ("user", "assistant")) -> DataFrame:
    """Messages of every plan in turn order: (plan_id, page, messages).

    A page holds turns `page * n` up to the next one, so a row has that many turns at most however long
    a plan is. A message that is there several times counts once; different messages of a turn all stay.
    """
    rows = turns.filter(F.col("role").isin(*roles)).select("plan_id", "turn", "role", "content").distinct()
    paged = rows.withColumn("page", F.floor(F.col("turn") / F.lit(page)).cast("bigint"))
    messages = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    return paged.groupBy("plan_id", "page").agg(messages.alias("messages"))
