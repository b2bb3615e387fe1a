"""Application tracking: ordered commands to state and append-only history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hireloom.operators.filters import not_cancelled, owned_by
from hireloom.operators.ordered import neighbour

APPLICATION = ["application_key"]
ORDER = ["ts", "command_id"]


def default_key() -> Column:
    return F.concat_ws(
        ":", F.lit("track"), F.col("profile_id").cast("string"), F.col("posting_id").cast("string")
    )


def resolve(commands: DataFrame, applications: DataFrame | None = None) -> DataFrame:
    """Give every command the key of the application it is about.

    An application with the command's key wins, cancelled or not; then an
    active one of the same profile and posting; then the command's own key.
    Within the batch the same holds: the first upsert of a pair, in order of
    time, makes the application that later new keys are about, until a delete
    ends it. A pair's commands meet in one window; they are few.
    """
    own = F.coalesce("idempotency_key", default_key())
    found = commands.withColumn("own_key", own)
    known, active = F.lit(False), F.lit(None).cast("string")
    if applications is not None:
        by_key = applications.select(
            F.col("application_key").alias("own_key"), F.lit(True).alias("_known")
        )
        by_pair = (
            applications.filter(not_cancelled())
            .groupBy("profile_id", "posting_id")
            .agg(F.min("application_key").alias("_active_key"))
        )
        found = found.join(by_key, "own_key", "left").join(
            by_pair, ["profile_id", "posting_id"], "left"
        )
        known, active = F.coalesce("_known", F.lit(False)), F.col("_active_key")
    pair = Window.partitionBy("profile_id", "posting_id")
    before = pair.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    until = pair.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    life = Window.partitionBy("profile_id", "posting_id", "_life").orderBy(*ORDER)
    whole = life.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ended = F.coalesce(F.sum((F.col("op") == "delete").cast("int")).over(before), F.lit(0))
    opener = F.first(F.when(F.col("op") == "upsert", F.col("own_key")), True).over(whole)
    return (
        found.withColumn("_life", ended)
        .withColumn("_owner", F.when(F.col("_life") == 0, F.coalesce(active, opener)).otherwise(opener))
        .withColumn("_made", F.collect_set(F.when(F.col("op") == "upsert", F.col("_owner"))).over(until))
        .withColumn(
            "application_key",
            F.when(known | F.array_contains("_made", F.col("own_key")), F.col("own_key")).otherwise(
                F.coalesce("_owner", "own_key")
            ),
        )
        .select(*commands.columns, "application_key")
    )


def history(commands: DataFrame, applications: DataFrame | None = None) -> DataFrame:
    """Status history rows of resolved commands, in order per application.

    The first upsert creates an application. Later commands write a row when
    the status changes; a delete always writes one. Commands before the
    creation name no application and are left out (see ``rejected``).
    """
    known = _with_start(commands, applications)
    before = neighbour(
        known, APPLICATION, ORDER, F.col("status"), "from_status", F.to_date("ts")
    )
    created = F.col("from_status").isNull()
    wrote = (
        created
        | (F.col("op") == "delete")
        | (F.col("status") != F.col("from_status"))
    )
    reason = (
        F.when(created, "tracker_create")
        .when(F.col("op") == "upsert", "tracker_upsert")
        .when(F.col("op") == "delete", "tracker_remove")
        .otherwise(F.coalesce("reason", F.lit("status_update")))
    )
    return before.filter((F.col("op") != "existing") & wrote).select(
        "application_key",
        "profile_id",
        "posting_id",
        "command_id",
        "from_status",
        F.col("status").alias("to_status"),
        reason.alias("reason"),
        F.col("ts").alias("created_at"),
    )


def _prepared(commands: DataFrame) -> DataFrame:
    if "reason" not in commands.columns:
        commands = commands.withColumn("reason", F.lit(None).cast("string"))
    return commands.select(
        "application_key", "profile_id", "posting_id", "command_id", "ts", "op", "status", "reason"
    )


def _with_start(commands: DataFrame, applications: DataFrame | None) -> DataFrame:
    """Commands at or after the creation of their application."""
    rows = _prepared(commands)
    if applications is not None:
        state = applications.select(
            "application_key",
            "profile_id",
            "posting_id",
            F.lit(-1).cast("bigint").alias("command_id"),
            F.col("updated_at").alias("ts"),
            F.lit("existing").alias("op"),
            "status",
            F.lit(None).cast("string").alias("reason"),
        )
        rows = rows.unionByName(state)
    at = F.struct(*ORDER)
    starts = (
        rows.filter(F.col("op").isin("upsert", "existing"))
        .groupBy(*APPLICATION)
        .agg(F.min(at).alias("_start"))
    )
    return rows.join(starts, APPLICATION).filter(at >= F.col("_start")).drop("_start")


def rejected(commands: DataFrame, applications: DataFrame | None = None) -> DataFrame:
    """Commands on an application that did not exist yet."""
    kept = _with_start(commands, applications).select("command_id")
    return _prepared(commands).join(kept, "command_id", "left_anti")


def applications_after(
    history_rows: DataFrame, applications: DataFrame | None = None
) -> DataFrame:
    """Newest status per application, with creation and change times."""
    rows = history_rows.select(
        "application_key", "profile_id", "posting_id", "command_id",
        F.col("to_status").alias("status"),
        F.col("created_at").alias("created_at"),
        F.col("created_at").alias("updated_at"),
    )
    if applications is not None:
        rows = rows.unionByName(
            applications.select(
                "application_key", "profile_id", "posting_id",
                F.lit(-1).cast("bigint").alias("command_id"),
                "status", "created_at", "updated_at",
            )
        )
    newest = F.struct("updated_at", "command_id")
    return rows.groupBy("application_key", "profile_id", "posting_id").agg(
        F.max_by("status", newest).alias("status"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
    )


def latest_status(history_rows: DataFrame) -> DataFrame:
    return history_rows.groupBy(*APPLICATION).agg(
        F.max_by("to_status", F.struct("created_at", "command_id")).alias("status"),
        F.max("created_at").alias("since"),
    )


def board(
    applications: DataFrame, postings: DataFrame, companies: DataFrame, owner: object = None
) -> DataFrame:
    """Active applications with posting and company, newest change first.

    With ``owner`` only those of that profile, cut before anything is joined.

    The same rows keep their place when a posting is gone; its columns are null.
    """
    shown = postings.select(
        "posting_id", "company_id", "title", F.col("canonical_url").alias("url")
    )
    if owner is not None:
        applications = applications.filter(owned_by(owner))
    return (
        applications.filter(not_cancelled())
        .join(shown, "posting_id", "left")
        .join(companies.select("company_id", "company_name"), "company_id", "left")
        .orderBy(F.col("updated_at").desc(), "application_key")
    )


def durations(history_rows: DataFrame) -> DataFrame:
    """Time spent in each status until the next change."""
    following = neighbour(
        history_rows,
        APPLICATION,
        ["created_at", "command_id"],
        F.struct("created_at", "to_status"),
        "_next",
        F.to_date("created_at"),
        following=True,
    )
    seconds = (
        F.unix_micros(F.col("_next.created_at")) - F.unix_micros(F.col("created_at"))
    ) / F.lit(1e6)
    return following.withColumn("next_status", F.col("_next.to_status")).withColumn(
        "seconds", seconds
    ).drop("_next")


def transitions(history_rows: DataFrame) -> DataFrame:
    """How often each status follows another, and how long the step takes."""
    return (
        durations(history_rows)
        .filter(F.col("next_status").isNotNull())
        .groupBy(F.col("to_status").alias("status"), "next_status")
        .agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 2).alias("avg_seconds"))
    )


def illegal(history_rows: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Changes missing from a transition table; without a table all are legal."""
    if allowed is None:
        return history_rows.filter(F.lit(False))
    pairs = allowed.select("from_status", "to_status").distinct()
    return history_rows.filter(F.col("from_status").isNotNull()).join(
        pairs, ["from_status", "to_status"], "left_anti"
    )


def funnel(applications: DataFrame) -> DataFrame:
    """Applications per provider and status with subtotals, and conversion rates."""
    def rate(*states: str) -> Column:
        return F.round(F.avg(F.col("status").isin(*states).cast("int")), 4)

    return applications.rollup("provider", "status").agg(
        F.count("*").alias("n"),
        rate("applied", "interview").alias("applied_rate"),
        rate("interview").alias("interview_rate"),
        F.grouping_id().alias("subtotal_level"),
    )


def conversion(history_rows: DataFrame, steps: list[str]) -> DataFrame:
    """How many applications ever reached each step, and what share of those that reached the step before.

    An application counts for a step whatever came between; the share counts
    those that reached both. One row per step, in order.
    """
    reached = history_rows.groupBy(*APPLICATION).agg(
        *[F.max((F.col("to_status") == s).cast("int")).alias(f"s{i}") for i, s in enumerate(steps)]
    )
    sums = [F.sum(f"s{i}").alias(f"n{i}") for i in range(len(steps))]
    sums += [F.sum(F.col(f"s{i - 1}") * F.col(f"s{i}")).alias(f"b{i}") for i in range(1, len(steps))]
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(s).alias("step"),
            F.coalesce(f"n{i}", F.lit(0)).alias("applications"),
            (F.round(F.col(f"b{i}") / F.nullif(F.col(f"n{i - 1}"), F.lit(0)), 4) if i else F.lit(None).cast("double")).alias("from_before"),
        )
        for i, s in enumerate(steps)
    ]
    return reached.agg(*sums).select(F.inline(F.array(*rows)))


def acceptance(matches: DataFrame, applications: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the matches shown that their profile applied to, per ``keys`` of the matches."""
    taken = applications.select("profile_id", "posting_id", F.lit(1).alias("_taken")).distinct()
    return matches.join(taken, ["profile_id", "posting_id"], "left").groupBy(*keys).agg(
        F.count("*").alias("shown"),
        F.count("_taken").alias("accepted"),
        F.round(F.count("_taken") / F.count("*"), 4).alias("acceptance_rate"),
    )
