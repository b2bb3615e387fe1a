"""Resume versions: active version, edits, lineage, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hireloom.functions.text import checksum
from hireloom.operators.filters import origin_is, usable_resume
from hireloom.session import materialize, new_path, remove


def active_versions(resumes: DataFrame, versions: DataFrame) -> DataFrame:
    """The version a resume points to, else its lowest version number."""
    pointed = F.col("version_id") == F.col("active_version_id")
    rank = F.struct((~F.coalesce(pointed, F.lit(False))).alias("other"), "version_number")
    kept = [c for c in versions.columns if c != "resume_id"]
    return (
        resumes.select("resume_id", "active_version_id")
        .join(versions, "resume_id")
        .groupBy("resume_id")
        .agg(F.min_by(F.struct(*kept), rank).alias("v"))
        .select("resume_id", "v.*")
    )


def resume_for_matching(
    resumes: DataFrame, versions: DataFrame, resume_id: object | None = None
) -> DataFrame:
    """Newest usable resume per profile with its active version."""
    wanted = resumes if resume_id is None else resumes.filter(F.col("resume_id") == resume_id)
    active = active_versions(wanted, versions).select("resume_id", "version_id", "content_id")
    usable = wanted.join(active, "resume_id").filter(usable_resume())
    newest = F.struct("created_at", "resume_id")
    return usable.groupBy("profile_id").agg(
        F.max_by(F.struct("resume_id", "version_id", "content_id"), newest).alias("r")
    ).select("profile_id", "r.*")


def active_preferences(preferences: DataFrame) -> DataFrame:
    """The active preference set with the highest version per profile."""
    kept = [c for c in preferences.columns if c != "profile_id"]
    return (
        preferences.filter("is_active")
        .groupBy("profile_id")
        .agg(F.max_by(F.struct(*kept), "version").alias("p"))
        .select("profile_id", "p.*")
    )


def listed(
    resumes: DataFrame, origin: str | None = None, by: str = "created_at", descending: bool = True
) -> DataFrame:
    order = F.col(by).desc() if descending else F.col(by).asc()
    return resumes.filter(origin_is(origin)).orderBy(order, "resume_id")


def _new_version(
    base: DataFrame, number: Column, kind: str, parent: Column, posting: Column, source: str
) -> DataFrame:
    return base.select(
        "resume_id",
        F.sha2(F.concat_ws("|", F.col("resume_id").cast("string"), number.cast("string")), 256).alias(
            "version_id"
        ),
        number.cast("int").alias("version_number"),
        F.lit(kind).alias("kind"),
        F.lit("extracted").alias("status"),
        parent.alias("parent_version_id"),
        posting.alias("posting_id"),
        checksum("content").alias("content_checksum"),
        F.lit(source).alias("source"),
        "content",
    )


def edited_versions(
    resumes: DataFrame, versions: DataFrame, edits: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """New versions of edited resumes, and the moved pointers.

    Edits of one resume in a batch are numbered in their order after the
    highest number in use; each has the version before it as its parent.
    """
    top = versions.groupBy("resume_id").agg(F.max("version_number").alias("_top"))
    active = active_versions(resumes, versions).select(
        "resume_id", F.col("version_id").alias("_active")
    )
    turn = F.row_number().over(Window.partitionBy("resume_id").orderBy("edit_id"))
    base = (
        edits.withColumn("_turn", turn)
        .join(top, "resume_id", "left")
        .join(active, "resume_id", "left")
    )
    number = F.coalesce("_top", F.lit(0)) + F.col("_turn")
    before = F.sha2(
        F.concat_ws("|", F.col("resume_id").cast("string"), (number - 1).cast("string")), 256
    )
    parent = F.when(F.col("_turn") == 1, F.col("_active").cast("string")).otherwise(before)
    fresh = _new_version(
        base, number, "edited", parent, F.lit(None).cast("bigint"), "user_edit"
    )
    pointers = fresh.groupBy("resume_id").agg(
        F.max_by("version_id", "version_number").alias("active_version_id")
    )
    return fresh, pointers


def generated_versions(tailored: DataFrame) -> DataFrame:
    """First version of each resume saved from tailoring, with parent and posting."""
    base = tailored.withColumn(
        "resume_id",
        F.sha2(
            F.concat_ws(
                "|", F.lit("generated"), F.col("parent_version_id").cast("string"),
                F.col("posting_id").cast("string"),
            ),
            256,
        ),
    )
    return _new_version(
        base, F.lit(1), "generated", F.col("parent_version_id"), F.col("posting_id"), "generated"
    )


def lineage(versions: DataFrame, postings: DataFrame) -> DataFrame:
    """Each version beside its parent and the posting it was written for."""
    parent = versions.select(
        F.col("version_id").alias("parent_version_id"),
        F.col("version_number").alias("parent_number"),
        F.col("resume_id").alias("parent_resume_id"),
    )
    target = postings.select("posting_id", F.col("title").alias("posting_title"))
    return versions.join(parent, "parent_version_id", "left").join(target, "posting_id", "left")


def ancestry(versions: DataFrame) -> DataFrame:
    """``version_id``, ``root_version_id``, ``depth`` and ``cyclic`` of every version, however long its chain.

    Pointer doubling: each step joins a version's farthest known ancestor with
    that ancestor's own, so a chain of n versions takes log2(n) joins, and only
    versions whose root is not known yet take part. A parent that is not in the
    table counts as none. Versions on a cycle, or below one, have neither root
    nor depth; they are those left after as many steps as the table can need.
    """
    spark = versions.sparkSession
    work = new_path(spark, "ancestry")
    known = versions.select(F.col("version_id").alias("p")).distinct()
    linked = versions.select(F.col("version_id").alias("v"), F.col("parent_version_id").alias("p")).join(known, "p", "left_semi")
    roots = versions.select(F.col("version_id").alias("v")).join(linked.select("v"), "v", "left_anti")
    done = materialize(roots.select("v", F.col("v").alias("up"), F.lit(0).cast("long").alias("depth")), "done", folder=work)
    open_ = materialize(linked.select("v", F.col("p").alias("up"), F.lit(1).cast("long").alias("depth")), "open", folder=work)
    total = done.count() + open_.count()
    for _ in range(total.bit_length() + 1):
        if open_.isEmpty():
            break
        # What the ancestors point to by now: a root points to itself at depth 0.
        ahead = done.withColumn("found", F.lit(True)).unionByName(open_.withColumn("found", F.lit(False)))
        ahead = ahead.select(F.col("v").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), "found")
        moved = open_.join(ahead, "up").select("v", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), "found")
        moved = materialize(moved, "moved", folder=work)
        done = done.unionByName(moved.filter("found").drop("found"))
        open_ = moved.filter("NOT found").drop("found")
    rooted = done.select(F.col("v").alias("version_id"), F.col("up").alias("root_version_id"), "depth", F.lit(False).alias("cyclic"))
    none = F.lit(None)
    lost = open_.select(
        F.col("v").alias("version_id"),
        none.cast(versions.schema["version_id"].dataType).alias("root_version_id"),
        none.cast("long").alias("depth"),
        F.lit(True).alias("cyclic"),
    )
    found = materialize(rooted.unionByName(lost), "ancestry")
    remove(spark, work)
    return found


def delete_resumes(
    gone: DataFrame, resumes: DataFrame, versions: DataFrame, contents: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables without the deleted resumes.

    Their versions go too, children of those lose the parent link, and a
    content goes once no version uses it any more.
    """
    ids = gone.select("resume_id").distinct()
    kept = versions.join(ids, "resume_id", "left_anti")
    removed = versions.join(ids, "resume_id", "left_semi")
    dropped = removed.select(
        F.col("version_id").alias("parent_version_id"), F.lit(True).alias("_gone")
    )
    kept = kept.join(dropped, "parent_version_id", "left").withColumn(
        "parent_version_id", F.when(F.col("_gone").isNull(), F.col("parent_version_id"))
    ).select(*versions.columns)
    orphans = (
        removed.filter(F.col("content_id").isNotNull())
        .select("content_id")
        .distinct()
        .join(kept.select("content_id"), "content_id", "left_anti")
    )
    return (
        resumes.join(ids, "resume_id", "left_anti"),
        kept,
        contents.join(orphans, "content_id", "left_anti"),
    )
