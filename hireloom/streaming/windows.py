"""Windows and sessions over a stream with state that holds open ones only.

Each micro-batch is folded to mergeable parts (counts and sums of a window; first,
last and number of a session). Parts whose window ended by the watermark are late and
go to a table of their own; the others join the open ones. What the new watermark
passes is closed: written once, in the folder of its batch. The open rest is the
state. A bounded run ends with reading closed, late and open parts together, so no
event is lost, whatever the order of its files; an endless run may read the closed
ones alone and the late ones apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hireloom.operators.versioned import Manifest, names, publish, read_text
from hireloom.session import new_path, remove
from hireloom.streaming.jobs import run_batches

PARTS = ("closed", "late", "open")


@dataclass(frozen=True)
class Kind:
    """``fold``: events to parts, which have ``seen``, the time of their last event. ``merge``: parts of the same windows to one. ``end``: when a part is over."""

    fold: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    end: Column


def windows(width: str, slide: str | None = None) -> Kind:
    """Events and values per type in tumbling, or with ``slide`` sliding, windows."""

    def fold(events: DataFrame) -> DataFrame:
        window = F.window("ts", width, slide) if slide else F.window("ts", width)
        counted = events.groupBy(window.alias("w"), "event_type").agg(
            F.count("*").alias("n"), F.sum("value").alias("total"), F.max("ts").alias("seen")
        )
        return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total", "seen")

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy("start", "end", "event_type").agg(
            F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("seen").alias("seen")
        )

    return Kind(fold, merge, F.col("end"))


def sessions(gap: str) -> Kind:
    """Sessions of each user, closed by a gap.

    A part is the first and last event and their number. Parts less than a gap
    apart are one session; merged parts equal the sessions of all events, in
    whatever groups the events came.
    """
    space = F.expr(f"interval {gap}")

    def joined(rows: DataFrame, first: str, last: str, n: Column) -> DataFrame:
        so_far = Window.partitionBy("user_id").orderBy(first, last)
        before = F.max(last).over(so_far.rowsBetween(Window.unboundedPreceding, -1))
        is_new = F.when(F.col(first) < before + space, 0).otherwise(1)
        numbered = rows.withColumn("_new", is_new).withColumn("_session", F.sum("_new").over(so_far))
        return numbered.groupBy("user_id", "_session").agg(
            F.min(first).alias("first"), F.max(last).alias("seen"), F.sum(n).alias("n")
        ).drop("_session")

    def fold(events: DataFrame) -> DataFrame:
        # Spark's session window merges before the shuffle, so a busy user stays small.
        counted = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(
            F.min("ts").alias("first"), F.max("ts").alias("seen"), F.count("*").alias("n")
        )
        return counted.select("user_id", "first", "seen", "n")

    def merge(parts: DataFrame) -> DataFrame:
        return joined(parts, "first", "seen", F.col("n"))

    return Kind(fold, merge, F.col("seen") + space)


class WindowTables:
    """The tables of one run: ``closed`` and ``late`` by batch, ``open`` by version, and a small manifest for each batch."""

    def __init__(self, spark: SparkSession, root: str, kind: Kind, delay: str):
        self.spark, self.root, self.kind, self.delay = spark, root, kind, delay

    def manifest(self) -> Manifest:
        """The newest manifest; ``version`` counts batches, notes hold the watermark in microseconds."""
        known = sorted(int(n) for n in names(self.spark, f"{self.root}/manifests") if n.isdigit())
        return Manifest.parse(read_text(self.spark, f"{self.root}/manifests/{known[-1]}")) if known else Manifest()

    def _over(self, watermark: int | None) -> Column:
        return F.unix_micros(self.kind.end) <= F.lit(watermark) if watermark is not None else F.lit(False)

    def step(self, batch: DataFrame, number: int) -> None:
        """One micro-batch. It writes to folders of its own and is published in the end, so it may run again."""
        old = self.manifest()
        if number < old.version:
            return
        watermark = old.notes.get("watermark")
        path = f"{self.root}/parts/batch={number}"
        self.kind.fold(batch).write.mode("overwrite").parquet(path)
        parts = self.spark.read.parquet(path)
        newest = parts.agg(F.unix_micros(F.max("seen") - F.expr(f"interval {self.delay}"))).first()[0]
        passed = max((w for w in (watermark, newest) if w is not None), default=None)
        late = self._over(watermark)
        parts.where(late).write.mode("overwrite").parquet(f"{self.root}/late/batch={number}")
        merged = parts.where(~late)
        if number:
            merged = self.kind.merge(merged.unionByName(self.spark.read.schema(parts.schema).parquet(f"{self.root}/open/version={number}")))
        state = f"{self.root}/merged/batch={number}"
        merged.write.mode("overwrite").parquet(state)
        merged = self.spark.read.schema(merged.schema).parquet(state)
        over = self._over(passed)
        merged.where(over).write.mode("overwrite").parquet(f"{self.root}/closed/batch={number}")
        merged.where(~over).write.mode("overwrite").parquet(f"{self.root}/open/version={number + 1}")
        publish(self.spark, f"{self.root}/manifests/{number + 1}", Manifest(number + 1, notes={"watermark": passed}).text())
        for gone in (path, state, f"{self.root}/open/version={number - 1}", f"{self.root}/manifests/{number - 1}"):
            remove(self.spark, gone)

    def parts(self, which: str) -> DataFrame:
        """Parts of one table, as of the newest published batch."""
        version = self.manifest().version
        if which == "open":
            return self.spark.read.parquet(f"{self.root}/open/version={version}")
        return self.spark.read.parquet(f"{self.root}/{which}").where(F.col("batch") < version).drop("batch")

    def read(self, which: tuple[str, ...] = PARTS) -> DataFrame:
        """Whole windows or sessions, merged from the given tables."""
        found = self.parts(which[0])
        for name in which[1:]:
            found = found.unionByName(self.parts(name))
        return self.kind.merge(found)


def run_to_tables(
    events: DataFrame, kind: Kind, delay: str, name: str, root: str | None = None, checkpoint: str | None = None
) -> WindowTables:
    """Process all that is there. A later run with the same ``root`` and ``checkpoint`` goes on from there."""
    spark = events.sparkSession
    tables = WindowTables(spark, root or new_path(spark, name), kind, delay)
    run_batches(events, name, tables.step, checkpoint)
    return tables
