"""Search for texts inside postings by lists of the three-character pieces that they hold.

A text that contains a needle holds every piece of it. The index has a row for
each piece and posting, in the order of the pieces and dealt by them, and how many
postings hold each piece. A search reads the lists of the needle's rarest pieces
only, meets them, and tests the needle itself on the postings left, in the
buckets where these lie. A piece that most postings hold fills many files and is
read only where a needle has none that is rarer.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hireloom.functions.text import let, text_blob
from hireloom.operators.filters import catalog_text, free_text

SIZE = 3
SEARCHED = ("title", "description", "location")


def pieces_of(text: Column) -> Column:
    """The distinct pieces of a text. Characters are split off once, so long texts take no more than their length."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def cut(xs: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(xs) - SIZE)
        return F.transform(places, lambda i: F.concat(*[F.get(xs, i + k) for k in range(SIZE)]))

    found = let(chars, lambda xs: F.when(F.size(xs) >= SIZE, cut(xs)))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def _needles(literals: list[str]) -> list[str]:
    """Pieces that a match must hold; those beyond ASCII are left to the last test, as languages differ on lower case."""
    lowered = [x.lower() for x in literals]
    found = {x[i : i + SIZE] for x in lowered for i in range(len(x) - SIZE + 1)}
    return sorted(x for x in found if x.isascii())


class TextIndex:
    """``lists`` (piece, posting), ``counts`` and ``postings`` under a folder, each dealt into ``buckets``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root, self.buckets = spark, root, buckets

    def build(self, postings: DataFrame) -> TextIndex:
        """Write the tables. Null and empty texts hold no pieces and stay in ``postings``."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        home = F.pmod(F.xxhash64("posting_id"), F.lit(self.buckets)).cast("int")
        postings.withColumn("home", home).repartition("home").write.partitionBy("home").parquet(f"{self.root}/postings")
        blob = text_blob(*[F.col(c) for c in SEARCHED])
        rows = postings.select(F.explode(pieces_of(blob)).alias("piece"), "posting_id", home.alias("home"))
        rows = rows.withColumn("part", self._part(F.col("piece")))
        # Ranges split a piece that most postings hold.
        order = ["part", "piece", "posting_id"]
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.partitionBy("part").parquet(f"{self.root}/lists")
        counts = self._table("lists").groupBy("part", "piece").agg(F.count("*").alias("n"))
        counts.repartition("part").sortWithinPartitions("part", "piece").write.partitionBy("part").parquet(f"{self.root}/counts")
        return self

    def _part(self, piece: Column) -> Column:
        return F.pmod(F.xxhash64(piece), F.lit(self.buckets)).cast("int")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _rows(self, name: str, pieces: list[str]) -> DataFrame:
        """Rows of some pieces; only their partitions are read."""
        if not pieces:
            return self._table(name).filter(F.lit(False))
        parts = self.spark.range(1).select(*[self._part(F.lit(p)) for p in pieces]).first()
        return self._table(name).filter(F.col("part").isin(sorted(set(parts))) & F.col("piece").isin(pieces))

    def candidates(self, literals: list[str], lists: int = 4) -> DataFrame | None:
        """``posting_id`` and ``home`` of the postings that may hold all literals; None where these are too short to tell.

        The ``lists`` rarest pieces are met, rarest first; more would cut little
        and the needle itself decides in the end.
        """
        needed = _needles(literals)
        if not needed:
            return None
        # As many rows as the needle has pieces, at most.
        counts = {r["piece"]: r["n"] for r in self._rows("counts", needed).collect()}
        if len(counts) < len(needed):
            return self._table("lists").filter(F.lit(False)).select("posting_id", "home")
        rarest = sorted(needed, key=lambda p: (counts[p], p))[:lists]
        found = self._rows("lists", rarest[:1]).select("posting_id", "home")
        for piece in rarest[1:]:
            found = found.join(self._rows("lists", [piece]).select("posting_id"), "posting_id", "left_semi")
        return found

    def search(self, literals: list[str], test: Column) -> DataFrame:
        """Postings that pass ``test``, which every text without one of the literals fails."""
        rows = self._table("postings")
        found = self.candidates(literals)
        if found is not None:
            # Bucket numbers: as many as there are buckets, at most.
            homes = sorted(r[0] for r in found.select("home").distinct().collect())
            rows = rows.filter(F.col("home").isin(homes) if homes else F.lit(False)).join(found.select("posting_id"), "posting_id", "left_semi")
        return rows.filter(test).drop("home")

    def free_text(self, query: str) -> DataFrame:
        return self.search([query.strip()], free_text(query))

    def catalog_text(self, query: str, wildcards: bool = False) -> DataFrame:
        text = query.strip()
        return self.search(re.split(r"[%_\\]", text) if wildcards else [text], catalog_text(query, wildcards))
