"""Line ids of the source text behind each extracted record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hireloom.functions.text import first_items, let, str_array, strip
from hireloom.operators.sections import line_id, numbered

SHORTEST = 4
REVERSE_ABOVE = 24


def line_ids(lines: Column, needles: Column, limit: int | None = None) -> Column:
    """Line ids that contain a needle, needle by needle.

    A long needle also matches a line that it contains itself.
    """
    wanted = F.filter(
        F.transform(needles, lambda n: F.lower(strip(n))),
        lambda n: n.isNotNull() & (F.length(n) >= SHORTEST),
    )

    def hits(n: Column) -> Column:
        return F.transform(
            F.filter(
                lines,
                lambda x: x["text"].contains(n)
                | ((F.length(n) > REVERSE_ABOVE) & n.contains(x["text"])),
            ),
            lambda x: line_id(x["no"]),
        )

    return first_items(F.array_distinct(F.flatten(F.transform(wanted, hits))), limit)


def _lines(text: Column) -> Column:
    lowered = F.transform(
        numbered(text),
        lambda x: F.struct(x["no"].alias("no"), F.lower(strip(x["text"])).alias("text")),
    )
    return F.filter(lowered, lambda x: x["text"] != "")


def _grounded(entries: Column, text: Column, needles) -> Column:
    """Entries with their line ids. The lines are bound outside of the entries and their needles; without entries none are needed."""

    def one(e: Column, lines: Column) -> Column:
        return let(
            line_ids(lines, needles(e)),
            lambda ids: e.withField(
                "source_fact_ids", F.when(F.size(ids) > 0, ids).otherwise(e["source_fact_ids"])
            ),
        )

    found = let(_lines(text), lambda lines: F.transform(entries, lambda e: one(e, lines)))
    return F.when(F.size(entries) > 0, found).otherwise(entries)


def ground(docs: DataFrame, content: str = "content", text: str = "text") -> DataFrame:
    """Attach line ids to every record; content and text sit in the same row."""
    body = F.col(content)

    def bullets(e: Column) -> Column:
        return F.coalesce(e["bullets"], str_array([]))

    needles = {
        "experience": lambda e: F.concat(F.array(e["title"], e["company"]), bullets(e)),
        "education": lambda e: F.array(e["institution"], e["degree"]),
        "projects": lambda e: F.concat(F.array(e["title"], e["organization"]), bullets(e)),
        "certifications": lambda e: F.array(e["title"], e["issuer"]),
        "awards": lambda e: F.array(e["title"], e["issuer"]),
    }
    out = body
    for part, of in needles.items():
        out = out.withField(part, _grounded(body[part], F.col(text), of))
    return docs.withColumn(content, out)
