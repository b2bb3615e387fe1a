"""Resume text to numbered lines and sections.

A whole text sits in one row, so all steps are array expressions on that row:
nothing is exploded and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hireloom import vocab
from hireloom.functions.text import WHITE_SPACE, let, str_array, str_map, strip, word_count

_LINE_END = "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C-\\u001E\\u0085\\u2028\\u2029]"
_ALIASES = {alias: key for key, names in vocab.SECTION_HEADINGS.items() for alias in names}
_HEADING = (
    r"(?iU)^\s*("
    + "|".join(sorted(_ALIASES, key=len, reverse=True))
    + r")\s*(?:[:\-–—]\s*|$)"
)


def normal_text(raw: Column) -> Column:
    """Unix newlines, plain blanks, and no outer blanks on any line."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), "\\r\\n|\\r", "\n")
    text = F.regexp_replace(F.translate(text, " ", " "), r"[ \t]+", " ")
    return F.array_join(F.transform(F.split(text, "\n"), strip), "\n")


def text_lines(text: Column) -> Column:
    """Lines without trailing blanks; a final newline opens no further line."""
    body = F.regexp_replace(text, f"(?:{_LINE_END})\\z", "")
    lines = F.transform(F.split(body, _LINE_END), lambda x: F.rtrim(x, F.lit(WHITE_SPACE)))
    return F.when(F.coalesce(text, F.lit("")) == "", str_array([])).otherwise(lines)


def line_id(number: Column) -> Column:
    return F.format_string("L%03d", number)


def numbered(text: Column) -> Column:
    """Lines as (no, text), counted from one."""
    return F.transform(
        text_lines(text),
        lambda x, i: F.struct((i + 1).cast("int").alias("no"), x.alias("text")),
    )


def section_name(line: Column) -> Column:
    """Section opened by a line, or null. A long sentence opens none."""
    alias = F.lower(F.regexp_extract(line, _HEADING, 1))
    sentence = line.endswith(".") & (word_count(line) > 6)
    return F.when(~sentence, F.try_element_at(str_map(_ALIASES), alias))


def heading_rest(line: Column) -> Column:
    """Text behind a heading on the same line."""
    return F.regexp_replace(
        F.regexp_replace(line, _HEADING, ""), r"^[ :\-–—]+|[ :\-–—]+$", ""
    )


def islands(items: Column, starts: Callable[[Column], Column], keep_head: bool = True) -> Column:
    """Cut an array into runs that begin where ``starts`` holds.

    ``keep_head`` keeps what comes before the first start as a run of its own.
    """

    def cut(xs: Column) -> Column:
        marks = F.transform(
            xs, lambda x, i: F.when(starts(x) | (F.lit(keep_head) & (i == 0)), i.cast("int"))
        )
        return let(
            F.array_append(F.array_compact(marks), F.size(xs)),
            lambda at: F.transform(
                F.slice(at, 1, F.size(at) - 1),
                lambda s, j: F.slice(xs, s + 1, at[j.cast("int") + 1] - s),
            ),
        )

    return let(items, cut)


def _body(lines: Column) -> Column:
    """All body lines as (section, no, text), in text order."""
    marked = F.transform(
        lines,
        lambda x: let(
            strip(x["text"]),
            lambda t: let(
                section_name(t),
                # Only the first line of a run tells what follows its heading.
                lambda s: F.struct(
                    x["no"].alias("no"),
                    x["text"].alias("text"),
                    s.alias("section"),
                    F.when(s.isNotNull(), heading_rest(t)).alias("rest"),
                ),
            ),
        ),
    )
    start = F.array(
        F.struct(
            F.lit(0).alias("no"), F.lit("").alias("text"), F.lit("header").alias("section"),
            F.lit("").alias("rest"),
        )
    )

    def entry(section: Column, no: Column, text: Column) -> Column:
        return F.struct(section.alias("section"), no.alias("no"), text.alias("text"))

    def parts(runs: Column) -> Column:
        def one(run: Column, j: Column) -> Column:
            head = run[0]
            before = F.when(j > 0, F.get(runs, j.cast("int") - 1)[0]["section"])
            shown = F.when(
                head["section"] != F.coalesce(before, F.lit("")), head["rest"]
            ).otherwise(head["text"])
            own = F.filter(
                F.array(entry(head["section"], head["no"], shown)),
                lambda e: (head["rest"] != ""),
            )
            tail = F.transform(
                F.slice(run, 2, F.size(run)),
                lambda x: entry(head["section"], x["no"], x["text"]),
            )
            return F.concat(own, tail)

        return F.flatten(F.transform(runs, one))

    runs = islands(F.concat(start, marked), lambda x: x["section"].isNotNull())
    return let(runs, parts)


def _filled_numbers(rows: Column) -> Column:
    return F.transform(F.filter(rows, lambda e: e["text"].rlike(r"\S")), lambda e: e["no"])


def segments(text: Column) -> Column:
    """Sections in fixed order: name, text, first and last line, line ids."""

    def collect(body: Column) -> Column:
        def one(name: Column) -> Column:
            mine = F.filter(body, lambda e: e["section"] == name)
            return let(mine, lambda rows: let(_filled_numbers(rows), lambda f: build(name, rows, f)))

        def build(name: Column, rows: Column, filled: Column) -> Column:
            whole_header = name == "header"
            first = F.when(whole_header, F.get(rows, F.lit(0))["no"]).otherwise(
                F.get(filled, F.lit(0))
            )
            last = F.when(
                whole_header | (F.size(filled) > 0), F.try_element_at(rows, F.lit(-1))["no"]
            )
            return F.struct(
                name.alias("section"),
                strip(F.array_join(F.transform(rows, lambda e: e["text"]), "\n")).alias("text"),
                first.alias("start_line"),
                last.alias("end_line"),
                F.transform(filled, line_id).alias("line_ids"),
            )

        only_header = F.forall(body, lambda e: e["section"] == "header")
        found = F.transform(str_array(vocab.SECTION_ORDER), one)
        return F.filter(
            found, lambda s: (s["text"] != "") | ((s["section"] == "header") & only_header)
        )

    return let(_body(numbered(text)), collect)


def section_text_lines(found: Column, name: str) -> Column:
    """Non-blank trimmed lines of one section."""
    text = F.try_element_at(F.filter(found, lambda s: s["section"] == name), F.lit(1))["text"]
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip)
    return F.filter(lines, lambda x: x != "")


def segment_documents(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per document and section."""
    return docs.select(key, F.inline(segments(F.col(text))))
