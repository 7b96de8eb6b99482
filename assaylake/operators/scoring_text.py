"""Scoring and criteria texts, read line by line with windows over an exam's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exam_text import bound, is_scoring_summary
from ..functions.text import span
from . import sequences as seq

#: Roman numerals of groups.
ROMANS = ["I", "II", "III", "IV", "V"]


def group_id(roman: Column) -> Column:
    """grupo_i to grupo_v; null for anything else."""
    return F.when(F.upper(roman).isin(ROMANS), F.concat(F.lit("grupo_"), F.lower(roman)))


def page_groups(pages: DataFrame) -> DataFrame:
    """(exam_id, page, group_id): the group heading that holds for a page; pages before any, and scoring pages, have none."""
    roman = F.nullif(F.regexp_extract("text", r"(?i)grupo\s+(I{1,3}V?|IV)\b", 1), F.lit(""))
    out = seq.carry_forward(pages, ["exam_id"], ["page"], F.concat(F.lit("grupo_"), F.lower(roman)), "group_id", is_scoring_summary(F.col("text")))
    return out.filter("group_id IS NOT NULL").select("exam_id", "page", "group_id")


#: How a text names documents: from one to another, several, one, or all of them.
DOC_RANGE = r"\b(?:documentos?|docs?\.?)\s+(?:de\s+)?(\d+)\s*(?:a|ao|-|–|—)\s*(\d+)\b"
DOC_LIST = r"\b(?:documentos?|docs?\.?)\s+((?:\d+\s*(?:,|;|e)\s*)+\d+)\b"
DOC_ONE = r"\b(?:documento|doc\.?)\s+(\d+)\b"
DOC_ALL = [
    "cada um dos documentos", "dos documentos apresentados", "dos dois documentos", "dos tres documentos", "dos três documentos",
    "dados disponiveis nos documentos", "dados disponíveis nos documentos", r"a partir dos documentos(?!\s+de\s+\d)",
]


def document_references(text: Column, allowed: Column) -> Column:
    """Sorted numbers of the documents that a text names, by ranges, lists and single mentions together.

    If it names none but speaks of all, all allowed ones.  An empty list allows any number; then a range of more than
    10,000 stands for its ends.  Numbers beyond 32 bits name nothing.
    """
    text = F.coalesce(text, F.lit(""))
    found = lambda t, pattern, group: F.transform(F.regexp_extract_all(t, F.lit("(?iu)" + pattern), F.lit(group)), lambda x: x.try_cast("int"))
    ends = F.filter(F.zip_with(found(text, DOC_RANGE, 1), found(text, DOC_RANGE, 2), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    within = lambda a, b: F.when(F.size(allowed) > 0, F.filter(allowed, lambda n: n.between(a, b))).otherwise(span(a, b))
    spans = F.flatten(F.transform(ends, lambda x: within(F.least(x["a"], x["b"]), F.greatest(x["a"], x["b"]))))
    listed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit("(?iu)" + DOC_LIST), F.lit(1)), lambda t: found(t, r"(\d+)", 1)))
    named = F.array_distinct(F.array_compact(F.concat(spans, listed, found(text, DOC_ONE, 1))))
    named = bound(named, lambda n: F.when((F.size(n) == 0) & text.rlike("(?iu)" + "|".join(DOC_ALL)), allowed).otherwise(n))
    named = F.array_sort(F.when(F.size(allowed) > 0, F.array_intersect(named, allowed)).otherwise(named))
    # most texts name none
    return F.when(F.lower(text).contains("doc"), named).otherwise(F.array().cast("array<int>"))


def scoring_columns(lines: DataFrame) -> DataFrame:
    """(exam_id, group_id, item, points) from lines (exam_id, line_no, line) of a table read down its columns.

    After a group's numeral come its items and then as many points; a further number is the group's sum.
    """
    t = F.trim("line")
    roman, item, number = group_id(F.when(t.rlike(r"^[IV]+$"), t)), F.regexp_extract(t, r"^(\d{1,2})\.$", 1), F.regexp_extract(t, r"^(\d{1,3})$", 1)
    df = lines.select("exam_id", "line_no", roman.alias("roman"), F.nullif(item, F.lit("")).cast("bigint").alias("item"), F.nullif(number, F.lit("")).cast("bigint").alias("points"))
    df = seq.carry_forward(df, ["exam_id"], ["line_no"], F.col("roman"), "group_id").filter("group_id IS NOT NULL AND roman IS NULL")
    place = lambda c: F.row_number().over(Window.partitionBy("exam_id", "group_id").orderBy("line_no")).alias(c)
    items = df.filter("item IS NOT NULL").select("exam_id", "group_id", "item", place("pos"))
    points = df.filter("item IS NULL AND points IS NOT NULL").select("exam_id", "group_id", "points", place("pos"))
    return items.join(points, ["exam_id", "group_id", "pos"]).select("exam_id", "group_id", "item", "points")
