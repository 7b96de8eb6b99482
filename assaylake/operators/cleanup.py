"""Clean-ups of an exam's tables: filters on rows and on their references, and associations that were missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exam_text as T
from ..sources.exams import Exams

GROUPS = ["grupo_i", "grupo_ii", "grupo_iii"]
#: States of jobs that can be exported.
EXPORTABLE = ["completed", "completed_with_warnings", "needs_review", "partial_failed", "error"]
#: Warnings that only tell what was repaired.
INFO_WARNINGS = [
    "portuguese_points_repaired", "portuguese_text_sources_repaired", "portuguese_legacy_duplicates_removed", "portuguese_group_iii_duplicates_removed", "portuguese_group_iii_observations_removed",
    "portuguese_inline_options_stripped", "portuguese_composition_visual_attached", "portuguese_choice_options_repaired", "portuguese_multiblank_repaired", "portuguese_embedded_group_iii_removed",
    "portuguese_group_iii_recovered", "portuguese_multiple_compositions_collapsed", "portuguese_missing_questions_recovered", "portuguese_grupo_i_b_reconstructed", "portuguese_grupo_i_b_injected",
    "instruction_questions_removed", "recovered_questions_present", "partial_text_fallback_used", "text_fallback_used", "history_question_cleanup", "history_points_repaired",
    "history_points_repaired_from_scoring_text", "history_multi_select_repaired", "history_multiblank_repaired", "history_interaction_type_repaired", "history_false_interaction_type_repaired",
    "history_line_number_artifact_removed", "cross_group_ref_stripped", "multi_select_max_inferred", "portuguese_recovered_from_pdf_text",
]
#: Issues of the history audit that another run may mend.
RETRYABLE = [
    "GROUP_NUMBER_GAP", "CORRUPT_TEXT", "MULTIPLE_CHOICE_WITHOUT_OPTIONS", "MATCHING_WITHOUT_COLUMNS", "ORDERING_WITHOUT_ITEMS", "MULTIBLANK_WITHOUT_OPTIONS", "MULTIBLANK_MISCLASSIFIED",
    "CHOICE_LIKE_OPEN_ANSWER", "OPEN_ANSWER_SHOULD_BE_SELECTION", "BROKEN_SOURCE_REF", "BROKEN_CHILD_REF", "CROSS_GROUP_SOURCE_REF", "SOURCE_REFS_WITHOUT_MEDIA", "MENTIONS_SOURCE_WITHOUT_REF",
    "MISSING_EXPECTED_DOCUMENTS", "MISSING_MEDIA_FILE", "MISSING_SOURCE_CROP_FILE", "MISSING_CHILD_CROP_FILE", "DUPLICATE_SOURCE_CROPS", "SUSPECT_CROP_TOO_SMALL",
]


def _text() -> Column:
    return F.concat_ws(" ", F.coalesce("statement", F.lit("")), F.coalesce("raw_text", F.lit("")))


def without_phantom_tables(q: DataFrame) -> DataFrame:
    """Questions that do not speak of tables lose their references to them."""
    phantom = (F.size("table_refs") > 0) & ~_text().rlike(T.TABLE_WORDS)
    kept = F.when(phantom, F.filter("asset_refs", lambda r: ~F.lower(r).contains("tabela"))).otherwise(F.col("asset_refs"))
    return q.withColumn("asset_refs", kept).withColumn("table_refs", F.when(phantom, F.slice("table_refs", 1, 0)).otherwise(F.col("table_refs")))


def own_group_refs(q: DataFrame) -> DataFrame:
    """References to sources of another group go; `stripped` tells whether any did."""
    own = F.filter("source_refs", lambda r: F.startswith(F.coalesce(r["source_id"], F.lit("")), F.concat("group_id", F.lit("_"))))
    clean = F.when(F.coalesce("group_id", F.lit("")) == "", F.col("source_refs")).otherwise(own)
    return q.withColumn("stripped", F.size(clean) < F.size("source_refs")).withColumn("source_refs", clean)


def without_cover_sources(q: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources that begin on the cover go, with all of their id, and so do references to them."""
    bad = sources.filter(F.col("group_id").isin(GROUPS) & (F.col("page_start") == 1)).groupBy("root").agg(F.collect_set("source_id").alias("__bad"))
    kept = sources.join(bad, "root", "left").filter("__bad IS NULL OR NOT array_contains(__bad, source_id)").drop("__bad")
    q = q.join(bad, "root", "left")
    refs = F.filter("source_refs", lambda r: ~F.coalesce(F.array_contains("__bad", r["source_id"]), F.lit(False)))
    return q.withColumn("source_refs", refs).drop("__bad"), kept


def without_empty_tables(ex: Exams) -> DataFrame:
    """Assets but for tables without rows, columns and references."""
    refs = ex.questions.select("root", F.explode(F.concat("image_refs", "table_refs", "asset_refs")).alias("asset_id"), F.lit(True).alias("used")).distinct()
    empty = F.startswith("asset_id", F.lit("tabela_")) & (F.size("rows") == 0) & (F.size("columns") == 0)
    return ex.assets.join(refs, ["root", "asset_id"], "left").filter(~empty | F.col("used").isNotNull()).drop("used")


def found_subquestions(q: DataFrame, pages: DataFrame) -> DataFrame:
    """Without questions of a number with a part that begins no line of the exam's text; who named them as parent has none.

    In an exam that loses questions, a row of type group without a question left under it is a calculation.
    """
    numbers = pages.select("root", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(\d+\.\d+)\.\s"), F.lit(1))).alias("number"), F.lit(True).alias("there")).distinct()
    told = pages.filter("text <> ''").select("root", F.lit(True).alias("told")).distinct()
    q = q.withColumn("__no", F.trim("number")).join(numbers.withColumnRenamed("number", "__no"), ["root", "__no"], "left").join(told, "root", "left")
    q = q.withColumn("__fake", F.col("told").isNotNull() & F.col("__no").rlike(r"^\d+\.\d+$") & F.col("there").isNull())
    gone = q.filter("__fake").select("root", F.col("question_id").alias("parent"), F.lit(True).alias("__gone")).distinct()
    kept = q.filter("NOT __fake").join(gone, ["root", "parent"], "left")
    kept = kept.withColumn("parent", F.when(F.col("__gone").isNull(), F.col("parent"))).drop("__no", "there", "told", "__fake", "__gone")
    if "type" not in kept.columns or "is_group" not in kept.columns:
        return kept
    kids = kept.filter("parent IS NOT NULL").select("root", F.col("parent").alias("question_id"), F.lit(True).alias("__kids")).distinct()
    kept = kept.join(kids, ["root", "question_id"], "left").join(gone.select("root", F.lit(True).alias("__lost")).distinct(), "root", "left")
    bare = F.coalesce((F.col("type") == "group") & F.col("__kids").isNull() & F.col("__lost").isNotNull(), F.lit(False))
    return kept.withColumn("is_group", F.col("is_group") & ~bare).withColumn("type", F.when(bare, "calculation").otherwise(F.col("type"))).drop("__kids", "__lost")


def group_rows(q: DataFrame) -> DataFrame:
    """Group rows have neither options nor blanks."""
    group = F.col("is_group") | (F.col("type") == "group")
    return q.withColumn("options", F.when(group, F.slice("options", 1, 0)).otherwise(F.col("options"))).withColumn("blanks", F.when(~group, F.col("blanks")))


def mandatory_before(policy: DataFrame, exams: DataFrame, year: int = 2020) -> DataFrame:
    """Items of exams before the year are all mandatory."""
    out = policy.join(exams.select("root", "year"), "root", "left")
    return out.withColumn("mandatory", F.col("mandatory") | F.coalesce(F.col("year") < year, F.lit(False))).drop("year")


def is_visible() -> Column:
    """Whether a question has anything to show."""
    lists = [F.size(c) > 0 for c in ("options", "blanks", "asset_refs", "image_refs", "table_refs", "source_refs", "media")]
    out = F.coalesce("statement", F.lit("")) != ""
    for c in lists:
        out = out | F.coalesce(c, F.lit(False))
    return out


def is_info(kind: Column, severity: Column, message: Column, rescaled: Column) -> Column:
    """Whether a warning only informs: by severity or type, or low points that are no less than 3 or come from rescaling."""
    points = F.coalesce(F.nullif(F.regexp_extract(message, r"low points: (\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))
    return F.coalesce(severity == "info", F.lit(False)) | kind.isin(INFO_WARNINGS) | (kind == "suspicious_points") & ((points >= 3) | rescaled)


def is_history(ex: Exams) -> DataFrame:
    """(root, history): by the subject, else by title and id, else by sources of documents, else by groups with sources."""
    q = ex.questions.groupBy("root").agg(F.bool_or(F.startswith(F.lower(F.coalesce("group_id", F.lit(""))), F.lit("grupo_"))).alias("grouped"), F.bool_or(F.size("source_refs") > 0).alias("sourced"))
    s = ex.sources.groupBy("root").agg(F.bool_or(F.lower("source_id").contains("doc")).alias("docs"))
    low = F.lower(F.coalesce("subject", F.lit("")))
    marker = F.lower(F.concat_ws(" ", "subject", "title", "root"))
    no = lambda c: F.coalesce(c, F.lit(False))
    by = F.when((low != "") & ~low.contains("hist"), False).otherwise(marker.contains("hist") | no(F.col("docs")) | no(F.col("grouped") & F.col("sourced")))
    return ex.exams.join(q, "root", "left").join(s, "root", "left").select("root", by.alias("history"))


def figures_on_page(q: DataFrame, assets: DataFrame) -> DataFrame:
    """(root, ord, asset_id): figures that a question names and that stand on its page; ids end in the number and page."""
    no, page = F.regexp_extract("asset_id", r"(?i)^figura_(\d+)_p(\d+)", 1), F.regexp_extract("asset_id", r"(?i)^figura_(\d+)_p(\d+)", 2)
    # of figures of one number and page the last counts
    figures = assets.filter(no != "").select("root", no.alias("fig"), page.try_cast("bigint").alias("page"), "ord", "asset_id").groupBy("root", "fig", "page").agg(F.max_by("asset_id", "ord").alias("asset_id"))
    named = q.filter("source_page > 0").select("root", "ord", F.col("source_page").alias("page"), F.explode(F.array_distinct(F.regexp_extract_all(_text(), F.lit(r"(?i)Figura\s+(\d+)"), F.lit(1)))).alias("fig"))
    return named.join(figures, ["root", "fig", "page"]).select("root", "ord", "asset_id")


def tables_of_questions(q: DataFrame, assets: DataFrame) -> DataFrame:
    """(root, asset_ord, ord, score): the question that a table no one refers to belongs to.

    Candidates are the last question of the number that the table stands near, and those of its page.  The number
    counts 10, words of tables 8, a type that may use one 1; no score, no question; ties go to the first.
    """
    used = q.select("root", F.explode("table_refs").alias("asset_id")).distinct()
    tables = assets.filter((F.col("type") == "table") | F.lower("asset_id").contains("tabela")).join(used, ["root", "asset_id"], "left_anti").select("root", F.col("ord").alias("asset_ord"), "page", F.trim(F.coalesce("near", F.lit(""))).alias("near"))
    low = F.lower(_text())
    about = F.when(low.contains("tabela") | low.contains("medições") | low.contains("apresentam-se"), 8).otherwise(0) + F.when(F.col("type").isin("calculation", "open_answer", "multi_blank_choice"), 1).otherwise(0)
    rows = q.select("root", "ord", "source_page", F.trim("number").alias("number"), about.alias("about"))
    last = rows.withColumn("last", F.row_number().over(Window.partitionBy("root", "number").orderBy(F.desc("ord"))) == 1).filter("last")
    near = tables.filter("near <> ''").join(last, (tables["root"] == last["root"]) & (F.col("near") == F.col("number"))).select(tables["root"], "asset_ord", "ord", (F.col("about") + 10).alias("score"), F.lit(0).alias("way"))
    on_page = tables.join(rows, (tables["root"] == rows["root"]) & (F.col("page") == F.col("source_page"))).select(tables["root"], "asset_ord", "ord", (F.col("about") + F.when(F.col("number") == F.col("near"), 10).otherwise(0)).alias("score"), F.lit(1).alias("way"))
    best = near.unionByName(on_page).groupBy("root", "asset_ord").agg(F.min(F.struct((-F.col("score")).alias("s"), "way", "ord")).alias("b"))
    return best.filter("b.s < 0").select("root", "asset_ord", F.col("b.ord").alias("ord"), (-F.col("b.s")).cast("bigint").alias("score"))


def homes_of_assets(q: DataFrame, assets: DataFrame) -> DataFrame:
    """(root, asset_ord, ord): the question of an asset without one: the first of the number it is near, else the last of its page; null: none."""
    used = q.select("root", F.explode(F.concat("image_refs", "table_refs")).alias("asset_id")).distinct()
    free = assets.filter("type <> 'embedded_image'").join(used, ["root", "asset_id"], "left_anti").select("root", F.col("ord").alias("asset_ord"), "page", F.nullif(F.coalesce("near", F.lit("")), F.lit("")).alias("near"))
    first = q.groupBy("root", F.col("number").alias("near")).agg(F.min("ord").alias("by_number"))
    last = q.filter("source_page IS NOT NULL").groupBy("root", F.col("source_page").alias("page")).agg(F.max("ord").alias("by_page"))
    return free.join(first, ["root", "near"], "left").join(last, ["root", "page"], "left").select("root", "asset_ord", F.coalesce("by_number", "by_page").alias("ord"))


def groups_from_pages(q: DataFrame, page_groups: DataFrame) -> DataFrame:
    """Questions with the group of their page; where it has none they keep theirs."""
    known = page_groups.select("root", F.col("page").alias("source_page"), F.col("group_id").alias("__g"))
    return q.join(known, ["root", "source_page"], "left").withColumn("group_id", F.coalesce("__g", "group_id")).drop("__g")


def composite_ids(q: DataFrame) -> DataFrame:
    """(root, ord, question_id, new_id, parent): ids made of group and number; parents follow the last question of their id."""
    has = (F.coalesce("group_id", F.lit("")) != "") & (F.coalesce("number", F.lit("")) != "")
    q = q.withColumn("new_id", F.when(has, F.concat("group_id", F.lit("_q"), F.translate("number", ".", "_"))))
    renamed = q.filter("new_id IS NOT NULL").groupBy("root", F.col("question_id").alias("parent")).agg(F.max_by("new_id", "ord").alias("new_parent"))
    return q.join(renamed, ["root", "parent"], "left").select("root", "ord", "question_id", F.coalesce("new_id", "question_id").alias("new_id"), F.coalesce("new_parent", "parent").alias("parent"))


def existing_media(q: DataFrame, files: DataFrame, relative) -> tuple[DataFrame, DataFrame]:
    """(root, ord, url) of media whose file is there, and of those whose is not."""
    media = q.select("root", "ord", F.explode("media").alias("url")).filter("url <> ''").withColumn("rel", relative("url"))
    known = files.select("root", "rel").distinct()
    cut = lambda how: media.join(known, ["root", "rel"], how).select("root", "ord", "url")
    return cut("left_semi"), cut("left_anti")


def question_order() -> list[Column]:
    """Sort keys: page (none: 999), whole number (none: 999) and the part after its dot."""
    parts = F.split("number", r"\.")
    major, minor = parts[0].try_cast("int"), F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).try_cast("int")).otherwise(0)
    whole = major.isNotNull() & minor.isNotNull()
    return [F.coalesce("source_page", F.lit(999)), F.when(whole, major).otherwise(999), F.when(whole, minor).otherwise(0), F.col("ord")]


def cover_data(pages: DataFrame) -> DataFrame:
    """(root, year, subject, phase, title) that the first two pages of an exam tell, the earlier one first."""
    place = F.row_number().over(Window.partitionBy("root").orderBy("page"))
    told = pages.withColumn("place", place).filter("place <= 2").select("root", "place", T.cover(F.col("text")).alias("c"))
    first = lambda name: F.min_by(F.col(f"c.{name}"), F.when(F.col(f"c.{name}").isNotNull(), F.col("place"))).alias(name)
    out = told.groupBy("root").agg(*map(first, ("year", "subject", "phase")))
    return out.withColumn("title", F.when(F.col("subject").isNotNull() & F.col("year").isNotNull(), F.concat(F.lit("Exame Nacional de "), "subject", F.lit(" - "), "year")))


def preflight(pages: DataFrame) -> DataFrame:
    """(root, type, abort, noisy): what a file is by the phrases of its first three pages, and its pages with watermarks.

    Two phrases make it a criteria document (which ends the run) if they are more than the exam's, else an exam.
    """
    place = F.row_number().over(Window.partitionBy("root").orderBy("page"))
    df = pages.withColumn("place", place).withColumn("low", F.lower("text"))
    count = lambda words: sum(F.max((F.col("place") <= 3) & F.col("low").contains(w)).cast("int") for w in words)
    noisy = F.array_sort(F.collect_set(F.when(F.col("text").rlike(T.WATERMARKS), F.col("page"))))
    df = df.groupBy("root").agg(count(T.CRITERIA_MARKERS).alias("criteria"), count(T.EXAM_MARKERS).alias("exam"), noisy.alias("noisy"))
    kind = F.when((F.col("criteria") >= 2) & (F.col("criteria") > F.col("exam")), "criteria").when(F.col("exam") >= 2, "exam").otherwise("unknown")
    return df.select("root", kind.alias("type"), (kind == "criteria").alias("abort"), "noisy")
