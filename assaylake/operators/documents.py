"""Source documents of groups: found by their labels, referred to, superseded, and made where a text implies one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exam_text import is_scoring_summary

#: Labels of documents in a page's text, and ways that a question names documents and pictures.
LABEL = r"(?iu)documento\s+(\d+)\s*(?:\(([^)]+)\))?"
MENTIONS = [r"[Dd]ocumento\s+(\d+)", r"[Dd]oc\.?\s*(\d+)"]
PICTURES = r"(?iu)(?:imagem|figura)\s+([A-Z])"
#: Ids of sources read from a text, and of numbered ones that these supersede.
TEXT_SOURCE, NUMBERED_SOURCE = r"^grupo_(?:i{1,3}|ii)_texto_p\d+$", r"^grupo_(?:i{1,3}|ii)_documento_\d+$"
#: Words of the tables that a first group shows without a label, and words of scoring pages.
TABLE_WORDS = ["norte", "centro", "sul", "total", "senhorio", "distribuição", "localização", "titulares"]
SCORING_WORDS = ["cotações", "cotacoes", "cotação", "cotacao"]
IMPLICIT = "grupo_i_documento_1"


def _number(text: Column) -> Column:
    """A number's digits without leading zeros: any length, compared as text."""
    return F.regexp_replace(text, r"^0+(?=\d)", "")


def labelled(pages: DataFrame, groups: DataFrame, asked: DataFrame) -> DataFrame:
    """(root, group_id, number, page): the page of each document of a group.

    pages(root, page, text), groups(root, page, group_id), asked(root, page): pages with questions.  A document stands
    on the first page that labels it, where pages without questions come before those with.  If the first page
    of a group without questions has no label, it is the group's document 1; later unlabelled pages are none, as by
    then the group has a document.  Scoring pages have no documents of their own.
    """
    df = pages.join(groups, ["root", "page"]).join(asked.select("root", "page", F.lit(True).alias("has")).distinct(), ["root", "page"], "left").withColumn("has", F.coalesce("has", F.lit(False)))
    df = df.withColumn("text", F.coalesce("text", F.lit(""))).filter(F.col("has") | ~is_scoring_summary(F.col("text")))
    df = df.withColumn("numbers", F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(LABEL), F.lit(1)), _number)))
    first = F.row_number().over(Window.partitionBy("root", "group_id", "has").orderBy("page"))
    implied = ~F.col("has") & (F.col("first") == 1) & (F.size("numbers") == 0)
    df = df.withColumn("first", first).withColumn("numbers", F.when(implied, F.array(F.lit("1"))).otherwise(F.col("numbers")))
    found = df.select("root", "group_id", F.explode("numbers").alias("number"), F.struct("has", "page").alias("at"))
    return found.groupBy("root", "group_id", "number").agg(F.min("at").alias("at")).select("root", "group_id", "number", "at.page")


def detect_sources(pages: DataFrame, groups: DataFrame, asked: DataFrame, assets: DataFrame) -> DataFrame:
    """(root, source_id, group_id, number, page, label, kind, asset_refs, children) of the documents of groups.

    assets(root, asset_id, page, type, x, y).  A document has its page's embedded images, or else its other assets, in
    reading order (no place: last).  Documents that share a page get one asset each in order of their numbers, if there are enough of
    them, else none.  Several assets of one document are its children a, b, c and so on.
    """
    place = F.struct(F.coalesce("y", F.lit(9999.0)).alias("y"), F.coalesce("x", F.lit(9999.0)).alias("x"), "asset_id", "type")
    embedded = F.col("type") == "embedded_image"
    listed = assets.groupBy("root", "page").agg(F.array_sort(F.collect_list(F.when(embedded, place))).alias("embedded"), F.array_sort(F.collect_list(F.when(~F.coalesce(embedded, F.lit(False)), place))).alias("others"))
    listed = listed.select("root", "page", F.when(F.size("embedded") > 0, F.col("embedded")).otherwise(F.col("others")).alias("all"))
    on_page = Window.partitionBy("root", "page")
    df = labelled(pages, groups, asked).withColumn("many", F.count("*").over(on_page)).withColumn("nth", F.row_number().over(on_page.orderBy(F.length("number"), "number")))
    df = df.join(listed, ["root", "page"], "left").join(pages.select("root", "page", F.coalesce("text", F.lit("")).alias("text")), ["root", "page"])
    empty = F.slice("all", 1, 0)
    own = F.when(F.col("all").isNull() | (F.col("many") == 1), F.col("all")).when(F.size("all") >= F.col("many"), F.slice("all", F.col("nth"), 1)).otherwise(empty)
    df = df.withColumn("own", own).withColumn("n", F.coalesce(F.size("own"), F.lit(0))).withColumn("n", F.greatest("n", F.lit(0))).withColumn("source_id", F.concat("group_id", F.lit("_documento_"), "number"))
    has = lambda *types: F.exists("own", lambda a: F.coalesce(a["type"], F.lit("")).isin(*types))
    kind = (
        F.when(F.col("n") == 0, F.when(F.col("text").rlike(MENTIONS[0]), "text_source").otherwise("image")).when(F.col("n") > 1, "image_set")
        .when(has("table"), "table").when(has("graph", "chart"), "graph").when(has("map"), "map").when(has("text_source", "document_excerpt"), "text_source").otherwise("image")
    )
    titles = F.zip_with(F.regexp_extract_all("text", F.lit(LABEL), F.lit(1)), F.regexp_extract_all("text", F.lit(LABEL), F.lit(2)), lambda n, t: F.struct(_number(n).alias("n"), t.alias("t")))
    title = F.get(F.filter(titles, lambda x: (x["n"] == F.col("number")) & (x["t"] != "")), F.lit(0))["t"]
    label = F.concat(F.lit("Documento "), "number", F.coalesce(F.concat(F.lit(" ("), title, F.lit(")")), F.lit("")))
    children = F.when(F.col("n") > 1, F.transform("own", lambda a, i: F.concat("source_id", F.lit("_"), F.chr(97 + i))))
    none = F.array().cast("array<string>")
    return df.select("root", "source_id", "group_id", "number", "page", label.alias("label"), kind.alias("kind"), F.coalesce(F.transform("own", lambda a: a["asset_id"]), none).alias("asset_refs"), F.coalesce(children, none).alias("children"))


def late_references(questions: DataFrame, groups: DataFrame) -> DataFrame:
    """(root, ord, source_id, child_id, mode) for questions(root, ord, text, has_refs) without references.

    groups(root, ord, source_id, label, children): page groups of older exams, the last of those whose labels hold one
    number counts.  A picture's letter in the text stands for the first child whose id has that letter as a part of
    its own (`x_b`, `x_b_y`); letters without such a child give nothing, and a text without letters the whole group.
    """
    number = F.regexp_extract("label", r"(\d+)", 1)
    by_number = groups.withColumn("number", number).filter("number <> ''").groupBy("root", "number").agg(F.max_by(F.struct("source_id", "children"), "ord").alias("g"))
    numbers = F.array_distinct(F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in MENTIONS)))
    letters = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(PICTURES), F.lit(1)), F.lower))
    df = questions.filter("NOT has_refs AND text IS NOT NULL").select("root", "ord", letters.alias("letters"), F.explode(numbers).alias("number")).join(by_number, ["root", "number"])
    child = lambda x: F.get(F.filter("g.children", lambda c: c.contains(F.concat(F.lit("_"), x, F.lit("_"))) | c.endswith(F.concat(F.lit("_"), x))), F.lit(0))
    parts = F.transform(F.array_compact(F.transform("letters", child)), lambda c: F.struct(c.alias("child_id"), F.lit("specific_child").alias("mode")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("child_id"), F.lit("full_group").alias("mode")))
    return df.select("root", "ord", "g.source_id", F.explode(F.when(F.size("letters") > 0, parts).otherwise(whole)).alias("r")).select("root", "ord", "source_id", "r.child_id", "r.mode").distinct()


def supersede(sources: DataFrame, refs: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sources, refs and media without numbered documents that sources read from a text supersede.

    Where a question refers to both, its references to numbered documents go, and with them all media of an exam that
    show these; such a source itself goes once no question of the exam refers to it.  sources(root, source_id, ..),
    refs(root, ord, source_id, ..), media(root, ord, source_id, ..); rows keep their other columns.
    """
    texts = sources.filter(F.col("source_id").rlike(TEXT_SOURCE)).select("root", "source_id").distinct()
    both = refs.join(texts, ["root", "source_id"], "left_semi").select("root", "ord").distinct()
    numbered = F.coalesce(F.col("source_id").rlike(NUMBERED_SOURCE), F.lit(False))
    doubled = refs.filter(numbered).join(both, ["root", "ord"], "left_semi").select("root", "ord", "source_id").distinct()
    left = refs.join(doubled, ["root", "ord", "source_id"], "left_anti")
    gone = doubled.select("root", "source_id").distinct()
    unused = gone.join(left.select("root", "source_id"), ["root", "source_id"], "left_anti")
    return sources.join(unused, ["root", "source_id"], "left_anti"), left, media.join(gone, ["root", "source_id"], "left_anti")


def implied_document(questions: DataFrame, sources: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new sources, new references) for questions of group I that speak of a document but refer to none.

    questions(root, ord, group_id, text, page, has_refs).  If the exam has the group's document 1, they refer to it.
    Else it is made on the first page after the cover that is no scoring page and, in this order of preference, holds
    such a question, names the group beside a word of a table, or names the group; without one, nothing is made.
    """
    asking = questions.filter((F.col("group_id") == "grupo_i") & ~F.col("has_refs") & F.lower("text").contains("documento")).select("root", "ord", "page")
    any_of = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))
    low = F.lower(F.coalesce("text", F.lit("")))
    scored = pages.filter(any_of(low, SCORING_WORDS)).select("root", "page")
    had = sources.filter(F.col("source_id") == IMPLICIT).select("root").distinct()
    lacking = asking.join(had, "root", "left_anti")
    own = lacking.filter("page > 1").join(scored, ["root", "page"], "left_anti").groupBy("root").agg(F.min("page").alias("own"))
    named = pages.filter((F.col("page") > 1) & low.contains("grupo i")).join(scored, ["root", "page"], "left_anti")
    named = named.groupBy("root").agg(F.min(F.when(any_of(low, TABLE_WORDS), F.col("page"))).alias("table"), F.min("page").alias("any"))
    made = lacking.select("root").distinct().join(own, "root", "left").join(named, "root", "left").select("root", F.coalesce("own", "table", "any").alias("page"))
    made = made.join(pages.select("root", "page").distinct(), ["root", "page"], "left_semi")
    new = made.select("root", F.lit(IMPLICIT).alias("source_id"), F.lit("grupo_i").alias("group_id"), F.lit("Documento 1").alias("label"), F.lit("table_source").alias("kind"), "page")
    refs = asking.join(had.unionByName(made.select("root")), "root", "left_semi").select("root", "ord", F.lit(IMPLICIT).alias("source_id"))
    return new, refs
