"""What is recovered from page texts or rebuilt from other tables, and how tables leave and enter the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exam_text as T
from ..sources.exams import Exams
from .cleanup import is_info
from .rules import leaves

#: What the text layer of a criteria document holds somewhere.
CRITERIA_HINTS = ["ção", "grupo", "pontos", "versão", "classificação", "item"]
ANCHOR = r"(?m)(?=^[ \t]*\d{1,2}\.\s+\S)"
SUB_ANCHOR = r"(?m)(?=^[ \t]*\d+(?:\.\d+)+\.\s)"
#: Marks of formulas in a statement, and of options that are pictures.
MATH = r"(?iu)\\frac|\\sqrt|\^\{|_\{|[=<>≤≥±×÷∈∞πθΩ∅∪∩]|\b(sen|cos|tg|log|ln|lim)\b|\d+\s*/\s*\d+|\(-?1\)\^n"
VISUAL_OPTIONS = r"(?iu)\b(diagramas?|gráficos?|graficos?|figuras?|esboços?|esbocos?|curvas?|representad[ao]s?\s+graficamente|plano\s+complexo|conjunto\s+de\s+pontos)\b|qual\s+dos\s+seguintes\s+(diagramas|gráficos|graficos|esboços|esbocos)|em\s+qual\s+das\s+op[çc][õo]es\s+seguintes\s+est[áa]\s+representad"
PLAIN_OPTION = r"(?i)^\s*(?:[+-]?\d+(?:[,.]\d+)?\s*(?:m|cm|%|pontos?)?|[A-Za-z0-9π∞Ω∅∪∩+\-−×*/^(),.\s]+)\s*$"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def questions_in_text(pages: DataFrame) -> DataFrame:
    """pages(root, page, text) -> (root, page, number, type, options, statement): the blocks that numbers at line starts begin.

    Covers (pages 1 and 2 without a group), criteria, and scoring pages but for questions before the scoring are passed
    over, and so are blocks under 40 characters; of a page's blocks of one number the first counts.
    """
    low = F.lower("text")
    scoring = (low.contains("cotacoes") | low.contains("cotação") | low.contains("cotaçõ")) & (low.contains("grupo") | low.contains("subtotal"))
    df = pages.filter((F.col("page") > 0) & (_strip(F.col("text")) != "") & ((F.col("page") > 2) | low.contains("grupo i")) & ~low.contains("criterios de classificacao"))
    df = df.withColumn("text", F.when(scoring, T.without_scoring(F.col("text"))).otherwise(F.col("text")))
    df = df.select("root", "page", F.posexplode(F.split("text", ANCHOR)).alias("pos", "block")).withColumn("number", F.nullif(F.regexp_extract("block", r"^\s*(\d{1,2})\.\s", 1), F.lit("")))
    df = df.withColumn("block", _strip(F.col("block"))).filter("number IS NOT NULL AND length(block) >= 40")
    first = df.groupBy("root", "page", "number").agg(F.min_by("block", "pos").alias("block"))
    block = F.col("block")
    choice = block.rlike(r"\([A-D]\)") | block.rlike(r"(?m)^\s*[A-D]\s*(?:-|–|\))")
    kind = F.when(choice, "multiple_choice").when(T.is_multi_blank(block), "multi_blank_choice").otherwise("open_answer")
    none = F.slice(T.choice_options(block), 1, 0)
    return first.select("root", "page", "number", kind.alias("type"), F.when(choice, T.choice_options(block)).otherwise(none).alias("options"), block.alias("statement"))


def missing_subquestions(pages: DataFrame, q: DataFrame) -> DataFrame:
    """(root, page, number, parent_number, type, statement) of numbers with parts in page texts that no question has, from page 4 on."""
    low = F.lower("text")
    df = pages.filter((F.col("page") > 3) & ~low.contains("cotações") & ~low.contains("tabela periódica"))
    df = df.select("root", "page", F.explode(F.split("text", SUB_ANCHOR)).alias("block")).withColumn("number", F.nullif(F.regexp_extract("block", r"^\s*(\d+(?:\.\d+)+)\.\s", 1), F.lit("")))
    block = _strip(F.regexp_replace(_strip(F.col("block")), r"(?s)\n\s*(?:Prova\s+\d+|FIM)\b.*", ""))
    df = df.withColumn("block", block).filter("number IS NOT NULL AND length(block) >= 40")
    df = df.join(q.select("root", F.trim("number").alias("number")).distinct(), ["root", "number"], "left_anti")
    statement = _strip(F.regexp_replace("block", r"^\s*\d+(?:\.\d+)+\.\s*", ""))
    return df.select("root", "page", "number", F.regexp_replace("number", r"\.\d+$", "").alias("parent_number"), T.question_type(F.col("block")).alias("type"), statement.alias("statement"))


def is_scanned(text: Column) -> Column:
    """Whether a criteria document's text layer is no use: too short, over 2 % lost characters, or none of its words."""
    t = _strip(F.coalesce(text, F.lit("")))
    lost = F.length(t) - F.length(F.translate(t, "�\u0000", ""))
    hinted = F.lit(False)
    for word in CRITERIA_HINTS:
        hinted = hinted | F.lower(t).contains(word)
    return (F.length(t) < 200) | (lost > 0.02 * F.length(t)) | ~hinted


def native_tables(pages: DataFrame) -> DataFrame:
    """pages(root, page, tables array<array<array<string>>>) -> (root, asset_id, page, options, columns, rows).

    Tables of two rows or more; the first row is the header.  A header of roman numerals makes a table of options.  Of a
    page's tables of one id the first counts.
    """
    df = pages.select("root", "page", F.posexplode("tables").alias("pos", "t")).filter("size(t) >= 2")
    header = F.transform(F.col("t")[0], lambda h: F.trim(F.coalesce(h, F.lit(""))))
    df = df.withColumn("columns", header).withColumn("options", F.forall("columns", lambda h: (h == "") | h.isin(T.ROMANS[:5])))
    df = df.withColumn("asset_id", F.concat(F.when(F.col("options"), "tabela_opcoes_p").otherwise("tabela_p"), F.col("page").cast("string")))
    rows = F.transform(F.slice("t", 2, F.size("t")), lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    first = df.withColumn("rows", rows).groupBy("root", "asset_id").agg(F.min_by(F.struct("page", "options", "columns", "rows"), "pos").alias("m"))
    return first.select("root", "asset_id", "m.*")


def figure_refs(q: DataFrame, assets: DataFrame) -> DataFrame:
    """(root, ord, image_refs): references to figures that a question does not name go, and those that it names on its page or the next come."""
    text = F.concat_ws(" ", F.coalesce("statement", F.lit("")), F.coalesce("raw_text", F.lit("")))
    figures = assets.withColumn("no", F.regexp_extract("asset_id", r"^figura_(\d+)", 1)).filter("no <> ''").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("ord", "no", "asset_id", "page"))).alias("figures"))
    df = q.join(figures, "root", "left").withColumn("named", F.regexp_extract_all(text, F.lit(r"[Ff]igura\s+(\d+)"), F.lit(1)))
    all_, named = F.coalesce("figures", F.array().cast("array<struct<ord:bigint,no:string,asset_id:string,page:bigint>>")), F.col("named")
    wrong = F.transform(F.filter(all_, lambda f: ~F.array_contains(named, f["no"])), lambda f: f["asset_id"])
    near = lambda f: (F.coalesce(f["page"], F.lit(0)) == 0) | (F.coalesce("source_page", F.lit(0)) == 0) | (F.abs(f["page"] - F.col("source_page")) <= 1)
    right = F.transform(F.filter(all_, lambda f: F.array_contains(named, f["no"]) & near(f)), lambda f: f["asset_id"])
    return df.select("root", "ord", F.array_union(F.array_except("image_refs", wrong), right).alias("image_refs"))


def source_groups(ex: Exams) -> DataFrame:
    """(root, page, group, children): assets by page, of pages without questions."""
    asked = ex.questions.filter("source_page IS NOT NULL").select("root", F.col("source_page").alias("page")).distinct()
    free = ex.assets.filter("type <> 'embedded_image'").join(asked, ["root", "page"], "left_anti")
    return free.groupBy("root", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "asset_id"))).alias("c")).select("root", "page", F.concat(F.lit("source_group_p"), F.col("page").cast("string")).alias("group"), F.col("c.asset_id").alias("children"))


def rebuilt_policy(q: DataFrame, policy: DataFrame, exams: DataFrame) -> DataFrame:
    """(root, items, raw_subtotal, mandatory, optional): scoring policies made anew of questions' points.

    Only where the policy has fewer items than the questions or another sum, and the questions' sum is between 180 and 260.
    """
    good = leaves(q).filter("coalesce(group_id, '') <> '' AND trim(coalesce(number, '')) <> '' AND points > 0")
    new = good.groupBy("root").agg(F.count("*").alias("items"), F.sum("points").alias("raw_subtotal"), F.sum(F.when(F.col("is_mandatory"), F.col("points")).otherwise(0)).alias("mandatory"), F.sum(F.when(~F.col("is_mandatory"), F.col("points")).otherwise(0)).alias("optional"))
    had = policy.groupBy("root").agg(F.count("*").alias("had"))
    df = new.join(had, "root", "left").join(exams.select("root", F.coalesce("subtotal", F.lit(0)).alias("told")), "root")
    kept = (F.coalesce("had", F.lit(0)) > 0) & (F.col("had") >= F.col("items")) & (F.col("told") == F.col("raw_subtotal"))
    return df.filter(~kept & F.col("raw_subtotal").between(180, 260)).select("root", "items", "raw_subtotal", "mandatory", "optional")


def merged_blanks(q: DataFrame) -> DataFrame:
    """Groups whose children are only a split question with blanks take their first such child's blanks, and the children go.

    q needs `parent`; the number of such a group has no part after a dot.
    """
    kids = q.filter("parent IS NOT NULL").groupBy("root", F.col("parent").alias("question_id")).agg(F.min(F.when((F.col("type") == "multi_blank_choice") & (F.size("blanks") > 0), F.struct("ord", "blanks"))).alias("kid"))
    df = q.join(kids, ["root", "question_id"], "left").withColumn("merge", F.col("is_group") & F.col("kid").isNotNull() & ~F.col("number").contains("."))
    gone = df.filter("merge").select("root", F.col("question_id").alias("parent"), F.lit(True).alias("gone")).distinct()
    df = df.join(gone, ["root", "parent"], "left").filter("gone IS NULL")
    return df.withColumn("blanks", F.when(F.col("merge"), F.col("kid.blanks")).otherwise(F.col("blanks"))).withColumn("type", F.when(F.col("merge"), "multi_blank_choice").otherwise(F.col("type"))).withColumn("is_group", F.col("is_group") & ~F.col("merge")).drop("kid", "merge", "gone")


def plain_options(kind: Column, text: Column, options: Column) -> Column:
    """Whether a choice's pictures of options are none: its text asks for no picture and all options but one, two at least, are plain."""
    plain = F.size(F.filter(options, lambda o: F.coalesce(o, F.lit("")).rlike(PLAIN_OPTION)))
    return (kind == "multiple_choice") & (F.size(options) > 0) & ~text.rlike(VISUAL_OPTIONS) & (plain >= F.greatest(F.lit(2), F.size(options) - 1))


def recovered_jobs(jobs: DataFrame, queue: DataFrame, uploads: DataFrame) -> DataFrame:
    """(job_id, status) of jobs that were running and are not queued: queued again if their file is there, else failed."""
    lost = jobs.filter("status = 'processing'").join(queue.select("job_id").distinct(), "job_id", "left_anti")
    there = uploads.select("job_id", F.lit(True).alias("there")).distinct()
    return lost.join(there, "job_id", "left").select("job_id", F.when(F.col("there"), "queued").otherwise("error").alias("status"))


def group_order() -> list[Column]:
    """Sort keys of the Portuguese exam: groups I to III, then the number's whole part, then the page."""
    group = F.coalesce(F.when(F.col("group_id") == "grupo_i", 1).when(F.col("group_id") == "grupo_ii", 2).when(F.col("group_id") == "grupo_iii", 3), F.lit(99))
    return [group, F.coalesce(F.split("number", r"\.")[0].try_cast("int"), F.lit(999)), F.coalesce(F.nullif("source_page", F.lit(0)), F.lit(999)), F.col("ord")]


def write_exams(ex: Exams, folder: str) -> None:
    """One JSON document for each exam, in files by exam subject: its fields and its questions in order."""
    q = ex.questions.groupBy("root").agg(F.array_sort(F.collect_list(F.struct(*[c for c in ("ord", "question_id", "group_id", "number", "type", "points", "statement", "source_page")]))).alias("questions"))
    ex.exams.join(q, "root", "left").write.mode("overwrite").partitionBy("subject").json(folder)


EXAM_JSON = "root string, title string, year bigint, phase string, total_pages bigint, subject string, questions array<struct<ord:bigint,question_id:string,group_id:string,number:string,type:string,points:bigint,statement:string,source_page:bigint>>"


def read_exams(spark, folder: str) -> DataFrame:
    """The documents that write_exams wrote."""
    return spark.read.schema(EXAM_JSON).json(folder)


def issue_summary(issues: DataFrame, exams: DataFrame) -> DataFrame:
    """(root, blocker, high, medium, info, verdict) of every exam: FAIL with a blocker, REVIEW with a high or medium issue, else PASS."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    counts = exams.select("root").distinct().join(issues.groupBy("root").agg(*map(n, ("BLOCKER", "HIGH", "MEDIUM", "INFO"))), "root", "left").na.fill(0)
    return counts.withColumn("verdict", F.when(F.col("blocker") > 0, "FAIL").when(F.col("high") + F.col("medium") > 0, "REVIEW").otherwise("PASS"))


def write_issues(issues: DataFrame, exams: DataFrame, folder: str) -> None:
    """The report of an audit: issues as CSV with a header, and a summary by exam, clean ones included."""
    issues.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/issues")
    issue_summary(issues, exams).write.mode("overwrite").option("header", True).csv(f"{folder}/summary")


def warnings_report(warnings: DataFrame) -> DataFrame:
    """warnings(root, ord, type, severity, message) -> (root, report): real ones with their severity, then those that only inform."""
    rescaled = F.max(F.col("type") == "grupo_ii_points_rescaled").over(Window.partitionBy("root"))
    df = warnings.withColumn("info", is_info(F.col("type"), F.col("severity"), F.col("message"), rescaled))
    line = F.concat(F.lit("["), F.when(F.col("info"), "INFO").otherwise(F.upper(F.coalesce("severity", F.lit("low")))), F.lit("] "), F.coalesce("type", F.lit("unknown")), F.lit(" — "), F.coalesce("message", F.lit("")))
    of = lambda info: F.transform(F.array_sort(F.collect_list(F.when(F.col("info") == info, F.struct("ord", line.alias("line"))))), lambda x: x["line"])
    df = df.groupBy("root").agg(of(False).alias("real"), of(True).alias("told"))
    head = lambda title, c: F.concat(F.lit(f"=== {title} ("), F.size(c).cast("string"), F.lit(") ==="))
    body = F.concat(F.array(head("Avisos da extração", "real")), F.when(F.size("real") == 0, F.array(F.lit("Sem avisos reais — extração limpa."))).otherwise(F.col("real")))
    tail = F.when(F.size("told") > 0, F.concat(F.array(head("Reparações automáticas do pipeline", "told")), F.col("told"))).otherwise(F.array().cast("array<string>"))
    return df.select("root", F.array_join(F.concat(body, tail), "\n").alias("report"))
