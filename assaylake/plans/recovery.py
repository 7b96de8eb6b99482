"""Questions from texts, rebuilt tables, and tables written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import recovery, rules
from ..sources import bundles
from ..sources.exams import MODEL_SQL, model, numbered, rooted
from ..sources.shared import shared_dir
from ..sources.tables import table
from .cleanup import _WARNING, _quoted, traced
from .registry import query
from .rules import GENERIC_SQL

traced("q_math_heavy", "Whether a statement holds formulas.", [("x = 2", "true"), ("Calcule 3/4 de 8", "true"), ("o log de x", "true"), ("Comente o texto", "false"), ("\\frac{1}{2}", "true"), ("logo a seguir", "false")], lambda t: t.rlike(recovery.MATH))
traced("q_plain_options", "Whether a choice's options are no pictures.", [
    ("Qual é o valor?", "2;3,5;x+1;7 m", "true"), ("Qual dos seguintes gráficos?", "A;B;C;D", "false"), ("Qual?", "1;é;ó;ç", "false"), ("Qual?", "1;2;é", "true"), ("Qual?", "1", "false"), ("Observe a figura", "1;2;3", "false"),
], lambda t, o: recovery.plain_options(F.lit("multiple_choice"), t, F.split(o, ";")))
_LONG = "texto da prova " * 20
traced("q_criteria_quality", "Whether a criteria document's text layer is no use.", [
    ("GRUPO I " + _LONG, "false"), ("pontos", "true"), (_LONG, "true"), ("classificação " + _LONG + "�" * 9, "true"), (None, "true"), ("Versão " + _LONG + "�", "false"),
], recovery.is_scanned)

#: Pages of exams, by key.
PAGES = [
    [(1, "1. Isto é a capa e não conta, por muito longa que seja a linha."), (3, "1. Qual é a resposta certa para esta pergunta longa?\n(A) uma\n(B) outra\n2. curta\n3. Explique por palavras suas o que o autor quis dizer aqui.\n1. Repetida: esta segunda pergunta um não conta na mesma página.")],
    [(2, "GRUPO I\n1. Comente a posição do autor sobre o tema em análise no texto."), (4, "1. Diga o que pensa sobre o assunto que o texto trata aqui.\nCOTAÇÕES\nGrupo I\n1. 20 pontos e mais um texto longo que já não conta para nada"), (5, "criterios de classificacao\n1. Nada disto conta, embora seja um texto com mais de quarenta letras.")],
    [(4, "2.1. Calcule o valor exato da expressão dada no enunciado acima.\n2.2. curta\n  3.1. Indique a opção que completa o que se pede na frase dada.\nFIM\nresto"), (5, "Tabela periódica\n4.1. Isto não conta, porque a página é de uma tabela de elementos."), (3, "5.1. Isto não conta, porque a página vem antes da quarta do exame.")],
]
#: Traced by hand: (key, page, number, type, options, first words).
TEXT_QUESTIONS = [(0, 3, "1", "multiple_choice", "A=uma|B=outra", "1. Qual é"), (0, 3, "3", "open_answer", "", "3. Explique"), (1, 2, "1", "open_answer", "", "1. Comente"), (1, 4, "1", "open_answer", "", "1. Diga o")]
SUBQUESTIONS = [(2, 4, "2.1", "2", "calculation", "Calcule o valor exato da expressão dada no enunciado acima."), (2, 4, "3.1", "3", "open_answer", "Indique a opção que completa o que se pede na frase dada.")]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_quoted(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    docs = F.array(*(F.array(*(F.struct(F.lit(p).cast("bigint").alias("page"), F.lit(t).alias("text")) for p, t in pages)) for pages in PAGES))
    return model(spark, d).exams.select("root", F.inline(docs[(F.col("exam_no") % len(PAGES)).cast("int")]))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS root, CAST(page AS BIGINT) AS page, number, type, options, words FROM orders JOIN (VALUES {_values(TEXT_QUESTIONS)}) v(k, page, number, type, options, words) ON o_orderkey % {len(PAGES)} = k")
def q_text_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions that page texts hold; the SQL holds values traced by hand."""
    found = recovery.questions_in_text(_pages(spark, d))
    shown = F.array_join(F.transform("options", lambda o: F.concat_ws("=", o["letter"], o["text"])), "|")
    return found.select("root", "page", "number", "type", shown.alias("options"), F.regexp_extract("statement", r"^(\S+ \S+(?: é| o)?)", 1).alias("words"))


@query(f"""WITH {MODEL_SQL} SELECT CAST(o_orderkey AS VARCHAR) AS root, CAST(page AS BIGINT) AS page, v.number, parent_number, v.type, v.statement FROM orders JOIN (VALUES {_values(SUBQUESTIONS)}) v(k, page, number, parent_number, type, statement) ON o_orderkey % {len(PAGES)} = k
WHERE NOT EXISTS (SELECT 1 FROM questions q WHERE q.root = CAST(o_orderkey AS VARCHAR) AND q.number = v.number)""")
def q_missing_subquestions(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with parts that only the text holds; the SQL holds values traced by hand."""
    return recovery.missing_subquestions(_pages(spark, d), model(spark, d).questions)


_HEADERS = "CASE ord % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'x' ELSE '' END"


@query(f"""WITH {MODEL_SQL}, t AS (SELECT root, ord, page, {_HEADERS} AS h, n_rows FROM assets WHERE n_rows > 0), r AS (SELECT root, page, 'tabela_' || CASE WHEN h <> 'x' THEN 'opcoes_' ELSE '' END || 'p' || page AS asset_id, h <> 'x' AS options, h || ',II' AS columns, n_rows AS n, ord FROM t)
SELECT root, asset_id, page, options, columns, n FROM r QUALIFY row_number() OVER (PARTITION BY root, asset_id ORDER BY ord) = 1""")
def q_native_tables(spark: SparkSession, d: str) -> DataFrame:
    """Assets' rows as tables of two columns below a header."""
    a = model(spark, d).assets.withColumn("t", F.concat(F.array(F.array(F.expr(_HEADERS), F.lit(" II "))), F.transform("rows", lambda x: F.array(x, F.lit(None).cast("string")))))
    pages = a.groupBy("root", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "t"))).alias("x")).select("root", "page", F.col("x.t").alias("tables"))
    return recovery.native_tables(pages).select("root", "asset_id", "page", "options", F.array_join("columns", ",").alias("columns"), F.size("rows").cast("bigint").alias("n"))


@query(f"""WITH {MODEL_SQL}, q AS (SELECT root, ord, image_ref, source_page, regexp_extract_all(coalesce(statement, '') || ' ' || coalesce(raw_text, ''), '[Ff]igura\\s+(\\d+)', 1) AS named FROM questions),
f AS (SELECT root, ord, asset_id, page, regexp_extract(asset_id, '^figura_(\\d+)', 1) AS no FROM assets WHERE asset_id LIKE 'figura_%'),
r AS (SELECT q.root, q.ord, image_ref AS ref FROM q WHERE image_ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.root = q.root AND f.asset_id = image_ref AND NOT list_contains(named, no)) UNION SELECT q.root, q.ord, asset_id FROM q JOIN f ON f.root = q.root AND list_contains(named, no) AND (source_page IS NULL OR abs(page - source_page) <= 1))
SELECT q.root, q.ord, coalesce(string_agg(ref, ',' ORDER BY ref), '') AS image_refs FROM q LEFT JOIN r ON r.root = q.root AND r.ord = q.ord GROUP BY q.root, q.ord""")
def q_figure_refs(spark: SparkSession, d: str) -> DataFrame:
    ex = model(spark, d)
    return recovery.figure_refs(ex.questions, ex.assets).select("root", "ord", F.array_join(F.array_sort("image_refs"), ",").alias("image_refs"))


@query(f"""WITH {MODEL_SQL} SELECT root, page, 'source_group_p' || page AS "group", string_agg(asset_id, ',' ORDER BY ord) AS children FROM assets a WHERE type <> 'embedded_image' AND NOT EXISTS (SELECT 1 FROM questions q WHERE q.root = a.root AND source_page = page) GROUP BY root, page""")
def q_source_groups(spark: SparkSession, d: str) -> DataFrame:
    return recovery.source_groups(model(spark, d)).withColumn("children", F.array_join("children", ","))


@query(f"""WITH {MODEL_SQL}, leaf AS (SELECT * FROM questions q WHERE NOT is_group AND group_id IS NOT NULL AND points > 0 AND NOT EXISTS (SELECT 1 FROM questions c WHERE c.root = q.root AND c.parent = q.question_id)),
n AS (SELECT root, count(*) AS items, CAST(sum(points) AS BIGINT) AS raw_subtotal, CAST(sum(CASE WHEN visual THEN 0 ELSE points END) AS BIGINT) AS mandatory, CAST(sum(CASE WHEN visual THEN points ELSE 0 END) AS BIGINT) AS optional FROM leaf GROUP BY root)
SELECT n.* FROM n JOIN exams e ON e.root = n.root LEFT JOIN (SELECT root, count(*) AS had FROM policy GROUP BY root) p ON p.root = n.root WHERE raw_subtotal BETWEEN 180 AND 260 AND NOT (coalesce(had, 0) >= items AND coalesce(subtotal, 0) = raw_subtotal)""")
def q_rebuilt_policy(spark: SparkSession, d: str) -> DataFrame:
    """Questions with a picture are optional here."""
    ex = model(spark, d)
    return recovery.rebuilt_policy(ex.questions.withColumn("is_mandatory", ~F.col("visual")), ex.policy, ex.exams)


@query(f"""WITH {MODEL_SQL}, k AS (SELECT root, parent, arg_min(n_blanks, ord) AS kid FROM questions WHERE parent IS NOT NULL AND type = 'multi_blank_choice' AND n_blanks > 0 GROUP BY root, parent),
m AS (SELECT q.*, kid, is_group AND kid IS NOT NULL AND number NOT LIKE '%.%' AS merge FROM questions q LEFT JOIN k ON k.root = q.root AND k.parent = q.question_id)
SELECT root, ord, CASE WHEN merge THEN 'multi_blank_choice' ELSE type END AS type, CASE WHEN merge THEN kid ELSE n_blanks END AS n_blanks, is_group AND NOT merge AS is_group FROM m WHERE NOT EXISTS (SELECT 1 FROM m p WHERE p.merge AND p.root = m.root AND p.question_id = m.parent)""")
def q_merged_blanks(spark: SparkSession, d: str) -> DataFrame:
    return recovery.merged_blanks(model(spark, d).questions).select("root", "ord", "type", F.size("blanks").cast("bigint").alias("n_blanks"), "is_group")


_JOBS = "CASE o_orderkey % 4 WHEN 0 THEN 'processing' WHEN 1 THEN 'queued' ELSE 'completed' END"


@query(f"""WITH j AS (SELECT o_orderkey AS job_id, {_JOBS} AS status, o_custkey % 3 = 0 AS queued, o_custkey % 2 = 0 AS there FROM orders) SELECT job_id, CASE WHEN there THEN 'queued' ELSE 'error' END AS status FROM j WHERE status = 'processing' AND NOT queued""")
def q_recovered_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "orders").selectExpr("o_orderkey AS job_id", f"{_JOBS} AS status", "o_custkey")
    return recovery.recovered_jobs(jobs, jobs.filter("o_custkey % 3 = 0"), jobs.filter("o_custkey % 2 = 0"))


@query("SELECT o_orderkey AS exam_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def q_golden_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Exams that have a criteria document."""
    criteria = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("exam_id"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("exam_id")).join(criteria, "exam_id", "left_semi")


@query(f"""WITH {MODEL_SQL} SELECT root, ord, row_number() OVER (PARTITION BY root ORDER BY CASE group_id WHEN 'grupo_i' THEN 1 WHEN 'grupo_ii' THEN 2 WHEN 'grupo_iii' THEN 3 ELSE 99 END, CAST(split_part(number, '.', 1) AS INT), coalesce(source_page, 999), ord) AS pos FROM questions""")
def q_group_order(spark: SparkSession, d: str) -> DataFrame:
    q = model(spark, d).questions
    return q.select("root", "ord", F.row_number().over(Window.partitionBy("root").orderBy(*recovery.group_order())).cast("bigint").alias("pos"))


@query(f"""WITH {MODEL_SQL} SELECT e.root, subject, year, count(q.root) AS questions, CAST(coalesce(sum(points), 0) AS BIGINT) AS points, coalesce(string_agg(question_id, ',' ORDER BY ord), '') AS ids FROM exams e LEFT JOIN questions q ON q.root = e.root GROUP BY e.root, subject, year""")
def q_exam_documents(spark: SparkSession, d: str) -> DataFrame:
    """Exams written as JSON documents and read again."""
    folder = f"{shared_dir(spark)}/exams-{uuid.uuid4().hex}"
    recovery.write_exams(model(spark, d), folder)
    q = F.coalesce("questions", F.array().cast(recovery.read_exams(spark, folder).schema["questions"].dataType))
    return recovery.read_exams(spark, folder).withColumn("q", q).select("root", "subject", "year", F.size("q").cast("bigint").alias("questions"), F.aggregate(F.transform("q", lambda x: F.coalesce(x["points"], F.lit(0))), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("points"), F.array_join(F.transform("q", lambda x: x["question_id"]), ",").alias("ids"))


@query(f"WITH i AS ({GENERIC_SQL}) SELECT root, code, severity, number, count(*) AS n FROM i GROUP BY ALL")
def q_issue_report(spark: SparkSession, d: str) -> DataFrame:
    """Issues of the generic audit written as a report and read again."""
    folder = f"{shared_dir(spark)}/issues-{uuid.uuid4().hex}"
    ex = model(spark, d)
    recovery.write_issues(rules.generic(ex), ex.exams, folder)
    found = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/issues")
    return found.groupBy("root", "code", "severity", F.coalesce("number", F.lit("")).alias("number")).agg(F.count("*").alias("n"))


@query(f"""WITH i AS ({GENERIC_SQL}), n AS (SELECT root, count(*) FILTER (severity = 'BLOCKER') AS blocker, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'INFO') AS info FROM i WHERE CAST(root AS BIGINT) % 4 <> 0 GROUP BY root)
SELECT CAST(o_orderkey AS VARCHAR) AS root, coalesce(blocker, 0) AS blocker, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(info, 0) AS info, CASE WHEN blocker > 0 THEN 'FAIL' WHEN high + medium > 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM orders LEFT JOIN n ON n.root = CAST(o_orderkey AS VARCHAR)""")
def q_issue_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary of a written report, read again; every fourth exam has no issue."""
    folder, ex = f"{shared_dir(spark)}/issues-{uuid.uuid4().hex}", model(spark, d)
    recovery.write_issues(rules.generic(ex).filter("CAST(root AS BIGINT) % 4 <> 0"), ex.exams, folder)
    return spark.read.option("header", True).schema("root string, blocker long, high long, medium long, info long, verdict string").csv(f"{folder}/summary")


#: Bundles of orders: every 13th has no document, every 17th one that is no JSON, every 19th is no zip.
_BUNDLED = "CASE WHEN o_orderkey % 19 = 0 THEN 'broken zip' WHEN o_orderkey % 13 = 0 THEN 'exam.json not found' WHEN o_orderkey % 17 = 0 THEN 'broken JSON' END"


def _bundles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = numbered(spark, d).groupBy("root").agg(F.array_sort(F.collect_list(F.struct(F.expr("CASE WHEN ord % 4 = 0 THEN 'notes/n' || CAST(ord AS STRING) || '.txt' WHEN ord % 2 = 0 THEN 'x/assets/f' || CAST(ord AS STRING) || '.PNG' ELSE 'assets/f' || CAST(ord AS STRING) || '.jpg' END").alias("rel"), F.expr("'part ' || CAST(l_partkey AS STRING)").alias("text")))).alias("files"))
    orders = rooted(spark, d).withColumn("error", F.expr(_BUNDLED))
    document = F.when(F.col("error") == "broken JSON", "{no").when(F.col("error").isNull(), F.to_json(F.struct("o_orderkey", "o_orderstatus")))
    made = bundles.zipped(orders.join(files, "root", "left").select("root", document.alias("document"), "files"))
    return bundles.bundles(made.withColumn("content", F.when(F.regexp_extract("path", r"(\d+)", 1).cast("long") % 19 == 0, F.lit(b"no zip")).otherwise(F.col("content"))))


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS root, CASE WHEN {_BUNDLED} IS NULL THEN o_orderkey END AS exam, {_BUNDLED} AS error FROM orders""")
def q_bundle_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of zipped bundles, and what is wrong with those that can't be read."""
    return _bundles(spark, d)[0].select("root", F.get_json_object("document", "$.o_orderkey").cast("long").alias("exam"), "error")


@query(f"""WITH {MODEL_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS root, 'assets/f' || CAST(ord AS VARCHAR) || CASE WHEN ord % 2 = 0 THEN '.PNG' ELSE '.jpg' END AS rel, CAST(length('part ' || CAST(l_partkey AS VARCHAR)) AS BIGINT) AS size, sha256('part ' || CAST(l_partkey AS VARCHAR)) AS digest FROM li WHERE ord % 4 <> 0 AND l_orderkey % 13 <> 0 AND l_orderkey % 19 <> 0""")
def q_bundle_files(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of zipped bundles with their sizes and digests."""
    return _bundles(spark, d)[1]


@query(f"""WITH {MODEL_SQL}, w AS (SELECT root, ord, {", ".join(f"{e} AS {n}" for n, e in _WARNING.items())}, coalesce(points, 0) % 6 AS low FROM questions),
k AS (SELECT *, coalesce(severity = 'info', false) OR type IN ('history_points_repaired', 'text_fallback_used') OR (type = 'suspicious_points' AND (low >= 3 OR bool_or(type = 'grupo_ii_points_rescaled') OVER (PARTITION BY root))) AS info FROM w),
l AS (SELECT root, string_agg('[' || upper(coalesce(severity, 'low')) || '] ' || type || ' — ' || message, chr(10) ORDER BY ord) FILTER (NOT info) AS real, count(*) FILTER (NOT info) AS n, string_agg('[INFO] ' || type || ' — ' || message, chr(10) ORDER BY ord) FILTER (info) AS told, count(*) FILTER (info) AS m FROM k GROUP BY root)
SELECT root, '=== Avisos da extração (' || n || ') ===' || chr(10) || coalesce(real, 'Sem avisos reais — extração limpa.') || CASE WHEN m > 0 THEN chr(10) || '=== Reparações automáticas do pipeline (' || m || ') ===' || chr(10) || told ELSE '' END AS report FROM l""")
def q_warnings_report(spark: SparkSession, d: str) -> DataFrame:
    return recovery.warnings_report(model(spark, d).questions.selectExpr("root", "ord", *(f"{e} AS {n}" for n, e in _WARNING.items())))
