"""Grading criteria: their text as items, and items joined to questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import criteria_text, matching, scoring
from ..sources.exams import MODEL_SQL, model
from ..sources.tables import table
from .registry import query

#: Criteria documents as pages of lines; every exam has one of them, by its key.
DOCUMENTS = [
    ["""CRITÉRIOS ESPECÍFICOS DE CLASSIFICAÇÃO
GRUPO I
1. ........ 20 pontos
Devem ser abordados os tópicos seguintes:
− refere a ironia;
Aspetos de conteúdo
2. Versão 1: (D); Versão 2: (B) ........ 13 pontos
GRUPO II
Chave
ITENS
VERSÃO 1
VERSÃO 2
PONTUAÇÃO
1.
(C)
(B)
13
2.
(C)
(D)
13
GRUPO III
Estruturação temática e discursiva (ETD) 24 pontos
Correção linguística (CL) 16 pontos
TOTAL 200"""],
    ["""COTAÇÕES
GRUPO I
1. ........ 20 pontos
CRITÉRIOS ESPECÍFICOS DE CLASSIFICAÇÃO
GRUPO I
A.
1.1. ........ 5 pontos

Resposta   esperada.
1.2. ......
20 pontos
B. ........ 30 pontos""", """texto final
GRUPO II
1. Resposta correcta: C ........ 5 pontos
2. a 5. ........ 40 pontos
3. (B) ...... 6 pontos
4. Explique
7 pontos
GRUPO III
Correcção linguística 20 pontos
Estruturação temática e discursiva (ETD) 30 pontos
Cotação (em pontos)
(CL) 99 pontos"""],
    ["""CRITÉRIOS ESPECÍFICOS DE CLASSIFICAÇÃO
GRUPO II
ITENS
VERSÃO 1
PONTUAÇÃO
1.
(A)
5
2.
(Oração) subordinada
adverbial
8
3.
6 pontos
resposta livre
Níveis
2
1
4.
(C)
7
5. Explique o sentido. ........ 13 pontos
Versão 1 – B, C e E
Versão 2 – A, C e D
6. ........ 9 pontos
Versão 1 – a) 2; b) 3
Deve ser abordado o seguinte:
− primeiro tópico
continua aqui
– segundo tópico longo
- abc
Aspetos de forma
TOTAL 200
2 x 15 pontos
os 3 itens cuja pontuação"""],
]

#: Their items, traced by hand: document, group, number, points, type, answers, topics, confidence, lines, pages.
TRACED = [
    (0, "grupo_i", "1", 20, "open_answer", None, None, "refere a ironia;", 0.95, 4, "1"), (0, "grupo_i", "2", 13, "multiple_choice", "D", "B", "", 0.95, 1, "1"),
    (0, "grupo_ii", "1", 13, "multiple_choice", "C", "B", "", 0.97, 4, "1"), (0, "grupo_ii", "2", 13, "multiple_choice", "C", "D", "", 0.97, 4, "1"), (0, "grupo_iii", "1", 40, "essay", None, None, "", 0.9, 3, "1"),
    (1, "grupo_i", "1.1", 5, "open_answer", None, None, "", 0.95, 2, "1"), (1, "grupo_i", "1.2", 20, "open_answer", None, None, "", 0.95, 4, "1,2"),
    (1, "grupo_ii", "1", 5, "multiple_choice", "C", None, "", 0.95, 2, "2"), (1, "grupo_ii", "3", 6, "multiple_choice", "B", None, "", 0.95, 1, "2"), (1, "grupo_ii", "4", 7, "open_answer", None, None, "", 0.95, 2, "2"),
    (1, "grupo_iii", "1", 50, "essay", None, None, "", 0.9, 3, "2"),
    (2, "grupo_ii", "1", 5, "multiple_choice", "A", None, "", 0.97, 3, "1"), (2, "grupo_ii", "2", 8, "open_answer", "(Oração) subordinada adverbial", None, "", 0.9, 4, "1"), (2, "grupo_ii", "3", 6, "open_answer", "resposta livre", None, "", 0.9, 3, "1"),
    (2, "grupo_ii", "4", 7, "multiple_choice", "C", None, "", 0.97, 3, "1"), (2, "grupo_ii", "5", 13, "multi_select", "B, C e E", "A, C e D", "", 0.95, 3, "1"),
    (2, "grupo_ii", "6", 9, "multi_blank_choice", "a) 2; b) 3", None, "primeiro tópico continua aqui|segundo tópico longo", 0.95, 11, "1"),
]

_SHOWN = "group_id, number, points, type, v1, v2, topics, confidence, n_lines, pages"
_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else f"{v}::BIGINT" for v in row) + ")" for row in TRACED)
_TRACED_SQL = f"traced(k, {_SHOWN}) AS (VALUES {_VALUES}), parsed AS (SELECT CAST(o_orderkey AS VARCHAR) AS root, {_SHOWN} FROM orders JOIN traced ON o_orderkey % 3 = k)"


def criteria_documents(spark: SparkSession, d: str) -> DataFrame:
    """(root, pages) of every exam."""
    docs = F.array(*(F.array(*(F.struct(F.lit(i + 1).cast("bigint").alias("page"), F.lit(t).alias("text")) for i, t in enumerate(pages))) for pages in DOCUMENTS))
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("root"), docs[(F.col("o_orderkey") % len(DOCUMENTS)).cast("int")].alias("pages"))


def criteria_pages(spark: SparkSession, d: str) -> DataFrame:
    return criteria_documents(spark, d).select("root", F.inline("pages"))


@query(f"WITH {_TRACED_SQL} SELECT root, {_SHOWN} FROM parsed")
def q_criteria_parse(spark: SparkSession, d: str) -> DataFrame:
    """Items of every exam's criteria text; the SQL holds hand-traced values of its three documents."""
    found = criteria_text.parse_documents(criteria_documents(spark, d))
    return found.select("root", "group_id", "number", F.col("points").cast("bigint").alias("points"), "type", "v1", "v2", F.array_join("topics", "|").alias("topics"), "confidence", F.size(F.split("raw_text", "\n")).cast("bigint").alias("n_lines"), F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query(f"WITH {_TRACED_SQL} SELECT root, '1' AS version, group_id, number, v1 AS answer FROM parsed WHERE v1 IS NOT NULL UNION ALL SELECT root, '2', group_id, number, v2 FROM parsed WHERE v2 IS NOT NULL")
def q_answer_keys(spark: SparkSession, d: str) -> DataFrame:
    return criteria_text.answer_keys(criteria_text.parse_documents(criteria_documents(spark, d)))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS root, CAST(CASE o_orderkey % 3 WHEN 1 THEN NULL ELSE 200 END AS BIGINT) AS total, CAST(CASE o_orderkey % 3 WHEN 2 THEN 15 END AS BIGINT) AS per_item, CAST(CASE o_orderkey % 3 WHEN 2 THEN 2 END AS BIGINT) AS pool, CAST(CASE o_orderkey % 3 WHEN 2 THEN 3 END AS BIGINT) AS choose FROM orders""")
def q_criteria_totals(spark: SparkSession, d: str) -> DataFrame:
    """What each criteria text says of its total and its pool; the SQL holds hand-traced values."""
    found = criteria_text.cross_check(criteria_pages(spark, d))
    return found.select("root", *(F.col(c).cast("bigint").alias(c) for c in ("total", "per_item", "pool", "choose")))


#: Items get numbers that no question has where their place is odd; the questions of some exams are numbered with parts.
_ITEM_NO = "CASE WHEN ord % 2 = 0 THEN number ELSE CAST(ord + 20 AS STRING) END"
_QUESTION_NO = "CASE WHEN CAST(root AS BIGINT) % 3 = 0 THEN CAST(ord AS STRING) || '.' || CAST(ord % 2 AS STRING) ELSE number END"
_QUESTION_ID = "root || '-' || CAST(ord AS STRING)"
_MATCH = f"""{MODEL_SQL}, i AS (SELECT root, ord, group_id, group_id AS gid, {_ITEM_NO} AS no, points FROM criteria), q AS (SELECT root, ord, {_QUESTION_ID} AS question_id, coalesce(group_id, '') AS gid, {_QUESTION_NO} AS no, points FROM questions),
idx AS (SELECT root, gid, no, arg_max(question_id, ord) AS exact FROM q GROUP BY root, gid, no), one AS (SELECT i.*, exact FROM i LEFT JOIN idx USING (root, gid, no)),
fq AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.root = q.root AND exact = question_id)), fi AS (SELECT *, row_number() OVER (PARTITION BY root, gid, points ORDER BY ord) AS nth FROM one WHERE exact IS NULL),
single AS (SELECT root, gid, points, min(question_id) AS by_points FROM fq GROUP BY root, gid, points HAVING count(*) = 1),
two AS (SELECT fi.*, by_points FROM fi LEFT JOIN single s ON s.root = fi.root AND s.gid = fi.gid AND s.points IS NOT DISTINCT FROM fi.points AND nth = 1),
rq AS (SELECT * FROM fq WHERE question_id NOT IN (SELECT by_points FROM two WHERE by_points IS NOT NULL)), ri AS (SELECT * FROM two WHERE by_points IS NULL),
g AS (SELECT root, gid FROM (SELECT root, gid, count(*) AS n, bool_and(regexp_full_match(no, '\\d+')) AS flat FROM ri GROUP BY root, gid) a JOIN (SELECT root, gid, count(*) AS n, bool_and(regexp_full_match(no, '\\d+')) AS flat_q, bool_and(regexp_matches(no, '^\\d+\\.\\d+')) AS deci FROM rq GROUP BY root, gid) b USING (root, gid, n) WHERE flat AND (flat_q OR deci)),
place AS (SELECT a.root, a.ord, question_id AS by_place FROM (SELECT root, gid, ord, row_number() OVER (PARTITION BY root, gid ORDER BY CAST(no AS INT), ord) AS p FROM ri JOIN g USING (root, gid)) a JOIN (SELECT root, gid, question_id, row_number() OVER (PARTITION BY root, gid ORDER BY CAST(split_part(no, '.', 1) AS INT), coalesce(try_cast(split_part(no, '.', 2) AS INT), -1), ord) AS p FROM rq JOIN g USING (root, gid)) b USING (root, gid, p)),
matched AS (SELECT one.root, one.ord, one.group_id, one.no AS number, coalesce(exact, by_points, by_place) AS question_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN by_points IS NOT NULL THEN 'points' WHEN by_place IS NOT NULL THEN 'positional' END AS match, exact IS NULL AND by_points IS NULL AS needs_review
    FROM one LEFT JOIN (SELECT root, ord, by_points FROM two) t ON t.root = one.root AND t.ord = one.ord LEFT JOIN place p ON p.root = one.root AND p.ord = one.ord)"""


def _match(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ex = model(spark, d)
    items = ex.criteria.withColumn("number", F.expr(_ITEM_NO))
    return matching.match_criteria(items, ex.questions.withColumn("question_id", F.expr(_QUESTION_ID)).withColumn("number", F.expr(_QUESTION_NO)))


@query(f"WITH {_MATCH} SELECT * FROM matched")
def q_criteria_match(spark: SparkSession, d: str) -> DataFrame:
    return _match(spark, d)[0]


@query(f"WITH {_MATCH} SELECT root, question_id FROM q WHERE question_id NOT IN (SELECT question_id FROM matched WHERE question_id IS NOT NULL)")
def q_unmatched_questions(spark: SparkSession, d: str) -> DataFrame:
    return _match(spark, d)[1]


@query(f"""WITH {_MATCH} SELECT CAST(o_orderkey AS VARCHAR) AS root, coalesce(n, 0) AS questions, coalesce(hit, 0) AS matched, coalesce(n - hit, 0) AS unmatched FROM orders
LEFT JOIN (SELECT q.root, count(*) AS n, count(m.question_id) AS hit FROM q LEFT JOIN (SELECT DISTINCT question_id FROM matched) m USING (question_id) GROUP BY q.root) c ON c.root = CAST(o_orderkey AS VARCHAR)""")
def q_match_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many of an exam's questions have criteria and how many have none."""
    ex = model(spark, d)
    left = _match(spark, d)[1].groupBy("root").agg(F.count("*").alias("unmatched"))
    out = ex.exams.select("root").join(ex.questions.groupBy("root").agg(F.count("*").alias("questions")), "root", "left").join(left, "root", "left")
    n, u = F.coalesce("questions", F.lit(0)), F.coalesce("unmatched", F.lit(0))
    return out.select("root", n.alias("questions"), (n - u).alias("matched"), u.alias("unmatched"))


@query(f"""WITH {_MATCH} SELECT q.root, q.question_id, CASE WHEN m.question_id IS NOT NULL THEN 'matched' ELSE 'missing' END AS status, coalesce(m.items, 0) AS items FROM q LEFT JOIN (SELECT question_id, count(*) AS items FROM matched GROUP BY question_id) m USING (question_id)""")
def q_question_criteria(spark: SparkSession, d: str) -> DataFrame:
    """Every question with the number of criteria items that it has now."""
    matched, _ = _match(spark, d)
    n = matched.filter("question_id IS NOT NULL").groupBy("root", "question_id").agg(F.count("*").alias("items"))
    q = model(spark, d).questions.select("root", F.expr(_QUESTION_ID).alias("question_id")).join(n, ["root", "question_id"], "left")
    return q.select("root", "question_id", F.when(F.col("items").isNotNull(), "matched").otherwise("missing").alias("status"), F.coalesce("items", F.lit(0)).alias("items"))


def _null(value) -> str:
    return "NULL" if value is None else str(value)


#: Exams by key: questions (number, group, points), scoring entries (number, points, group), and the points they end with, traced by hand.
SCORED = [
    ([("1", "grupo_i", None), ("2", "grupo_i", 5), ("1", "grupo_ii", None)], [("1.", "10", "grupo_ii"), ("1", "7.0", ""), ("2", "9", "grupo_i")], [7, 9, 10]),
    ([("2.1", "", None), ("2", "", None)], [("2_1", "4", ""), ("02", "6", ""), ("2", "dez", "")], [4, 6]),
    ([("1", "", None), ("1", "", None)], [("1", "3", ""), ("1", "4", ""), ("1", "5", "")], [3, 4]),
    ([("1", "grupo_ii", None), ("3", "", 2)], [("1", "8", "GRUPO_I"), ("3", "9", ""), ("4", "1", "")], [8, 2]),
    ([("1", "", None)], [], [None]),
]


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS root, CAST(ord AS BIGINT) AS ord, CAST(points AS BIGINT) AS points FROM orders JOIN (VALUES {', '.join(f'({k}, {i}, {_null(p)})' for k, (*_, told) in enumerate(SCORED) for i, p in enumerate(told))}) v(k, ord, points) ON o_orderkey % {len(SCORED)} = k")
def q_scores_in_turn(spark: SparkSession, d: str) -> DataFrame:
    """Scoring entries dealt to questions in turn, by four strategies; the SQL holds values traced by hand."""

    def rows(which: int, names: list[str], kinds: list[str]) -> DataFrame:
        docs = F.array(*(F.array(*(F.struct(F.lit(i).alias("ord"), *(F.lit(v).cast(t).alias(n) for v, n, t in zip(row, names, kinds, strict=True))) for i, row in enumerate(case[which]))).cast(f"array<struct<ord:int,{','.join(f'{n}:{t}' for n, t in zip(names, kinds, strict=True))}>>") for case in SCORED))
        return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("root"), F.inline(docs[(F.col("o_orderkey") % len(SCORED)).cast("int")]))

    found = scoring.assign_scores(rows(0, ["number", "group_id", "points"], ["string", "string", "int"]), rows(1, ["number", "points", "group"], ["string", "string", "string"]))
    return found.select("root", F.col("ord").cast("bigint").alias("ord"), F.col("points").cast("bigint").alias("points"))
