"""Queries that repair and recover questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profiles as P
from ..operators import repair as R
from ..operators.recovery import MATH
from ..sources.exams import MODEL_SQL, _cases, _pick, _select, made, model, numbered
from ..sources.layout import LAYOUT_SQL, layout
from .registry import query

#: The marks of formulas, as DuckDB reads them.
R_MATH = MATH.replace("(?iu)", "(?i)")

#: Texts before and after; of each of these a row has one.
_TEXTS = {
    "root": "CAST(l_orderkey AS STRING)", "ord": "ord",
    "now": _cases(_pick(3, 1, 5, 5), ["O texto fala da evolu??o econ?mica do pa?s no s?culo passado.", "Sem perdas de letras nenhumas aqui.", "Que mudou? E porquê? Diga.", "a?b?c?d?", None]),
    "native": _cases(_pick(1, 5, 3, 6), ["O texto fala da evolução económica do país no século passado.", "Curto.", "Seis palavras longas aqui para quem leia isto, ????", "Trata de assuntos muito diferentes mas passa bem de quarenta letras.", None, "extraordinariamenteextraordinariamenteextraordinariamente"]),
}
_MARKS = "(length({0}) - length(replace({0}, '?', '')))"
_NWORDS = "greatest(1, len(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+')))"


def _told(columns: dict[str, str]) -> str:
    return f"told AS (SELECT {_select(columns)} FROM li)"


def _rows(spark: SparkSession, d: str, columns: dict[str, str]) -> DataFrame:
    return made(numbered(spark, d), columns)


@query(f"""WITH {MODEL_SQL}, {_told(_TEXTS)}, m AS (SELECT *, {_MARKS.format("now")} AS a, {_MARKS.format("native")} AS b, {_NWORDS.format("now")} AS v, {_NWORDS.format("native")} AS w FROM told WHERE now IS NOT NULL AND native IS NOT NULL)
SELECT root, ord, native AS statement, now AS statement_raw FROM m WHERE length(native) >= 40 AND b <= greatest(1, a // 2) AND a >= 2 AND w >= v * 0.45 AND (a >= v * 0.015 OR a >= 4)""")
def q_repaired_texts(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose lost letters the text layer has."""
    told = _rows(spark, d, _TEXTS)
    kind, none = F.lit("open_answer").alias("type"), F.array().cast("array<struct<letter:string,text:string>>").alias("options")
    number = F.col("ord").cast("string").alias("number")
    q, native = told.select("root", "ord", F.lit(1).alias("page"), number, kind, F.col("now").alias("statement")), told.select("root", F.lit(1).alias("page"), number, kind, F.col("native").alias("statement"), none)
    return R.repaired_texts(q, native).select("root", "ord", "statement", "statement_raw")


def _cell(p: int, q: int, r: int) -> str:
    return _cases(_pick(p, q, r, 6), ["1. um ", "2) dois ", "10 dez ", "sem número ", "", "1. mais um "]) + " || CAST(ord AS STRING)"


_CELLS = {"root": "CAST(l_orderkey AS STRING)", "ord": "ord", "c1": _cell(3, 1, 5), "c2": _cell(5, 3, 1), "c3": _cell(1, 5, 3), "line": _cases(_pick(7, 1, 2, 5), ["a)", "  b) ___", "1. opção ", "2) outra ", "texto corrido"]) + f" || CASE WHEN {_pick(7, 1, 2, 5)} IN (2, 3) THEN CAST(ord AS STRING) ELSE '' END"}
_HEADS = [["a)", "B) ", "x"], ["c)", "", "a)"], ["x", "y", "z"], ["b)", "b)", " d) "], ["x", "y", "z"]]
_HEAD_ROWS = ", ".join(f"({k}, {i}, '{h}')" for k, heads in enumerate(_HEADS) for i, h in enumerate(heads, 1))
_OPTION = "^\\s*(\\d{1,2})[.)]?\\s+(.+?)\\s*$"


@query(f"""WITH {MODEL_SQL}, {_told(_CELLS)},
heads AS (SELECT k, col, lower(regexp_extract(h, '(?i)^\\s*([a-f])\\)\\s*$', 1)) AS letter FROM (VALUES {_HEAD_ROWS}) v(k, col, h)),
tables AS (SELECT DISTINCT root, t, (CAST(root AS BIGINT) + t * (CAST(root AS BIGINT) % 2)) % {len(_HEADS)} AS k FROM told, (SELECT unnest([0, 1]) AS t)),
under AS (SELECT x.root, letter, t, ord, h.col, regexp_extract(cell, '{_OPTION}', 1) AS n, regexp_extract(cell, '{_OPTION}', 2) AS text FROM tables x JOIN heads h ON h.k = x.k AND letter <> '' JOIN (SELECT root, ord, unnest([1, 2, 3]) AS col, unnest([c1, c2, c3]) AS cell FROM told) c ON c.root = x.root AND c.ord % 2 = x.t AND c.col = h.col),
from_tables AS (SELECT DISTINCT root, letter FROM tables x JOIN heads h ON h.k = x.k AND letter <> ''),
lines AS (SELECT root, ord, line, last_value(nullif(lower(regexp_extract(line, '(?i)^\\s*([a-f])\\)\\s*_*\\s*$', 1)), '') IGNORE NULLS) OVER (PARTITION BY root ORDER BY ord ROWS UNBOUNDED PRECEDING) AS letter FROM told),
from_text AS (SELECT DISTINCT root, letter FROM lines WHERE letter IS NOT NULL AND root NOT IN (SELECT root FROM from_tables)),
options AS (SELECT root, letter, t, ord, col, n, text FROM under WHERE n <> '' UNION ALL SELECT root, letter, 0, ord, 0, regexp_extract(line, '{_OPTION}', 1) AS n, regexp_extract(line, '{_OPTION}', 2) FROM lines WHERE letter IS NOT NULL AND n <> '' AND root NOT IN (SELECT root FROM from_tables)),
firsts AS (SELECT root, letter, n, first(text ORDER BY t, ord, col) AS text FROM options GROUP BY root, letter, n),
blanks AS (SELECT root, letter FROM from_tables UNION ALL SELECT root, letter FROM from_text UNION ALL SELECT root, unnest(['a', 'b', 'c', 'd']) FROM (SELECT DISTINCT root FROM told WHERE root NOT IN (SELECT root FROM from_tables) AND root NOT IN (SELECT root FROM from_text)))
SELECT b.root, b.letter || ')' AS number, coalesce(string_agg(n || '=' || text, '|' ORDER BY CAST(n AS INT)), '') AS options, CAST(count(n) AS BIGINT) AS n FROM blanks b LEFT JOIN firsts f ON f.root = b.root AND f.letter = b.letter GROUP BY b.root, b.letter""")
def q_page_blanks(spark: SparkSession, d: str) -> DataFrame:
    """Blanks of exams from two tables each, or from lines, or empty ones."""
    cells = _rows(spark, d, _CELLS).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("ord", F.array("c1", "c2", "c3").alias("cells"), "line"))).alias("all"))
    heads = F.array(*(F.array(*map(F.lit, h)) for h in _HEADS))
    root = F.col("root").cast("bigint")

    def rows(t: int) -> Column:
        head = F.get(heads, ((root + t * (root % 2)) % len(_HEADS)).cast("int"))
        return F.concat(F.array(head), F.transform(F.filter("all", lambda x: x["ord"] % 2 == t), lambda x: x["cells"]))

    text = F.array_join(F.transform("all", lambda x: x["line"]), "\n")
    found = cells.select("root", F.explode(R.page_blanks(F.array(rows(0), rows(1)), text)).alias("b"))
    return found.select("root", "b.number", F.array_join(F.transform("b.options", lambda o: F.concat_ws("=", o["letter"], o["text"])), "|").alias("options"), F.size("b.options").cast("bigint").alias("n"))


_PROMPT = {
    "root": "CAST(l_orderkey AS STRING)", "ord": "ord",
    "text": _cases(_pick(3, 1, 5, 3), ["Leia o texto.", "Qual é a opção? ", ""]) + " || " + _cases(_pick(5, 3, 1, 4), [" (A) um (B) dois (C) três", " (a) um", "\nA. um\nB. dois", " a. um (e) dois x"]).replace("\n", "' || chr(10) || '") + " || " + _cases(_pick(1, 7, 3, 4), [" Indique a letra. Selecione outra.", "", " escreva na folha", " fim identifique"]),
}
_SPLIT = "(?:^|\\s)(?:[A-Ea-e]\\.|\\([A-Ea-e]\\))\\s+"


@query(f"""WITH {MODEL_SQL}, {_told(_PROMPT)}, cut AS (SELECT *, regexp_split_to_array(text, '{_SPLIT}') AS parts FROM told),
ends AS (SELECT *, regexp_replace(parts[1], '^\\s+|\\s+$', '', 'g') AS head, coalesce({", ".join(f"nullif(regexp_extract(parts[-1], '(?is)\\b{w}\\b.*$'), '')" for w in ("Identifique", "Selecione", "Escreva", "Indique"))}, '') AS tail FROM cut)
SELECT root, ord, CASE WHEN len(parts) < 3 THEN text ELSE array_to_string(list_filter([head, regexp_replace(tail, '^\\s+|\\s+$', '', 'g')], lambda x: x <> ''), chr(10)) END AS stripped FROM ends""")
def q_inline_options(spark: SparkSession, d: str) -> DataFrame:
    """Statements without the options that stand in them."""
    return _rows(spark, d, _PROMPT).select("root", "ord", R.without_inline_options(F.col("text")).alias("stripped"))


_TABLES = {
    "root": "CAST(l_orderkey AS STRING)", "pos": "ord", "asset_id": _cases(_pick(3, 1, 5, 4), ["Tabela_p", "tabela_p", "figura_p", "tabela_p"]) + f" || CAST(1 + {_pick(1, 3, 5, 3)} AS STRING) || " + _cases(_pick(5, 1, 3, 3), ["", "_12", "x"]),
    "type": _cases(_pick(7, 1, 3, 2), ["table", "photo"]), "page": f"1 + {_pick(5, 3, 1, 3)}", "cells": _cases(_pick(1, 7, 3, 4), ["a) um b) dois", "1. um 2. dois", "1) nada", "ano valor"]), "heads": _cases(_pick(3, 7, 1, 5), ["x", "x c)", "y", "z", "ano"]),
    "ref": f"'tabela_p' || CAST(1 + {_pick(7, 5, 1, 3)} AS STRING) || " + _cases(_pick(1, 1, 3, 3), ["", "_12", "x"]), "text": _cases(_pick(5, 7, 1, 4), ["Complete o texto", "Diga porquê", "Em cada espaço", "Comente"]), "qpage": f"1 + {_pick(3, 5, 7, 3)}",
}


@query(f"""WITH {MODEL_SQL}, {_told(_TABLES)}, ids AS (SELECT *, lower(asset_id) AS low, regexp_extract(lower(asset_id), '^(tabela_p\\d+)', 1) AS prefix, (contains(lower(asset_id), 'tabela') OR type = 'table') AND ((contains(cells, 'a)') AND contains(cells, 'b)')) OR (contains(cells, '1.') AND contains(cells, '2.')) OR regexp_matches(heads, '[abc]\\)')) AS own FROM told),
tables AS (SELECT * FROM ids i WHERE own OR EXISTS (SELECT 1 FROM ids p WHERE p.root = i.root AND p.own AND p.prefix <> '' AND (i.low = p.prefix OR starts_with(i.low, p.prefix || '_')))),
asked AS (SELECT root, pos AS ord, qpage AS page, regexp_matches(lower(text), 'complete o texto|cada espaço') AS blanks, ref FROM told)
SELECT DISTINCT root, ord, asset_id FROM (SELECT root, ord, ref AS asset_id FROM asked a WHERE blanks OR NOT EXISTS (SELECT 1 FROM tables t WHERE t.root = a.root AND t.asset_id = a.ref)
UNION ALL SELECT t.root, o.ord, t.asset_id FROM tables t JOIN (SELECT root, page, min(ord) AS ord FROM asked WHERE blanks GROUP BY root, page) o ON o.root = t.root AND o.page = t.page)""")
def q_owned_tables(spark: SparkSession, d: str) -> DataFrame:
    """References once tables of options and their clones stand only where blanks are."""
    told = _rows(spark, d, _TABLES)
    assets = told.withColumn("rows", F.split("cells", " ")).withColumn("columns", F.split("heads", " "))
    return R.owned_tables(told.select("root", F.col("pos").alias("ord"), F.col("qpage").alias("page"), "text"), assets, told.select("root", F.col("pos").alias("ord"), F.col("ref").alias("asset_id")))


#: Pages with questions under their heading, made of a page's columns.
_ASKED = "text || chr(10) || CASE page % 4 WHEN 0 THEN '  ' || CAST(1 + page % 3 AS STRING) || '. Explique por palavras suas o que sucede no texto.' || chr(10) || '(A) um (B) dois (C) três' || chr(10) || '3. Curta' WHEN 1 THEN CAST(page AS STRING) || '.1. Diga de que modo o autor apresenta o tema da obra.' || chr(10) || 'COTAÇÕES' || chr(10) || '2. 20 pontos' WHEN 2 THEN chr(10) || 'B' || chr(10) || 'Redija um texto sobre a obra que estudou.' || chr(10) || 'Observações' ELSE '4. .... 10 pontos' || chr(10) || '7. Refira o sentido do título e comente o final do poema.' END"
_PAGES = f"asked_pages AS (SELECT root, page, {_ASKED} AS text FROM pages)"
_LONG = "long AS (SELECT root, first(block ORDER BY page) AS block FROM (SELECT root, page, trim(regexp_replace(regexp_extract(text, '(?ims)^\\s*B\\s*$\\s*(.+?)^\\s*(?:Observa|GRUPO\\s+II\\b|COTA|FIM\\b)', 1), '\\s+', ' ', 'g')) AS block FROM asked_pages WHERE regexp_matches(text, '(?i)\\bGRUPO\\s+I\\b') OR contains(text, chr(10) || 'B' || chr(10))) WHERE block <> '' GROUP BY root)"
_STARTS = "starts AS (SELECT root, number, min(page) AS page FROM (SELECT root, page, unnest(regexp_extract_all(text, '(?m)^\\s*(\\S+)\\.\\s+', 1)) AS number FROM asked_pages) GROUP BY root, number)"


def _asked_pages(spark: SparkSession, d: str) -> DataFrame:
    return layout(spark, d).pages.selectExpr("root", "page", f"{_ASKED} AS text")


@query(f"""WITH {MODEL_SQL}, {LAYOUT_SQL}, {_PAGES}, {_LONG}, {_STARTS},
lost AS (SELECT DISTINCT ON (root, group_id, number) root, group_id, number, points FROM policy p WHERE points IS NOT NULL AND NOT EXISTS (SELECT 1 FROM questions q WHERE q.root = p.root AND coalesce(q.group_id, '') = p.group_id AND q.number = p.number) ORDER BY root, group_id, number, points),
met AS (SELECT l.*, s.page, text, block, regexp_extract(text, '(?m)^\\s*' || l.number || '\\.\\s+') AS begun, CAST(CAST(split_part(l.number, '.', 1) AS INT) + 1 AS VARCHAR) AS next_no FROM lost l LEFT JOIN starts s ON s.root = l.root AND s.number = l.number LEFT JOIN asked_pages p ON p.root = s.root AND p.page = s.page LEFT JOIN long ON long.root = l.root),
cut AS (SELECT *, CASE WHEN begun <> '' THEN regexp_replace(begun || regexp_split_to_array(substr(text, instr(text, begun) + length(begun)), '(?im)^\\s*(?:' || next_no || '\\.|GRUPO\\s+[IVX]+\\b|COTA|FIM\\b)')[1], '^\\s+|\\s+$', '', 'g') END AS plain FROM met),
told AS (SELECT *, CASE WHEN group_id = 'grupo_i' AND number = '5' THEN coalesce(block, plain) ELSE plain END AS statement FROM cut)
SELECT root, group_id, number, points, page, CASE WHEN len(regexp_extract_all(statement, '(?:^|\\s)\\([A-Da-d]\\)')) >= 3 THEN 'multiple_choice' ELSE 'open_answer' END AS type, statement, CASE WHEN page IS NULL THEN 0.6 ELSE 0.78 END::DOUBLE AS confidence, page IS NULL AS review FROM told
WHERE length(statement) >= 20 AND length(regexp_replace(regexp_replace(statement, '(?i)\\bpontos?\\b', '', 'g'), '[^A-Za-zÀ-ÿ]', '', 'g')) >= 15""")
def q_recovered_from_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Questions that only the scoring has, with the text that pages hold for them."""
    ex = model(spark, d)
    entries = ex.policy.filter("points IS NOT NULL").groupBy("root", "group_id", "number").agg(F.min("points").alias("points"))
    return R.recovered_from_scoring(entries, ex.questions, _asked_pages(spark, d)).drop("options")


_POINTS = "CASE WHEN group_id = 'grupo_i' THEN 35 WHEN ord = 3 THEN 100 ELSE 0 END"


@query(f"""WITH {MODEL_SQL}, {LAYOUT_SQL}, {_PAGES}, {_LONG}, {_STARTS}, scored AS (SELECT root, group_id, number, {_POINTS} AS points FROM questions),
sums AS (SELECT root FROM scored GROUP BY root HAVING sum(points) = 170 AND sum(points) FILTER (group_id = 'grupo_i') = 70 AND count(*) FILTER (group_id = 'grupo_i' AND upper(number) IN ('B', '5')) = 0)
SELECT root, '5' AS number, 30::BIGINT AS points, (SELECT first(page ORDER BY number DESC) FROM starts s WHERE s.root = sums.root AND number IN ('B', '5')) AS page, coalesce(block, '{R.NO_TEXT_OF_B}') AS statement, CASE WHEN block IS NULL THEN 0.5 ELSE 0.7 END::DOUBLE AS confidence, block IS NULL AS review
FROM sums JOIN exams USING (root) LEFT JOIN long USING (root) WHERE year BETWEEN {R.OLD_YEARS[0]} AND {R.OLD_YEARS[1]}""")
def q_missing_item(spark: SparkSession, d: str) -> DataFrame:
    """Item B of first groups whose points prove that it was lost."""
    ex = model(spark, d)
    return R.missing_item(ex.exams, ex.questions.selectExpr("root", "group_id", "number", f"{_POINTS} AS points"), _asked_pages(spark, d))


#: Lines of exams' texts, one for each lineitem row.
_AXIS = _cases(_pick(3, 7, 1, 9), ["a", "12", "abc", "x", "Figura 3", "um texto corrido", "abcdef", "", "-1"])


@query()
def q_axis_lines(spark: SparkSession, d: str) -> DataFrame:
    """Texts of lines of ten exams each, without stretches of short ones; tests/test_sources.py holds the operator against a plain version."""
    lines = numbered(spark, d).selectExpr("CAST(l_orderkey DIV 10 AS STRING) AS root", "l_orderkey", "ord", f"{_AXIS} AS line")
    texts = lines.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "ord", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return R.without_axis_lines(texts, ["root"])


#: Families of questions: a group (k = 0) and two parts of it for each lineitem row.
_FAMILY = {
    "root": "CAST(l_orderkey AS STRING)", "ord": "ord * 3 + k", "question_id": "'q' || CAST(ord AS STRING) || '_' || CAST(k AS STRING)", "parent": "CASE WHEN k > 0 THEN 'q' || CAST(ord AS STRING) || '_0' END", "number": "CAST(ord AS STRING) || CASE WHEN k > 0 THEN '.' || CAST(k AS STRING) ELSE '' END", "is_group": "k = 0",
    "statement": _cases(_pick(1, 3, 7, 4), ["Considere a figura seguinte, que mostra um mapa. ", "Curto ", "Um texto longo que não diz nada de novo ", ""]) + " || CASE WHEN l_partkey % 5 = 0 THEN '1' ELSE '' END || CAST(ord AS STRING) || " + _cases("l_partkey % 3", [".1. Diga porquê.", ".2. Diga porquê.", ".1 diga"]),
}


@query(f"""WITH {MODEL_SQL}, family AS (SELECT {_select(_FAMILY)} FROM li, (SELECT unnest([0, 1, 2]) AS k)), met AS (SELECT root, ord, statement, regexp_extract(' ' || statement, '^(.*?[^\\p{{L}}\\p{{N}}_])' || number || '\\.1\\.?\\s', 1) AS before FROM family WHERE is_group)
SELECT root, ord, trim(before) AS statement FROM met WHERE length(before) > 21 AND length(trim(before)) >= 20""")
def q_trimmed_parents(spark: SparkSession, d: str) -> DataFrame:
    """Statements of groups up to their first part."""
    return R.trimmed_parents(made(numbered(spark, d).withColumn("k", F.explode(F.array(*map(F.lit, range(3))))), _FAMILY))


#: Numbers instead of a question's own, and what comes after its statement.
_OVER = {
    "root": "CAST(l_orderkey AS STRING)", "ord": "ord", "own_number": f"CASE {_pick(3, 5, 9, 8)} WHEN 0 THEN 'II' WHEN 1 THEN '95' END",
    "own_text": _cases(_pick(9, 5, 3, 4), ["", " x = 2", "\nFIM\n10", " texto"]).replace("\n", "' || chr(10) || '"),
}


@query(f"""WITH {MODEL_SQL}, over AS (SELECT {_select(_OVER)} FROM li), e AS (SELECT root, CASE WHEN contains(lower(subject), 'matem') THEN 'm' WHEN contains(lower(subject), 'hist') THEN 'h' ELSE 'p' END AS profile FROM exams),
q AS (SELECT q.root, q.ord, coalesce(own_number, number) AS number, group_id, parent, type, n_options, math_heavy, statement || own_text AS s0, profile FROM questions q JOIN over o ON o.root = q.root AND o.ord = q.ord JOIN e ON e.root = q.root),
a AS (SELECT *, CASE WHEN contains(s0, chr(10) || 'FIM') THEN trim(split_part(s0, chr(10) || 'FIM', 1)) ELSE s0 END AS s1, number = 'II' AND parent IS NULL AS no_question FROM q),
b AS (SELECT *, profile = 'm' AND NOT math_heavy AND NOT no_question AND regexp_matches(s1, '{R_MATH}') AS formulas, profile = 'h' AND NOT no_question AND number = '95' AND coalesce(group_id, '') <> '' AS line, regexp_split_to_array(s1, '{_SPLIT}') AS parts FROM a),
c AS (SELECT *, CASE WHEN profile = 'p' AND NOT no_question AND type IN ('multiple_choice', 'multi_select') AND n_options > 0 AND len(parts) >= 3 THEN trim(parts[1]) ELSE s1 END AS s2 FROM b)
SELECT root, ord, s2 AS statement, math_heavy OR formulas AS math_heavy, no_question OR line AS gone, array_to_string(list_filter([CASE WHEN s1 <> s0 THEN 'scoring_tail' END, CASE WHEN no_question THEN 'no_question' END, CASE WHEN formulas THEN 'formulas' END, CASE WHEN line THEN 'line_numbers' END, CASE WHEN s2 <> s1 THEN 'inline_options' END], lambda x: x IS NOT NULL), ',') AS steps FROM c WHERE NOT (no_question OR line)""")
def q_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Questions after the steps of their subject's profile, with the steps that changed them."""
    ex = model(spark, d)
    over = _rows(spark, d, _OVER)
    read = ex.questions.select("root", "ord", "number", "group_id", "parent", "type", "statement", "options", "math_heavy")
    q = read.join(over, ["root", "ord"]).withColumn("number", F.coalesce("own_number", "number")).withColumn("statement", F.concat("statement", "own_text")).drop("own_number", "own_text")
    return P.normalised(q, ex.exams).select("root", "ord", "statement", "math_heavy", F.lit(False).alias("gone"), F.array_join("steps", ",").alias("steps"))
