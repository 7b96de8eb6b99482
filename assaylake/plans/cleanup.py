"""Clean-ups over the exam model, and text functions over texts whose results were traced by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exam_text as T
from ..operators import cleanup, rules
from ..sources.exams import MODEL_SQL, model
from .registry import query
from .rules import HISTORY_SQL


def _quoted(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def traced(name: str, what: str, cases: list[tuple], found: Callable[..., Column]) -> None:
    """A query of the function over every question, each with one of the texts; the SQL holds the values traced by hand.

    A case: the function's arguments (strings or null), then the result as a string or null.
    """
    n = len(cases)
    place = f"(ord + CAST(root AS BIGINT)) % {n}"
    values = ", ".join(f"({i}, {_quoted(c[-1])})" for i, c in enumerate(cases))

    def run(spark: SparkSession, d: str) -> DataFrame:
        at = F.array(*(F.struct(*(F.lit(v).cast("string").alias(f"a{j}") for j, v in enumerate(c[:-1]))) for c in cases))[F.expr(place).cast("int")]
        q = model(spark, d).questions.select("root", "ord", at.alias("c"))
        q = q.select("root", "ord", *(F.col(f"c.a{j}").alias(f"a{j}") for j in range(len(cases[0]) - 1)))
        return q.select("root", "ord", found(*(F.col(f"a{j}") for j in range(len(cases[0]) - 1))).cast("string").alias("found"))

    run.__name__, run.__doc__ = name, what
    query(f"WITH {MODEL_SQL}, t(k, found) AS (VALUES {values}) SELECT root, ord, found FROM questions JOIN t ON {place} = k")(run)


def _shown(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat_ws("=", x["letter"], x["text"])), "|")


traced("q_choice_options", "Options (A) to (D) of a text.", [
    ("Qual?\n(A) um\n(B) dois  três\n(C) quatro", "A=um|B=dois três|C=quatro"), ("(a) um (b) dois (A) outro", "A=um|B=dois"), ("A - um\nB – dois", "A=um|B=dois"), ("(A) só uma", ""), ("nada", ""), ("(A) x\nB - y", ""),
], lambda t: _shown(T.choice_options(t)))
traced("q_letter_options", "Options a) to e) of a text.", [
    ("Ordene:\na) um facto\nb) outro  facto.\nc) mais\nd) fim", "A=um facto.|B=outro facto.|C=mais.|D=fim."), ("(c) três\n(a) um\n(b) dois\n(d) quatro\n2. outra", "A=um.|B=dois.|C=três.|D=quatro."), ("a) um\nb) dois", ""), ("", ""),
], lambda t: _shown(T.letter_options(t)))
traced("q_roman_options", "Statements I. to V. of a text.", [
    ("Leia:\nI. primeira\nII. segunda\nIII. terceira\nIV. quarta\nIdentifique as duas", "I=primeira.|II=segunda.|III=terceira.|IV=quarta."), ("II. b\nI. a\nIV. d\nIII. c", "I=a.|II=b.|III=c.|IV=d."), ("I. a\nII. b", ""), ("x", ""),
], lambda t: _shown(T.roman_options(t)))
traced("q_matching_columns", "Both columns of a matching question.", [
    ("COLUNA I (a) rei (b) papa COLUNA II (1) Roma (2) Lisboa", "a=rei|b=papa COLUNA II/1=Roma|2=Lisboa"), ("coluna I\n(a) um\ncoluna II\n(1) x\n(2) y", "a=um/1=x|2=y"), ("COLUNA I (a) um", None), ("COLUNA I e COLUNA II", None),
], lambda t: F.when(T.matching_columns(t).isNotNull(), F.concat(_shown(T.matching_columns(t)["left"]), F.lit("/"), _shown(T.matching_columns(t)["right"]))))
traced("q_ordering_items", "What a text asks to put in order.", [
    ("Ordene as imagens A, B, C e D.", "A=Imagem A|B=Imagem B|C=Imagem C|D=Imagem D"), ("as imagens C e as imagens A", "A=Imagem A|C=Imagem C"), ("a imagem C e a imagem A", ""), ("Ordene:\na) um\nb) dois\nc) três\nd) quatro", "A=um.|B=dois.|C=três.|D=quatro."), ("imagem A", ""),
], lambda t: _shown(T.ordering_items(t)))
traced("q_blank_markers", "Markers of blanks, and whether a text is of that type.", [
    ("Complete o texto seguinte com a opção adequada para cada espaço: a) ___ b) ___", "a),b):true"), ("A) um e c) dois", "a),c):false"), ("Complete o texto seguinte", ":false"), ("xa) b)", "b):false"),
], lambda t: F.concat(F.array_join(T.blank_markers(t), ","), F.lit(":"), T.is_multi_blank(t).cast("string")))
traced("q_numbered_options", "Options that stand in one cell.", [
    ("1. czar Nicolau II 2. iImperador Francisco José 3. kaiser", "1=czar Nicolau II|2=imperador Francisco José|3=kaiser"), ("1. um ; 2.  dois.", "1=um|2=dois"), ("", ""), ("sem números", ""), ("1. Imperador\t2. x", "1=imperador|2=x"),
], lambda t: _shown(T.numbered_options(t)))
traced("q_question_type", "Type of a recovered question.", [
    ("Complete o texto.", "multi_blank_choice"), ("(A) um (D) dois", "multiple_choice"), ("Calcule o valor.", "calculation"), ("Comente.", "open_answer"), ("Responda, selecionando a opção", "multi_blank_choice"), ("DETERMINE x", "calculation"),
], T.question_type)
traced("q_max_selections", "How many options a text asks for, of so many.", [
    ("Selecione as duas opções", "5", "2"), ("Indique três letras", "5", "3"), ("Escolha 4 afirmações", "5", "4"), ("Quais são verdadeiras?", "6", "3"), ("Quais são verdadeiras?", "3", None), ("Quais?", "5", None), ("quatro ou dois", "9", "2"), ("V ou F", "5", "2"),
], lambda t, n: T.max_selections(t, n.cast("int")))
traced("q_without_scoring", "A text without its scoring tail.", [
    ("1. Diga.\nFIM\nCOTAÇÕES\n10", "1. Diga."), ("1. Diga.\n  Cotações do grupo\n", "1. Diga."), ("1. FIM do texto ", "1. FIM do texto "), ("COTACOES 3", ""), ("a\nFIM\n", "a"),
], T.without_scoring)
traced("q_drop_reasons", "Why a row is no question.", [
    ("IV", "grupo_i", None, "Texto normal", "roman"), ("IV", "grupo_i", "q1", "Texto normal", ""), ("2", "", None, "Cotação e subtotal", "scoring"), ("95", "grupo_ii", None, "linha", "line_number"), ("95", None, None, "linha", ""), ("1", "grupo_i", None, "Leia, atentamente, o texto a seguir.", "instruction"),
    ("1", "grupo_i", None, "Leia o", ""), ("3", "grupo_i", None, "1. ........ 10 pontos 2. ....... 5 pontos", "scoring_lines"), ("x", None, None, None, "roman"), ("1", "g", None, "Observações:", "instruction"),
], lambda n, g, p, t: F.array_join(T.drop_reasons(n, g, p, t), ","))
traced("q_minimum_words", "The least number of words that a text asks for.", [
    ("um mínimo de 180 palavras", "180"), ("um mínimo de duzentas palavras", "200"), ("um Mínimo de cento e oitenta", "100"), ("mínimo de muitas", None), ("sem limite", None),
], T.minimum_words)
traced("q_pool_formula", "The pool that a scoring page states.", [
    ("contam 4 × 13 pontos", "4/13"), ("2x 15 pontos", "2/15"), ("2 vezes 15 pontos", None), ("10 pontos", None),
], lambda t: F.concat(T.optional_pool(t)["choose"].cast("string"), F.lit("/"), T.optional_pool(t)["points_each"].cast("string")))
traced("q_mandatory_mark", "Whether a number is marked as mandatory.", [
    ("3", "✱ 3. Diga", "true"), ("3", "*3 x", "true"), ("3", "33. Diga", "false"), ("2.1", "❋2.1. Diga", "true"), ("2.1", "*231. Diga", "false"), ("3", None, "false"),
], T.is_marked)
traced("q_without_controls", "A text without control characters.", [("a\u0007b", "ab"), ("[45::47;5u x", "[45::47;5u x"), ("x[12;5uy", "xy"), ("\ufeffz", "z"), (None, None)], T.without_controls)
traced("q_without_latex_tables", "LaTeX without tables.", [
    ("a \\begin{tabular}{c} 1 \\end{tabular} b", "a  b"), ("\\begin{center}\nx\n\\end{center}\ny", "y"), ("\\begin{center} open", "\\begin{center} open"), ("", ""),
], T.without_tables)
traced("q_points_of", "Points of a text.", [("7.9", "7"), ("10", "10"), ("dez", None), (None, None), ("-0.5", "0"), ("1e2", "100")], T.points_of)
traced("q_tidy_option", "A blank's option without stray marks.", [(" um  dois. ", "um dois"), ("a\u0007b;", "ab"), ("IImperador Carlos", "imperador Carlos"), ("Imperador", "imperador"), ("", "")], T.clean_blank_option)

_Q = f"q AS (SELECT *, coalesce(statement, '') || ' ' || coalesce(raw_text, '') AS t FROM questions)"
_TABLES = "regexp_matches(lower(t), 'tabela|medições|medidas|apresentam-se|coluna\\s+i')"


@query(f"""WITH {MODEL_SQL}, {_Q} SELECT root, ord, CASE WHEN table_ref IS NOT NULL AND {_TABLES} THEN table_ref ELSE '' END AS table_refs, CASE WHEN asset_ref IS NULL OR (table_ref IS NOT NULL AND NOT {_TABLES} AND asset_ref LIKE '%tabela%') THEN '' ELSE asset_ref END AS asset_refs FROM q""")
def q_phantom_tables(spark: SparkSession, d: str) -> DataFrame:
    q = cleanup.without_phantom_tables(model(spark, d).questions)
    return q.select("root", "ord", *(F.array_join(c, ",").alias(c) for c in ("table_refs", "asset_refs")))


@query(f"""WITH {MODEL_SQL}, k AS (SELECT *, source_ref IS NOT NULL AND (group_id IS NULL OR starts_with(source_ref, group_id || '_')) AS keep FROM questions) SELECT root, ord, CASE WHEN keep THEN source_ref ELSE '' END AS source_refs, source_ref IS NOT NULL AND NOT keep AS stripped FROM k""")
def q_cross_group_refs(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.own_group_refs(model(spark, d).questions).select("root", "ord", F.array_join("source_refs.source_id", ",").alias("source_refs"), "stripped")


_BAD = "bad AS (SELECT DISTINCT root, source_id FROM sources WHERE page_start = 1 AND group_id IN ('grupo_i', 'grupo_ii', 'grupo_iii'))"


@query(f"""WITH {MODEL_SQL}, {_BAD} SELECT q.root, ord, CASE WHEN source_ref IS NULL OR b.root IS NOT NULL THEN '' ELSE source_ref END AS source_refs FROM questions q LEFT JOIN bad b ON b.root = q.root AND b.source_id = source_ref""")
def q_cover_source_refs(spark: SparkSession, d: str) -> DataFrame:
    ex = model(spark, d)
    return cleanup.without_cover_sources(ex.questions, ex.sources)[0].select("root", "ord", F.array_join("source_refs.source_id", ",").alias("source_refs"))


@query(f"""WITH {MODEL_SQL}, {_BAD} SELECT root, ord, source_id FROM sources s WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.root = s.root AND b.source_id = s.source_id)""")
def q_cover_sources(spark: SparkSession, d: str) -> DataFrame:
    ex = model(spark, d)
    return cleanup.without_cover_sources(ex.questions, ex.sources)[1].select("root", "ord", "source_id")


@query(f"""WITH {MODEL_SQL}, r AS (SELECT root, image_ref AS ref FROM questions UNION SELECT root, table_ref FROM questions UNION SELECT root, asset_ref FROM questions) SELECT root, ord, asset_id FROM assets a WHERE NOT (starts_with(asset_id, 'tabela_') AND n_rows = 0 AND n_columns = 0) OR EXISTS (SELECT 1 FROM r WHERE r.root = a.root AND ref = asset_id)""")
def q_empty_tables(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.without_empty_tables(model(spark, d)).select("root", "ord", "asset_id")


_LINES = "1. um\n1.1. dois\n  3.1. três\nsem 2.1. isto"


@query(f"""WITH {MODEL_SQL}, f AS (SELECT *, CAST(root AS BIGINT) % 2 = 0 AND number LIKE '%.1' AND number NOT IN ('1.1', '3.1') AS fake FROM questions) SELECT root, ord, number, CASE WHEN NOT EXISTS (SELECT 1 FROM f g WHERE g.root = f.root AND g.fake AND g.question_id = f.parent) THEN parent END AS parent FROM f WHERE NOT fake""")
def q_found_subquestions(spark: SparkSession, d: str) -> DataFrame:
    """Every second exam has a text."""
    ex = model(spark, d)
    texts = ex.exams.select("root", F.when(F.col("root").cast("bigint") % 2 == 0, _LINES).otherwise("").alias("text"))
    return cleanup.found_subquestions(ex.questions, texts).select("root", "ord", "number", "parent")


@query(f"""WITH {MODEL_SQL} SELECT root, ord, CASE WHEN is_group THEN 0 ELSE n_options END AS n_options, CASE WHEN NOT is_group THEN n_blanks END AS n_blanks FROM questions""")
def q_group_rows(spark: SparkSession, d: str) -> DataFrame:
    q = cleanup.group_rows(model(spark, d).questions)
    return q.select("root", "ord", F.size("options").cast("bigint").alias("n_options"), F.when(F.col("blanks").isNotNull(), F.size("blanks")).cast("bigint").alias("n_blanks"))


@query(f"""WITH {MODEL_SQL} SELECT p.root, ord, mandatory OR coalesce(year < 2020, false) AS mandatory FROM policy p LEFT JOIN exams e ON e.root = p.root""")
def q_legacy_mandatory(spark: SparkSession, d: str) -> DataFrame:
    ex = model(spark, d)
    return cleanup.mandatory_before(ex.policy, ex.exams).select("root", "ord", "mandatory")


@query(f"""WITH {MODEL_SQL} SELECT root, ord FROM questions WHERE coalesce(statement, '') <> '' OR n_options > 0 OR n_blanks > 0 OR asset_ref IS NOT NULL OR image_ref IS NOT NULL OR table_ref IS NOT NULL OR source_ref IS NOT NULL OR media IS NOT NULL""")
def q_visible_questions(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).questions.filter(cleanup.is_visible()).select("root", "ord")


_STATE = "CASE o_orderkey % 7 WHEN 0 THEN 'completed' WHEN 1 THEN 'queued' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'partial_failed' WHEN 4 THEN 'error' WHEN 5 THEN 'processing' ELSE 'completed_with_warnings' END"


@query(f"SELECT o_orderkey AS job_id, {_STATE} AS status FROM orders WHERE o_orderkey % 7 IN (0, 2, 3, 4, 6)")
def q_exportable_jobs(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.tables import table

    jobs = table(spark, d, "orders").selectExpr("o_orderkey AS job_id", f"{_STATE} AS status")
    return jobs.filter(F.col("status").isin(cleanup.EXPORTABLE))


_WARNING = {"type": "CASE (ord + CAST(root AS BIGINT)) % 5 WHEN 0 THEN 'suspicious_points' WHEN 1 THEN 'history_points_repaired' WHEN 2 THEN 'broken_ref' WHEN 3 THEN 'grupo_ii_points_rescaled' ELSE 'text_fallback_used' END", "severity": "CASE WHEN number = '2' THEN 'info' WHEN number = '3' THEN 'high' END", "message": "'has unusually low points: ' || CAST(coalesce(points, 0) % 6 AS STRING)"}


@query(f"""WITH {MODEL_SQL}, w AS (SELECT root, ord, {", ".join(f"{e} AS {n}" for n, e in _WARNING.items())}, coalesce(points, 0) % 6 AS low FROM questions)
SELECT root, ord, coalesce(severity = 'info', false) OR type IN ('history_points_repaired', 'text_fallback_used') OR (type = 'suspicious_points' AND (low >= 3 OR bool_or(type = 'grupo_ii_points_rescaled') OVER (PARTITION BY root))) AS info FROM w""")
def q_info_warnings(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = model(spark, d).questions.selectExpr("root", "ord", *(f"{e} AS {n}" for n, e in _WARNING.items()))
    rescaled = F.max(F.col("type") == "grupo_ii_points_rescaled").over(Window.partitionBy("root"))
    return w.withColumn("rescaled", rescaled).select("root", "ord", cleanup.is_info(F.col("type"), F.col("severity"), F.col("message"), F.col("rescaled")).alias("info"))


@query(f"""WITH {MODEL_SQL} SELECT root, ord, coalesce(array_to_string(list_filter([image_ref, table_ref], lambda x: x IS NOT NULL), ','), '') AS refs, coalesce(nullif(group_id, ''), 'sem grupo') AS group_id, coalesce(points, 0) AS points FROM questions""")
def q_filled_fields(spark: SparkSession, d: str) -> DataFrame:
    """Lists that are missing are empty, and scalars have what the client shows for none."""
    q = model(spark, d).questions.withColumn("image_refs", F.when(F.size("image_refs") > 0, F.col("image_refs")))
    refs = F.concat(F.coalesce("image_refs", F.array().cast("array<string>")), F.coalesce("table_refs", F.array().cast("array<string>")))
    return q.select("root", "ord", F.array_join(refs, ",").alias("refs"), F.coalesce(F.nullif("group_id", F.lit("")), F.lit("sem grupo")).alias("group_id"), F.coalesce("points", F.lit(0)).cast("bigint").alias("points"))


@query(f"""WITH {MODEL_SQL}, x AS (SELECT root, CASE WHEN exam_no % 5 = 0 THEN NULL ELSE subject END AS subject FROM exams), s AS (SELECT root, bool_or(source_id LIKE '%doc%') AS docs FROM sources GROUP BY root) SELECT x.root, CASE WHEN subject IS NOT NULL THEN subject LIKE '%Hist%' ELSE coalesce(docs, false) END AS history FROM x LEFT JOIN s USING (root)""")
def q_history_guard(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth exam has no subject."""
    ex = model(spark, d)
    ex.exams = ex.exams.withColumn("subject", F.when(F.col("exam_no") % 5 != 0, F.col("subject")))
    return cleanup.is_history(ex)


_FIGURES = "asset_id || '_p' || CAST(page AS STRING)"


@query(f"""WITH {MODEL_SQL}, {_Q}, f AS (SELECT root, regexp_extract(asset_id, '^figura_(\\d+)', 1) AS fig, page, arg_max({_FIGURES}, ord) AS id FROM assets WHERE asset_id LIKE 'figura_%' GROUP BY root, fig, page),
n AS (SELECT root, ord, source_page, unnest(list_distinct(regexp_extract_all(t, '[Ff]igura\\s+(\\d+)', 1))) AS fig FROM q WHERE source_page > 0) SELECT n.root, ord, id AS asset_id FROM n JOIN f ON f.root = n.root AND f.fig = n.fig AND f.page = source_page""")
def q_figures_on_page(spark: SparkSession, d: str) -> DataFrame:
    ex = model(spark, d)
    return cleanup.figures_on_page(ex.questions, ex.assets.withColumn("asset_id", F.expr(_FIGURES)))


_NEAR = "CASE WHEN ord % 3 = 0 THEN CAST(ord AS STRING) END"


@query(f"""WITH {MODEL_SQL}, {_Q}, u AS (SELECT DISTINCT root, table_ref AS id FROM questions WHERE table_ref IS NOT NULL), a AS (SELECT root, ord AS asset_ord, page, coalesce({_NEAR}, '') AS near FROM assets WHERE (type = 'table' OR asset_id LIKE '%tabela%') AND NOT EXISTS (SELECT 1 FROM u WHERE u.root = assets.root AND id = asset_id)),
s AS (SELECT root, ord, number, source_page, CASE WHEN contains(lower(t), 'tabela') OR contains(lower(t), 'medições') OR contains(lower(t), 'apresentam-se') THEN 8 ELSE 0 END + CASE WHEN type IN ('calculation', 'open_answer', 'multi_blank_choice') THEN 1 ELSE 0 END AS about, row_number() OVER (PARTITION BY root, number ORDER BY ord DESC) = 1 AS last FROM q),
c AS (SELECT a.root, asset_ord, ord, about + CASE WHEN number = near THEN 10 ELSE 0 END AS score, CASE WHEN number = near AND last THEN 0 ELSE 1 END AS way FROM a JOIN s ON s.root = a.root AND (source_page = page OR (number = near AND last)))
SELECT root, asset_ord, ord, CAST(score AS BIGINT) AS score FROM c WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY root, asset_ord ORDER BY score DESC, way, ord) = 1""")
def q_tables_of_questions(spark: SparkSession, d: str) -> DataFrame:
    ex = model(spark, d)
    return cleanup.tables_of_questions(ex.questions, ex.assets.withColumn("near", F.expr(_NEAR)))


@query(f"""WITH {MODEL_SQL}, u AS (SELECT root, image_ref AS id FROM questions UNION SELECT root, table_ref FROM questions), a AS (SELECT root, ord AS asset_ord, page, {_NEAR} AS near FROM assets WHERE type <> 'embedded_image' AND NOT EXISTS (SELECT 1 FROM u WHERE u.root = assets.root AND id = asset_id))
SELECT a.root, asset_ord, coalesce((SELECT min(ord) FROM questions q WHERE q.root = a.root AND number = near), (SELECT max(ord) FROM questions q WHERE q.root = a.root AND source_page = page)) AS ord FROM a""")
def q_homes_of_assets(spark: SparkSession, d: str) -> DataFrame:
    ex = model(spark, d)
    return cleanup.homes_of_assets(ex.questions, ex.assets.withColumn("near", F.expr(_NEAR)))


@query(f"""WITH {MODEL_SQL} SELECT root, ord, CASE WHEN source_page BETWEEN 2 AND 3 THEN 'grupo_i' WHEN source_page = 4 THEN 'grupo_ii' ELSE group_id END AS group_id FROM questions""")
def q_groups_from_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages 2 and 3 of every exam are of the first group, page 4 of the second."""
    ex = model(spark, d)
    pages = ex.exams.select("root", F.inline(F.array(*(F.struct(F.lit(p).cast("bigint").alias("page"), F.lit(g).alias("group_id")) for p, g in ((2, "grupo_i"), (3, "grupo_i"), (4, "grupo_ii"))))))
    return cleanup.groups_from_pages(ex.questions, pages).select("root", "ord", "group_id")


@query(f"""WITH {MODEL_SQL}, n AS (SELECT *, CASE WHEN group_id IS NOT NULL THEN group_id || '_q' || replace(number, '.', '_') END AS made FROM questions), m AS (SELECT root, question_id, arg_max(made, ord) AS made FROM n WHERE made IS NOT NULL GROUP BY root, question_id)
SELECT n.root, n.ord, n.question_id, coalesce(n.made, n.question_id) AS new_id, coalesce(m.made, n.parent) AS parent FROM n LEFT JOIN m ON m.root = n.root AND m.question_id = n.parent""")
def q_composite_ids(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.composite_ids(model(spark, d).questions)


_THERE = "EXISTS (SELECT 1 FROM files f WHERE f.root = q.root AND f.rel = 'assets/' || split_part(media, '/assets/', 2))"


@query(f"""WITH {MODEL_SQL} SELECT root, ord, media AS url, CASE WHEN {_THERE} THEN 'kept' ELSE 'missing_media_ref' END AS status FROM questions q WHERE media IS NOT NULL""")
def q_media_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Media that stay, and those that go with a warning as their file is not there."""
    ex = model(spark, d)
    kept, gone = cleanup.existing_media(ex.questions, ex.files, rules.relative_path)
    return kept.withColumn("status", F.lit("kept")).unionByName(gone.withColumn("status", F.lit("missing_media_ref")))


@query(f"""WITH {MODEL_SQL} SELECT root, ord, row_number() OVER (PARTITION BY root ORDER BY coalesce(source_page, 999), CAST(split_part(number, '.', 1) AS INT), CAST(coalesce(nullif(split_part(number, '.', 2), ''), '0') AS INT), ord) AS pos FROM questions""")
def q_question_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    q = model(spark, d).questions
    return q.select("root", "ord", F.row_number().over(Window.partitionBy("root").orderBy(*cleanup.question_order())).cast("bigint").alias("pos"))


@query(f"""WITH {MODEL_SQL} SELECT root, parent, string_agg(number, ',' ORDER BY CAST(split_part(number, '.', 1) AS INT), CASE WHEN contains(number, '.') THEN 1 ELSE 0 END, ord) AS children FROM questions WHERE parent IS NOT NULL GROUP BY root, parent""")
def q_sorted_children(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of each parent's children in natural order."""
    from ..functions.text import sort_key

    q = model(spark, d).questions.filter("parent IS NOT NULL").withColumn("key", sort_key(F.col("number")))
    lists = q.groupBy("root", "parent").agg(F.array_sort(F.collect_list(F.struct("key", "ord", "number"))).alias("c"))
    return lists.select("root", "parent", F.array_join("c.number", ",").alias("children"))


@query(f"""WITH i AS ({HISTORY_SQL}) SELECT root, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, count(*) AS n FROM i WHERE code IN ({", ".join(f"'{c}'" for c in cleanup.RETRYABLE)}) GROUP BY root""")
def q_retryable_history(spark: SparkSession, d: str) -> DataFrame:
    """Issues of the history audit that another run may mend, by exam."""
    found = rules.history(model(spark, d)).filter(F.col("code").isin(cleanup.RETRYABLE))
    return found.groupBy("root").agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"), F.count("*").alias("n"))


#: First pages of exams, and what they tell: year, subject, phase, title.
COVERS = [
    (["Exame Final Nacional de Português\n2019 1.ª Fase", "outra de 2012 2ª Fase"], ("2019", "Português", "1ª Fase", "Exame Nacional de Português - 2019")),
    (["", "Prova de matemática a, 2ª Fase, 1998"], (None, "Matemática A", "2ª Fase", None)),
    (["capa", "ano 2015", "2011 Filosofia"], ("2015", None, None, None)),
    (["Biologia e Geologia", "2021"], ("2021", "Biologia e Geologia", None, "Exame Nacional de Biologia e Geologia - 2021")),
]


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS root, year, subject, phase, title FROM orders JOIN (VALUES {", ".join(f"({i}, {', '.join(map(_quoted, told))})" for i, (_, told) in enumerate(COVERS))}) v(k, year, subject, phase, title) ON o_orderkey % {len(COVERS)} = k""")
def q_cover_data(spark: SparkSession, d: str) -> DataFrame:
    """Year, subject, phase and title by the first two pages; the SQL holds values traced by hand."""
    docs = F.array(*(F.array(*(F.struct(F.lit(i + 1).alias("page"), F.lit(t).alias("text")) for i, t in enumerate(pages))) for pages, _ in COVERS))
    pages = model(spark, d).exams.select("root", F.inline(docs[(F.col("exam_no") % len(COVERS)).cast("int")]))
    return cleanup.cover_data(pages)
