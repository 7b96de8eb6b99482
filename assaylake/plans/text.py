"""Text rules: page classes, qualities, parsers and clean-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exam_text as E
from ..functions import text as T
from ..operators import cleanup, scoring_text
from ..sources.exams import MODEL_SQL, model, numbered
from ..sources.tables import table
from .cleanup import traced
from .registry import query

SYMBOLS = "*#$%&!"


@query("""WITH s AS (SELECT doc_id, length(text) - length(translate(text, '*#$%&!', '')) AS n, regexp_matches(text, '(^|\\n)\\s*\\d{1,2}\\.') AS numbered FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS symbols FROM s WHERE n > 15 AND NOT numbered""")
def q_formula_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages dense in symbols and without a question number."""
    n = T.count_chars(F.col("text"), SYMBOLS)
    return table(spark, d, "documents").filter((n > 15) & ~F.col("text").rlike(r"(^|\n)\s*\d{1,2}\.")).select("doc_id", n.alias("symbols"))


MARKERS = {"exam": ["the ", "and ", "of "], "criteria": ["der ", "und ", "die "]}


@query("""WITH m AS (SELECT conv_id, sum(CASE WHEN contains(lower(text), 'the ') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'and ') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'of ') THEN 1 ELSE 0 END) AS exam,
sum(CASE WHEN contains(lower(text), 'der ') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'und ') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'die ') THEN 1 ELSE 0 END) AS criteria FROM conversations WHERE turn < 3 GROUP BY conv_id)
SELECT conv_id, CAST(exam AS BIGINT) AS exam, CAST(criteria AS BIGINT) AS criteria, CASE WHEN criteria > exam THEN 'criteria' WHEN exam > 0 THEN 'exam' ELSE 'unknown' END AS class FROM m""")
def q_preflight(spark: SparkSession, d: str) -> DataFrame:
    """Class of a file by the marker phrases of its first three pages."""
    hits = lambda words: sum(F.lower("text").contains(w).cast("int") for w in words)
    first = table(spark, d, "conversations").filter("turn < 3")
    sums = first.groupBy("conv_id").agg(*(F.sum(hits(words)).cast("bigint").alias(k) for k, words in MARKERS.items()))
    return sums.withColumn("class", F.when(F.col("criteria") > F.col("exam"), "criteria").when(F.col("exam") > 0, "exam").otherwise("unknown"))


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS tokens, CASE WHEN len(w) = 0 THEN 0 ELSE CAST(floor(1000 * len(list_filter(w, lambda x: length(x) = 1)) / len(w)) AS BIGINT) END AS one_char_per_mille FROM t""")
def q_text_quality(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.size(F.filter(F.split("text", r"\s+"), lambda t: t != "")).cast("bigint")
    return table(spark, d, "documents").select("doc_id", tokens.alias("tokens"), T.one_char_ratio(F.col("text")).alias("one_char_per_mille"))


@query("""SELECT doc_id, translate(lang || ' ' || text, 'áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ', 'aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN') AS folded FROM documents""")
def q_accent_fold(spark: SparkSession, d: str) -> DataFrame:
    """Texts without accents."""
    return table(spark, d, "documents").select("doc_id", T.fold_accents(F.concat("lang", F.lit(" "), "text")).alias("folded"))


@query("""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '') AS u FROM pages),
n AS (SELECT page_id, 'https://' || regexp_replace(lower(regexp_extract(u, '^https?://([^/]+)', 1)), '^(www|m)\\.', '') || regexp_extract(u, '^https?://[^/]+(/.*)?$', 1) AS url FROM u)
SELECT min(page_id) AS page_id, url, count(*) AS copies FROM n GROUP BY url""")
def q_url_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Pages by normalised address, the first of each."""
    return table(spark, d, "pages").select("page_id", T.normalise_url(F.col("url")).alias("url")).groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies")).select("page_id", "url", "copies")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)""")
def q_json_tolerant(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("answer: "), "props", F.lit(" done"))).otherwise(F.col("props"))
    found = table(spark, d, "events").select("event_id", T.parse_json(wrapped).alias("json"))
    return found.filter("json IS NOT NULL").select("event_id", F.get_json_object("json", "$.k").cast("bigint").alias("k"))


_shown = lambda items: F.array_join(F.transform(items, lambda x: F.concat_ws("=", x["plain"], x["latex"])), "|")
traced("q_statement_format", "Statements with their parts on lines of their own.", [
    ("Texto. Sabe-se que: • a; • b", "Texto.\nSabe-se que:\n• a;\n• b"), ("Qual? (A) um (B)  dois", "Qual?\n(A) um\n(B) dois"), ("2.  Calcule x. Apresente o resultado em metros.", "2. Calcule x.\nApresente o resultado em metros."),
    ("a\r\n\r\n\r\n b ", "a\nb"), (None, ""), ("Pense. Na sua resposta, diga porquê. Fim", "Pense.\nNa sua resposta, diga porquê. Fim"), ("x \\\\\ny", "x \\\\\ny"),
], T.format_statement)
traced("q_latex_plain", "Plain text of LaTeX.", [
    ("\\(\\frac{1}{2} \\times \\sqrt{x}\\)", "1/2 × √(x)"), ("x^{2} \\in \\mathbb{R}", "x^2 ∈ R"), ("\\left( a \\leq b \\right)", "( a ≤ b )"), ("\\alpha + \\unknown{y}", "α + y"), ("\\infty", "∈fty"), ("", ""), (None, None),
], T.latex_to_plain)
traced("q_latex_fractions", "Numbers with a slash as fractions.", [
    ("3/5 e 3 / 10", "\\(\\frac{3}{5}\\) e \\(\\frac{3}{10}\\)"), ("1.5/2", "1.5/2"), ("\\frac 1/2", "\\frac 1/2"), ("a1/2", "a1/2"), ("é 7/12345", "é 7/12345"), (None, None),
], T.fractions_to_latex)
traced("q_math_spans", "Inline formulas of a text.", [("Se \\(x^{2}\\) e \\(y\\)", "x^2=\\(x^{2}\\)|y=\\(y\\)"), ("sem", ""), ("\\(aberto", "")], lambda t: _shown(T.math_spans(t)))
traced("q_latex_checks", "Balance of delimiters, parentheses and braces, and whether a text is LaTeX.", [
    ("\\(a\\)", "true,true,true,false"), ("\\(\\frac{1}{2}", "false,false,true,true"), ("}{", "true,true,false,false"), ("x^{2}", "true,true,true,true"),
], lambda t: F.array_join(F.array(*(T.latex_checks(t)[c].cast("string") for c in ("delimiters", "parentheses", "braces", "likely"))), ","))


#: Lines of a part's text, some of which are options.
_LINES = ["'Which ' || p_brand || '?'", "'(A) ' || p_type", "CASE WHEN p_size % 3 = 0 THEN 'x ' ELSE '' END || '(B) size ' || CAST(p_size AS STRING)", "CASE WHEN p_size % 2 = 0 THEN '(E) ' ELSE '(F) ' END || p_name"]


@query(f"""WITH l AS (SELECT p_partkey AS id, unnest([{", ".join(_LINES)}]) AS line FROM part) SELECT id, regexp_extract(line, '^\\(([A-E])\\) (.*)$', 1) AS letter, regexp_extract(line, '^\\(([A-E])\\) (.*)$', 2) AS text FROM l WHERE regexp_matches(line, '^\\([A-E]\\) ')""")
def q_option_extract(spark: SparkSession, d: str) -> DataFrame:
    """Lines of parts' texts that are options (A) to (E)."""
    df = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(" || chr(10) || ".join(_LINES)).alias("s"))
    at = lambda g: F.regexp_extract_all("s", F.lit(r"(?m)^\(([A-E])\) (.*)$"), F.lit(g))
    return df.select("id", F.inline(F.arrays_zip(at(1).alias("letter"), at(2).alias("text"))))


@query(f"""WITH {MODEL_SQL} SELECT root, ord, number, row_number() OVER (PARTITION BY root ORDER BY CAST(split_part(number, '.', 1) AS INT), CASE WHEN contains(number, '.') THEN 1 ELSE 0 END, ord) AS pos FROM questions""")
def q_natural_order(spark: SparkSession, d: str) -> DataFrame:
    """Places of an exam's questions in the natural order of their numbers: 1.2 before 1.10 before 2."""
    q = model(spark, d).questions
    pos = F.row_number().over(Window.partitionBy("root").orderBy(T.sort_key(F.col("number")), "ord"))
    return q.select("root", "ord", "number", pos.cast("bigint").alias("pos"))


@query("""SELECT p_partkey AS part_id, CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 12 AS VARCHAR) AS number FROM part ORDER BY p_size, p_partkey % 12, p_partkey LIMIT 50""")
def q_natural_sort_top(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 by natural order of number."""
    df = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 12).cast("string")).alias("number"))
    return df.orderBy(T.natural_key(F.col("number")), "part_id").limit(50)


@query(f"""WITH {MODEL_SQL} SELECT l_orderkey AS exam_id, CASE WHEN ord <= 3 THEN 'grupo_i' ELSE 'grupo_ii' END AS group_id, row_number() OVER (PARTITION BY l_orderkey, ord <= 3 ORDER BY ord) AS item, CAST(l_quantity AS BIGINT) AS points FROM li""")
def q_scoring_columns(spark: SparkSession, d: str) -> DataFrame:
    """Points of scoring tables that a text layer gives column by column: two groups for each order, each with its items, their points and a sum."""
    part = F.when(F.col("ord") <= 3, F.struct(F.lit(1).alias("g"), F.lit("I").alias("roman"))).otherwise(F.struct(F.lit(2).alias("g"), F.lit("II").alias("roman")))
    of = numbered(spark, d).select(F.col("l_orderkey").alias("exam_id"), part.alias("p"), "ord", F.col("l_quantity").cast("bigint").alias("points"))
    of = of.groupBy("exam_id", "p").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("points").cast("string").alias("points")))).alias("all"), F.sum("points").cast("string").alias("sum"))
    items, points = F.transform("all", lambda x, i: F.concat((i + 1).cast("string"), F.lit("."))), F.transform("all", lambda x: x["points"])
    lines = of.select("exam_id", "p.g", F.posexplode(F.concat(F.array(F.col("p.roman")), items, points, F.array("sum"))).alias("i", "line"))
    return scoring_text.scoring_columns(lines.select("exam_id", (F.col("g") * 1000 + F.col("i")).alias("line_no"), "line"))


#: Pages of exams, by key, and the group of each page, traced by hand.
GROUPED = [
    (["Prova 623", "GRUPO I\nDocumento 1", "1. Refira o autor", "GRUPO II", "COTAÇÕES GRUPO I"], [(2, "grupo_i"), (3, "grupo_i"), (4, "grupo_ii")]),
    (["Grupo i\nDocumento 1", "texto", "Grupo I Grupo II Grupo III total 200 pontos", "mais"], [(1, "grupo_i"), (2, "grupo_i"), (4, "grupo_i")]),
    (["capa", "nada", "Grupo IV", "Grupo III\ntotal"], [(3, "grupo_iv"), (4, "grupo_iii")]),
]


@query(f"SELECT o_orderkey AS exam_id, CAST(page AS BIGINT) AS page, group_id FROM orders JOIN (VALUES {', '.join(f'({k}, {p}, {g!r})' for k, (_, told) in enumerate(GROUPED) for p, g in told)}) v(k, page, group_id) ON o_orderkey % {len(GROUPED)} = k")
def q_page_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of each page of an exam, cover and scoring pages aside; the SQL holds values traced by hand."""
    docs = F.array(*(F.array(*map(F.lit, texts)) for texts, _ in GROUPED))
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("exam_id"), F.posexplode(docs[(F.col("o_orderkey") % len(GROUPED)).cast("int")]).alias("at", "text"))
    return scoring_text.page_groups(pages.select("exam_id", (F.col("at") + 1).cast("bigint").alias("page"), "text"))


#: Files by key, and their class and noisy pages, traced by hand.
FILES = [
    (["Critérios de Classificação", "Tópicos de resposta", "a prova inclui"], ("criteria", True, "")),
    (["Duração da prova: 120. Tolerância: 30", "versão de trabalho", "x", "DRAFT"], ("exam", False, "2,4")),
    (["capa", "x", "y", "duração da prova, tolerância"], ("unknown", False, "")),
    (["critérios de classificação, tópicos de resposta", "tolerância. A prova inclui"], ("exam", False, "")),
]


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS root, type, abort, noisy FROM orders JOIN (VALUES {', '.join(f'({k}, {t!r}, {str(a).lower()}, {n!r})' for k, (_, (t, a, n)) in enumerate(FILES))}) v(k, type, abort, noisy) ON o_orderkey % {len(FILES)} = k")
def q_file_class(spark: SparkSession, d: str) -> DataFrame:
    """What files are by the phrases of their first pages; the SQL holds values traced by hand."""
    docs = F.array(*(F.array(*map(F.lit, texts)) for texts, _ in FILES))
    pages = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("root"), F.posexplode(docs[(F.col("o_orderkey") % len(FILES)).cast("int")]).alias("at", "text"))
    found = cleanup.preflight(pages.select("root", (F.col("at") + 1).alias("page"), "text"))
    return found.withColumn("noisy", F.array_join(F.col("noisy").cast("array<string>"), ","))


_flags = lambda *tests: F.concat(*(t.cast("int").cast("string") for t in tests))
traced("q_scoring_pages", "Five ways to tell a scoring page, by who asks: any scoring word, a summary, its heading words, points beside a group, a heading line.", [
    ("COTAÇÕES\nGrupo I 10 pontos", "11111"), ("classificação final", "10000"), ("Grupo I Grupo II Grupo III total 200 pontos", "01010"), ("1. Grupo I Grupo II Grupo III total 200 pontos", "00010"), ("pontuação do item", "10000"), ("texto\n  Cota do mapa", "00001"), (None, "00000"),
], lambda t: _flags(E.has_scoring_text(t), E.is_scoring_summary(t), E.is_scored_page(t), E.looks_scored(t), E.has_scoring_heading(t)))
traced("q_formula_sheets", "Whether a page is a formula sheet.", [("Formulário\nx", "true"), ("Formulário\n1. Diga", "false"), ("√" * 16, "true"), ("√" * 16 + "\n 2. x", "false"), ("√" * 15, "false"), ("limites notáveis", "true")], E.is_formula_sheet)
traced("q_text_metrics", "Share of one-character words, lost glyphs and structure of a text.", [("a b cde □", "0.75/1/0.25"), ("uma frase normal", "0.0/0/1.0"), ("x [45::47u [1;2u �", "0.5/2/0.5"), ("a b", "1.0/0/0.0")], lambda t: F.concat_ws("/", *(E.text_metrics(t)[c].cast("string") for c in ("one_char", "weird", "structure"))))
traced("q_torn_formulas", "Lost characters, and formulas torn apart.", [("x\n2", "11"), ("a ^ ^ b", "01"), ("soma b c d fim", "01"), ("normal", "00"), ("\u0007", "10"), ("[1;2u", "10"), ("soma a c fim", "00")], lambda t: _flags(E.has_lost_characters(t), E.is_suspicious_math(t)))
