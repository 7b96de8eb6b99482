"""Queries over the source documents of exams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import scoring_text
from ..sources.exams import MODEL_SQL, _cases, _pick, made, model, numbered
from ..sources.layout import LAYOUT_SQL, layout
from .registry import query

_SUMMARY = "(contains(low, 'cotaç') OR (contains(low, 'grupo i') AND contains(low, 'grupo ii') AND contains(low, 'grupo iii') AND contains(low, 'total') AND contains(low, 'pontos') AND NOT regexp_matches(text, '(?m)^\\s*\\d{1,2}\\.')))"
#: Pages with the group in force; then documents by label.
_LABELLED = f"""WITH {MODEL_SQL}, {LAYOUT_SQL}, told AS (SELECT *, lower(text) AS low FROM pages),
grouped AS (SELECT root, page, text, 'grupo_' || lower(last_value(nullif(CASE WHEN {_SUMMARY} THEN NULL ELSE regexp_extract(text, '(?i)grupo\\s+(I{{1,3}}V?|IV)\\b', 1) END, '') IGNORE NULLS) OVER (PARTITION BY root ORDER BY page ROWS UNBOUNDED PRECEDING)) AS group_id, {_SUMMARY} AS scored FROM told),
known AS (SELECT g.root, page, text, group_id, EXISTS (SELECT 1 FROM questions q WHERE q.root = g.root AND q.source_page = g.page) AS has, list_transform(regexp_extract_all(text, '(?i)documento\\s+(\\d+)', 1), lambda x: regexp_replace(x, '^0+(\\d)', '\\1')) AS numbers FROM grouped g WHERE group_id IS NOT NULL AND NOT scored),
filled AS (SELECT root, page, group_id, has, CASE WHEN NOT has AND len(numbers) = 0 AND row_number() OVER (PARTITION BY root, group_id, has ORDER BY page) = 1 THEN ['1'] ELSE numbers END AS numbers FROM known),
labelled AS (SELECT root, group_id, number, first(page ORDER BY has, page) AS page FROM (SELECT root, group_id, has, page, unnest(numbers) AS number FROM filled) GROUP BY root, group_id, number)"""


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages = layout(spark, d).pages
    groups = scoring_text.page_groups(pages.withColumnRenamed("root", "exam_id")).withColumnRenamed("exam_id", "root")
    return pages, groups, model(spark, d).questions.filter("source_page IS NOT NULL").select("root", F.col("source_page").alias("page"))


@query(f"{_LABELLED} SELECT * FROM labelled")
def q_labelled_documents(spark: SparkSession, d: str) -> DataFrame:
    """The page of each document of a group."""
    return D.labelled(*_pages(spark, d))


@query(f"""{_LABELLED},
assets_of AS (SELECT root, page, list(a ORDER BY coalesce(y, 9999), coalesce(x, 9999), asset_id) FILTER (type = 'embedded_image') AS inner_, list(a ORDER BY coalesce(y, 9999), coalesce(x, 9999), asset_id) FILTER (type <> 'embedded_image') AS others FROM (SELECT *, {{'id': asset_id, 'type': type}} AS a FROM placed) GROUP BY root, page),
placed_docs AS (SELECT l.*, p.text, coalesce(inner_, others, []) AS found, count(*) OVER (PARTITION BY l.root, l.page) AS many, row_number() OVER (PARTITION BY l.root, l.page ORDER BY length(number), number) AS nth FROM labelled l JOIN pages p ON p.root = l.root AND p.page = l.page LEFT JOIN assets_of a ON a.root = l.root AND a.page = l.page),
owned AS (SELECT *, group_id || '_documento_' || number AS source_id, CASE WHEN many = 1 THEN found WHEN len(found) >= many THEN found[nth:nth] ELSE [] END AS own FROM placed_docs),
titled AS (SELECT *, list_filter(list_zip(list_transform(regexp_extract_all(text, '(?i)documento\\s+(\\d+)\\s*\\(([^)]+)\\)', 1), lambda x: regexp_replace(x, '^0+(\\d)', '\\1')), regexp_extract_all(text, '(?i)documento\\s+(\\d+)\\s*\\(([^)]+)\\)', 2)), lambda z: z[1] = number) AS titles FROM owned)
SELECT root, source_id, group_id, number, page, 'Documento ' || number || CASE WHEN len(titles) > 0 THEN ' (' || titles[1][2] || ')' ELSE '' END AS label,
CASE WHEN len(own) = 0 THEN CASE WHEN regexp_matches(text, '[Dd]ocumento\\s+(\\d+)') THEN 'text_source' ELSE 'image' END WHEN len(own) > 1 THEN 'image_set' WHEN own[1].type = 'table' THEN 'table' WHEN own[1].type IN ('graph', 'chart') THEN 'graph' WHEN own[1].type = 'map' THEN 'map' WHEN own[1].type IN ('text_source', 'document_excerpt') THEN 'text_source' ELSE 'image' END AS kind,
array_to_string(list_transform(own, lambda a: a.id), ',') AS asset_refs, CASE WHEN len(own) > 1 THEN array_to_string(list_transform(range(len(own)), lambda i: source_id || '_' || chr(CAST(97 + i AS INT))), ',') ELSE '' END AS children FROM titled""")
def q_document_sources(spark: SparkSession, d: str) -> DataFrame:
    """The documents of groups with their labels, kinds and assets."""
    found = D.detect_sources(*_pages(spark, d), layout(spark, d).assets)
    return found.withColumn("asset_refs", F.concat_ws(",", "asset_refs")).withColumn("children", F.concat_ws(",", "children"))


#: Texts that name documents and pictures, and page groups of older exams.
_MORE = f"{_cases(_pick(5, 3, 2, 6), [' Veja a imagem b.', ' Veja a Figura C e a imagem Z.', ' Ver doc. 2', ' Ver Doc 3 e documento 2', '', ''])}"
_LEGACY = {
    "root": "CAST(l_orderkey AS STRING)", "ord": "ord", "source_id": "'source_group_p' || CAST(ord AS STRING)", "label": f"{_cases(_pick(3, 2, 5, 5), ['Documento 1', 'Documento 2', 'Doc. 3', 'sem número', 'Documento 2'])}",
    "child1": f"'a_' || {_cases(_pick(7, 2, 5, 3), ['b', 'c', 'd'])} || '_1'", "child2": f"'img_' || {_cases(_pick(9, 2, 5, 3), ['b', 'c', 'z'])}",
}


@query(f"""WITH {MODEL_SQL}, legacy AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _LEGACY.items())} FROM li), more AS (SELECT CAST(l_orderkey AS STRING) AS root, ord, {_MORE} AS more FROM li), asked AS (SELECT q.root, q.ord, statement || more AS text FROM questions q JOIN more m ON m.root = q.root AND m.ord = q.ord WHERE source_ref IS NULL),
g AS (SELECT root, number, last(source_id ORDER BY ord) AS source_id, last([child1, child2] ORDER BY ord) AS children FROM (SELECT *, regexp_extract(label, '(\\d+)', 1) AS number FROM legacy) WHERE number <> '' GROUP BY root, number),
n AS (SELECT root, ord, list_distinct(list_transform(regexp_extract_all(text, '(?i)(?:imagem|figura)\\s+([A-Z])', 1), lambda x: lower(x))) AS letters, unnest(list_distinct(list_concat(regexp_extract_all(text, '[Dd]ocumento\\s+(\\d+)', 1), regexp_extract_all(text, '[Dd]oc\\.?\\s*(\\d+)', 1)))) AS number FROM asked),
m AS (SELECT n.root, n.ord, source_id, letters, children FROM n JOIN g ON g.root = n.root AND g.number = n.number)
SELECT DISTINCT root, ord, source_id, child AS child_id, CASE WHEN len(letters) = 0 THEN 'full_group' ELSE 'specific_child' END AS mode FROM (SELECT *, unnest(CASE WHEN len(letters) = 0 THEN [NULL] ELSE list_filter(list_transform(letters, lambda x: list_filter(children, lambda c: contains(c, '_' || x || '_') OR suffix(c, '_' || x))[1]), lambda c: c IS NOT NULL) END) AS child FROM m)""")
def q_late_references(spark: SparkSession, d: str) -> DataFrame:
    """References to page groups, for questions that have none."""
    more = numbered(spark, d).selectExpr("root", "ord", f"{_MORE} AS more")
    q = model(spark, d).questions.join(more, ["root", "ord"]).select("root", "ord", F.concat("statement", "more").alias("text"), (F.size("source_refs") > 0).alias("has_refs"))
    groups = made(numbered(spark, d), _LEGACY).withColumn("children", F.array("child1", "child2"))
    return D.late_references(q, groups)


def _source(p: int, q: int, r: int) -> str:
    return f"{_cases(_pick(p, q, r, 3), ['grupo_i', 'grupo_ii', 'grupo_iv'])} || {_cases(_pick(q, r, p, 2), ['_texto_p', '_documento_'])} || CAST(1 + {_pick(r, p, q, 2)} AS STRING)"


_TOLD = {"root": "CAST(l_orderkey AS STRING)", "ord": "ord", "source": _source(3, 1, 2), "ref1": _source(1, 5, 3), "ref2": _source(5, 2, 7), "shown": _source(7, 3, 1)}
_SUPERSEDED = f"""WITH {MODEL_SQL}, told AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _TOLD.items())} FROM li), sources_of AS (SELECT DISTINCT root, source AS source_id FROM told),
refs AS (SELECT root, ord, ref1 AS source_id, 1 AS place FROM told UNION ALL SELECT root, ord, ref2, 2 FROM told), media_of AS (SELECT root, ord, shown AS source_id FROM told),
both_ AS (SELECT DISTINCT r.root, r.ord FROM refs r JOIN sources_of s ON s.root = r.root AND s.source_id = r.source_id WHERE regexp_matches(s.source_id, '{D.TEXT_SOURCE}')),
doubled AS (SELECT DISTINCT r.root, r.ord, r.source_id FROM refs r JOIN both_ b ON b.root = r.root AND b.ord = r.ord WHERE regexp_matches(r.source_id, '{D.NUMBERED_SOURCE}')),
kept AS (SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM doubled x WHERE x.root = r.root AND x.ord = r.ord AND x.source_id = r.source_id))"""


@query(f"""{_SUPERSEDED} SELECT 'source' AS what, root, CAST(NULL AS BIGINT) AS ord, source_id FROM sources_of s WHERE NOT (EXISTS (SELECT 1 FROM doubled x WHERE x.root = s.root AND x.source_id = s.source_id) AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.root = s.root AND k.source_id = s.source_id))
UNION ALL SELECT 'reference', root, ord, source_id FROM kept UNION ALL SELECT 'medium', root, ord, source_id FROM media_of m WHERE NOT EXISTS (SELECT 1 FROM doubled x WHERE x.root = m.root AND x.source_id = m.source_id)""")
def q_superseded(spark: SparkSession, d: str) -> DataFrame:
    """Sources, references and media that are left once sources read from texts supersede numbered documents."""
    told = made(numbered(spark, d), _TOLD)
    refs = told.select("root", "ord", F.explode(F.array("ref1", "ref2")).alias("source_id"))
    sources, refs, media = D.supersede(told.select("root", F.col("source").alias("source_id")).distinct(), refs, told.select("root", "ord", F.col("shown").alias("source_id")))
    rows = lambda df, what: df.select(F.lit(what).alias("what"), "root", (F.col("ord") if "ord" in df.columns else F.lit(None).cast("bigint")).alias("ord"), "source_id")
    return rows(sources, "source").unionByName(rows(refs, "reference")).unionByName(rows(media, "medium"))


@query(f"""WITH {MODEL_SQL}, {LAYOUT_SQL}, asking AS (SELECT root, ord, source_page AS page FROM questions WHERE group_id = 'grupo_i' AND source_ref IS NULL AND contains(lower(statement), 'documento')),
had AS (SELECT DISTINCT root FROM sources WHERE source_id = 'grupo_i_documento_1' AND CAST(root AS BIGINT) % 3 = 0), told AS (SELECT *, lower(text) AS low FROM pages),
free AS (SELECT * FROM told WHERE page > 1 AND NOT regexp_matches(low, '{"|".join(D.SCORING_WORDS)}')), lacking AS (SELECT * FROM asking WHERE root NOT IN (SELECT root FROM had)),
chosen AS (SELECT l.root, coalesce(min(CASE WHEN l.page > 1 AND NOT EXISTS (SELECT 1 FROM told t WHERE t.root = l.root AND t.page = l.page AND regexp_matches(low, '{"|".join(D.SCORING_WORDS)}')) THEN l.page END), (SELECT min(page) FROM free f WHERE f.root = l.root AND contains(low, 'grupo i') AND regexp_matches(low, '{"|".join(D.TABLE_WORDS)}')), (SELECT min(page) FROM free f WHERE f.root = l.root AND contains(low, 'grupo i'))) AS page FROM lacking l GROUP BY l.root),
made AS (SELECT c.root, c.page FROM chosen c JOIN pages p ON p.root = c.root AND p.page = c.page)
SELECT 'source' AS what, root, CAST(NULL AS BIGINT) AS ord, page FROM made UNION ALL SELECT 'reference', root, ord, NULL FROM asking WHERE root IN (SELECT root FROM had) OR root IN (SELECT root FROM made)""")
def q_implied_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents made for first groups that speak of one without a label, and the references to them."""
    ex = model(spark, d)
    q = ex.questions.select("root", "ord", "group_id", F.col("statement").alias("text"), F.col("source_page").alias("page"), (F.size("source_refs") > 0).alias("has_refs"))
    new, refs = D.implied_document(q, ex.sources.filter("CAST(root AS BIGINT) % 3 = 0"), layout(spark, d).pages)
    return new.select(F.lit("source").alias("what"), "root", F.lit(None).cast("bigint").alias("ord"), "page").unionByName(refs.select(F.lit("reference").alias("what"), "root", "ord", F.lit(None).cast("bigint").alias("page")))
