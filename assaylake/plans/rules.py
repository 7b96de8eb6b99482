"""The rule catalogue over the exam model, one query for each family of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules, scoring_text
from ..sources.exams import MODEL_SQL, model
from ..sources.tables import pages
from .registry import ORACLE_SQL, query

_AT = {"qid": "question_id", "grp": "group_id", "num": "number"}
_NUM = {"qid": "question_id", "num": "number"}


def _rule(table: str, where: str, severity: str, code: str, qid: str = "''", grp: str = "''", num: str = "''", exp: str = "''", act: str = "''") -> str:
    quoted = lambda s: s if s.startswith("CASE") else f"'{s}'"
    text = lambda e: f"coalesce(CAST({e} AS VARCHAR), '')"
    return f"SELECT root, {quoted(severity)} AS severity, {quoted(code)} AS code, {text(qid)} AS question_id, {text(grp)} AS \"group\", {text(num)} AS number, {text(exp)} AS expected, {text(act)} AS actual FROM {table} WHERE {where}"


def _issues(ctes: str, *parts: str) -> str:
    return f"WITH {MODEL_SQL}, {ctes}, found AS ({' UNION ALL '.join(parts)}) SELECT root, severity, code, lower(replace(code, '_', ' ')) AS message, question_id, \"group\", number, expected, actual FROM found"


_OF = "root IN (SELECT root FROM sub)"
_SUBJECT = "sub AS (SELECT * FROM exams WHERE {})"
_TEXT = "coalesce(statement, '') || ' ' || coalesce(raw_text, '')"
_Q = f"q AS (SELECT *, {_TEXT} AS t, lower({_TEXT}) AS low FROM questions WHERE {_OF})"

GENERIC_SQL = _issues(
    _SUBJECT.format("subject NOT LIKE '%Hist%' AND subject NOT LIKE '%Portug%'") + f""", {_Q},
leaf AS (SELECT * FROM q WHERE NOT is_group AND NOT EXISTS (SELECT 1 FROM q c WHERE c.root = q.root AND c.parent = q.question_id)),
sums AS (SELECT sub.root, pool, n, total, missing, optional FROM sub LEFT JOIN (SELECT root, count(*) AS n, CAST(sum(coalesce(points, 0)) AS BIGINT) AS total, count(*) FILTER (coalesce(points, 0) = 0) AS missing FROM leaf GROUP BY root) l USING (root) LEFT JOIN (SELECT root, bool_or(NOT mandatory) AS optional FROM policy GROUP BY root) p USING (root)),
twice AS (SELECT *, row_number() OVER (PARTITION BY root, coalesce(group_id, ''), number ORDER BY ord) AS nth FROM leaf)""",
    _rule("sums", "n IS NULL", "BLOCKER", "GENERIC_NO_QUESTIONS"),
    _rule("sums", "missing = 0 AND NOT pool AND NOT coalesce(optional, false) AND total <> 200", "CASE WHEN abs(total - 200) > 10 THEN 'HIGH' ELSE 'MEDIUM' END", "GENERIC_TOTAL_POINTS", exp="200", act="total"),
    _rule("leaf", "coalesce(points, 0) = 0", "HIGH", "GENERIC_MISSING_POINTS", **_NUM),
    _rule("leaf", "type = 'multiple_choice' AND greatest(n_options - n_empty, 0) < 3", "HIGH", "GENERIC_MC_OPTIONS", **_NUM),
    _rule("leaf", "length(trim(coalesce(statement, ''))) < 10 AND NOT visual", "MEDIUM", "GENERIC_EMPTY_STATEMENT", **_NUM),
    _rule("leaf", "text_status = 'corrupt'", "HIGH", "GENERIC_CORRUPT_TEXT", **_NUM),
    _rule("twice", "nth > 1", "MEDIUM", "GENERIC_DUPLICATE_NUMBER", **_NUM),
)


@query(GENERIC_SQL)
def q_rules_generic(spark: SparkSession, d: str) -> DataFrame:
    return rules.generic(model(spark, d))


_MEDIA = [
    _rule("q", "source_ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sources s WHERE s.root = q.root AND s.source_id = source_ref)", "BLOCKER", "BROKEN_SOURCE_REF", act="source_ref", **_AT),
    _rule("q", "source_ref IS NOT NULL AND child_ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sources s WHERE s.root = q.root AND s.child_id = child_ref)", "BLOCKER", "BROKEN_CHILD_REF", act="child_ref", **_AT),
    _rule("(SELECT *, 'assets/' || split_part(media, '/assets/', 2) AS rel FROM q WHERE media IS NOT NULL) q", "NOT EXISTS (SELECT 1 FROM files f WHERE f.root = q.root AND f.rel = q.rel)", "BLOCKER", "MISSING_MEDIA_FILE", act="rel", **_AT),
    _rule("sources s", f"{_OF} AND child_crop IS NOT NULL AND NOT EXISTS (SELECT 1 FROM files f WHERE f.root = s.root AND f.rel = child_crop)", "BLOCKER", "MISSING_CHILD_CROP_FILE", act="child_crop"),
]
_CROPS = "crops AS (SELECT s.*, total_pages, 'assets/' || split_part(crop, '/assets/', 2) AS path, width, height, digest FROM sources s JOIN sub USING (root) LEFT JOIN files f ON f.root = s.root AND f.rel = 'assets/' || split_part(crop, '/assets/', 2))"
_SIZED = {"qid": "source_id", "grp": "group_id", "act": "path || ' (' || width || 'x' || height || ')'"}
_CROP = {
    "SCORING_PAGE_AS_SOURCE": _rule("crops", "total_pages > 0 AND group_id = 'grupo_i' AND coalesce(page_start, 0) >= total_pages AND method = 'history_unlabelled_doc_crop'", "BLOCKER", "SCORING_PAGE_AS_SOURCE", grp="'grupo_i'", act="source_id"),
    "SOURCE_WITHOUT_CROP": _rule("crops", "crop IS NULL AND render IS DISTINCT FROM 'text'", "HIGH", "SOURCE_WITHOUT_CROP", act="source_id"),
    "MISSING_SOURCE_CROP_FILE": _rule("crops", "crop IS NOT NULL AND width IS NULL", "BLOCKER", "MISSING_SOURCE_CROP_FILE", act="path"),
    "SMALL": _rule("crops", "height < 80", "HIGH", "SUSPECT_CROP_TOO_SMALL", **_SIZED),
    "LONG": _rule("crops", "height >= 80 AND width / height > 8", "INFO", "SUSPECT_CROP_TOO_SMALL", **_SIZED),
    "SAME": _rule("(SELECT root, group_id, string_agg(source_id, ',' ORDER BY ord, source_id) AS ids FROM crops WHERE width IS NOT NULL GROUP BY root, group_id, digest HAVING count(*) > 1)", "true", "HIGH", "DUPLICATE_SOURCE_CROPS", grp="group_id", act="ids"),
}

_MARKS = "(length(t) - length(replace(t, '?', '')))"
#: What the texts of the model name, by hand; the last are all documents of the group.
_NAMED = "CASE WHEN t LIKE '%documento 1 e o documento 3%' THEN [1, 3] WHEN t LIKE '%documentos 1 a 3%' THEN [1, 2, 3] WHEN t LIKE '%documentos 1, 2 e 4%' THEN [1, 2, 4] WHEN t LIKE 'A partir dos documentos%' THEN allowed ELSE [] END"
HISTORY_SQL = _issues(
    _SUBJECT.format("subject LIKE '%Hist%'") + f""", {_Q}, {_CROPS},
sums AS (SELECT sub.*, coalesce(n, 0) AS n, nulls, zeros, total FROM sub LEFT JOIN (SELECT root, count(*) AS n, count(*) FILTER (points IS NULL) AS nulls, count(*) FILTER (points <= 0) AS zeros, CAST(sum(points) FILTER (points > 0) AS BIGINT) AS total FROM q GROUP BY root) s USING (root)),
nums AS (SELECT root, group_id, list_sort(list(DISTINCT CAST(number AS INT))) AS found FROM q WHERE group_id IS NOT NULL AND number NOT LIKE '%.%' GROUP BY root, group_id),
gaps AS (SELECT *, range(found[1], found[-1] + 1) AS every FROM nums WHERE found[-1] - found[1] + 1 <> len(found)),
allow AS (SELECT root, group_id, list_sort(list(DISTINCT CAST(split_part(source_id, '_documento_', 2) AS INT))) AS allowed FROM sources GROUP BY root, group_id),
docs AS (SELECT q.*, {_NAMED} AS named, allowed, CASE WHEN source_ref IS NULL THEN [] ELSE [CAST(split_part(source_ref, '_documento_', 2) AS INT)] END AS got FROM q LEFT JOIN allow ON q.root = allow.root AND q.group_id = allow.group_id),
wants AS (SELECT *, list_sort(CASE WHEN len(coalesce(allowed, [])) > 0 THEN list_intersect(named, allowed) ELSE named END) AS wanted FROM docs)""",
    _rule("sums", "coalesce(expected, 0) <> 0 AND expected <> n", "HIGH", "QUESTION_COUNT_MISMATCH", exp="expected", act="n"),
    _rule("sums", "nulls > 0", "BLOCKER", "POINTS_NULL", exp="'integer > 0'", act="nulls || ' invalid'"),
    _rule("sums", "zeros > 0", "BLOCKER", "POINTS_ZERO", exp="'integer > 0'", act="zeros || ' zero'"),
    _rule("sums", "nulls = 0 AND zeros = 0 AND total < 200", "HIGH", "TOTAL_POINTS_TOO_LOW", exp="'>=200'", act="total"),
    _rule("sums", "year IS NULL", "HIGH", "MISSING_YEAR", exp="'year'", act="'None'"),
    _rule("sums", "coalesce(phase, '') = ''", "HIGH", "MISSING_PHASE", exp="'phase'", act="coalesce(phase, 'None')"),
    _rule("sums", "warning = 'broken_ref'", "MEDIUM", "PIPELINE_WARNING", act="warning"),
    _rule("sums", "load_error IS NOT NULL", "BLOCKER", "LOAD_FAILED", act="load_error"),
    _rule("q", "group_id IS NOT NULL AND NOT starts_with(source_ref, group_id || '_')", "BLOCKER", "CROSS_GROUP_SOURCE_REF", act="source_ref", **_AT),
    _rule("q", f"t LIKE '%�%' OR ({_MARKS} >= 2 AND {_MARKS} / greatest(len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')), 1) >= 0.015) OR {_MARKS} >= 4", "BLOCKER", "CORRUPT_TEXT", act=_MARKS, **_AT),
    _rule("q", "type = 'multiple_choice' AND n_options < 2", "HIGH", "MULTIPLE_CHOICE_WITHOUT_OPTIONS", **_AT),
    _rule("q", "type = 'multi_select' AND n_options < 3", "HIGH", "MULTI_SELECT_WITHOUT_OPTIONS", **_AT),
    _rule("q", "type = 'multi_select' AND coalesce(max_selections, 0) < 2", "MEDIUM", "MULTI_SELECT_SELECTION_COUNT", **_AT),
    _rule("q", "type = 'multi_blank_choice' AND (n_blanks = 0 OR n_last = 0)", "HIGH", "MULTIBLANK_WITHOUT_OPTIONS", **_AT),
    _rule("q", "type = 'matching' AND (n_left < 2 OR n_right < 2)", "HIGH", "MATCHING_WITHOUT_COLUMNS", **_AT),
    _rule("q", "type = 'ordering' AND n_order < 2", "HIGH", "ORDERING_WITHOUT_ITEMS", **_AT),
    _rule("q", "low LIKE '%complete o texto%' AND type <> 'multi_blank_choice'", "HIGH", "MULTIBLANK_MISCLASSIFIED", exp="'multi_blank_choice'", act="type", **_AT),
    _rule("q", "(t LIKE '%(A)%' OR t LIKE '%(B)%' OR t LIKE '%(C)%' OR t LIKE '%(D)%') AND type = 'open_answer'", "MEDIUM", "CHOICE_LIKE_OPEN_ANSWER", **_AT),
    _rule("q", "type = 'open_answer' AND low NOT LIKE '%transcreva duas afirma%' AND (low LIKE '%identifique as duas%' OR low LIKE '%indique a opção%')", "HIGH", "OPEN_ANSWER_SHOULD_BE_SELECTION", exp="'multiple_choice or multi_select'", act="'open_answer'", **_AT),
    _rule("q", "source_ref IS NOT NULL AND media IS NULL", "HIGH", "SOURCE_REFS_WITHOUT_MEDIA", **_AT),
    _rule("q", "regexp_matches(low, '\\b(documento|imagem)\\s+[a-z0-9]') AND source_ref IS NULL", "HIGH", "MENTIONS_SOURCE_WITHOUT_REF", **_AT),
    _rule("gaps", "true", "BLOCKER", "GROUP_NUMBER_GAP", grp="group_id", exp="array_to_string(every, ',')", act="array_to_string(found, ',')"),
    _rule("wants", "len(list_filter(wanted, lambda x: NOT list_contains(got, x))) > 0", "BLOCKER", "MISSING_EXPECTED_DOCUMENTS", exp="array_to_string(wanted, ',')", act="array_to_string(got, ',')", **_AT),
    *_MEDIA, *_CROP.values(),
)


@query(HISTORY_SQL)
def q_rules_history(spark: SparkSession, d: str) -> DataFrame:
    return rules.history(model(spark, d))


_III = {"qid": "question_id", "grp": "'grupo_iii'", "num": "number"}
PORTUGUESE_SQL = _issues(
    _SUBJECT.format("subject LIKE '%Portug%'") + f""", {_Q}, {_CROPS},
sums AS (SELECT sub.*, n, invalid, total, coalesce(has, '') AS has, many, items, optional FROM sub LEFT JOIN (SELECT root, count(*) AS n, count(*) FILTER (NOT coalesce(points > 0, false)) AS invalid, CAST(sum(points) FILTER (points > 0) AS BIGINT) AS total, string_agg(DISTINCT group_id, ',' ORDER BY group_id) AS has, count(*) FILTER (group_id = 'grupo_iii') AS many FROM q GROUP BY root) s USING (root)
    LEFT JOIN (SELECT root, count(*) AS items, count(*) FILTER (NOT mandatory) AS optional FROM policy GROUP BY root) p USING (root)),
third AS (SELECT q.*, year FROM q JOIN sub USING (root) WHERE group_id = 'grupo_iii' QUALIFY row_number() OVER (PARTITION BY root ORDER BY ord) = 1),
twice AS (SELECT *, row_number() OVER w AS nth, first_value(question_id) OVER w AS first_id FROM q WHERE group_id IS NOT NULL WINDOW w AS (PARTITION BY root, group_id, number ORDER BY ord)),
keyed AS (SELECT root, group_id, number, points, true AS there FROM q WHERE group_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY root, group_id, number ORDER BY ord DESC) = 1),
scored AS (SELECT root, count(*) FILTER (there IS NULL) AS missing, count(*) FILTER (there AND (k.points = p.points) IS NOT TRUE) AS differ FROM policy p LEFT JOIN keyed k USING (root, group_id, number) WHERE {_OF} GROUP BY root),
ids AS (SELECT root, asset_id, path FROM assets QUALIFY row_number() OVER (PARTITION BY root, asset_id ORDER BY ord DESC) = 1),
refs AS (SELECT q.*, ids.asset_id, ids.path FROM q LEFT JOIN ids ON ids.root = q.root AND ids.asset_id = asset_ref WHERE asset_ref IS NOT NULL)""",
    *(_rule("sums", f"NOT list_contains(string_split(has, ','), '{g}')", "BLOCKER", "PORTUGUESE_GROUP_MISSING", grp=f"'{g}'", exp="'grupo_i,grupo_ii,grupo_iii'", act="has") for g in ("grupo_i", "grupo_ii", "grupo_iii")),
    _rule("twice", "nth > 1", "HIGH", "PORTUGUESE_DUPLICATE_QUESTION_NUMBER", exp="'unique groupId+number'", act="first_id || ',' || question_id", **_AT),
    _rule("q", "coalesce(group_id, '') <> 'grupo_iii' AND low LIKE '%grupo iii%'", "BLOCKER", "PORTUGUESE_GROUP_III_EMBEDDED", **_AT),
    _rule("sums", "invalid > 0", "BLOCKER", "PORTUGUESE_POINTS_INVALID", exp="'integer > 0'", act="invalid"),
    _rule("sums", "invalid = 0 AND n > 0 AND total < 200", "HIGH", "PORTUGUESE_TOTAL_POINTS_TOO_LOW", exp="'>=200'", act="total"),
    _rule("sums", "invalid = 0 AND n > 0 AND total > 210 AND NOT pool", "HIGH", "PORTUGUESE_TOTAL_POINTS_TOO_HIGH", exp="'~200'", act="total"),
    _rule("scored", "missing > 0", "BLOCKER", "PORTUGUESE_SCORING_ITEM_MISSING", exp="'all scoringPolicy.items present'", act="missing"),
    _rule("scored", "differ > 0", "BLOCKER", "PORTUGUESE_SCORING_POINTS_MISMATCH", exp="'points from scoringPolicy.items'", act="differ"),
    _rule("q", "type = 'multiple_choice' AND n_options < 2", "HIGH", "PORTUGUESE_MC_WITHOUT_OPTIONS", **_AT),
    _rule("q", "type = 'multi_select' AND n_options < 3", "HIGH", "PORTUGUESE_MULTI_SELECT_WITHOUT_OPTIONS", **_AT),
    _rule("q", "type = 'multi_select' AND n_options >= 3 AND coalesce(max_selections, 0) NOT BETWEEN 2 AND n_options", "HIGH", "PORTUGUESE_MULTI_SELECT_INVALID_MAX", exp="'2..options_count'", act="coalesce(CAST(max_selections AS VARCHAR), 'None')", **_AT),
    _rule("q", "type = 'multi_blank_choice' AND (n_blanks < 2 OR n_last < 2)", "HIGH", "PORTUGUESE_MULTIBLANK_WITHOUT_OPTIONS", **_AT),
    _rule("sums", "many > 1", "HIGH", "PORTUGUESE_MULTIPLE_COMPOSITIONS"),
    _rule("third", "type NOT IN ('open_answer', 'essay')", "HIGH", "PORTUGUESE_COMPOSITION_WRONG_TYPE", **_III),
    _rule("third", "len(regexp_extract_all(low, '\\S+')) < 25 OR NOT (low LIKE '%texto%' OR low LIKE '%opini%' OR low LIKE '%exposi_ao%')", "HIGH", "PORTUGUESE_COMPOSITION_TRUNCATED", **_III),
    _rule("third", "(low LIKE '%cartoon%' OR low LIKE '%descrição da cena%') AND media IS NULL AND asset_ref IS NULL AND source_ref IS NULL", "HIGH", "PORTUGUESE_COMPOSITION_MISSING_VISUAL", **_III),
    *_MEDIA, _CROP["MISSING_SOURCE_CROP_FILE"], _CROP["SOURCE_WITHOUT_CROP"].replace("'HIGH'", "'MEDIUM'"),
    _rule("refs", "asset_id IS NULL", "HIGH", "PORTUGUESE_BROKEN_ASSET_REF", exp="'asset id in assets[]'", act="asset_ref", **_AT),
    _rule("refs", "path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM files f WHERE f.root = refs.root AND f.rel = path)", "HIGH", "PORTUGUESE_MISSING_ASSET_REF_FILE", exp="path", act="'missing'", **_AT),
    _rule("sums", "year IS NOT NULL AND NOT contains(title, CAST(year AS VARCHAR))", "HIGH", "PORTUGUESE_TITLE_YEAR_MISMATCH", exp="'year ' || year || ' in title'", act="title"),
    _rule("sources", f"{_OF} AND group_id IN ('grupo_i', 'grupo_ii') AND kind = 'text_source' AND trim(coalesce(text, '')) = '' AND crop IS NULL", "HIGH", "PORTUGUESE_TEXT_SOURCE_EMPTY", exp="'text or crop'", act="'empty'"),
    _rule("q", "parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM q o WHERE o.root = q.root AND (o.question_id = q.parent OR starts_with(o.question_id, q.parent || '_')))", "HIGH", "PORTUGUESE_BROKEN_PARENT", exp="'existing questionId'", act="parent", **_AT),
    _rule("sources", f"{_OF} AND page_start = 1", "HIGH", "PORTUGUESE_COVER_PAGE_AS_SOURCE", exp="'pageStart > 1'", act="page_start"),
    _rule("sums", "items > 0 AND (items < 8 OR coalesce(subtotal, 0) < 180)", "HIGH", "PORTUGUESE_SCORING_POLICY_INCOMPLETE", exp="'>=8 items and rawSubtotal>=180'", act="items || ' items, subtotal=' || coalesce(subtotal, 0)"),
    _rule("sums", "items > 0 AND policy_source = 'rebuilt_from_questions'", "MEDIUM", "PORTUGUESE_SCORING_POLICY_REBUILT", exp="'source=cotacoes (parsed from PDF)'", act="'source=rebuilt_from_questions'"),
    _rule("sums", "year < 2020 AND optional > 0", "HIGH", "PORTUGUESE_LEGACY_EXAM_HAS_OPTIONAL", exp="'all isMandatory for pre-2020'", act="optional"),
    _rule("third", "year BETWEEN 2008 AND 2014 AND coalesce(points, 0) <> 50", "HIGH", "PORTUGUESE_LEGACY_GRUPO_III_POINTS_INVALID", exp="'50'", act="coalesce(points, 0)"),
    _rule("q", "question_id LIKE '%\\_recovered%' ESCAPE '\\' AND coalesce(source_page, 0) = 0", "MEDIUM", "PORTUGUESE_RECOVERED_WITHOUT_SOURCE_PAGE", qid="question_id", exp="'sourcePage set'", act="'null'"),
)


@query(PORTUGUESE_SQL)
def q_rules_portuguese(spark: SparkSession, d: str) -> DataFrame:
    return rules.portuguese(model(spark, d))


_LOOK = ["PORTUGUESE_RECOVERED_WITHOUT_SOURCE_PAGE", "PORTUGUESE_SCORING_POLICY_REBUILT"]


@query(f"""WITH exam AS (WITH {MODEL_SQL} SELECT root, missing_pages FROM exams WHERE subject LIKE '%Portug%'), i AS ({PORTUGUESE_SQL}),
c AS (SELECT root, missing_pages, count(*) FILTER (severity = 'BLOCKER') AS blocker, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'INFO') AS info, bool_or(code IN ('{_LOOK[0]}', '{_LOOK[1]}')) AS look FROM exam LEFT JOIN i USING (root) GROUP BY root, missing_pages),
v AS (SELECT *, CASE WHEN blocker + high > 0 THEN 'FAIL' WHEN medium > 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM c)
SELECT root, blocker, high, medium, info, verdict, CASE WHEN verdict = 'FAIL' THEN 'needs_review' WHEN missing_pages THEN 'partial_failed' WHEN verdict = 'REVIEW' THEN 'completed_with_warnings' ELSE 'completed' END AS status,
CASE WHEN verdict = 'FAIL' OR missing_pages THEN true WHEN verdict = 'REVIEW' THEN look ELSE false END AS needs_review FROM v""")
def q_audit_gate(spark: SparkSession, d: str) -> DataFrame:
    """The audit's verdict, and the exam's status after it."""
    ex = model(spark, d)
    return rules.gate(rules.subject(ex, "portug"), rules.portuguese(ex), _LOOK)


@query(f"""WITH i AS ({HISTORY_SQL}), exam AS (WITH {MODEL_SQL} SELECT root FROM exams WHERE subject LIKE '%Hist%'),
c AS (SELECT root, count(*) FILTER (severity = 'BLOCKER') AS blocker, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'INFO') AS info FROM exam LEFT JOIN i USING (root) GROUP BY root)
SELECT *, CASE WHEN blocker > 0 THEN 'FAIL' WHEN high + medium > 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM c""")
def q_audit_summary(spark: SparkSession, d: str) -> DataFrame:
    """The report's summary of the history audit: here only blockers fail."""
    ex = model(spark, d)
    n = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    out = rules.subject(ex, "hist").select("root").join(rules.history(ex), "root", "left").groupBy("root").agg(*map(n, ("BLOCKER", "HIGH", "MEDIUM", "INFO")))
    return out.withColumn("verdict", F.when(F.col("blocker") > 0, "FAIL").when(F.col("high") + F.col("medium") > 0, "REVIEW").otherwise("PASS"))


_CORRUPT = " OR ".join(f"contains(statement, {x})" for x in ("'□'", "'�'", "chr(31)", "chr(30)", "'^ h'", "'] g'", "' b l'", "'[45::47;5u'"))
_LOST = f"({_CORRUPT} OR (len(regexp_extract_all(coalesce(statement, ''), '\\S+')) > 8 AND len(list_filter(regexp_extract_all(coalesce(statement, ''), '\\S+'), lambda x: length(x) = 1)) > 0.35 * len(regexp_extract_all(coalesce(statement, ''), '\\S+'))))"
_FIRST = """firsts AS (SELECT root, asset_id, type AS first_type, n_rows FROM assets QUALIFY row_number() OVER (PARTITION BY root, asset_id ORDER BY ord) = 1),
lasts AS (SELECT root, asset_id, crop_status FROM assets QUALIFY row_number() OVER (PARTITION BY root, asset_id ORDER BY ord DESC) = 1)"""
_REFS = "refs AS (SELECT * FROM (SELECT root, ord, question_id, number, t, 1 AS k, image_ref AS ref FROM q UNION ALL SELECT root, ord, question_id, number, t, 2, table_ref FROM q UNION ALL SELECT root, ord, question_id, number, t, 3, asset_ref FROM q) WHERE ref IS NOT NULL)"
_QV = f"q AS (SELECT questions.*, total_pages, {_TEXT} AS t FROM questions JOIN exams USING (root))"
_NO_TABLE = "first_type IS NULL OR (first_type <> 'embedded_image' AND n_rows = 0)"
VALIDATOR_SQL = _issues(
    f"""{_QV}, {_REFS}, {_FIRST},
main AS (SELECT root, bool_or(group_id IS NOT NULL) AS grouped, list_sort(list(DISTINCT CAST(number AS INT)) FILTER (number NOT LIKE '%.%' AND (parent IS NULL OR is_group))) AS found FROM questions GROUP BY root),
flat AS (SELECT root, found FROM main WHERE NOT grouped AND len(found) > 0),
gaps AS (SELECT root, unnest(range(1, found[-1] + 1)) AS n, found FROM flat),
seen AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS root, CAST(n AS INT) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(chr(10) || text, '\\n[\\s]*(\\d{{1,2}})\\.\\s+\\S', 1)) AS n FROM conversations)),
held AS (SELECT root, asset_ref AS ref FROM sources WHERE asset_ref IS NOT NULL UNION ALL SELECT root, ref FROM refs),
loose AS (SELECT * FROM assets a WHERE type <> 'embedded_image' AND parent_asset IS NULL AND NOT linked AND NOT EXISTS (SELECT 1 FROM held h WHERE h.root = a.root AND h.ref = a.asset_id) AND NOT EXISTS (SELECT 1 FROM refs h WHERE h.root = a.root AND starts_with(h.ref, a.asset_id || '_'))),
boxes AS (SELECT root, count(*) FILTER (NOT estimated) AS none, count(*) FILTER (estimated) AS guessed FROM assets WHERE n_bbox = 0 AND type NOT IN ('table', 'text_source', 'document_excerpt', 'formula_block', 'embedded_image') GROUP BY root),
unpaid AS (SELECT root, count(*) AS n FROM questions WHERE number NOT LIKE '%.%' AND parent IS NULL AND points IS NULL AND NOT is_group GROUP BY root)""",
    _rule("q", "coalesce(source_page, 0) < 1 OR (total_pages > 0 AND source_page > total_pages)", "", "INVALID_PAGE", act="coalesce(CAST(source_page AS VARCHAR), 'None')", **_NUM),
    _rule("q", "region_page IS NOT NULL AND (region_page <> coalesce(source_page, 0) OR n_bbox <> 4)", "", "INVALID_REGION", **_NUM),
    _rule("q", "points > 0 AND points < 3 AND type NOT IN ('multiple_choice', 'group')", "", "SUSPICIOUS_POINTS", act="points", **_NUM),
    _rule("q", f"type = 'multiple_choice' AND math_heavy AND {_LOST}", "", "CORRUPT_MATH_TEXT", **_NUM),
    _rule("(SELECT DISTINCT root, ord, question_id, number, t, ref FROM refs) r", "starts_with(ref, 'figura_') AND regexp_matches(t, '[Ff]igura\\s+\\d') AND NOT list_contains(regexp_extract_all(t, '[Ff]igura\\s+(\\d+)', 1), regexp_extract(ref, '^figura_(\\d+)', 1))", "", "WRONG_ASSET_REFERENCE", act="ref", **_NUM),
    _rule("refs", "NOT EXISTS (SELECT 1 FROM assets a WHERE a.root = refs.root AND a.asset_id = ref) AND NOT EXISTS (SELECT 1 FROM sources s WHERE s.root = refs.root AND s.source_id = ref)", "", "BROKEN_REF", act="ref", **_NUM),
    _rule("q", "parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM questions o WHERE o.root = q.root AND o.question_id = q.parent)", "", "BROKEN_PARENT", act="parent", **_NUM),
    _rule("(SELECT refs.*, first_type, n_rows FROM refs LEFT JOIN firsts ON firsts.root = refs.root AND asset_id = ref WHERE k = 2)", _NO_TABLE, "", "MISSING_TABLE_DATA", act="ref", **_NUM),
    _rule("(SELECT refs.*, crop_status FROM refs JOIN lasts ON lasts.root = refs.root AND asset_id = ref WHERE k < 3)", "crop_status IS DISTINCT FROM 'success'", "high", "MISSING_ASSET_CROP", act="ref", **_NUM),
    _rule("loose", "true", "", "CASE WHEN EXISTS (SELECT 1 FROM questions WHERE questions.root = loose.root AND source_page = page) THEN 'POSSIBLE_HALLUCINATION' ELSE 'SOURCE_ASSET_PENDING_REFERENCE' END", act="asset_id"),
    _rule("boxes", "none > 0", "", "MISSING_BBOX", act="none"), _rule("boxes", "guessed > 0", "", "ESTIMATED_BBOX_ONLY", act="guessed"),
    _rule("flat", "len(found) <> found[-1]", "high", "QUESTION_COUNT_MISMATCH", exp="found[-1]", act="len(found)"),
    _rule("gaps", "NOT list_contains(found, n)", "critical", "MISSING_QUESTION", num="n"),
    _rule("seen", "n BETWEEN 1 AND 30 AND root IN (SELECT root FROM main WHERE NOT grouped) AND NOT EXISTS (SELECT 1 FROM questions o WHERE o.root = seen.root AND o.number = CAST(seen.n AS VARCHAR))", "critical", "MISSING_QUESTION", num="n", act="'in text'"),
    _rule("unpaid", "true", "high", "MISSING_POINTS_CRITICAL", act="n"),
)


@query(VALIDATOR_SQL)
def q_rules_validator(spark: SparkSession, d: str) -> DataFrame:
    return rules.validator(model(spark, d), pages(spark, d).select(F.col("exam_id").cast("string").alias("root"), "text"))


@query(f"""WITH {MODEL_SQL}, {_QV}, {_REFS}, {_FIRST},
found AS (SELECT refs.root, refs.ord, bool_or((k = 2 AND ({_NO_TABLE})) OR (k < 3 AND lasts.root IS NOT NULL AND crop_status IS DISTINCT FROM 'success')) AS look FROM refs LEFT JOIN firsts ON firsts.root = refs.root AND firsts.asset_id = ref LEFT JOIN lasts ON lasts.root = refs.root AND lasts.asset_id = ref GROUP BY refs.root, refs.ord),
merged AS (SELECT root, ord, string_agg(DISTINCT ref, ',' ORDER BY ref) AS asset_refs FROM refs GROUP BY root, ord),
types AS (SELECT DISTINCT refs.root, refs.ord, a.type FROM refs JOIN assets a ON a.root = refs.root AND asset_id = ref)
SELECT q.root, q.ord, question_id, coalesce(asset_refs, '') AS asset_refs, asset_refs IS NOT NULL AS visual, EXISTS (SELECT 1 FROM types t WHERE t.root = q.root AND t.ord = q.ord AND t.type = 'geometry_diagram') AS has_diagram,
EXISTS (SELECT 1 FROM types t WHERE t.root = q.root AND t.ord = q.ord AND t.type = 'graph') AS has_graph, coalesce((math_heavy AND (confidence < 90 OR (type = 'multiple_choice' AND {_LOST}))), false) OR coalesce(look, false) AS needs_review
FROM q LEFT JOIN merged ON merged.root = q.root AND merged.ord = q.ord LEFT JOIN found ON found.root = q.root AND found.ord = q.ord""")
def q_review_flags(spark: SparkSession, d: str) -> DataFrame:
    return rules.reviewed(model(spark, d))


@query(f"""WITH {MODEL_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY root, question_id ORDER BY ord) AS nth, question_id || '_p' || coalesce(source_page, 0) AS renamed FROM questions)
SELECT n.root, n.ord, n.question_id, CASE WHEN n.nth > 1 THEN n.renamed ELSE n.question_id END AS new_id, coalesce(s.renamed, n.parent) AS parent FROM n LEFT JOIN n s ON s.root = n.root AND s.question_id = n.parent AND s.nth = 2""")
def q_fix_question_ids(spark: SparkSession, d: str) -> DataFrame:
    return rules.unique_question_ids(model(spark, d).questions)


_ASSET_IDS = f"{MODEL_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY root, asset_id ORDER BY ord) AS nth, asset_id || '_' || (row_number() OVER (PARTITION BY root ORDER BY ord) - 1) AS renamed FROM assets)"


@query(f"WITH {_ASSET_IDS} SELECT root, ord, asset_id, CASE WHEN nth > 1 THEN renamed ELSE asset_id END AS new_id FROM n")
def q_fix_asset_ids(spark: SparkSession, d: str) -> DataFrame:
    ex = model(spark, d)
    return rules.unique_asset_ids(ex.assets, ex.questions.select("root", "ord", F.explode("image_refs").alias("ref")))[0]


@query(f"WITH {_ASSET_IDS} SELECT q.root, q.ord, image_ref AS ref, coalesce(renamed, image_ref) AS new_ref FROM questions q LEFT JOIN n ON n.root = q.root AND n.asset_id = image_ref AND nth = 2 WHERE image_ref IS NOT NULL")
def q_fix_asset_refs(spark: SparkSession, d: str) -> DataFrame:
    ex = model(spark, d)
    return rules.unique_asset_ids(ex.assets, ex.questions.select("root", "ord", F.explode("image_refs").alias("ref")))[1]


_MATCHED = f"""{MODEL_SQL}, q AS (SELECT *, coalesce(group_id, '') AS gid, question_id IN (SELECT question_id FROM criteria c WHERE c.root = questions.root) AS matched FROM questions),
grouped AS (SELECT DISTINCT root FROM q WHERE gid <> '')"""
CRITERIA_SQL = f"""WITH {_MATCHED}, qu AS (SELECT * FROM q WHERE NOT coalesce(matched, false) QUALIFY row_number() OVER (PARTITION BY root, question_id ORDER BY ord DESC) = 1),
lastq AS (SELECT root, question_id, points AS q_points FROM questions QUALIFY row_number() OVER (PARTITION BY root, question_id ORDER BY ord DESC) = 1),
named AS (SELECT qu.*, CASE WHEN gid = '' AND root IN (SELECT root FROM grouped) THEN 'CRITERIA_QUESTION_NOT_GROUPED' WHEN EXISTS (SELECT 1 FROM q o WHERE o.matched AND o.root = qu.root AND o.gid = qu.gid AND o.number = qu.number) THEN 'CRITERIA_QUESTION_DUPLICATE' ELSE 'CRITERIA_ITEM_MISSING' END AS code FROM qu),
found AS ({" UNION ALL ".join([
    _rule("(SELECT DISTINCT root, gid FROM q WHERE gid <> '') g", "NOT EXISTS (SELECT 1 FROM criteria c WHERE c.root = g.root AND c.group_id = gid)", "high", "CRITERIA_GROUP_MISSING", grp="gid"),
    _rule("named", "true", "CASE WHEN code = 'CRITERIA_ITEM_MISSING' THEN 'high' ELSE 'medium' END", "CASE WHEN true THEN code END", qid="question_id", grp="gid", num="number"),
    _rule("criteria", "type = 'multiple_choice' AND coalesce(v1, '') = ''", "blocker", "CRITERIA_MC_NO_ANSWER", grp="group_id", num="number"),
    _rule("criteria JOIN lastq USING (root, question_id)", "points <> q_points", "high", "CRITERIA_POINTS_MISMATCH", grp="group_id", num="number", exp="points", act="q_points"),
])}) SELECT root, severity, code, lower(replace(code, '_', ' ')) AS message, question_id, "group", number, expected, actual FROM found"""  # fmt: skip


@query(CRITERIA_SQL)
def q_rules_criteria(spark: SparkSession, d: str) -> DataFrame:
    return rules.criteria(model(spark, d))


@query(f"""WITH {_MATCHED}, a AS (SELECT root, count(*) FILTER (matched) AS matched, count(*) FILTER (NOT coalesce(matched, false)) AS unmatched, coalesce(string_agg(DISTINCT group_id, ',' ORDER BY group_id), '') AS exam_groups FROM q GROUP BY root),
c AS (SELECT root, count(*) AS items, coalesce(string_agg(DISTINCT group_id, ',' ORDER BY group_id) FILTER (group_id <> ''), '') AS criteria_groups FROM criteria GROUP BY root)
SELECT root, coalesce(items, 0) AS items, coalesce(matched, 0) AS matched, coalesce(unmatched, 0) AS unmatched, coalesce(exam_groups, '') AS exam_groups, coalesce(criteria_groups, '') AS criteria_groups FROM a FULL JOIN c USING (root)""")
def q_criteria_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rules.coverage(model(spark, d))


@query(f"""WITH {_MATCHED} SELECT root, CASE WHEN blocker + high > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, blocker, high FROM (SELECT root, count(*) FILTER (severity = 'blocker') AS blocker, count(*) FILTER (severity = 'high') AS high FROM (SELECT DISTINCT root FROM questions) e LEFT JOIN ({CRITERIA_SQL}) i USING (root) GROUP BY root)""")
def q_criteria_verdict(spark: SparkSession, d: str) -> DataFrame:
    ex = model(spark, d)
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    out = ex.questions.select("root").distinct().join(rules.criteria(ex), "root", "left").groupBy("root").agg(n("blocker"), n("high"))
    return out.select("root", F.when(F.col("blocker") + F.col("high") > 0, "FAIL").otherwise("PASS").alias("verdict"), "blocker", "high")


@query(f"""WITH {MODEL_SQL}, e(t, allowed, wanted) AS (VALUES
    ('os documentos 1 a 2 e documento 3', [1, 2, 3], [1, 2, 3]), ('documentos 2 a 1', [1, 2], [1, 2]), ('documento 1; ver documento 3', [1, 2, 3], [1, 3]), ('documentos 1 a 3', [1, 2], [1, 2]), ('cada um dos documentos', [1, 2], [1, 2]),
    ('Dos documentos apresentados', [4, 5], [4, 5]), ('documento 4', [1, 2], []), ('documento 4', [], [4]), ('docs 1, 2 e 3', [1, 3], [1, 3]), ('sem mais', [1], []))
SELECT root, ord, array_to_string(wanted, ',') AS docs FROM (SELECT root, ord, list_value('os documentos 1 a 2 e documento 3', 'documentos 2 a 1', 'documento 1; ver documento 3', 'documentos 1 a 3', 'cada um dos documentos', 'Dos documentos apresentados', 'documento 4', 'documento 4', 'docs 1, 2 e 3', 'sem mais')[1 + CAST(ord + CAST(root AS BIGINT) AS BIGINT) % 10] AS t, CAST(ord + CAST(root AS BIGINT) AS BIGINT) % 10 AS k FROM questions) q JOIN e ON q.t = e.t AND (k <> 6 OR len(allowed) > 0) AND (k <> 7 OR len(allowed) = 0)""")
def q_document_references(spark: SparkSession, d: str) -> DataFrame:
    """Documents that each question's text refers to, of those allowed; the SQL holds hand-traced values for each text."""
    cases = [("os documentos 1 a 2 e documento 3", [1, 2, 3]), ("documentos 2 a 1", [1, 2]), ("documento 1; ver documento 3", [1, 2, 3]), ("documentos 1 a 3", [1, 2]), ("cada um dos documentos", [1, 2]), ("Dos documentos apresentados", [4, 5]), ("documento 4", [1, 2]), ("documento 4", []), ("docs 1, 2 e 3", [1, 3]), ("sem mais", [1])]
    listed = F.array(*(F.struct(F.lit(t).alias("t"), F.array(*map(F.lit, a)).cast("array<int>").alias("a")) for t, a in cases))
    q = model(spark, d).questions.select("root", "ord", listed[((F.col("ord") + F.col("root").cast("bigint")) % len(cases)).cast("int")].alias("c"))
    return q.select("root", "ord", F.array_join(scoring_text.document_references(F.col("c.t"), F.col("c.a")).cast("array<string>"), ",").alias("docs"))


@query(f"""WITH v AS ({VALIDATOR_SQL}), r AS ({ORACLE_SQL["q_review_flags"]}), {MODEL_SQL},
w AS (SELECT root, bool_or(code IN ({", ".join(f"'{c}'" for c in rules.REVIEW_CODES)}) OR lower(severity) IN ('critical', 'high')) AS grave, bool_or(code IN ({", ".join(f"'{c}'" for c in rules.WARNING_CODES)})) AS light FROM v GROUP BY root),
a AS (SELECT q.root, bool_or(text_status IN ('needs_review', 'corrupt') AND math_heavy) AS doubt, bool_or(needs_review) AS open_ FROM questions q JOIN r ON r.root = q.root AND r.ord = q.ord GROUP BY q.root),
s AS (SELECT e.root, CASE WHEN missing_pages THEN 'partial_failed' WHEN coalesce(grave, false) OR coalesce(doubt, false) THEN 'needs_review' WHEN coalesce(open_, false) OR coalesce(light, false) THEN 'completed_with_warnings' ELSE 'completed' END AS status FROM exams e LEFT JOIN w ON w.root = e.root LEFT JOIN a ON a.root = e.root)
SELECT root, status, status IN ('partial_failed', 'needs_review') AS review FROM s""")
def q_processing_status(spark: SparkSession, d: str) -> DataFrame:
    """Each exam's status by all that the validator and the reviews found."""
    ex = model(spark, d)
    warnings = rules.validator(ex, pages(spark, d).select(F.col("exam_id").cast("string").alias("root"), "text"))
    q = rules.reviewed(ex, "text_status", "math_heavy").select("root", "needs_review", "text_status", F.col("math_heavy").alias("math_review"))
    return rules.processing_status(ex.exams, warnings, q)
