"""Queries over the pages and blocks of exams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import nearness as N
from ..sources.exams import MODEL_SQL, _cases, _pick, _select, made, model, numbered
from ..sources.layout import LAYOUT_SQL, layout
from .registry import query

_STRIPPED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
#: Skipped are the last pages of exams whose number five divides.
_SEGMENTS = f"""WITH {MODEL_SQL}, {LAYOUT_SQL}, heights AS (SELECT root, page, 842.0 - 100 * (page % 2) AS height FROM (SELECT DISTINCT root, page FROM blocks)),
lines AS (SELECT *, CASE WHEN contains(t, chr(10)) THEN trim(split_part(t, chr(10), 1)) ELSE left(t, 80) END AS l FROM (SELECT *, {_STRIPPED} AS t FROM blocks WHERE type = 'text' AND text IS NOT NULL AND NOT (page = 4 AND CAST(root AS BIGINT) % 5 = 0)) WHERE length(t) >= 4),
told AS (SELECT *, CASE WHEN regexp_matches(l, '{L.LISTED}') THEN NULL WHEN regexp_matches(l, '{L.SUB}') THEN 'sub_question' WHEN regexp_matches(l, '{L.MAIN}') THEN 'main_question' WHEN regexp_matches(l, '{L.GROUP}') THEN 'group' WHEN regexp_matches(l, '{L.ITEM}') THEN 'item' END AS method FROM lines),
named AS (SELECT *, CASE method WHEN 'sub_question' THEN regexp_extract(l, '{L.SUB}', 1) WHEN 'main_question' THEN regexp_extract(l, '{L.MAIN}', 1) WHEN 'group' THEN 'Grupo ' || regexp_extract(l, '{L.GROUP}', 1) WHEN 'item' THEN 'Item ' || regexp_extract(l, '{L.ITEM}', 1) END AS number FROM told WHERE method IS NOT NULL),
begun AS (SELECT *, last_value(CASE WHEN method = 'group' THEN number END IGNORE NULLS) OVER (PARTITION BY root ORDER BY page, pos ROWS UNBOUNDED PRECEDING) AS scope, lead(y0) OVER (PARTITION BY root, page ORDER BY pos) AS next_y FROM named WHERE method <> 'main_question' OR CAST(number AS INT) <= 30),
ranked AS (SELECT *, row_number() OVER (PARTITION BY root, scope, number ORDER BY page, pos) AS again FROM begun),
kept AS (SELECT r.*, coalesce(next_y - 2, h.height) AS y1 FROM ranked r JOIN heights h ON h.root = r.root AND h.page = r.page WHERE again = 1)"""


def _skipped(blocks: DataFrame) -> DataFrame:
    return blocks.filter("page = 4 AND CAST(root AS BIGINT) % 5 = 0").select("root", "page")


def _segments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    blocks = layout(spark, d).blocks
    heights = blocks.select("root", "page").distinct().withColumn("height", F.lit(842.0) - 100 * (F.col("page") % 2))
    return L.segments(blocks, heights, _skipped(blocks))


@query(f"""{_SEGMENTS} SELECT root, page, pos, scope, number, method, y0, CAST(y1 AS DOUBLE) AS y1, coalesce((SELECT string_agg(CAST(b.pos AS VARCHAR), ',' ORDER BY b.pos) FROM blocks b WHERE b.root = kept.root AND b.page = kept.page AND b.y0 >= kept.y0 - 5 AND b.y0 < kept.y1), '') AS block_ids,
CASE WHEN method IN ('main_question', 'sub_question') THEN 0.92 ELSE 0.85 END::DOUBLE AS confidence, CASE WHEN method = 'sub_question' THEN regexp_replace(number, '\\.\\d+$', '') END AS parent, method = 'group' AS is_group FROM kept""")
def q_segments(spark: SparkSession, d: str) -> DataFrame:
    """Questions, parts, groups and items that blocks begin, with their regions and the blocks in them."""
    return _segments(spark, d)[0].withColumn("block_ids", F.concat_ws(",", F.col("block_ids").cast("array<string>")))


@query(f"{_SEGMENTS} SELECT root, page, scope, number FROM ranked WHERE again > 1")
def q_segment_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that come again in their group."""
    return _segments(spark, d)[1]


@query(f"""WITH {MODEL_SQL}, {LAYOUT_SQL}, starts AS (SELECT root, page, number, first(y0 ORDER BY pos) AS y0 FROM (SELECT *, regexp_extract({_STRIPPED}, '^(\\S+)\\.\\s+\\S', 1) AS number FROM blocks) WHERE number <> '' GROUP BY root, page, number),
bottoms AS (SELECT root, page, CASE WHEN max(y0 + height) > 0 THEN max(y0 + height) ELSE 842 END AS bottom FROM blocks GROUP BY root, page),
met AS (SELECT q.root, q.ord, s.page, s.y0, bottom, coalesce(lead(s.y0) OVER (PARTITION BY s.root, s.page ORDER BY s.y0, q.ord), bottom) AS e FROM questions q JOIN starts s ON s.root = q.root AND s.page = q.source_page AND s.number = q.number JOIN bottoms b ON b.root = s.root AND b.page = s.page)
SELECT root, ord, page, round(y0, 2) AS y0, round(CASE WHEN e <= y0 THEN least(bottom, y0 + 180) ELSE e END, 2) AS y1 FROM met""")
def q_question_regions(spark: SparkSession, d: str) -> DataFrame:
    """The region of each question whose number begins a block of its page."""
    return L.question_regions(model(spark, d).questions.withColumnRenamed("source_page", "page"), layout(spark, d).blocks)


#: Labels and images with places, of a lineitem row.
_LABELS = {"root": "CAST(l_orderkey AS STRING)", "page": f"1 + {_pick(1, 3, 5, 2)}", "label_id": "ord", "x0": f"CAST({_pick(3, 7, 1, 500)} AS DOUBLE)", "x1": f"CAST({_pick(3, 7, 1, 500)} + 30 AS DOUBLE)", "y0": f"CAST({_pick(5, 1, 7, 800)} AS DOUBLE)"}
_IMAGES = {
    "root": "CAST(l_orderkey AS STRING)", "page": f"1 + {_pick(3, 1, 1, 2)}", "pos": "ord", "asset_id": "'i' || CAST(ord AS STRING)", "x": f"CAST({_pick(7, 3, 1, 500)} AS DOUBLE)", "y": f"CAST({_pick(1, 5, 3, 900)} - 50 AS DOUBLE)",
    "width": f"CAST({_pick(5, 3, 1, 90)} AS DOUBLE)", "height": f"CAST({_pick(5, 1, 3, 300)} AS DOUBLE)",
}


@query(f"""WITH {MODEL_SQL}, labels AS (SELECT {_select(_LABELS)} FROM li), images AS (SELECT {_select(_IMAGES)} FROM li)
SELECT l.root, l.page, label_id, first(asset_id ORDER BY pos) AS asset_id FROM labels l JOIN images i ON i.root = l.root AND i.page = l.page AND y + height >= y0 - 80 AND y < y0 + 20 AND abs(x + width / 2 - (x0 + x1) / 2) < 0.4 * 595 GROUP BY l.root, l.page, label_id""")
def q_images_of_labels(spark: SparkSession, d: str) -> DataFrame:
    """The first image beside or above each label."""
    li = numbered(spark, d)
    labels, images = made(li, _LABELS), made(li, _IMAGES)
    return N.images_of_labels(labels, images, labels.select("root", "page").distinct().withColumn("width", F.lit(595.0)))


#: Four or more labels for each lineitem row, k = 0 .. 4.
_MARKS = {"root": "CAST(l_orderkey AS STRING)", "ord": "ord", "letter": f"{_cases('k', ['A', 'B', 'C', 'D', 'A'])}", "x": "CAST((l_partkey * 7 + l_suppkey + k * 97) % 400 AS DOUBLE)", "y": "CAST((l_partkey + l_suppkey * 3 + k * k * 31) % 120 AS DOUBLE)"}


@query(f"""WITH RECURSIVE {MODEL_SQL}, marks AS (SELECT {_select(_MARKS)} FROM li, (SELECT unnest([0, 1, 2, 3, 4]) AS k)), firsts AS (SELECT root, ord, letter, min({{'y': y, 'x': x}}) AS spot FROM marks WHERE NOT (letter = 'D' AND ord = 2) GROUP BY root, ord, letter),
sorted AS (SELECT root, ord, letter, spot.x AS x, spot.y AS y, row_number() OVER (PARTITION BY root, ord ORDER BY spot.y, spot.x, letter) AS i, count(*) OVER (PARTITION BY root, ord) AS n FROM firsts),
walk AS (SELECT root, ord, letter, x, y, i, 1 AS row_, y AS top FROM sorted WHERE i = 1 AND n = 4 UNION ALL SELECT s.root, s.ord, s.letter, s.x, s.y, s.i, CASE WHEN s.y - top >= 45 THEN row_ + 1 ELSE row_ END, CASE WHEN s.y - top >= 45 THEN s.y ELSE top END FROM walk w JOIN sorted s ON s.root = w.root AND s.ord = w.ord AND s.i = w.i + 1)
SELECT root, ord, CAST(row_ AS BIGINT) AS row, row_number() OVER (PARTITION BY root, ord, row_ ORDER BY x, y, letter) AS "column", letter FROM walk""")
def q_label_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows and columns that the labels of options stand in."""
    marks = made(numbered(spark, d).withColumn("k", F.explode(F.array(*map(F.lit, range(5))))), _MARKS)
    return N.label_rows(marks.filter("NOT (letter = 'D' AND ord = 2)"))
