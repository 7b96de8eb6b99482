"""Pages, blocks and placed assets of exams over the driver tables, for what is read off a page's layout.

As in `exams`, every scalar is one expression that Spark and the SQL of the tests share.  An exam (order) has three
blocks for each of its lineitem rows, five to a page, and eight pages of text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exams import _cases, _select, made, numbered, rooted

_AT = "((ord - 1) * 3 + k)"


def _pick(p: int, q: int, r: int, m: int) -> str:
    return f"((l_partkey * {p} + l_suppkey * {q} + l_orderkey * {r} + pos) % {m})"


def _told(i: int, m: int) -> str:
    return f"((o_orderkey * {2 * i + 3} + o_custkey * {i + 1} + page * {5 * i + 7}) % {m})"


#: Texts of blocks; head and n are columns before them.
_BLOCK_TEXTS = [
    "n || '. Explique a ideia principal do texto.'", "n || '. Explique o que a imagem mostra.'", "n || '.1. Indique duas causas do problema.'", "n || '.2.1.  Refira uma causa.'",
    "head || chr(10) || '1. Leia'", "'2. igual'", "n || '. x'", "'  45. Nota de rodapé do texto'", "'item ' || n || ' do texto'", "'Texto corrido, sem número.'",
    "n || '. Observe' || chr(10) || 'o mapa'", "NULL", "chr(10) || ' ' || n || '. Calcule a soma' || chr(10) || '3. igual'", "'abc'",
]

#: Blocks: scalars by name, of a lineitem row and k = 0, 1, 2.
BLOCK = {
    "root": "CAST(l_orderkey AS STRING)", "pos": _AT, "page": "1 + CAST((pos - pos % 5) / 5 AS BIGINT)", "n": f"CAST(1 + {_pick(3, 1, 5, 7)} AS STRING)", "head": _cases(_pick(11, 1, 1, 4), ["GRUPO I", "Grupo II", " grupo III", "Grupo IV"]), "type": f"CASE WHEN {_pick(5, 3, 1, 11)} = 0 THEN 'image' ELSE 'text' END",
    "x0": f"CAST(30 + {_pick(1, 7, 1, 5)} * 60 AS DOUBLE)", "y0": f"CAST(40 + 150 * (pos % 5) - CASE WHEN {_pick(3, 1, 1, 13)} = 0 THEN 170 ELSE 0 END + {_pick(1, 1, 7, 9)} AS DOUBLE)", "height": f"CAST(20 + {_pick(1, 3, 7, 40)} AS DOUBLE)",
    "text": f"CASE {_pick(7, 5, 3, len(_BLOCK_TEXTS))} " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_BLOCK_TEXTS)) + " END",
}

#: Texts of pages: a heading and a body, each of one of these.
_HEADS = ["", "", "", "GRUPO I", "Grupo II", "Grupo III", "COTAÇÕES", ""]
_BODIES = ["texto corrido", "Documento 1", "Documento 2 (carta de 1910)", "documento 03 (mapa) e Documento 1", "DOCUMENTO 12", "Distribuição pelo norte e pelo sul", "", "Documento 99999999999999999999"]
PAGE = {"root": "CAST(o_orderkey AS STRING)", "page": "page", "text": f"{_cases(_told(1, len(_HEADS)), _HEADS)} || chr(10) || {_cases(_told(2, len(_BODIES)), _BODIES)}"}

#: Assets with their places, of a lineitem row.
PLACED = {
    "root": "CAST(l_orderkey AS STRING)", "asset_id": "'a' || CAST(ord AS STRING)", "page": "1 + (l_partkey * 3 + l_orderkey + ord) % 8", "type": _cases("(l_partkey + l_suppkey * 5 + ord) % 7", ["embedded_image", "table", "graph", "map", "photo", "text_source", "photo"]),
    "x": "CASE WHEN (l_partkey + ord) % 6 = 0 THEN NULL ELSE CAST((l_partkey * 7 + ord) % 300 AS DOUBLE) END", "y": "CASE WHEN (l_partkey + ord) % 6 = 0 THEN NULL ELSE CAST((l_suppkey * 11 + ord) % 5 * 100 AS DOUBLE) END",
}

LAYOUT_SQL = f"""blocks AS (SELECT {_select(BLOCK)} FROM li, (SELECT unnest([0, 1, 2]) AS k)), pages AS (SELECT {_select(PAGE)} FROM orders, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS page)), placed AS (SELECT {_select(PLACED)} FROM li)"""


@dataclass
class Layout:
    blocks: DataFrame
    pages: DataFrame
    assets: DataFrame


def layout(spark: SparkSession, d: str) -> Layout:
    """blocks(root, pos, page, type, x0, y0, height, text, ..), pages(root, page, text) and assets(root, asset_id, page, type, x, y)."""
    li = numbered(spark, d)
    pages = rooted(spark, d).withColumn("page", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(8).cast("bigint"))))
    blocks = li.withColumn("k", F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(3)))))
    return Layout(made(blocks, BLOCK), made(pages, PAGE), made(li, PLACED))
