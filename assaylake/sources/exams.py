"""An exam model over the driver tables: exams, questions, assets, sources, files, scoring items and criteria.

Every scalar is one expression that Spark and the SQL of the tests share; Spark alone builds lists of them.
Exams are orders, and questions, assets, sources, files and scoring items come from their lineitem rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import dealt_once
from .tables import ORDER, table

#: Statements, by number; each sets off one or more rules, or none.
STATEMENTS = [
    "Explique a ideia principal do texto e justifique com dois exemplos.",
    "Complete o texto com as expressões adequadas a cada espaço.",
    "Identifique as duas afirmações verdadeiras sobre o autor.",
    "Qual é a opção correta? (A) uma (B) duas (C) três (D) quatro",
    "Observe a Figura 3 e a Figura 4 e indique a opção correta.",
    "Refira o que mostra o documento 1 e o documento 3.",
    "Compare os documentos 1 a 3 quanto ao tema.",
    "Compare os documentos 1, 2 e 4 quanto ao tema.",
    "A partir dos documentos, caracterize a época descrita.",
    "Curto.",
    "Que � sinal é este no texto?",
    "Porquê? Como? Quando? Onde? Para quem?",
    "□ valor de x na expressão dada",
    "a b c d e f g h i j",
    "Grupo III: escreva um texto de opinião sobre a leitura nas escolas portuguesas de hoje, com um mínimo de cento e oitenta palavras e com argumentos que sustentem bem o seu ponto de vista.",
    "Elabore a descrição da cena que vê no cartoon.",
    "Transcreva duas afirmações do texto que o provem; assinale a melhor.",
]

_ROW = "l_partkey * {} + l_suppkey * {} + l_orderkey * {} + ord"


def _pick(p: int, q: int, r: int, m: int) -> str:
    """A number from 0 to m - 1 that depends on the row."""
    return f"(({_ROW.format(p, q, r)}) % {m})"


def _cases(what: str, values: list[str | None]) -> str:
    quoted = ["NULL" if v is None else f"'{v}'" for v in values]
    return f"CASE {what} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END"


TYPES = ["multiple_choice", "multi_select", "multi_blank_choice", "matching", "ordering", "open_answer", "open_answer", "essay", "true_false"]
_GROUP = f"CASE WHEN l_orderkey % 4 = 0 OR {_pick(131, 1, 1, 29)} = 0 THEN NULL WHEN ord <= 2 THEN 'grupo_i' WHEN ord <= 4 THEN 'grupo_ii' ELSE 'grupo_iii' END"
_QID = f"coalesce({_GROUP} || '_', '') || 'q' || CAST(l_linenumber AS STRING) || CASE WHEN {_pick(5, 1, 3, 37)} = 0 THEN '_recovered' ELSE '' END"

#: Questions: scalars by name.
QUESTION = {
    "root": "CAST(l_orderkey AS STRING)", "ord": "ord", "question_id": _QID, "group_id": _GROUP,
    "number": f"CAST(l_linenumber AS STRING) || CASE WHEN {_pick(1, 1, 1, 23)} = 0 THEN '.1' ELSE '' END",
    "type": _cases(_pick(3, 5, 1, 9), TYPES),
    "points": f"CASE WHEN {_pick(7, 3, 2, 61)} = 0 THEN NULL WHEN {_pick(11, 2, 5, 67)} = 0 THEN 0 WHEN l_orderkey % 5 = 0 THEN 50 ELSE CAST(l_quantity AS BIGINT) END",
    "statement": _cases(_pick(13, 7, 3, len(STATEMENTS)), STATEMENTS),
    "raw_text": _cases(_pick(2, 9, 7, 5), ["", "", "ver figura 2", None, "texto"]),
    "n_options": _pick(17, 3, 1, 5), "n_empty": _pick(19, 2, 3, 2), "n_blanks": _pick(23, 1, 7, 4), "n_last": _pick(29, 5, 2, 4),
    "max_selections": f"CASE WHEN {_pick(31, 1, 1, 4)} = 0 THEN NULL ELSE {_pick(37, 1, 2, 6)} END",
    "n_left": _pick(41, 3, 3, 4), "n_right": _pick(43, 1, 1, 4), "n_order": _pick(47, 3, 1, 4),
    "parent": f"CASE WHEN {_pick(53, 1, 3, 11)} = 0 THEN coalesce({_GROUP} || '_', '') || 'q' || CAST(l_linenumber - 1 AS STRING) WHEN {_pick(53, 1, 3, 11)} = 1 THEN {_GROUP} END",
    "is_group": f"({_pick(59, 3, 2, 29)} = 0)", "visual": f"({_pick(61, 1, 1, 3)} = 0)", "math_heavy": f"({_pick(67, 1, 3, 2)} = 0)",
    "confidence": f"{_pick(71, 1, 1, 100)}",
    "source_page": f"CASE WHEN {_pick(73, 1, 5, 17)} = 0 THEN NULL WHEN {_pick(73, 1, 5, 17)} = 1 THEN 99 ELSE 1 + ord END",
    "region_page": f"CASE WHEN {_pick(79, 1, 1, 3)} = 0 THEN NULL ELSE 1 + ord + CASE WHEN {_pick(83, 1, 1, 9)} = 0 THEN 1 ELSE 0 END END",
    "n_bbox": f"CASE WHEN {_pick(89, 1, 1, 7)} = 0 THEN 3 ELSE 4 END",
    "image_ref": f"CASE WHEN {_pick(97, 3, 1, 3)} = 0 THEN 'figura_' || CAST({_pick(3, 1, 1, 6)} AS STRING) END",
    "table_ref": f"CASE WHEN {_pick(101, 1, 1, 4)} = 0 THEN 'tabela_' || CAST({_pick(5, 1, 1, 4)} AS STRING) END",
    "asset_ref": f"CASE WHEN {_pick(103, 1, 1, 5)} = 0 THEN 'figura_' || CAST({_pick(7, 1, 1, 7)} AS STRING) END",
    "source_ref": f"CASE WHEN {_pick(107, 1, 1, 3)} = 0 THEN coalesce({_GROUP}, 'grupo_i') || '_documento_' || CAST(1 + {_pick(9, 1, 1, 4)} AS STRING) WHEN {_pick(107, 1, 1, 3)} = 1 THEN 'grupo_ii_documento_1' END",
    "child_ref": f"CASE WHEN {_pick(109, 1, 1, 4)} = 0 THEN 'child_' || CAST({_pick(11, 1, 1, 5)} AS STRING) END",
    "media": f"CASE WHEN {_pick(113, 1, 1, 2)} = 0 THEN '/files/' || CAST(l_orderkey AS STRING) || '/assets/f' || CAST({_pick(13, 1, 1, 12)} AS STRING) || '.png' END",
    "text_status": _cases(_pick(127, 1, 1, 4), ["ok", "ok", "needs_review", "corrupt"]),
}

#: Assets: scalars by name.
ASSET = {
    "root": "CAST(l_orderkey AS STRING)", "ord": "ord",
    "asset_id": f"CASE WHEN {_pick(3, 1, 1, 2)} = 0 THEN 'figura_' || CAST({_pick(5, 2, 1, 6)} AS STRING) ELSE 'tabela_' || CAST({_pick(7, 2, 1, 4)} AS STRING) END",
    "type": _cases(_pick(11, 1, 2, 6), ["graph", "geometry_diagram", "table", "embedded_image", "photo", "text_source"]),
    "page": f"1 + {_pick(13, 1, 1, 8)}",
    "n_bbox": f"CASE WHEN {_pick(17, 1, 1, 3)} = 0 THEN 0 ELSE 4 END", "estimated": f"({_pick(19, 1, 1, 2)} = 0)",
    "n_rows": _pick(23, 1, 1, 3), "n_columns": _pick(29, 1, 1, 3), "crop_status": _cases(_pick(31, 1, 1, 3), ["success", "failed", None]),
    "parent_asset": f"CASE WHEN {_pick(37, 1, 1, 7)} = 0 THEN 'figura_0' END", "linked": f"({_pick(41, 1, 1, 6)} = 0)",
    "path": f"CASE WHEN {_pick(43, 1, 1, 4)} = 0 THEN NULL ELSE 'assets/f' || CAST({_pick(47, 1, 1, 12)} AS STRING) || '.png' END",
}

#: Sources: scalars by name.
SOURCE = {
    "root": "CAST(l_orderkey AS STRING)", "ord": "ord",
    "source_id": f"coalesce({_GROUP}, 'grupo_i') || '_documento_' || CAST(1 + {_pick(3, 7, 1, 4)} AS STRING)", "group_id": f"coalesce({_GROUP}, 'grupo_i')",
    "kind": _cases(_pick(5, 7, 1, 2), ["text_source", "image_source"]), "page_start": f"CASE WHEN {_pick(7, 7, 1, 13)} = 0 THEN NULL ELSE {_pick(11, 7, 1, 9)} END",
    "text": _cases(_pick(13, 7, 1, 3), ["um texto", "  ", None]), "render": _cases(_pick(17, 7, 1, 3), ["text", "image", None]),
    "crop": f"CASE WHEN {_pick(19, 7, 1, 4)} = 0 THEN NULL ELSE '/files/x/assets/f' || CAST({_pick(23, 7, 1, 12)} AS STRING) || '.png' END",
    "method": _cases(_pick(29, 7, 1, 3), ["history_unlabelled_doc_crop", "label_crop", None]),
    "child_id": f"CASE WHEN {_pick(31, 7, 1, 2)} = 0 THEN 'child_' || CAST({_pick(37, 7, 1, 5)} AS STRING) END",
    "child_crop": f"CASE WHEN {_pick(41, 7, 1, 3)} = 0 THEN 'assets/f' || CAST({_pick(43, 7, 1, 14)} AS STRING) || '.png' END",
    "asset_ref": f"CASE WHEN {_pick(47, 7, 1, 3)} = 0 THEN 'figura_' || CAST({_pick(53, 7, 1, 6)} AS STRING) END",
}

#: Files of an exam: scalars by name; the same name may come up again and is then one file.
FILE = {
    "root": "CAST(l_orderkey AS STRING)", "rel": f"'assets/f' || CAST({_pick(3, 1, 5, 12)} AS STRING) || '.png'",
    "width": f"40 + {_pick(3, 1, 5, 12)} * 90", "height": f"30 + (({_pick(3, 1, 5, 12)} * 5) % 12) * 20", "digest": f"'d' || CAST({_pick(3, 1, 5, 12)} % 5 AS STRING)",
}

#: Items of an exam's scoring table: scalars by name.
POLICY = {
    "root": "CAST(l_orderkey AS STRING)", "ord": "ord", "group_id": f"coalesce({_GROUP}, 'grupo_i')", "number": f"CAST(l_linenumber + CASE WHEN {_pick(3, 5, 7, 9)} = 0 THEN 1 ELSE 0 END AS STRING)",
    "points": f"CASE WHEN {_pick(5, 5, 7, 31)} = 0 THEN NULL WHEN l_orderkey % 5 = 0 THEN 50 ELSE CAST(l_quantity AS BIGINT) END", "mandatory": f"({_pick(7, 5, 7, 10)} <> 0)",
}

#: Items of the grading criteria: scalars by name.
CRITERION = {
    "root": "CAST(l_orderkey AS STRING)", "ord": "ord", "group_id": f"CASE WHEN l_orderkey % 6 = 1 THEN 'grupo_i' ELSE coalesce({_GROUP}, '') END", "number": f"CAST(l_linenumber AS STRING) || CASE WHEN {_pick(3, 5, 9, 11)} = 0 THEN '.2' ELSE '' END",
    "type": _cases(_pick(5, 5, 9, 2), ["multiple_choice", "open_answer"]), "v1": _cases(_pick(7, 5, 9, 4), ["A", "B", None, ""]),
    "points": f"CASE WHEN {_pick(11, 5, 9, 19)} = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) + CASE WHEN {_pick(13, 5, 9, 7)} = 0 THEN 1 ELSE 0 END END",
    "question_id": f"CASE WHEN {_pick(17, 5, 9, 5)} = 0 THEN NULL ELSE {_QID} END",
}

#: Exams: scalars by name, of an order.
EXAM = {
    "root": "CAST(o_orderkey AS STRING)", "subject": _cases("o_orderkey % 3", ["Matemática A", "História A", "Português"]), "exam_no": "o_orderkey",
    "title": "'Exame Nacional ' || CAST(2005 + o_custkey % 18 AS STRING)", "year": "CASE o_custkey % 19 WHEN 0 THEN NULL WHEN 1 THEN 2012 ELSE 2005 + o_custkey % 18 END",
    "phase": _cases("o_custkey % 5", ["1", "2", "", None, "1"]), "total_pages": "CASE o_custkey % 4 WHEN 0 THEN 0 ELSE 6 + o_custkey % 3 END", "expected": "CASE o_custkey % 3 WHEN 0 THEN NULL ELSE o_custkey % 6 END",
    "policy_source": _cases("o_custkey % 4", ["cotacoes", "rebuilt_from_questions", None, "cotacoes"]), "subtotal": "CASE o_custkey % 7 WHEN 0 THEN NULL ELSE 150 + o_custkey % 60 END", "pool": "(o_custkey % 6 = 0)",
    "missing_pages": "(o_custkey % 23 = 0)", "load_error": "CASE WHEN o_custkey % 97 = 0 THEN 'exam.json not found' END", "warning": _cases("o_custkey % 5", ["broken_ref", "possible_hallucination", "missing_crop_ref", None, "invalid_page"]),
}

_PARTS = {"questions": QUESTION, "assets": ASSET, "sources": SOURCE, "policy": POLICY, "criteria": CRITERION}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


#: The same tables in SQL, scalars only.
MODEL_SQL = f"""li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS ord FROM lineitem),
exams AS (SELECT {_select(EXAM)} FROM orders), """ + ", ".join(f"{name} AS (SELECT {_select(columns)} FROM li)" for name, columns in _PARTS.items()) + f", files AS (SELECT DISTINCT {_select(FILE)} FROM li)"


def _texts(n: int, empty: int = 0) -> list[str]:
    return [f"texto {i}" if i <= n - empty else "" for i in range(1, n + 1)]


def _listed(values: list, kind: str) -> Column:
    """The lists as one constant."""
    lists = lambda v: F.array(*map(lists, v)) if isinstance(v, list) else F.lit(v)
    return lists(values).cast(f"array<{kind}>")


def _at(values: list, kind: str, *places: str) -> Column:
    """The list at the place, one index for each level of lists; an empty one where there is none.

    A look-up in a constant, as a function that builds the list would take all columns beside it out of generated code.
    """
    found = _listed(values, "array<" * (len(places) - 1) + kind + ">" * (len(places) - 1))
    for place in places:
        found = F.get(found, F.col(place).cast("int"))
    return F.coalesce(found, F.array().cast(kind))


def _one(c: str | Column) -> Column:
    """A list of the value, or an empty one if it is null."""
    c = F.col(c) if isinstance(c, str) else c
    one = F.array(c)
    return F.when(c.isNotNull(), one).otherwise(F.slice(one, 1, 0))


class Exams:
    """The tables of exams by name; one that is given as a function is made when it is first asked for."""

    NAMES = ("exams", "questions", "assets", "sources", "files", "policy", "criteria")

    def __init__(self, *tables: DataFrame | Callable[[], DataFrame] | None):
        self._tables = dict(zip(self.NAMES, tables, strict=True))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise AttributeError(name)
        found = self._tables[name]
        if callable(found) and not isinstance(found, DataFrame):
            found = self._tables[name] = found()
        return found


#: Rows of a bucket of exams, and the fewest that are worth a bucket of their own.
BUCKET_ROWS, LEAST_BUCKET_ROWS = 800_000, 10_000


def _buckets(spark: SparkSession, d: str) -> int:
    """How many buckets hold the exams: as many as there are cores, unless these would be too large or too small."""
    rows = table(spark, d, "lineitem").count()
    return max(1, -(-rows // BUCKET_ROWS), min(spark.sparkContext.defaultParallelism, rows // LEAST_BUCKET_ROWS))


def _dealt(spark: SparkSession, d: str, name: str, build: Callable[[int], DataFrame]) -> DataFrame:
    """Rows of exams in buckets by `root`; within a query that reads such, joins by `root` and more stay in their bucket."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return dealt_once(spark, f"{d}/{name}", build, lambda: _buckets(spark, d))


def numbered(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with `root`, its exam, and `ord`, the place of a row in its order; sorted once for all that the model makes of it."""
    w = Window.partitionBy("root").orderBy(*ORDER)
    li = lambda n: table(spark, d, "lineitem").withColumn("root", F.col("l_orderkey").cast("string")).repartition(n, "root")
    return _dealt(spark, d, "numbered", lambda n: li(n).withColumn("ord", F.row_number().over(w).cast("bigint")))


def rooted(spark: SparkSession, d: str) -> DataFrame:
    """orders with `root`, in the buckets of their rows."""
    return _dealt(spark, d, "rooted", lambda n: table(spark, d, "orders").withColumn("root", F.col("o_orderkey").cast("string")).repartition(n, "root"))


def made(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns of rows that have their exam as `root`: that one stays as it is, so that Spark knows where it lies."""
    return df.selectExpr(*(n if n == "root" else f"{e} AS {n}" for n, e in columns.items()))


def model(spark: SparkSession, d: str) -> Exams:
    """The tables with their lists: options, blanks, columns, references, regions, crops.

    They are made of the numbered rows while a query reads them, each with the columns that it asks for: that is less
    work than to write and read them.
    """
    li = numbered(spark, d)
    of = {name: made(li, columns) for name, columns in _PARTS.items()}
    # as many as the scalars above can ask for
    texts = [_texts(n) for n in range(5)]
    boxes = lambda n: _at([[1.0] * i for i in range(5)], "array<double>", n)
    q = of["questions"]
    options = _at([[_texts(n, empty) for empty in range(2)] for n in range(5)], "array<string>", "n_options", "n_empty")
    blanks = _at([[[*[_texts(3)] * (n - 1), *[_texts(last)] * (n > 0)] for last in range(4)] for n in range(4)], "array<array<string>>", "n_blanks", "n_last")
    listed = lambda n: _at(texts, "array<string>", n)
    q = q.select(
        "root", "ord", "question_id", "group_id", "number", "type", "points", "statement", "raw_text", "parent", "is_group", "visual", "math_heavy", (F.col("confidence") / 100).alias("confidence"), "source_page", "text_status", "max_selections",
        options.alias("options"), blanks.alias("blanks"), listed("n_left").alias("left"), listed("n_right").alias("right"), listed("n_order").alias("ordering"),
        F.when(F.col("region_page").isNotNull(), F.struct(F.col("region_page").alias("page"), boxes("n_bbox").alias("bbox"))).alias("region"),
        _one("image_ref").alias("image_refs"), _one("table_ref").alias("table_refs"), _one("asset_ref").alias("asset_refs"), _one("media").alias("media"),
        _one(F.when(F.col("source_ref").isNotNull(), F.struct(F.col("source_ref").alias("source_id"), F.col("child_ref").alias("child_id")))).alias("source_refs"),
    )
    a = of["assets"].select("root", "ord", "asset_id", "type", "page", "estimated", "crop_status", "parent_asset", "linked", "path", boxes("n_bbox").alias("bbox"), listed("n_rows").alias("rows"), listed("n_columns").alias("columns"))
    s = of["sources"].select("root", "ord", "source_id", "group_id", "kind", "page_start", "text", "render", "crop", "method", _one("child_id").alias("children"), _one("child_crop").alias("child_crops"), _one("asset_ref").alias("asset_refs"))
    return Exams(made(rooted(spark, d), EXAM), q, a, s, made(li, FILE).distinct(), of["policy"], of["criteria"])
