"""Grading criteria from their text: sections, items, answer keys, compositions, totals.

Lines are rows; what the text carries from line to line is windows over an exam's lines.  Only what stands inside one
item (its lines, a row of an answer key) is read as a list, by a fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headings, anchors and answers of criteria documents.
MARKER = r"(?iu)CRIT[ÉE]RIOS\s+ESPEC[ÍI]FICOS"
GROUP = r"(?i)^GRUPO\s+(III|II|I)(?![IVX])"
ITEM = r"^(\d{1,2})\.(\s|$)"
ITEM_TEXT = r"^(\d{1,2})\.\s"
LETTER = r"^([A-E])\.(\s|$)"
SUB_ITEM = r"^(\d{1,2}\.\d{1,2})\."
RANGE = r"^\d{1,2}\.\s*a\s*\d{1,2}\."
POINTS = r"(?i)(\d{1,3})\s*pontos\b"
TWO_VERSIONS = r"(?iu)Vers[ãa]o\s*1\s*:\s*\(([A-D])\).{0,20}?Vers[ãa]o\s*2\s*:\s*\(([A-D])\)"
ONE_ANSWER = r"(?i)Resposta\s+correc?ta\s*:\s*\(?([A-D])\)?"
INLINE = r"^\d{1,2}\.\s*\(([A-D])\)"
VERSION = r"(?iu)Vers[ãa]o\s*([12])\s*[:‒–—\-]\s*(.+)$"
ONE_LETTER = r"^\(?([A-D])\)?$"
SEVERAL = r"(?i)^[A-F](\s*(,|\be\b)\s*[A-F])+$"
KEY_ROW = r"^(\d{1,2}(?:\.\d{1,2})?)\.$"
COMPOSITION = r"\(etd\)|\(cl\)|estruturação temática|correc?ção lingu"


def _part(line: Column | str, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


def flat_lines(pages: DataFrame) -> DataFrame:
    """pages(root, page, text) -> (root, idx, page, line): lines in order, leaders and blanks made one, empty ones gone."""
    lines = pages.select("root", "page", F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")).alias("pos", "line"))
    line = F.trim(F.regexp_replace(F.regexp_replace("line", r"\.{4,}", " "), r"[ \t]+", " "))
    lines = lines.withColumn("line", line).filter("line <> ''")
    return lines.select("root", F.row_number().over(Window.partitionBy("root").orderBy("page", "pos")).alias("idx"), "page", "line")


def sections(lines: DataFrame) -> DataFrame:
    """Lines of the first section of each group, with its group_id and the place of its heading.

    Headings before the marker of the specific criteria count only if none follows it.
    """
    doc = Window.partitionBy("root")
    order = doc.orderBy("idx")
    roman = F.upper(_part("line", GROUP))
    df = lines.withColumn("gid", F.concat(F.lit("grupo_"), F.lower(roman))).withColumn("from", F.coalesce(F.min(F.when(F.col("line").rlike(MARKER), F.col("idx"))).over(doc), F.lit(0)))
    after = F.col("gid").isNotNull() & (F.col("idx") >= F.col("from"))
    df = df.withColumn("some", F.max(after).over(doc)).withColumn("gid", F.when(after | ~F.col("some"), F.col("gid")))
    before = F.last("gid", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("mark", F.when(F.col("gid").isNotNull() & ~F.coalesce(before == F.col("gid"), F.lit(False)), F.struct("gid", "idx")))
    df = df.withColumn("mark", F.last("mark", ignorenulls=True).over(order)).filter("mark IS NOT NULL")
    df = df.select("root", "idx", "page", "line", F.col("mark.gid").alias("group_id"), F.col("mark.idx").alias("start"))
    return df.withColumn("first", F.min("start").over(Window.partitionBy("root", "group_id"))).filter("start = first").drop("first")


def _answer(text: Column) -> Column:
    """An answer without a footnote and stray marks; a single letter without brackets; null if nothing is left."""
    clean = F.rtrim(F.trim(F.element_at(F.split(F.trim(text), r"\s+\d\s+Vide\b", 2), 1)), F.lit(" .;"))
    letter = _part(clean, ONE_LETTER)
    return F.nullif(F.coalesce(F.upper(letter), clean), F.lit(""))


def _topics(lines: Column) -> Column:
    """Up to twelve topics between the line that announces them and that of the aspects; a dash begins a topic."""
    state = "struct<on:boolean,done:boolean,buf:string,found:array<string>>"
    start = F.struct(F.lit(False).alias("on"), F.lit(False).alias("done"), F.lit("").alias("buf"), F.array().cast("array<string>").alias("found")).cast(state)

    def step(s: Column, line: Column) -> Column:
        low = F.lower(line)
        opens = low.contains("devem ser abordados") | low.contains("deve ser abordado") | low.contains("tópicos seguintes")
        clean = F.trim(F.regexp_replace(line, r"^[−–\- ]+", ""))
        flush = F.when(s["buf"] != "", F.concat(s["found"], F.array(s["buf"]))).otherwise(s["found"])
        new = lambda on, done, buf, found: F.struct(on.alias("on"), done.alias("done"), buf.alias("buf"), found.alias("found")).cast(state)
        ends = F.startswith(low, F.lit("aspetos de"))
        grown = F.when(s["buf"] == "", clean).otherwise(F.concat_ws(" ", s["buf"], clean))
        return (
            F.when(s["done"], s)
            .when(opens, new(F.lit(True), F.lit(False), s["buf"], s["found"]))
            .when(~s["on"], s)
            .when(ends, new(F.lit(True), F.lit(True), s["buf"], s["found"]))
            .when(clean == "", new(F.lit(True), F.lit(False), F.lit(""), flush))
            .when(line.rlike(r"^[−–\-]"), new(F.lit(True), F.lit(False), clean, flush))
            .otherwise(new(F.lit(True), F.lit(False), grown, s["found"]))
        )

    last = lambda s: F.when(s["buf"] != "", F.concat(s["found"], F.array(s["buf"]))).otherwise(s["found"])
    return F.slice(F.filter(F.aggregate(lines, start, step, last), lambda t: F.length(t) > 4), 1, 12)


def _item(**columns: Column) -> list[Column]:
    kinds = {"group_id": "string", "number": "string", "points": "int", "type": "string", "v1": "string", "v2": "string", "topics": "array<string>", "raw_text": "string", "pages": "array<bigint>", "confidence": "double"}
    return [F.col("root"), *(columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items())]


def prose_items(lines: DataFrame, ahead: int = 5) -> DataFrame:
    """Items that lines with a number (or a letter) begin and whose points stand there or within the next lines.

    Numbers with a part after a dot, where a section has any, take the place of all others.
    """
    part = Window.partitionBy("root", "group_id")
    order = part.orderBy("idx")
    line = F.col("line")
    sub, item, letter = _part(line, SUB_ITEM), _part(line, ITEM), _part(line, LETTER)
    df = lines.withColumn("own", _part(line, POINTS).cast("int")).withColumn("stop", line.rlike(ITEM) | line.rlike(SUB_ITEM))
    # the first of the next lines that has points or begins another item
    near = F.collect_list(F.struct("idx", "own", "stop")).over(order.rowsBetween(1, ahead))
    hit = F.try_element_at(F.filter(near, lambda x: x["stop"] | x["own"].isNotNull()), F.lit(1))
    df = df.withColumn("later", F.when(~hit["stop"], hit))
    paid = F.col("own").isNotNull() | F.col("later").isNotNull()
    ranged = line.rlike(RANGE)
    df = df.withColumn("sub", F.when(~ranged & paid, sub)).withColumn("plain", F.when(~ranged & paid & sub.isNull(), F.coalesce(item, letter)))
    number = F.when(F.max(F.col("sub").isNotNull()).over(part), F.col("sub")).otherwise(F.col("plain"))
    df = df.withColumn("number", number).withColumn("at", F.when(F.col("number").isNotNull(), F.col("idx")))
    df = df.withColumn("next", F.min("at").over(order.rowsBetween(1, Window.unboundedFollowing))).withColumn("at", F.last("at", ignorenulls=True).over(order)).filter("at IS NOT NULL")
    points = F.coalesce("own", F.when(F.coalesce(F.col("later.idx") < F.col("next"), F.lit(True)), F.col("later.own")))
    head = F.max(F.when(F.col("idx") == F.col("at"), F.struct("number", points.alias("points"), "line"))).alias("h")
    df = df.groupBy("root", "group_id", "at").agg(head, F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("l"), F.sort_array(F.collect_set("page")).alias("pages"))
    text, first = F.col("l.line"), F.col("h.line")
    told = F.filter(F.transform(text, lambda x: F.struct(_part(x, VERSION).alias("n"), _answer(F.regexp_extract(x, VERSION, 2)).alias("a"))), lambda x: x["n"].isNotNull() & x["a"].isNotNull())
    of = lambda n: F.try_element_at(F.filter(told, lambda x: x["n"] == n), F.lit(-1))["a"]
    two, one = _part(first, TWO_VERSIONS), F.coalesce(_part(first, ONE_ANSWER), _part(first, INLINE))
    # the type follows the answer of the version named first, as it was named last
    lead = F.when(F.try_element_at(told, F.lit(1))["n"] == "1", of("1")).otherwise(of("2"))
    shape = F.when(lead.rlike(ONE_LETTER), "multiple_choice").when(lead.rlike(SEVERAL), "multi_select").when(lead.rlike(r"\b[a-e]\)"), "multi_blank_choice").otherwise("multiple_choice")
    return df.select(*_item(
        group_id=F.col("group_id"), number=F.col("h.number"), points=F.col("h.points"), confidence=F.lit(0.95), topics=_topics(text), raw_text=F.array_join(text, "\n"), pages=F.col("pages"),
        type=F.when(two.isNotNull() | one.isNotNull(), "multiple_choice").when(F.size(told) > 0, shape).otherwise("open_answer"),
        v1=F.when(two.isNotNull() | one.isNotNull(), F.upper(F.coalesce(two, one))).otherwise(of("1")),
        v2=F.when(two.isNotNull(), F.upper(_part(first, TWO_VERSIONS, 2))).when(one.isNull(), of("2")),
    ), "at")


def _key_row(tokens: Column) -> Column:
    """A row of an answer key from the lines after its number: letters, points, text, and how many lines it took."""
    state = "struct<done:boolean,letters:array<string>,points:int,texts:array<string>,used:int>"
    start = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("letters"), F.lit(None).cast("int").alias("points"), F.array().cast("array<string>").alias("texts"), F.lit(0).alias("used")).cast(state)

    def step(s: Column, line: Column) -> Column:
        new = lambda done, letters, points, texts, used: F.struct(done.alias("done"), letters.alias("letters"), points.alias("points"), texts.alias("texts"), (s["used"] + used).alias("used")).cast(state)
        over = new(F.lit(True), s["letters"], s["points"], s["texts"], F.lit(0))
        letter, alone = _part(line, ONE_LETTER), _part(line, r"(?i)^(\d{1,3})\s*pontos\b")
        return (
            F.when(s["done"], s)
            .when(letter.isNotNull(), new(F.lit(False), F.concat(s["letters"], F.array(F.upper(letter))), s["points"], s["texts"], F.lit(1)))
            .when(line.rlike(r"^\d{1,3}$"), F.when(s["points"].isNotNull(), over).otherwise(new(F.lit(True), s["letters"], line.try_cast("int"), s["texts"], F.lit(1))))
            .when(alone.isNotNull() & s["points"].isNull() & (F.size(s["letters"]) == 0), new(F.lit(False), s["letters"], alone.try_cast("int"), s["texts"], F.lit(1)))
            .when(F.lower(line).isin("níveis", "niveis", "descritores de desempenho") | (F.size(s["letters"]) > 0), over)
            .otherwise(new(F.lit(False), s["letters"], s["points"], F.concat(s["texts"], F.array(line)), F.lit(1)))
        )

    return F.aggregate(tokens, start, step)


def key_items(lines: DataFrame) -> DataFrame:
    """Items of a section's answer key, which has one token a line: number, answers, points.

    The key ends at the first line that begins an item of prose, or at a row with neither answers nor points.
    """
    part = Window.partitionBy("root", "group_id")
    order = part.orderBy("idx")
    line, low = F.col("line"), F.lower("line")
    df = lines.withColumn("head", F.min(F.when(low.contains("pontuação") | low.contains("pontuacao"), F.col("idx"))).over(part))
    second = (low.contains("versão 2") | low.contains("versao 2")) & (F.col("head").isNull() | (F.col("idx") <= F.col("head")))
    df = df.withColumn("two", F.max(second).over(part)).filter("head IS NULL OR idx > head")
    df = df.withColumn("number", _part(line, KEY_ROW)).withColumn("at", F.last(F.when(F.col("number").isNotNull(), F.col("idx")), ignorenulls=True).over(order))
    ends = F.min(F.when(F.col("at").isNotNull() & line.rlike(ITEM_TEXT) & ~line.rlike(RANGE), F.col("idx"))).over(part)
    df = df.withColumn("ends", ends).filter("at IS NOT NULL AND (ends IS NULL OR idx < ends)")
    df = df.groupBy("root", "group_id", "at").agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("l"), F.max("number").alias("number"), F.max("two").alias("two"), F.min_by("page", "idx").alias("page"))
    text = F.col("l.line")
    df = df.withColumn("r", _key_row(F.slice("l.line", 2, F.size("l")))).withColumn("bad", (F.size("r.letters") == 0) & F.col("r.points").isNull())
    df = df.withColumn("over", F.max("bad").over(part.orderBy("at"))).filter("NOT over")
    chosen = F.size("r.letters") > 0
    return df.select(*_item(
        group_id=F.col("group_id"), number=F.col("number"), points=F.col("r.points"), type=F.when(chosen, "multiple_choice").otherwise("open_answer"), topics=F.array(), pages=F.array("page"),
        v1=F.when(chosen, F.try_element_at("r.letters", F.lit(1))).otherwise(F.nullif(F.trim(F.array_join("r.texts", " ")), F.lit(""))), v2=F.when(F.col("two"), F.try_element_at("r.letters", F.lit(2))),
        raw_text=F.array_join(F.slice(text, F.lit(1), F.col("r.used") + 1), "\n"), confidence=F.when(chosen, 0.97).otherwise(0.9),
    ))


def composition(lines: DataFrame) -> DataFrame:
    """The one item of the composition's section: its points are the sum of its parameters' points, before any table of totals."""
    part = Window.partitionBy("root", "group_id")
    low = F.lower("line")
    ends = F.min(F.when(low.contains("cotação (em pontos)") | low.contains("cotacao (em pontos)") | F.startswith(low, F.lit("total")), F.col("idx"))).over(part)
    df = lines.withColumn("ends", ends).filter("ends IS NULL OR idx < ends")
    paid = F.when(low.rlike(COMPOSITION), _part("line", POINTS).cast("int"))
    df = df.groupBy("root", "group_id").agg(F.sum(paid).alias("points"), F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("l"), F.sort_array(F.collect_set("page")).alias("pages"))
    return df.select(*_item(group_id=F.col("group_id"), number=F.lit("1"), points=F.col("points"), type=F.lit("essay"), topics=F.array(), raw_text=F.array_join("l.line", "\n"), pages=F.col("pages"), confidence=F.when(F.col("points") > 0, 0.9).otherwise(0.5)))


def parse(pages: DataFrame) -> DataFrame:
    """pages(root, page, text) of criteria documents -> their items.

    In the second group the answer key goes before prose, and of prose items of one number the last counts.
    """
    found = sections(flat_lines(pages))
    key = key_items(found.filter("group_id = 'grupo_ii'")).withColumn("at", F.lit(1 << 30))
    both = prose_items(found.filter("group_id IN ('grupo_i', 'grupo_ii')")).unionByName(key)
    last = F.row_number().over(Window.partitionBy("root", "group_id", "number").orderBy(F.desc("at"))) == 1
    both = both.withColumn("last", last).filter("last OR group_id = 'grupo_i'").drop("last", "at")
    return both.unionByName(composition(found.filter("group_id = 'grupo_iii'")))


def parse_documents(documents: DataFrame) -> DataFrame:
    """documents(root, pages array<struct<page, text>>), a row for each exam -> the items that `parse` finds, of every exam.

    Exams of one edition have the same criteria: each different list of pages is parsed once, and its items go to all
    exams that have it, by a digest of the whole list.  Where all differ, each is parsed as before.
    """
    document = F.sha2(F.to_json("pages"), 256).alias("document")
    items = parse(documents.select("pages").distinct().select(document.alias("root"), F.inline("pages")))
    listed = items.groupBy(F.col("root").alias("document")).agg(F.collect_list(F.struct(*(c for c in items.columns if c != "root"))).alias("items"))
    return documents.select("root", document).join(listed, "document").select("root", F.inline("items"))


def cross_check(pages: DataFrame) -> DataFrame:
    """(root, total, per_item, pool, choose) that a document states about its points."""
    text = flat_lines(pages).groupBy("root").agg(F.array_join(F.array_sort(F.collect_list(F.struct("idx", "line")))["line"], "\n").alias("text"))
    pool = r"(?i)(\d+)\s*[x×]\s*(\d+)\s*pontos"
    number = lambda p, g=1: _part("text", p, g).try_cast("int")
    return text.select("root", number(r"TOTAL\s+(\d{2,3})\b").alias("total"), number(pool, 2).alias("per_item"), number(pool).alias("pool"), number(r"(?i)os\s+(\d+)\s+iten[s]?\s+cuj").alias("choose"))


def answer_keys(items: DataFrame) -> DataFrame:
    """(root, version, group_id, number, answer) of every answer of either version."""
    told = F.array(F.struct(F.lit("1").alias("version"), F.col("v1").alias("answer")), F.struct(F.lit("2").alias("version"), F.col("v2").alias("answer")))
    return items.select("root", "group_id", "number", F.inline(told)).filter("answer IS NOT NULL").select("root", "version", "group_id", "number", "answer")
