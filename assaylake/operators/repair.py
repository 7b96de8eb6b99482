"""Repairs of questions from the native text and tables of their pages, and from what the scoring implies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exam_text import bound, first_of_each
from ..functions.text import count_of, fold_accents, strip

#: Heads of columns and lines of blanks, their options, and what ends an option's text.
BLANK_HEAD = r"(?i)^\s*([a-f])\)\s*$"
BLANK_LINE = r"(?im)^[^\S\n]*([a-f])\)[^\S\n]*_*[^\S\n]*$"
BLANK_OPTION = r"^\s*(\d{1,2})[.)]?\s+(.+?)\s*$"
BLANK_MARKER = r"(?i)\b([a-f])\)\s*_*"
OPTION_END = r"(?iU)\s*(?:GRUPO\s+[IVX]+|COTA\w+|FIM)\b.*$"
#: A vertical fraction in the text layer (its lower number before the upper one), and bullets.
VERTICAL = r"(?i)(?:^|\n)\s*[•\-–‒]\s*(\d{1,3})\s*\n\s*(\d{1,3})\s+([^\n;]{6,120};?)"
BULLET = r"[•\-–‒]\s*"
#: Options that stand in a statement, and the words its question goes on with after them, by rank.
INLINE_OPTION = r"(?:^|\s)(?:[A-Ea-e]\.|\([A-Ea-e]\))\s+"
GOES_ON = [r"\bIdentifique\b", r"\bSelecione\b", r"\bEscreva\b", r"\bIndique\b"]
LETTERED = r"(?:^|\s)\(([A-Da-d])\)\s*"
#: What the statement of a question with blanks says.
BLANK_PHRASES = ["complete o texto", "cada espaço", "opção adequada", "selecionando a opção", "corresponde à opção"]
#: What follows the block of a question.
BLOCK_END = r"GRUPO\s+[IVX]+\b|COTA\w+|FIM\b"
LONG_ITEM = r"(?imsU)^\s*B\s*$\s*(.+?)(?=^\s*(?:Observa\w*|GRUPO\s+II|COTA\w*|FIM)\b)"
#: Totals of the editions whose first group has an item B.
OLD_YEARS, TOTAL_WITHOUT_B, GROUP_WITHOUT_B, POINTS_OF_B = (2008, 2017), 170, 70, 30
NO_TEXT_OF_B = "Grupo I — B (item de resposta extensa; texto não extraído do PDF)."


def _words(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+")))


def is_better(current: Column, native: Column) -> Column:
    """Whether a native text should replace one whose letters were lost as question marks.

    Never one under 40 characters, one with more than half the question marks (one is allowed), or one with under
    45 % of the words; and only for two question marks or more, which are 1.5 % of the words, or four.
    """
    marks, other = count_of(current, "?"), count_of(native, "?")
    told = (F.length(current) > 0) & (F.length(native) >= 40) & (other <= F.greatest(F.lit(1), F.floor(marks / 2))) & (marks >= 2)
    enough = _words(native) >= _words(current) * 0.45
    return F.coalesce(told & enough & ((marks / _words(current) >= 0.015) | (marks >= 4)), F.lit(False))


def repaired_texts(questions: DataFrame, native: DataFrame) -> DataFrame:
    """(root, ord, type, statement, statement_raw, options) of questions whose text the native one of their page and number replaces.

    questions(root, ord, page, number, type, statement), native(root, page, number, type, statement, options), one for
    each key.  Choices and blanks take the native type, too; options are the native ones, none if there are none.
    """
    n = native.select("root", "page", F.trim("number").alias("number"), F.col("type").alias("__type"), F.col("statement").alias("__text"), "options")
    df = questions.select("root", "ord", "page", F.trim("number").alias("number"), "type", "statement").join(n, ["root", "page", "number"]).filter(is_better(F.col("statement"), F.col("__text")))
    kind = F.when(F.col("__type").isin("multiple_choice", "multi_blank_choice"), F.col("__type")).otherwise(F.col("type"))
    return df.select("root", "ord", kind.alias("type"), F.col("__text").alias("statement"), F.col("statement").alias("statement_raw"), "options")


def _quoted(text: Column) -> Column:
    r"""A pattern that a text matches as it stands: between \Q and \E, with any \E of its own put outside."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def vertical_fractions(raw: Column) -> Column:
    """(top, bottom, phrase) of the fractions that a text layer holds over two lines, each with the phrase after it."""
    at = lambda g: F.regexp_extract_all(raw, F.lit(VERTICAL), F.lit(g))
    told = F.zip_with(F.zip_with(at(1), at(2), lambda b, t: F.struct(t.alias("top"), b.alias("bottom"))), at(3), lambda f, p: F.struct(f["top"].alias("top"), f["bottom"].alias("bottom"), F.trim(F.regexp_replace(p, r"\s+", " ")).alias("phrase")))
    return F.filter(told, lambda f: (f["phrase"] != "") & (f["bottom"].cast("int") != 0))


def with_fractions(text: Column, raw: Column) -> Column:
    """A text with the fractions that it lost put back before the phrases that follow them in the text layer.

    A fraction that the text has in any form stays away, and so does one whose phrase is under three words.  The first
    seven words of the phrase are looked for, after a bullet first, then anywhere; a fraction whose phrase is not there
    is left out.  Null stays null.
    """

    def put(out: Column, f: Column) -> Column:
        latex = F.concat(F.lit("\\frac{"), f["top"], F.lit("}{"), f["bottom"], F.lit("}"))
        inline = F.concat(F.lit("\\("), latex, F.lit("\\)"))
        words = F.slice(F.split(f["phrase"], " "), 1, 7)
        anchor = F.array_join(F.transform(words, _quoted), r"\s+")
        safe = F.replace(inline, F.lit("\\"), F.lit("\\\\"))  # as a replacement
        bullet = F.concat(F.lit(r"(?ius)\A(.*?" + BULLET + r")(?:\\\(\s*\\\))?\s*(?="), anchor, F.lit(")"))
        anywhere = F.concat(F.lit(r"(?ius)\A(.*?)(?<![\p{L}\p{N}_])("), anchor, F.lit(")"))
        with_bullet = F.regexp_replace(out, bullet, F.concat(F.lit("$1"), safe, F.lit(" ")))
        placed = F.when(F.rlike(out, bullet), with_bullet).otherwise(F.regexp_replace(out, anywhere, F.concat(F.lit("$1"), safe, F.lit(" $2"))))
        known = out.contains(F.concat(f["top"], F.lit("/"), f["bottom"])) | out.contains(latex)
        return F.when(known | (F.size(F.split(f["phrase"], " ")) < 3), out).otherwise(placed)

    return F.aggregate(F.coalesce(vertical_fractions(raw), F.array().cast("array<struct<top:string,bottom:string,phrase:string>>")), text, put)


def _options(cells: Column) -> Column:
    """(letter, text) of the cells or lines that are numbered options: the first of each number, in order of number."""
    read = F.transform(cells, lambda c, i: F.struct(F.regexp_extract(c, BLANK_OPTION, 1).alias("letter"), i.alias("i"), F.regexp_extract(c, BLANK_OPTION, 2).alias("text")))
    first = first_of_each(F.filter(read, lambda p: p["letter"] != ""), "letter")
    ranked = F.array_sort(F.transform(first, lambda p: F.struct(p["letter"].cast("int").alias("n"), p["i"].alias("i"), p["letter"].alias("letter"), p["text"].alias("text"))))
    return F.transform(ranked, lambda p: F.struct(p["letter"].alias("letter"), p["text"].alias("text")))


def _by_letter(told: Column) -> Column:
    """Blanks of (letter, cells) in order of letter, the cells of equal letters together."""

    def blanks(told: Column) -> Column:
        letters = F.array_sort(F.array_distinct(F.transform(told, lambda t: t["letter"])))
        return F.transform(letters, lambda x: F.struct(F.concat(x, F.lit(")")).alias("number"), _options(F.flatten(F.transform(F.filter(told, lambda t: t["letter"] == x), lambda t: t["cells"]))).alias("options")))

    return bound(told, blanks)


def table_blanks(tables: Column) -> Column:
    """Blanks of a page's tables (rows of cells): a column whose head is a letter a) to f) holds that blank's numbered options."""
    clean = F.transform(tables, lambda t: F.transform(t, lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit(""))))))

    def columns(t: Column) -> Column:
        body = F.slice(t, 2, F.greatest(F.size(t), F.lit(1)))
        under = lambda heads, x: F.flatten(F.transform(body, lambda r: F.filter(r, lambda c, i: F.get(heads, i) == x)))
        of = lambda heads: F.transform(F.array_distinct(F.filter(heads, lambda h: h != "")), lambda x: F.struct(x.alias("letter"), under(heads, x).alias("cells")))
        return bound(F.transform(F.get(t, F.lit(0)), lambda h: F.lower(F.regexp_extract(h, BLANK_HEAD, 1))), of)

    return _by_letter(F.flatten(F.transform(F.filter(clean, lambda t: F.size(t) > 0), columns)))


def text_blanks(block: Column) -> Column:
    """Blanks of a text: a line that is a letter a) to f) begins one, and numbered lines up to the next are its options."""
    told = lambda letters: F.zip_with(letters, F.slice(F.split(block, BLANK_LINE), 2, F.size(letters) + 1), lambda x, p: F.struct(F.lower(x).alias("letter"), F.transform(F.split(F.coalesce(p, F.lit("")), "\n"), lambda c: F.trim(c)).alias("cells")))
    return _by_letter(bound(F.regexp_extract_all(block, F.lit(BLANK_LINE), F.lit(1)), told))


def page_blanks(tables: Column, block: Column) -> Column:
    """Blanks of a question: from its page's tables, else from its text, else the letters it names (or a to d) without options."""
    none = F.array().cast("array<struct<letter:string,text:string>>")
    letters = F.array(*map(F.lit, "abcd"))

    def named(block: Column) -> Column:
        found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(block, F.lit(BLANK_MARKER), F.lit(1)), F.lower)))
        told = bound(found, lambda x: F.when(F.size(x) > 0, x).otherwise(letters))
        return F.transform(F.coalesce(told, letters), lambda x: F.struct(F.concat(x, F.lit(")")).alias("number"), none.alias("options")))

    first = lambda a, other: bound(a, lambda found: F.when(F.size(found) > 0, found).otherwise(other))
    of = lambda block: first(text_blanks(F.coalesce(block, F.lit(""))), named(block))
    return first(table_blanks(F.coalesce(tables, F.array().cast("array<array<array<string>>>"))), bound(block, of))


def normal_blanks(blanks: Column) -> Column:
    """Blanks in canonical form: a number `a)`, made from the place if it has none; options without tails, blanks and repeats."""

    def number(b: Column, i: Column) -> Column:
        told = F.regexp_replace(F.trim(F.coalesce(b["number"], F.lit(""))), r"\.+$", "")
        return F.when(F.trim(F.coalesce(b["number"], F.lit(""))) == "", F.concat(F.chr(97 + i), F.lit(")"))).when(told.rlike(r"^[a-zA-Z]$"), F.concat(F.lower(told), F.lit(")"))).otherwise(told)

    def option(o: Column) -> Column:
        text = F.regexp_replace(strip(F.regexp_replace(strip(F.regexp_replace(F.coalesce(o["text"], F.lit("")), r"\s+", " ")), OPTION_END, "")), r"[ .]+$", "")
        return F.struct(F.trim(F.coalesce(o["letter"], F.lit(""))).alias("letter"), text.alias("text"))

    def options(b: Column) -> Column:
        told = F.transform(F.filter(F.transform(b["options"], option), lambda o: (o["letter"] != "") & (o["text"] != "")), lambda o: F.struct(F.struct(o["letter"], F.lower(fold_accents(o["text"]))).alias("key"), o["letter"].alias("letter"), o["text"].alias("text")))
        return F.transform(first_of_each(told, "key"), lambda o: F.struct(o["letter"].alias("letter"), o["text"].alias("text")))

    return F.transform(blanks, lambda b, i: F.struct(number(b, i).alias("number"), options(b).alias("options")))


def valid_blanks(blanks: Column) -> Column:
    """Two blanks or more, each with two options or more."""
    return F.coalesce((F.size(blanks) >= 2) & F.forall(blanks, lambda b: F.size(b["options"]) >= 2), F.lit(False))


def without_inline_options(text: Column) -> Column:
    """A statement without the options that stand in it, if there are two or more.

    What comes before the first stays, and what comes after the last from the first word on that a question goes on with.
    """
    parts = F.split(text, INLINE_OPTION)
    before, last = strip(F.get(parts, F.lit(0))), F.element_at(parts, -1)
    after = F.coalesce(*(F.nullif(F.regexp_extract(last, f"(?is){p}.*$", 0), F.lit("")) for p in GOES_ON))
    kept = F.array_join(F.filter(F.array(before, strip(F.coalesce(after, F.lit("")))), lambda x: x != ""), "\n")
    return F.when(F.size(parts) < 3, text).otherwise(strip(F.regexp_replace(kept, r"[ \t]+\n", "\n")))


def lettered_options(text: Column) -> Column:
    """(letter, text) of options (A) to (D), none unless there are three marks or more."""
    letters, parts = F.regexp_extract_all(text, F.lit(LETTERED), F.lit(1)), F.split(text, LETTERED)
    tidy = lambda t: strip(F.regexp_replace(strip(F.regexp_replace(t, r"\s+", " ")), r"(?i)\s*(?:GRUPO\s+[IVX]+|COTAÇÕES|FIM)\b.*$", ""))
    told = F.filter(F.zip_with(letters, F.slice(parts, 2, F.size(letters) + 1), lambda x, p: F.struct(F.upper(x).alias("letter"), tidy(F.coalesce(p, F.lit(""))).alias("text"))), lambda o: o["text"] != "")
    return F.when(F.size(letters) >= 3, told).otherwise(F.slice(told, 1, 0))


def owned_tables(questions: DataFrame, assets: DataFrame, refs: DataFrame) -> DataFrame:
    """(root, ord, asset_id) of refs(root, ord, asset_id) once tables of options stand only where blanks are.

    assets(root, pos, asset_id, type, page, rows array of cells as text, columns), questions(root, ord, page, text).  A table of options
    has heads a), b), or c), or lettered or numbered cells; with it go its clones, whose ids go on after `tabela_pN_`.
    References to them go from questions without blanks; the first question with blanks on a table's page gets it.
    """
    low = lambda c: F.lower(F.concat_ws(" ", c))
    cells, heads = low("rows"), low("columns")
    both = lambda a, b: cells.contains(a) & cells.contains(b)
    held = both("a)", "b)") | both("a)", "c)") | both("1.", "2.") | both("1)", "2)") | heads.rlike(r"[abc]\)")
    ids = assets.select("root", "pos", "asset_id", "page", F.regexp_extract(F.lower("asset_id"), r"^(tabela_p\d+)", 1).alias("prefix"), ((F.lower("asset_id").contains("tabela") | F.coalesce(F.col("type") == "table", F.lit(False))) & held).alias("own"))
    ids = ids.withColumn("clone", F.lower("asset_id").rlike(r"^tabela_p\d+(_|$)"))
    prefixes = ids.filter("own AND prefix <> ''").select("root", "prefix", F.lit(True).alias("known")).distinct()
    tables = ids.join(prefixes, ["root", "prefix"], "left").filter("own OR (clone AND known)")
    text = F.lower(F.coalesce("text", F.lit("")))
    blanks = questions.withColumn("blanks", F.exists(F.array(*map(F.lit, BLANK_PHRASES)), lambda p: text.contains(p)))
    names = tables.select("root", "asset_id").distinct()
    stray = refs.join(names, ["root", "asset_id"], "left_semi").join(blanks.filter("NOT blanks").select("root", "ord"), ["root", "ord"], "left_semi")
    kept = refs.select("root", "ord", "asset_id").join(stray.select("root", "ord", "asset_id").distinct(), ["root", "ord", "asset_id"], "left_anti")
    owners = blanks.filter("blanks").groupBy("root", "page").agg(F.min("ord").alias("ord"))
    return kept.unionByName(tables.join(owners, ["root", "page"]).select("root", "ord", "asset_id")).distinct()


def long_item(pages: DataFrame) -> DataFrame:
    """(root, block): the text of item B of the first group, of the first page that has it."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\u0007"), F.lit(" "))
    df = pages.select("root", "page", text.alias("text")).filter(F.col("text").rlike(r"(?i)\bGRUPO\s+I\b") | F.col("text").contains("\nB\n"))
    block = strip(F.regexp_replace(F.regexp_extract("text", LONG_ITEM, 1), r"\s+", " "))
    return df.withColumn("block", block).filter("block <> ''").groupBy("root").agg(F.min_by("block", "page").alias("block"))


def numbers_on_pages(pages: DataFrame) -> DataFrame:
    """(root, number, page): the first page on which a line begins with each number."""
    found = pages.select("root", "page", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?m)^\s*(\S+)\.\s+"), F.lit(1)))).alias("number"))
    return found.groupBy("root", "number").agg(F.min("page").alias("page"))


def recovered_from_scoring(entries: DataFrame, questions: DataFrame, pages: DataFrame) -> DataFrame:
    """(root, group_id, number, points, page, type, options, statement, confidence, review) of items that only the scoring has.

    entries(root, group_id, number, points), questions(root, group_id, number), pages(root, page, text).  An item's
    text goes from its number at the start of a line, on the first page that has it, to the next whole number, group,
    scoring or end; item 5 of the first group may be its item B.  Texts under 20 characters or 15 letters are no questions.
    """
    have = questions.select("root", F.coalesce("group_id", F.lit("")).alias("group_id"), "number").distinct()
    lost = entries.dropDuplicates(["root", "group_id", "number"]).join(have, ["root", "group_id", "number"], "left_anti")
    lost = lost.withColumn("head", F.when(F.col("number").endswith(".0"), F.substring_index("number", ".", 1)).otherwise(F.col("number")))
    found = lost.join(numbers_on_pages(pages).withColumnRenamed("number", "head"), ["root", "head"], "left").join(pages.select("root", "page", F.replace("text", F.lit("\u0007"), F.lit(" ")).alias("text")), ["root", "page"], "left").join(long_item(pages), "root", "left")
    start = F.concat(F.lit(r"(?m)^\s*"), _quoted(F.col("head")), F.lit(r"\.\s+"))
    following = F.substring_index("number", ".", 1).try_cast("int") + 1
    found = found.withColumn("begin", F.call_function("regexp_extract", F.col("text"), start, F.lit(0))).withColumn("rest", F.expr("substring(text, instr(text, begin) + length(begin))"))
    end = F.concat(F.lit(r"(?imU)^\s*(?:"), F.coalesce(following.cast("string"), F.lit("")), F.lit(rf"\.|{BLOCK_END})"))
    plain = F.when(F.col("begin") != "", strip(F.concat("begin", F.get(F.split("rest", end, 2), F.lit(0)))))
    found = found.withColumn("statement", F.when((F.col("group_id") == "grupo_i") & (F.col("number") == "5"), F.coalesce("block", plain)).otherwise(plain))
    prose = F.regexp_replace(F.regexp_replace("statement", r"(?i)\bpontos?\b", ""), "[^A-Za-zÀ-ÿ]", "")
    found = found.filter((F.length("statement") >= 20) & (F.length(prose) >= 15)).withColumn("options", lettered_options(F.col("statement")))
    return found.select(
        "root", "group_id", "number", "points", "page", F.when(F.size("options") >= 3, "multiple_choice").otherwise("open_answer").alias("type"), "options", "statement",
        F.when(F.col("page").isNotNull(), 0.78).otherwise(0.6).alias("confidence"), F.col("page").isNull().alias("review"),
    )


def missing_item(exams: DataFrame, questions: DataFrame, pages: DataFrame) -> DataFrame:
    """(root, number, points, page, statement, confidence, review): item B of the first group, where the points prove that it was lost.

    exams(root, year), questions(root, group_id, number, points).  Only for the editions that had it, whose questions
    add up to 170, of which 70 in the first group, without an item B or 5.  Its text is empty of content where no page has it.
    """
    points = F.coalesce(F.col("points").cast("bigint"), F.lit(0))
    first = F.coalesce(F.col("group_id") == "grupo_i", F.lit(False))
    sums = questions.groupBy("root").agg(F.sum(points).alias("total"), F.sum(F.when(first, points)).alias("own"), F.max(F.coalesce(first & F.upper(F.trim("number")).isin("B", "5"), F.lit(False))).alias("has"))
    lost = exams.filter(F.col("year").between(*OLD_YEARS)).join(sums.filter((F.col("total") == TOTAL_WITHOUT_B) & (F.col("own") == GROUP_WITHOUT_B) & ~F.col("has")), "root").select("root")
    on = numbers_on_pages(pages).filter(F.col("number").isin("B", "5")).groupBy("root").agg(F.max_by("page", "number").alias("page"))
    df = lost.join(long_item(pages), "root", "left").join(on, "root", "left")
    return df.select("root", F.lit("5").alias("number"), F.lit(POINTS_OF_B).cast("bigint").alias("points"), "page", F.coalesce("block", F.lit(NO_TEXT_OF_B)).alias("statement"), F.when(F.col("block").isNotNull(), 0.7).otherwise(0.5).alias("confidence"), F.col("block").isNull().alias("review"))


def without_axis_lines(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """texts, one for each key, without stretches of short lines that a picture or a torn formula left in them.

    A stretch are lines next to each other of six characters or fewer, from the first of one to five on.  It goes if it
    has three lines or more and `Figura N` stands in it, in the two lines before or the three after.  Else, if it begins at most
    two lines into the stretch, six lines or more of at most three characters go that have a line of over eight within
    three before and three after.  Lines keep their order; null texts and texts without such lines stay as they are.

    Lines are rows, so a text of any length is sorted and not held; only neighbours of a stretch are looked up.
    """
    lines = texts.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("n", F.length(F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))))
    short = lines.filter("n <= 6").withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    runs = short.groupBy(*keys, "run").agg(
        F.min("pos").alias("s"), (F.max("pos") + 1).alias("e"), F.min(F.when(F.col("n").between(1, 5), F.col("pos"))).alias("i0"), F.coalesce(F.max(F.when(F.col("n") > 3, F.col("pos"))), F.lit(-1)).alias("far"),
        F.array_sort(F.collect_list(F.struct("pos", "n", "line"))).alias("own"),
    ).filter("i0 IS NOT NULL AND e - i0 >= 3")
    runs = runs.withColumn("i1", F.array_min(F.transform(F.filter("own", lambda x: (x["pos"] <= F.col("s") + 2) & x["n"].between(1, 5) & (x["pos"] > F.col("far"))), lambda x: x["pos"])))
    around = runs.select(*keys, "run", "i0", "i1", "e", F.explode(F.array(*(F.col("s") - i for i in (3, 2, 1)), *(F.col("e") + i for i in (0, 1, 2)))).alias("pos")).join(lines, [*keys, "pos"])
    near = around.groupBy(*keys, "run").agg(
        F.array_sort(F.collect_list(F.when((F.col("pos") >= F.col("e")) | (F.col("pos") >= F.col("i0") - 2), F.struct("pos", "n", "line")))).alias("near"),
        F.coalesce(F.bool_or((F.col("pos") < F.col("e")) & (F.col("pos") >= F.col("i1") - 3) & (F.col("n") > 8)), F.lit(False)).alias("before"), F.coalesce(F.bool_or((F.col("pos") >= F.col("e")) & (F.col("n") > 8)), F.lit(False)).alias("after"),
    )
    runs = runs.join(near, [*keys, "run"], "left")
    told = F.array_sort(F.concat(F.filter("own", lambda x: x["pos"] >= F.col("i0") - 2), F.coalesce("near", F.slice("own", 1, 0))))
    named = F.array_join(F.transform(told, lambda x: x["line"]), "\n").rlike(r"[Ff]igura\s*\d+")
    torn = F.coalesce((F.col("e") - F.col("i1") >= 6) & F.col("before") & F.col("after"), F.lit(False))
    gone = runs.select(*keys, F.when(named, F.col("i0")).when(torn, F.col("i1")).alias("start"), "e").filter("start IS NOT NULL").select(*keys, F.explode(F.sequence("start", F.col("e") - 1)).alias("pos"))
    touched = gone.select(*keys).distinct()
    kept = lines.join(touched, keys, "left_semi").join(gone, [*keys, "pos"], "left_anti").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("__kept"))
    out = texts.join(touched.withColumn("__touched", F.lit(True)), keys, "left").join(kept, keys, "left")
    return out.withColumn(text, F.when(F.col("__touched"), F.coalesce("__kept", F.lit(""))).otherwise(F.col(text))).drop("__touched", "__kept")


def trimmed_parents(questions: DataFrame) -> DataFrame:
    """(root, ord, statement) of groups whose statement goes on with their first child: it ends there.

    questions(root, ord, question_id, parent, number, is_group, statement).  The first child is the one of the least
    number as text; its number has to stand, as a word of its own, more than 20 characters into the statement, and 20
    characters or more have to be left.
    """
    first = questions.filter("parent IS NOT NULL AND number IS NOT NULL").groupBy("root", F.col("parent").alias("question_id")).agg(F.min("number").alias("child"))
    df = questions.filter("is_group AND coalesce(number, '') <> '' AND coalesce(statement, '') <> ''").join(first.filter("child <> ''"), ["root", "question_id"])
    # the text before the first such number; the whole text if there is none
    before = F.get(F.split("statement", F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), _quoted(F.col("child")), F.lit(r"\.?\s")), 2), F.lit(0))
    df = df.withColumn("before", before).withColumn("kept", strip(F.col("before")))
    return df.filter((F.length("before") < F.length("statement")) & (F.length("before") > 20) & (F.length("kept") >= 20)).select("root", "ord", F.col("kept").alias("statement"))
