"""Column functions on text.  Patterns are Unicode-aware and case-insensitive only where they say so."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"


def fold_accents(text: Column) -> Column:
    """Accented letters of the finite set without their accents."""
    return F.translate(text, ACCENTED, PLAIN)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def count_of(text: Column, part: str) -> Column:
    """Number of non-overlapping places of a string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("bigint")


def count_chars(text: Column, chars: str) -> Column:
    """Number of characters that are one of `chars`."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


#: The most numbers that a stretch of numbers is spelled out as.
WIDEST = 10_000


def span(low: Column, high: Column, widest: int = WIDEST) -> Column:
    """The whole numbers from low to high; of more than `widest` only the two ends; none if high is below low, null without ends."""
    wide = high.cast("decimal(20,0)") - low.cast("decimal(20,0)")
    none = F.slice(F.array(low), 1, 0)
    return F.when(wide < 0, none).when(wide < widest, F.sequence(low, F.when(wide.between(0, widest - 1), high).otherwise(low))).when(wide.isNotNull(), F.array(low, high))


def one_char_ratio(text: Column) -> Column:
    """Tokens of one character per thousand tokens (integer); 0 without tokens."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.when(F.size(tokens) == 0, F.lit(0)).otherwise(F.floor(1000 * F.size(F.filter(tokens, lambda t: F.length(t) == 1)) / F.size(tokens))).cast("bigint")


def natural_key(number: Column) -> Column:
    """Sort key of a dotted number: 1.2 before 1.10 before 2; parts that are no numbers come last."""
    return F.transform(F.split(number, r"[.\-]"), lambda p: F.coalesce(F.try_to_number(p, F.lit("9999999999")).cast("bigint"), F.lit(999)))


def replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    """The steps' replacements, one after the other."""
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


#: What stands on a line of its own in a statement, in order.
STATEMENT_STEPS = [
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
    (r"\s+(Sabe-se que:)\s*", "\n$1\n"),
    (r"\s+(Considere que:|Admita que:)\s*", "\n$1\n"),
    (r"\s*•\s*", "\n• "),
    (r";\s*\n•", ";\n•"),
    (r"\s+(Apresente (?:o resultado|a sua resposta)[^.]*\.)", "\n$1"),
    (r"\s+(Na sua resposta,[^.]*\.)", "\n$1"),
    (r"\s+\(([A-D])\)\s*", "\n($1) "),
]

#: LaTeX to plain text, in order.
LATEX_STEPS = [
    (r"\\frac\{([^}]*)\}\{([^}]*)\}", "$1/$2"), (r"\\sqrt\{([^}]*)\}", "√($1)"), (r"\\overrightarrow\{([^}]*)\}", "$1"), (r"\\left([(\[|])", "$1"), (r"\\right([)\]|])", "$1"),
    (r"\\cdot", "·"), (r"\\times", "×"), (r"\\leq", "≤"), (r"\\geq", "≥"), (r"\\pi", "π"), (r"\\in", "∈"), (r"\\infty", "∞"), (r"\\alpha", "α"), (r"\\beta", "β"), (r"\\theta", "θ"),
    (r"\\mathbb\{([^}]*)\}", "$1"), (r"\^\{([^}]*)\}", "^$1"), (r"_\{([^}]*)\}", "_$1"),
]


def format_statement(text: Column) -> Column:
    """A statement with introductions, list marks, options and final instructions on lines of their own; null is empty.

    A line end after a LaTeX row break stays where it is.
    """
    kept = F.lit("\\\\ __NL__ ")
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    s = replaced(F.replace(s, F.lit("\\\\\n"), kept), STATEMENT_STEPS)
    s = F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"^(\d+(?:\.\d+)?)\.\s+", "$1. ")
    lines = F.filter(F.transform(F.split(s, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.replace(F.array_join(lines, "\n"), kept, F.lit("\\\\\n"))


def latex_to_plain(text: Column) -> Column:
    """Readable text of LaTeX: known commands as characters, other commands, braces and delimiters gone."""
    bare = F.regexp_replace(text, r"\\[()]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(replaced(bare, LATEX_STEPS), r"\\[a-zA-Z]+", ""), r"[{}]", ""), r"^\s+|\s+$", "")


def fractions_to_latex(text: Column) -> Column:
    """Whole numbers with a slash between as LaTeX fractions, unless the text has fractions already."""
    made = F.regexp_replace(text, r"(?U)(?<![\w.])([0-9]{1,4})\s*/\s*([0-9]{1,4})(?![\w.])", r"\\(\\frac{$1}{$2}\\)")
    return F.when(text.contains("\\frac"), text).otherwise(made)


def math_spans(text: Column) -> Column:
    """(plain, latex) of each inline formula."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\\\((.+?)\\\)"), F.lit(1)), lambda x: F.struct(latex_to_plain(x).alias("plain"), F.concat(F.lit("\\("), x, F.lit("\\)")).alias("latex")))


def latex_checks(text: Column) -> Column:
    """(delimiters, parentheses, braces, likely): whether each is balanced, and whether the text is LaTeX at all."""
    same = lambda a, b: count_of(text, a) == count_of(text, b)
    return F.struct(same("\\(", "\\)").alias("delimiters"), same("(", ")").alias("parentheses"), (brace_balance(text) == 0).alias("braces"), text.rlike(r"\\frac|\\sqrt|\\pi|\\in|\\mathbb|\\left|\\right|\^\{").alias("likely"))


def brace_balance(text: Column) -> Column:
    """Final balance of braces, -1 if a closing one ever comes first."""
    step = lambda acc, ch: F.when(acc < 0, acc).when(ch == "{", acc + 1).when(ch == "}", acc - 1).otherwise(acc)
    return F.aggregate(F.split(text, ""), F.lit(0), step).cast("bigint")


def parse_json(text: Column) -> Column:
    """JSON text that parses: the whole, what a fence holds, or the first braces; null if none does."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(*(F.when(F.try_parse_json(t).isNotNull(), t) for t in (text, fenced, braces)))


def normalise_url(url: Column) -> Column:
    """Lower-case scheme and host, without mobile prefix, query, fragment and final slash."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"/+$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^https?://([^/]+)", 1)), r"^(?:www|m)\.", "")
    return F.concat(F.lit("https://"), host, F.regexp_extract(u, r"^https?://[^/]+(/.*)?$", 1))


def sort_key(number: Column) -> Column:
    """Parts of a number between dots and dashes, as numbers to sort by; one zero if a part is none."""
    parts = F.transform(F.filter(F.split(number, r"[.\-]"), lambda p: p != ""), lambda p: p.try_cast("double"))
    return F.when(F.exists(parts, lambda p: p.isNull()), F.array(F.lit(0.0))).otherwise(parts)
