"""Document fingerprints (I-Match): terms of a band of document frequencies, hashed over randomised lexicon subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term is in the band if it stands in at least 1 / RARE and at most 1 / COMMON of all documents.
RARE, COMMON = 2000, 10
#: Subsets of a scale; at scale s each is a random 1 / 4 ** (s + 1) of the lexicon.
SLOTS = 32
#: A text is read at the first scale whose subsets hold LOAD of its terms or fewer on average, and at the next.
LOAD = 2
#: Lists that a lexicon is dealt over, so that a look-up reads a few numbers.
LISTS = 1 << 16


#: ASCII characters that stand in no word.
SEPARATORS = "".join(chr(b) for b in range(128) if not chr(b).isalnum())


def terms(text: str) -> Column:
    """The distinct words of a text, each as the number that the first 60 bits of its md5 are."""
    spaced = F.translate(text, UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    words = F.filter(F.array_distinct(F.split(spaced, " ")), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.left(F.md5(F.encode(w, "UTF-8")), F.lit(15)), 16, 10).cast("long"))


def band(docs: DataFrame, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """(term, df) of docs(text): terms of the band.  There are at most `rare` times the mean number of a text's terms."""
    found = docs.select(F.explode(terms("text")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return found.filter((F.col("df") * rare >= docs.count()) & (F.col("df") * common <= docs.count()))


def _in_band(rows: DataFrame, column: str, lexicon: DataFrame, most: int) -> DataFrame:
    """Rows whose array `column` keeps only terms of the lexicon.

    Up to `most` terms the lexicon is one value, looked up where the row stands; beyond it the terms of distinct arrays
    meet the lexicon in a join.
    """
    if lexicon.limit(most + 1).count() <= most:
        lists = lexicon.groupBy((F.col("term") % LISTS).alias("at")).agg(F.collect_list("term").alias("list"))
        full = rows.sparkSession.range(LISTS).select(F.col("id").alias("at")).join(lists, "at", "left").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("list", F.expr("CAST(array() AS ARRAY<BIGINT>)")).alias("list")))).alias("all")).select("all.list")
        return rows.withColumn("lexicon", full.scalar()).withColumn(column, F.expr(f"filter({column}, t -> array_contains(lexicon[CAST(t % {LISTS} AS INT)], t))")).drop("lexicon")
    sets = rows.select(F.col(column).alias("was"), F.sha2(F.concat_ws(" ", F.col(column).cast("array<string>")), 256).alias("key"))
    known = sets.groupBy("key").agg(F.first("was").alias("was")).select("key", F.explode("was").alias("term")).join(lexicon, "term").groupBy("key").agg(F.collect_list("term").alias("known"))
    keyed = rows.withColumn("key", F.sha2(F.concat_ws(" ", F.col(column).cast("array<string>")), 256))
    return keyed.join(known, "key", "left").withColumn(column, F.coalesce("known", F.expr("CAST(array() AS ARRAY<BIGINT>)"))).drop("key", "known")


def _slots(scale: str) -> str:
    """SQL for the hashes of a scale's subsets, each with its scale and number; a subset without a term has none.

    Each term is put beside the numbers of its subsets once; of a scale with more classes than SLOTS the first ones count.
    """
    bits = f"(2 * ({scale} + 1))"
    mask = f"(shiftleft(1L, {bits}) - 1)"
    few = f"IF({bits} <= 5, kept, filter(kept, t -> t & {mask} < {SLOTS}))"
    rounds = f"sequence(0, IF({bits} <= 5, CAST({SLOTS} / shiftleft(1, {bits}) AS INT), 1) - 1)"
    pairs = f"flatten(transform({rounds}, r -> transform({few}, t -> struct(shiftleft(CAST(r AS BIGINT), {bits}) + (shiftright(t, r * {bits}) & {mask}) AS k, t AS t))))"
    # p is bound to the pairs, so that they are made once and not for each subset
    chosen = f"transform(array({pairs}), p -> transform(sequence(0L, {SLOTS - 1}L), k -> struct(k, transform(filter(p, x -> x.k = k), x -> x.t) AS x)))[0]"
    return f"transform(filter({chosen}, s -> size(s.x) > 0), s -> concat_ws('.', {scale}, s.k, left(md5(array_join(CAST(s.x AS ARRAY<STRING>), ' ')), 8)))"


def _printed(rows: DataFrame, text: str, lexicon: DataFrame, most: int, scale: str, slots: str) -> DataFrame:
    """Adds the scale of a text, by how many terms it has, and the slots of this scale and the next.

    The subsets of the next scale lie in those of this one, so only terms in these are looked up in the lexicon.
    """
    bits = f"(2 * ({scale} + 1))"
    rows = rows.withColumn("own", terms(text)).withColumn(scale, F.expr(f"IF(size(own) = 0, -9, size(filter(sequence(1, 12), j -> size(own) > {LOAD} * shiftleft(1L, 2 * j))))"))
    rows = rows.withColumn("own", F.expr(f"IF({bits} <= 5, own, filter(own, t -> t & (shiftleft(1L, {bits}) - 1) < {SLOTS}))")).withColumn("kept", F.col("own"))
    rows = _in_band(rows, "kept", lexicon, most).withColumn("kept", F.expr("sort_array(IF(size(kept) > 0, kept, own))")).drop("own")
    rows = rows.withColumn(scale, F.expr(f"IF(size(kept) = 0, -9, {scale})"))
    return rows.withColumn(slots, F.expr(f"IF(size(kept) = 0, array(concat('x.', md5(encode({text}, 'UTF-8')))), concat({_slots(scale)}, {_slots(f'({scale} + 1)')}))")).drop("kept")


def likeness(scale1: str, slots1: str, scale2: str, slots2: str) -> str:
    """SQL for the share of equal hashes among the subsets, of scales both texts are read at, where either has a term."""
    shared = lambda x: f"transform(filter({x}, e -> CAST(substring_index(e, '.', 1) AS INT) BETWEEN greatest({scale1}, {scale2}) AND least({scale1}, {scale2}) + 1), e -> substring_index(e, '.', 2))"
    either = f"size(array_union({shared(slots1)}, {shared(slots2)}))"
    return f"IF({scale1} < 0 OR {scale2} < 0 OR {either} = 0, IF({slots1} = {slots2}, 1.0D, 0.0D), size(array_intersect({slots1}, {slots2})) / CAST({either} AS DOUBLE))"


def fingerprint(docs: DataFrame, text: str = "text", rare: int = RARE, common: int = COMMON, most: int = 1_000_000) -> DataFrame:
    """docs with a column fingerprint: I-Match hashes over several random subsets of the lexicon.

    The lexicon are the words (runs of ASCII letters, digits and other characters above ASCII, A-Z in lower case) that
    stand in at least 1 / rare and at most 1 / common of the documents; a text that has none of them in its subsets uses
    all its words there, one without words its digest.  The distinct terms in each subset are sorted and hashed.  Equal texts have
    equal fingerprints.  A null text is empty; texts of any length are read whole; docs must not have columns scale,
    slots, own, kept or lexicon.
    """
    base = docs.withColumn(text, F.coalesce(text, F.lit("")))
    lexicon = materialize(band(base.select(F.col(text).alias("text")), rare, common).select("term"), "lexicon")
    return _printed(base, text, lexicon, most, "scale", "slots").withColumn("fingerprint", F.concat_ws(" ", "slots")).drop("scale", "slots")


def _successors(ids: DataFrame) -> DataFrame:
    """Adds next to ids(doc_id, ..), whose doc_ids are distinct: the next larger one; of the largest the smallest, where null is.

    Ids are dealt over ranges; only the first of each range crosses to the one before.
    """
    dealt = materialize(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    starts = dealt.groupBy("part").agg(F.min("doc_id").alias("start"), F.max(F.col("doc_id").isNull()).alias("none"))
    w = Window.orderBy("part")  # one row for each range
    starts = starts.select("part", F.lead("start").over(w).alias("start"))
    whole = dealt.agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("none")).select(F.expr("IF(none, NULL, least)").alias("least"))
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return dealt.withColumn("next", inside).join(starts, "part").withColumn("next", F.coalesce("next", "start", whole.scalar())).drop("part", "start")


def compare_with_edits(docs: DataFrame, rare: int = RARE, common: int = COMMON, most: int = 1_000_000) -> DataFrame:
    """Fingerprints of docs(doc_id, text) and of texts whose last quarter is the start of the next document's text.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (likeness of the
    fingerprint to the edited text's and to the next document's), a row for each row of docs.  The next document has
    the next larger doc_id (after the largest the smallest; null comes first); of rows with one doc_id it is the one
    whose text has the least sha256.  A null text is empty; repeated rows stay; texts of any length are read whole;
    other columns are ignored; no rows give no rows.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lexicon = materialize(band(base, rare, common).select("term"), "lexicon")
    order = materialize(_successors(base.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 4)).cast("int").alias("need"))), "order")
    before = order.select(F.col("doc_id").alias("id"), F.col("next"), F.col("need"))
    digest = F.sha2(F.encode("text", "UTF-8"), 256)
    heads = base.join(before, base.doc_id.eqNullSafe(before.next)).groupBy("id").agg(F.min_by(F.expr("left(text, need)"), digest).alias("head"))
    both = base.join(heads, base.doc_id.eqNullSafe(heads.id)).withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.expr("CAST(n_chars div 4 AS INT)"))
    both = both.select("doc_id", "text", "n_chars", F.expr("concat(left(text, CAST(n_chars AS INT) - cut), left(head, cut))").alias("edited"))
    found = _printed(_printed(both, "text", lexicon, most, "scale", "slots"), "edited", lexicon, most, "edited_scale", "edited_slots")
    found = found.select("doc_id", digest.alias("digest"), "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "scale", "slots", F.concat_ws(" ", "edited_slots").alias("edited_fingerprint"), F.expr(likeness("scale", "slots", "edited_scale", "edited_slots")).alias("near_edited"))
    found = materialize(found, "fingerprints")
    after = found.join(before, found.doc_id.eqNullSafe(before.next)).groupBy("id").agg(F.min_by(F.struct("scale", "slots"), "digest").alias("then"))
    out = found.join(after, found.doc_id.eqNullSafe(after.id))
    return out.select("doc_id", "n_chars", "edited_sha256", F.concat_ws(" ", "slots").alias("fingerprint"), "edited_fingerprint", "near_edited", F.expr(likeness("scale", "slots", "then.scale", "then.slots")).alias("near_next"))
