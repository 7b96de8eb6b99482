"""N-gram Jaccard self-join: rare-first prefixes with length, positional and suffix filters, each pair verified once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, WordHashes, discard, materialize, mix, sum_tables, table_blocks, windows
from .components import connected_components

#: Counters of the frequency table: 4 bytes each, so 16 MB, at every size of input.
SKETCH_BITS = 22
#: Bits of a set's parity signature, for the suffix filter.
PARITY_BITS = 512


def shingle_hashes(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it has fewer words; none without words."""
    words = (text or "").encode().translate(LOWER_BYTES).split()
    h = hashes.of(words)
    return np.unique(windows(h, min(k, len(words)))) if words else h


def parity_of(hashes: np.ndarray) -> bytes:
    """Whether an odd number of hashes falls on each of PARITY_BITS places: a hash that only one of two sets has flips one bit."""
    return np.packbits(np.bincount((hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1 > 0).tobytes()


def node_of(hashes: np.ndarray) -> int:
    """A set's own 64-bit number: equal sets are one node."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _scan(docs: DataFrame, k: int) -> DataFrame:
    """One reading of the texts: a row per document (block null), and each task's shares of the frequency table.

    A column digest is passed on where docs has one.
    """
    told = "digest" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        table = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        names = ["block", "doc_id", "n", "node", "data", "digest"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            n, node, parity = [], [], []
            for text in batch.column("text"):
                s = shingle_hashes(text.as_py(), k, hashes)
                np.add.at(table, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
                parity.append(parity_of(s))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[None] * len(n), batch.column("doc_id").to_pylist(), n, node, parity, batch.column("digest").to_pylist() if told else [None] * len(n)], kinds, strict=True)], names)
        for block, data in table_blocks(table):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([block, None, None, None, data, None], kinds, strict=True)], names)

    return docs.mapInArrow(run, "block int, doc_id bigint, n bigint, node bigint, data binary, digest binary")


def _prefixes(docs: DataFrame, table, k: int, num: int, den: int, hot: int) -> DataFrame:
    """(key, salt, node, n, pos): a set's first n - ceil(n * num / den) + 1 hashes by frequency, then hash.

    A hash that may stand in more than `hot` sets is dealt over several salts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, count, done = WordHashes(), table.value, set()
        for batch in batches:
            cols = [[], [], [], [], []]
            for text in batch.column("text"):
                s = shingle_hashes(text.as_py(), k, hashes)
                n = len(s)
                if not n or (node := node_of(s)) in done:  # copies in this task; others meet by their node
                    continue
                done.add(node)
                if len(done) > 200_000:
                    done.clear()
                p = n - -(-n * num // den) + 1
                f = count[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                at = np.argsort(f, kind="stable")[:p]  # s is sorted, so ties stand in order of the hash
                salts = f[at].astype(np.int64) // hot + 1
                for c, x in zip(cols, (s[at].view(np.int64), np.where(salts > 1, 1 + abs(node) % salts, 0), np.full(p, node), np.full(p, n), np.arange(p)), strict=True):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(cols, (np.int64, np.int32, np.int64, np.int32, np.int32), strict=True)], ["key", "salt", "node", "n", "pos"])

    return docs.mapInArrow(run, "key bigint, salt int, node bigint, n int, pos int")


MEMBERS = "key bigint, salt int, node bigint, n int, pos int, node2 bigint, n2 int, pos2 int, three boolean"


def _beside_first(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Each row beside the first of its run, in one stream over rows sorted by key, salt, size and node.

    A key's rows fall into runs of sizes, each allowed by the length filter beside the one before it; no pair across
    runs can link.  Unsalted keys are told apart by run, and their rows that are alone in one go; repeated rows of a
    node go.  A salted key's rows all stay, as others of like size may have other salts.  `three` is false only for
    rows of a run of two, whose only pair this is (it is true where a batch cuts a run or a key is salted).
    """
    kinds = (np.int64, np.int32, np.int64, np.int32, np.int32)
    names = ["key", "salt", "node", "n", "pos", "node2", "n2", "pos2", "three"]

    def out(x: list[np.ndarray], firsts: list[np.ndarray], three: np.ndarray) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            own = np.where(x[1] > 0, x[0], (x[0].view(np.uint64) ^ mix(firsts[1].astype(np.uint64))).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip([own, *x[1:], *firsts, three], (*kinds, *kinds[2:], bool), strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose next is not known yet; whether its run has one before it; the run's first
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [c.to_numpy() for c in batch.columns]
            if held:
                x = [np.concatenate([[v], c]).astype(t) for v, c, t in zip(held[0], x, kinds, strict=True)]
            same = (x[0][1:] == x[0][:-1]) & (x[1][1:] == x[1][:-1])
            x = [c[np.concatenate([[True], ~(same & (x[2][1:] == x[2][:-1]))])] for c in x]
            key, salt, _, n, _ = x
            m = len(key)
            near = np.zeros(m + 1, dtype=bool)  # near[i]: row i is in the run of row i - 1
            near[0] = bool(held) and held[1]
            near[1:m] = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1]) & (n[:-1].astype(np.int64) * den >= n[1:].astype(np.int64) * num)
            starts, group = np.flatnonzero(~near[:m]), np.cumsum(~near[:m])  # group 0 goes on with held's run
            firsts = [np.concatenate([[held[2][i] if held else 0], x[i + 2][starts]])[group] for i in range(3)]
            keep = near[:-1] | near[1:] | (salt > 0)
            keep[-1] = False
            three = (np.bincount(group)[group] > 2) | (group == 0) | (group == group[-1]) | (salt > 0)
            if keep.any():
                yield out([c[keep] for c in x], [c[keep] for c in firsts], three[keep])
            held = tuple(c[-1] for c in x), bool(near[m - 1]), tuple(c[-1] for c in firsts)
        if held and (held[1] or held[0][1] > 0):
            yield out([np.array([v], dtype=t) for v, t in zip(held[0], kinds, strict=True)], [np.array([v], dtype=t) for v, t in zip(held[2], kinds[2:], strict=True)], np.ones(1, dtype=bool))

    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "node").mapInArrow(run, MEMBERS)


def _possible(num: int, den: int) -> Column:
    """Length and positional filters on a pair that meets at places pos and pos2 of sets of n and n2."""
    # intersection >= num * union / den  <=>  intersection * (den + num) >= num * (n + n2)
    small, large = F.least("n", "n2").cast("long"), F.greatest("n", "n2").cast("long")
    rest = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    before = F.least("pos", "pos2")  # the hashes that the two sets may share before this one
    return (small * den >= large * num) & ((rest + before) * (den + num) >= (F.col("n") + F.col("n2")) * num)


def _marks(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(ids.view(np.uint64)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _bits(ids: DataFrame) -> np.ndarray:
    """A table of fixed size that marks the given doc_ids (and, by chance, a few others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(1 << SKETCH_BITS, dtype=bool)
        for batch in batches:
            marks[_marks(batch.column("doc_id").to_numpy())] = True
        if marks.any():
            yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(np.packbits(marks).tobytes())], pa.binary())], ["data"])

    found = np.zeros(1 << SKETCH_BITS - 3, dtype=np.uint8)
    for row in ids.select("doc_id").coalesce(64).mapInArrow(run, "data binary").toLocalIterator():
        found |= np.frombuffer(zstandard.decompress(row["data"]), dtype=np.uint8)
    return np.unpackbits(found).view(bool)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, PARITY_BITS // 64)


def _near_enough(x: np.ndarray, y: np.ndarray, both: np.ndarray, num: int, den: int) -> np.ndarray:
    """Suffix filter: signatures that differ in d bits belong to sets that differ in d hashes or more; both: n + n2."""
    apart = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    # 2 * intersection = n + n2 - difference
    return (both - apart) * (den + num) >= 2 * num * both


def _texts(nodes: DataFrame, docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(node, text) of the given nodes, compressed: only texts whose doc_id a table of fixed size marks leave their task."""
    wanted = materialize(nodes.select("node").distinct().join(classes, "node"), "wanted")
    marks = docs.sparkSession.sparkContext.broadcast(_bits(wanted))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pack = WordHashes(), zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            batch = batch.filter(pa.array(marks.value[_marks(batch.column("doc_id").to_numpy())]))
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if len(s := shingle_hashes(text.as_py(), k, hashes)):  # rows that repeat a doc_id may be other nodes
                    rows.append((node_of(s), doc, pack(text.as_py().encode())))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["node", "doc_id", "text"])

    found = docs.select("doc_id", "text").mapInArrow(marked, "node bigint, doc_id bigint, text binary").join(wanted, ["node", "doc_id"], "left_semi")
    out = materialize(found.dropDuplicates(["node", "doc_id"]).select("node", "text"), "texts")
    discard(wanted)
    return out


def _near(pairs: DataFrame, signatures: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs(a, b) that the suffix filter leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = _near_enough(_signatures(batch.column("sa")), _signatures(batch.column("sb")), batch.column("both").to_numpy(), num, den)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    of = lambda node, n, data: signatures.select(F.col("node").alias(node), F.col("n").alias(n), F.col("data").alias(data))
    both = pairs.join(of("a", "na", "sa"), "a").join(of("b", "nb", "sb"), "b")
    return both.select("a", "b", "sa", "sb", (F.col("na") + F.col("nb")).alias("both")).mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """pairs(a, b) of nodes -> those whose sets meet the threshold."""

    def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack = WordHashes(), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("ta"), batch.column("tb"), strict=True):
                x, y = (shingle_hashes(unpack(t.as_py()).decode(), k, hashes) for t in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both * den >= (len(x) + len(y) - both) * num)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return materialize(both.select("a", "b", "ta", "tb").mapInArrow(equal, "a bigint, b bigint"), "links")


#: Places of a key's strays or members in one block.
BLOCK_ROWS = 1000
#: Pairs that are looked at together in memory (about 200 bytes each).
PAIRS = 250_000
#: By rank of nearness, which candidates of a stray each round tries; a block has no more members than the last covers.
RANKS = [0, 2, 16, 1 << 40]


def _mixed(members: DataFrame, parts: DataFrame, signatures: DataFrame) -> DataFrame:
    """The members of keys that hold several components, each with its part, its signature, the key's main part and its numbers of blocks.

    Runs of two are left out: their pair was tried already.
    """
    named = members.filter("three").select("key", "node", "n", "pos").join(parts, members["node"] == parts["id"], "left").select("key", "node", "n", "pos", F.coalesce("component", "node").alias("part"))
    named = materialize(named, "named")
    discard(members)
    mixed = named.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("key")
    sizes = named.join(mixed, "key", "left_semi").groupBy("key", "part").agg(F.countDistinct("node").alias("m")).groupBy("key").agg(F.max(F.struct("m", "part")).alias("main"), F.sum("m").alias("total"))
    blocks = lambda c: F.greatest(F.ceil(c / BLOCK_ROWS), F.lit(1)).cast("int")
    sizes = materialize(sizes.select("key", F.col("main.part").alias("main"), blocks(F.col("total")).alias("nb"), blocks(F.col("total") - F.col("main.m")).alias("ns")), "sizes")
    out = materialize(named.join(sizes, "key").distinct().join(signatures.select("node", "data"), "node").select("key", "node", "n", "pos", "part", "main", "nb", "ns", "data"), "mixed")
    discard(named, sizes)
    return out


def _candidates(rows: DataFrame, ranks: tuple[int, int], num: int, den: int) -> DataFrame:
    """Of each row outside its key's main part, the candidates of these ranks that are in another component now.

    rows: as _mixed gives them, and `now`, a row's present component.  A row's candidates in a block are members of
    other parts that length, positional and suffix filters leave; the fewer bits differ, the lower their rank.
    Gives (key, x, y, more): pairs, with more true if the row has candidates of later ranks.  With ranks from
    0 on also, with y null, each row that is in any pair.  So no more rows come out than go in, times the ranks.
    Keys of many members are dealt over blocks: strays by members.
    """
    small = (F.col("nb") == 1) & (F.col("ns") == 1)  # one block: a stray is a member that asks
    place, own = F.xxhash64("node"), ["node", "n", "pos", "part", "now", "data"]
    as_member = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("i"), F.pmod(place, "nb").cast("int").alias("j"), (small & (F.col("part") != F.col("main"))).alias("asks"), F.lit(True).alias("member"), *own)
    as_stray = rows.filter((F.col("part") != F.col("main")) & ~small).select("key", F.pmod(place, "ns").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("member"), *own)
    keys = ["key", "i", "j"]

    def out(*columns: np.ndarray | pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["key", "x", "y", "more"])

    def groups(g: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole groups, all at once: each stray beside each member of its group, so many strays at a time as make PAIRS pairs."""
        key, i, j, node, n, pos, part, now = (g.column(c).to_numpy().astype(np.int64) for c in (*keys, "node", "n", "pos", "part", "now"))
        asks, data = g.column("asks").to_numpy(), _signatures(g.column("data"))
        group = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) - 1
        strays, there, seen = np.flatnonzero(asks), np.flatnonzero(g.column("member").to_numpy()), np.zeros(len(key), dtype=bool)
        many = np.bincount(group[there], minlength=group[-1] + 1)
        begin, reps = (np.cumsum(many) - many)[group[strays]], many[group[strays]]
        chunk = np.cumsum(reps) // PAIRS
        for at, end in zip(*(np.searchsorted(chunk, np.unique(chunk), side) for side in ("left", "right")), strict=True):
            r = reps[at:end]
            x = np.repeat(strays[at:end], r)
            y = there[np.repeat(begin[at:end], r) + np.arange(len(x)) - np.repeat(np.cumsum(r) - r, r)]
            ok = (part[x] != part[y]) & (np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num)
            x, y = x[ok], y[ok]
            ok = (np.minimum(n[y] - pos[y], n[x] - pos[x]) + np.minimum(pos[x], pos[y])) * (den + num) >= (n[x] + n[y]) * num
            x, y = x[ok], y[ok]
            apart = np.bitwise_count(data[x] ^ data[y]).sum(axis=-1, dtype=np.int64)
            ok = (n[x] + n[y] - apart) * (den + num) >= 2 * num * (n[x] + n[y])
            x, y, apart = x[ok], y[ok], apart[ok]
            if not len(x):
                continue
            seen[x] = seen[y] = True
            order = np.lexsort((node[y], apart, x))
            x, y = x[order], y[order]
            first = np.concatenate([[True], x[1:] != x[:-1]])
            rank = np.arange(len(x)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            apart_now = now[x] != now[y]
            more = np.zeros(len(key), dtype=bool)
            more[x[apart_now & (rank >= ranks[1])]] = True
            ok = apart_now & (rank >= ranks[0]) & (rank < ranks[1])
            yield out(key[x[ok]], node[x[ok]], node[y[ok]], more[x[ok]])
            more[x[ok]] = False
            alone = np.flatnonzero(more)  # all of their candidates come later
            yield out(key[alone], node[alone], node[alone], np.ones(len(alone), dtype=bool))
        if ranks[0] == 0 and seen.any():
            x = np.flatnonzero(seen)
            x = x[np.lexsort((node[x], group[x]))]
            x = x[np.concatenate([[True], (node[x][1:] != node[x][:-1]) | (group[x][1:] != group[x][:-1])])]
            yield out(key[x], node[x], pa.nulls(len(x), pa.int64()), np.zeros(len(x), dtype=bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last group so far
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys])
            cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
            if held and tuple(held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in keys) != tuple(k[:, 0]):
                yield from groups(pa.Table.from_batches(held).combine_chunks())
                held = []
            if len(cuts):
                yield from groups(pa.Table.from_batches([*held, batch.slice(0, cuts[-1])]).combine_chunks())
                held = []
            held.append(batch.slice(cuts[-1] if len(cuts) else 0))
        if held:
            yield from groups(pa.Table.from_batches(held).combine_chunks())

    found = as_member.unionByName(as_stray).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "key bigint, x bigint, y bigint, more boolean")
    return materialize(found, "candidates")


def _more_links(mixed: DataFrame, tried: DataFrame, links: DataFrame, parts: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """parts after all candidates of mixed are either in one component or refuted.

    Every round tries each stray's next nearest candidates, so most of what links does so in the first, and what is
    then in one component is not tried any more.  The text of a node is fetched once.
    """
    texts, rows = None, mixed.withColumn("now", F.col("part"))
    for ranks in zip(RANKS, RANKS[1:], strict=False):
        found = _candidates(rows, ranks, num, den)
        if texts is None:
            known = found.filter("y is null").select("key", F.col("x").alias("node")).distinct()
            texts = _texts(known.select("node"), docs, classes, k)
            rows = materialize(rows.join(known, ["key", "node"], "left_semi"), "open")
            discard(mixed)
        pairs = found.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        new = _verified(pairs, texts, k, num, den)
        tried = tried.unionByName(pairs)
        if not new.isEmpty():
            parts = materialize(connected_components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(new)), "parts")
        open_keys = found.filter("more").select("key").distinct()
        if open_keys.isEmpty():
            break
        named = parts.select(F.col("id").alias("node"), "component")
        rows = rows.join(open_keys, "key", "left_semi").join(named, "node", "left").withColumn("now", F.coalesce("component", "node")).drop("component")
        rows = materialize(rows, "open")
    return parts


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, hot: int = 1_000_000) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Words: runs of characters other than space and tab to carriage return, after lower-casing A-Z.  A set:
    the distinct k-word shingles, or the whole sequence if it has fewer words.  Two documents link when
    den * intersection >= num * union.  Shingles, and whole sets, are compared by 64-bit hashes.

    Equal sets are one node.  Sets are ordered by a frequency table of all documents (of fixed size; any
    order gives the same links, a better one fewer candidates).  Nodes that share a prefix shingle are
    candidates if their sizes allow a link.  First each member of a shingle's group meets the group's first, and
    what links is united; then members outside the group's main component meet the others, nearest first and in
    rounds, and only those that no earlier round has united, so a group of near copies never yields all its pairs.  Shingles that may stand in more than `hot` sets are salted.

    Null or wordless text: an empty set, linked with nothing.  Rows with a null doc_id get component_id
    null and link with nothing.  Rows that repeat a doc_id each stand for their own text.  An empty table
    gives no rows.  Extra columns are ignored.
    """
    rows, nodes = _grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, num, den, hot)
    out = rows.join(nodes.select("node", "component_id"), "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def _grouped(docs: DataFrame, k: int, num: int, den: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text, perhaps digest) -> rows (doc_id, n, node, digest), and nodes (node, part, component_id)."""
    spark = docs.sparkSession
    scanned = materialize(_scan(docs, k), "shingles")
    rows = scanned.filter("block is null").select("doc_id", "n", "node", "digest")
    table = spark.sparkContext.broadcast(sum_tables(scanned.filter("block is not null"), 1 << SKETCH_BITS))
    docs = docs.filter("doc_id is not null")

    classes = materialize(rows.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "classes")
    signatures = scanned.filter("node is not null").select("doc_id", "node", "n", "data").join(classes, ["node", "doc_id"], "left_semi").select("node", "n", "data")
    signatures = materialize(signatures.dropDuplicates(["node"]), "signatures")

    members = materialize(_beside_first(_prefixes(docs, table, k, num, den, hot), num, den), "members")
    firsts = members.filter("salt > 0 and node = node2").select("key", "node", "n", "pos").distinct()
    ends = firsts.groupBy("key").agg(F.min(F.struct("node", "n", "pos")).alias("f")).select("key", F.col("f.node").alias("node2"), F.col("f.n").alias("n2"), F.col("f.pos").alias("pos2"))
    meet = members.select("node", "n", "pos", "node2", "n2", "pos2").unionByName(firsts.join(ends, "key").select("node", "n", "pos", "node2", "n2", "pos2"))
    ordered = [F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")]
    pairs = materialize(meet.filter("node <> node2").filter(_possible(num, den)).select(*ordered).distinct(), "pairs")
    near = materialize(_near(pairs, signatures, num, den), "near")
    texts = _texts(near.select(F.explode(F.array("a", "b")).alias("node")), docs, classes, k)
    links = _verified(near, texts, k, num, den)
    discard(texts, pairs)
    parts = materialize(connected_components(links), "parts")
    mixed = _mixed(members, parts, signatures)
    discard(signatures)
    parts = _more_links(mixed, near, links, parts, docs, classes, k, num, den)

    nodes = classes.join(parts, classes["node"] == parts["id"], "left").select("node", "doc_id", F.coalesce("component", "node").alias("part"))
    ends = nodes.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return rows, materialize(nodes.select("node", "part").join(ends, "part").select("node", "part", "component_id"), "nodes")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, hot: int = 1_000_000) -> DataFrame:
    """docs, all columns as they are, with one row of each group of documents that link (over any number of links).

    The one of smallest doc_id stays; of several with that doc_id, the one whose text has the smallest SHA-256, and
    of equal ones any.  A doc_id may have several texts: each is judged by itself.  Rows with a null doc_id, null
    or wordless texts stay.
    """
    doc_id, digest = docs["doc_id"].cast("long"), F.unhex(F.sha2(docs["text"], 256))
    rows, nodes = _grouped(docs.select(doc_id.alias("doc_id"), "text", digest.alias("digest")), k, num, den, hot)
    named = rows.filter("doc_id is not null and node is not null").join(nodes, "node")
    told = materialize(named.groupBy("part", "doc_id", "digest").agg(F.count("*").alias("m")), "group-rows")
    best = told.groupBy("part").agg(F.min(F.struct("doc_id", "digest")).alias("best"), F.sum("m").alias("total")).filter("total > 1")
    told = told.join(best, "part").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "m", (F.struct("doc_id", "digest") == F.col("best")).alias("first"))
    told = materialize(told.filter("not first or m > 1"), "group-copies")
    same = (doc_id == F.col("__id")) & (digest == F.col("__digest"))
    # what is no copy, and one each of rows that only equal ones stand beside
    out = docs.join(told.select("__id", "__digest"), same, "left_anti")
    again = told.filter("first").select("__id", "__digest")
    if again.isEmpty():
        return out
    return out.unionByName(docs.join(again, same).dropDuplicates(["__id", "__digest"]).drop("__id", "__digest"))
