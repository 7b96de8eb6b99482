"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import base64
import heapq
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnitCache, env_threads_off

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, cost double"
TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as ranks.
RANKS = "byte_bpe_50k.tiktoken"
#: Tokens that one task packs at a time (4 bytes each).
WINDOW_TOKENS = 4_000_000


def pack_ids(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, dtype="<u4").tobytes()


#: What units may hold to go the fast way: characters that every Unicode version classes alike.
PLAIN = re.compile(r"[ -~\n\u00c0-\u024f]*")


def encoder(tokenizer: str, path: str | None = None, ranks: str | None = RANKS, ranks_path: str | None = None, most_units: int = 700_000) -> UnitCache:
    """Ids of texts as the `tokenizers` library gives them without added special tokens; special strings by its default.

    Units of plain characters are encoded from the same vocabulary's ranks, several times faster; ranks=None
    leaves all to the library.
    """
    env_threads_off()
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or public_tokenizers.path(tokenizer))
    t.no_truncation()
    t.no_padding()
    special = tuple(x.content for x in t.get_added_tokens_decoder().values())
    whole = lambda text: pack_ids(t.encode(text, add_special_tokens=False).ids)
    if ranks is None:
        return UnitCache(whole, lambda unit: whole(" " + unit), b"".join, special, most_units)
    import tiktoken

    with open(ranks_path or public_tokenizers.path(ranks), "rb") as f:
        table = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding(tokenizer, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def unit(text: str) -> bytes:
        return pack_ids(fast(" " + text)) if PLAIN.fullmatch(text) else whole(" " + text)

    return UnitCache(whole, unit, b"".join, special, most_units)


def cost_of(length: int, linear: float, quadratic: float) -> float:
    """Estimated cost of a piece: linear work for each token, and attention among the piece's tokens."""
    return linear * length + quadratic * length * length


def sequence_lengths(total: int, size: int) -> list[int]:
    """Full sequences, then the rest as powers of two, which need no padding."""
    rest = total % size
    return [size] * (total // size) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def balance(lengths: list[int], size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Packs documents of the given lengths; (document, start, length, sequence, offset) of each piece.

    Documents in descending cost (ties: in their order) go to the sequence of the lowest cost that has room
    left (ties: the first); what does not fit there goes on to the next such sequence.
    """
    room = sequence_lengths(sum(lengths), size)
    filled = [0] * len(room)
    heap = [(0.0, i) for i in range(len(room))]
    out = []
    for doc in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[doc]
        while left:
            cost, seq = heapq.heappop(heap)
            take = min(left, room[seq] - filled[seq])
            out.append((doc, start, take, seq, filled[seq]))
            filled[seq] += take
            start, left = start + take, left - take
            if filled[seq] < room[seq]:
                heapq.heappush(heap, (cost + cost_of(take, linear, quadratic), seq))
    return out


def pack(docs: DataFrame, size: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048, tokenizer: str = TOKENIZER, tokenizer_path: str | None = None, window_tokens: int = WINDOW_TOKENS, most_units: int = 700_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost.

    A document's tokens are its text's ids and then `end_id`; each token lies in exactly one piece.  Every
    task packs the rows that it reads in windows of about `window_tokens` tokens, so nothing is shuffled and
    no task holds more than a window, one document (a very long one is held whole) and the ids of `most_units` words.  All sequences of a window are full but the last few,
    whose lengths are powers of two: nothing needs padding.  sequence_id is the task's number and a count.

    Null text is the empty text (one token).  Repeated rows and null doc_ids are packed as rows of their own.
    An empty table gives no rows.  Extra columns are ignored.
    """
    if size & (size - 1) or size < 1:
        raise ValueError("size must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = encoder(tokenizer, tokenizer_path, most_units=most_units)
        end = pack_ids([end_id])
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held: list[tuple[int, bytes]] = []
        tokens = 0

        def flush():
            nonlocal first
            lengths = [len(ids) // 4 for _, ids in held]
            pieces = balance(lengths, size, linear, quadratic)
            cols = [[held[d][0] for d, *_ in pieces], [s for _, s, *_ in pieces], [n for _, _, n, *_ in pieces], [zlib.crc32(memoryview(held[d][1])[4 * s : 4 * (s + n)]) for d, s, n, *_ in pieces], [lengths[d] for d, *_ in pieces], [first + p[3] for p in pieces], [p[4] for p in pieces]]
            first += 1 + max((p[3] for p in pieces), default=-1)
            cost = [cost_of(n, linear, quadratic) for n in cols[2]]
            for i in range(0, len(pieces), 10_000):
                yield pa.RecordBatch.from_arrays([*(pa.array(c[i : i + 10_000], pa.int64()) for c in cols), pa.array(cost[i : i + 10_000], pa.float64())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"])
            held.clear()

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = cache.value(text.as_py() or "") + end
                held.append((doc, ids))
                tokens += len(ids) // 4
                if tokens >= window_tokens:
                    yield from flush()
                    tokens = 0
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)
