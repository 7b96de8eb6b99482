"""Helpers that the operators of this folder share."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Bytes of UTF-8 text to word bytes: A-Z become a-z, and every ASCII character
#: that is neither a letter nor a digit becomes a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Only A-Z become a-z.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is set, a session on one machine (tests) gets its own; on a cluster that raises RuntimeError.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialize wrote for these, once everything made of them is written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def simple_words(data: bytes) -> list[bytes]:
    """Words of a text's UTF-8 bytes: runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z."""
    return data.translate(WORD_BYTES).split()


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column; null becomes the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """Word bytes to 64-bit hash, kept for words seen lately; emptied when it holds `most` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of every k consecutive word hashes, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, np.uint64(k), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ h[i : i + n]) * _ODD
            out ^= out >> np.uint64(29)
        return mix(out)


#: A space at an end of the text or beside other white space.
_UNEVEN = re.compile(r" (?:(?<!\S )|(?!\S))")


def even(text: str) -> bool:
    """Whether every space stands alone between characters that are no white space."""
    return not _UNEVEN.search(text)


class Kept(dict):
    """What `find` gave for the keys seen lately; long keys are not kept, and all go when it holds `most`."""

    def __init__(self, find, most: int, longest: int = 64):
        super().__init__()
        self.find, self.most, self.longest = find, most, longest

    def __missing__(self, key):
        value = self.find(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class UnitCache:
    """Tokenizes by space-separated units and keeps what it found for each unit.

    A tokenizer whose pieces never hold a space after another character treats each unit with its leading
    space apart from what stands before it, so a text's ids are its units' ids in a row.  Texts in which a
    space stands at an end or beside other white space, or that hold one of `special`, go to `encode` whole.

    encode(string): its value, by the library.  unit(string): the value of a unit that isn't a text's first.
    join(values): the value of strings in a row.
    """

    def __init__(self, encode, unit, join, special: tuple[str, ...], most: int = 700_000):
        self.encode, self.join, self.special = encode, join, special
        self.seen = Kept(unit, most)

    def value(self, text: str):
        if not text or not even(text) or any(s in text for s in self.special):
            return self.encode(text)
        units = text.split(" ")
        units[0] = self.encode(units[0])
        units[1:] = map(self.seen.__getitem__, units[1:])
        return self.join(units)


def env_threads_off() -> None:
    """One thread for each task; Spark runs the tasks side by side."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


#: Counters in one block of a table of counters.
BLOCK = 1 << 14


def table_blocks(table: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(number, bytes) of a task's blocks of counters that are not all zero."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for at in range(0, len(table), BLOCK):
        if table[at : at + BLOCK].any():
            yield at // BLOCK, pack(table[at : at + BLOCK].astype("<u4").tobytes())


def sum_tables(shares: DataFrame, size: int) -> np.ndarray:
    """Sums shares(block, data) of all tasks, block by block and in streams, to one table of a fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                counts = np.frombuffer(unpack(data.as_py()), dtype="<u4").astype(np.uint64)
                sums[block] = sums[block] + counts if block in sums else counts
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())], ["block", "data"])

    table = np.zeros(size, dtype=np.uint32)
    for row in shares.select("block", "data").repartition("block").mapInArrow(add, "block int, data binary").toLocalIterator():
        part = np.frombuffer(row["data"], dtype="<u4")
        table[row["block"] * BLOCK : row["block"] * BLOCK + len(part)] = part
    return table
