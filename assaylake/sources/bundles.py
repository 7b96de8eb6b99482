"""Bundles of an exam: a zip, a folder or a bare JSON document, with the files of its assets."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of pictures, and of the document in a bundle.
PICTURE = r"(?i)\.(png|jpg|jpeg|webp|gif)$"
DOCUMENT = "exam.json"
NOT_FOUND, BROKEN_ZIP, BROKEN_JSON = f"{DOCUMENT} not found", "broken zip", "broken JSON"
MEMBERS = {"root": pa.string(), "rel": pa.string(), "document": pa.string(), "size": pa.int64(), "digest": pa.string(), "error": pa.string(), "kind": pa.string()}
#: What a member comes from, and the most rows and letters of documents that leave a task at once.
ZIP, BARE, OWNED = "zip", "bare", "owned"
MOST_ROWS, MOST_LETTERS = 2_000, 4_000_000
_LOCAL, _CENTRAL, _END = struct.Struct("<4s2B4HL2L2H"), struct.Struct("<4s4B4HL2L5H2L"), struct.Struct("<4s4H2LH")


def _rel(name: str) -> str:
    """A member's path from its folder of assets on, with slashes."""
    name = name.replace("\\", "/")
    return "assets/" + name.split("/assets/", 1)[1] if "/assets/" in name else name.lstrip("/")


def _reader(content: bytes, z: zipfile.ZipFile):
    """z.read for members that are stored plainly; any other, and any that does not check, goes to z.read itself."""
    starts = sorted([x.header_offset for x in z.infolist()] + [z.start_dir])
    ends = dict(zip(starts, starts[1:]))

    def read(name: str) -> bytes:
        x = z.getinfo(name)
        at = x.header_offset
        if x.compress_type == zipfile.ZIP_DEFLATED and not x.flag_bits and content[at : at + 4] == b"PK\3\4" and x.orig_filename.isascii():
            n, extra = struct.unpack_from("<2H", content, at + 26)
            first = at + 30 + n + extra
            last = first + x.compress_size
            if content[at + 30 : at + 30 + n] == x.orig_filename.encode() and last <= ends.get(at, 0) and content[at + 6 : at + 8] == b"\0\0":
                try:
                    inflate = zlib.decompressobj(-15)
                    data = inflate.decompress(content[first:last], x.file_size + 1)
                    if inflate.eof and len(data) == x.file_size and zlib.crc32(data) == x.CRC:
                        return data
                except zlib.error:
                    pass
        return z.read(name)

    return read


def zip_members(content: bytes, pictures: bool = True) -> Iterator[tuple[str | None, str | None, int | None, str | None, str | None]]:
    """(rel, document, size, digest, error) of a zip's document and, if asked for, pictures; one row with an error if it can't be read.

    A picture that can't be read has neither size nor digest.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names, read = sorted(z.namelist()), _reader(content, z)
            found = DOCUMENT if DOCUMENT in names else next((n for n in names if n.endswith("/" + DOCUMENT)), None)
            if found is None:
                yield None, None, None, None, NOT_FOUND
                return
            yield DOCUMENT, read(found).decode("utf-8"), None, None, None
            for name in names if pictures else []:
                if re.search(PICTURE, name):
                    try:
                        data = read(name)
                        yield _rel(name), None, len(data), hashlib.sha256(data).hexdigest(), None
                    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError, zlib.error):
                        yield _rel(name), None, None, None, None
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError, UnicodeDecodeError, ValueError, zlib.error):
        yield None, None, None, None, BROKEN_ZIP


def _file_members(path: str, content: bytes | None, pictures: bool) -> Iterator[tuple]:
    """Rows of MEMBERS that a file gives: a zip's members, a bare document, a file below a folder's assets."""
    name = path.replace("\\", "/").rpartition("/")[2]
    if re.search(r"(?ai)\.zip$", name):
        root = re.sub(r"(?ai)\.zip$", "", name)
        for told in zip_members(content or b"", pictures):
            yield root, *told, ZIP
    above, owned, rel = path.partition("/assets/")
    if owned:
        data = content if pictures else None
        yield above.rpartition("/")[2], "assets/" + rel, None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), None, OWNED
    elif re.search(r"(?ai)\.json$", name):
        folder = path.rpartition("/")[0].rpartition("/")[2] if "/" in path else None
        try:
            document, error = (content or b"").decode("utf-8"), None
        except UnicodeDecodeError:
            document, error = None, BROKEN_JSON
        yield folder if name == DOCUMENT else re.sub(r"(?ai)\.json$", "", name), None, document, None, None, error, BARE


def _members(files: DataFrame, pictures: bool) -> DataFrame:
    """Rows of MEMBERS of all files, each of which is read once; without pictures their sizes and digests are null or their rows left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), MEMBERS.values(), strict=True)], list(MEMBERS))
        rows, letters = [], 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for row in _file_members(path, content.as_py(), pictures) if path is not None else ():
                    rows.append(row)
                    letters += len(row[2] or "")
                    if len(rows) >= MOST_ROWS or letters >= MOST_LETTERS:
                        yield made(rows)
                        rows, letters = [], 0
        if rows:
            yield made(rows)

    return files.select("path", "content").mapInArrow(run, ", ".join(f"{n} {'bigint' if t == pa.int64() else 'string'}" for n, t in MEMBERS.items()))


def is_json(text: Column) -> Column:
    """Whether a text is a JSON object."""
    return F.coalesce(F.json_object_keys(text).isNotNull(), F.lit(False))


def bundles(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and files of the bundles that files(path, content) hold, as Spark's binaryFile reader lists a folder.

    documents(root, document, error): a zip's `exam.json` (at its top, or else the first below), `<root>/exam.json` of a
    folder, or `<root>.json` beside one.  What can't be read is a row with an error (of a broken zip, of a bundle without a document,
    of a document that is no JSON object) and ends no job.  assets(root, rel, size, digest): pictures of a zip and all files
    below a folder's `assets`, by SHA-256.  A root that comes up several times has a row each time.  Null content is
    empty.  Each table reads each file once, by one task; other columns are ignored.
    """
    rows = _members(files, pictures=False)
    told, owned, bare = F.col("document").isNotNull() | F.col("error").isNotNull(), F.col("kind") == OWNED, F.col("kind") == BARE
    of = rows.groupBy("root").agg(F.collect_list(F.when(told, F.struct("document", "error"))).alias("told"), F.bool_or(owned).alias("owned"), F.bool_or(bare).alias("bare"))
    lost = F.array(F.struct(F.lit(None).cast("string").alias("document"), F.lit(NOT_FOUND).alias("error")))
    found = of.select("root", F.inline(F.when(F.col("owned") & ~F.col("bare"), F.concat("told", lost)).otherwise(F.col("told"))))
    broken = F.col("document").isNotNull() & ~is_json(F.col("document"))
    documents = found.select("root", F.when(~broken, F.col("document")).alias("document"), F.when(broken, BROKEN_JSON).otherwise(F.col("error")).alias("error"))
    return documents, _members(files, pictures=True).filter("document IS NULL AND error IS NULL").select("root", "rel", "size", "digest")


def read_bundles(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The bundles below a folder, of any store that Spark reads.  Spark's reader does not list files without a byte."""
    return bundles(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder))


def load_failures(documents: DataFrame) -> DataFrame:
    """Issues (root, severity, code, actual) of bundles that could not be read."""
    return documents.filter("error IS NOT NULL").select("root", F.lit("BLOCKER").alias("severity"), F.lit("LOAD_FAILED").alias("code"), F.col("error").alias("actual"))


def _zip(members: list[tuple[str, str]]) -> bytes:
    """A zip of (name, text) members, byte for byte as zipfile writes it; plain small members are put together at once."""
    out, listed, at = [], [], 0
    for name, text in members:
        raw, data = name.encode(), text.encode()
        if not name.isascii() or not name or "\0" in name or name.endswith("/") or len(raw) > 60_000 or len(data) + at > 1 << 30 or len(members) > 60_000:
            told = io.BytesIO()
            with zipfile.ZipFile(told, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
                for n, t in members:
                    z.writestr(zipfile.ZipInfo(n), t, zipfile.ZIP_DEFLATED)
            return told.getvalue()
        packed, crc = zlib.compress(data, 6, -15), zlib.crc32(data)
        # version 2.0, deflated, 1 January 1980, and in the list: made on Unix, mode 600
        fields = (0, zipfile.ZIP_DEFLATED, 0, 33, crc, len(packed), len(data), len(raw), 0)
        out += _LOCAL.pack(b"PK\3\4", 20, 0, *fields), raw, packed
        listed += _CENTRAL.pack(b"PK\1\2", 20, 3, 20, 0, *fields, 0, 0, 0, 0o600 << 16, at), raw
        at += _LOCAL.size + len(raw) + len(packed)
    return b"".join((*out, *listed, _END.pack(b"PK\5\6", 0, 0, len(members), len(members), sum(map(len, listed)), at, 0)))


def zipped(bundle: DataFrame) -> DataFrame:
    """(path, content) of bundle(root, document, files array<struct<rel, text>>): a zip for each row, as exports have it.

    Members bear no times, so equal bundles are equal bytes.  A null document is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, out = batch.column("files"), []
            ends = files.offsets.to_pylist()
            rels, texts = files.values.field("rel").to_pylist(), files.values.field("text").to_pylist()
            for document, valid, at, end in zip(batch.column("document").to_pylist(), files.is_valid().to_pylist(), ends, ends[1:]):
                owned = [(rel, text or "") for rel, text in zip(rels[at:end], texts[at:end], strict=True)] if valid else []
                out.append(_zip(owned if document is None else [(DOCUMENT, document), *owned]))
            yield pa.RecordBatch.from_arrays([pa.array([f"{r}.zip" for r in batch.column("root").to_pylist()]), pa.array(out, pa.binary())], ["path", "content"])

    return bundle.select("root", "document", "files").mapInArrow(run, "path string, content binary")
