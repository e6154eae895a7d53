"""Packed books as rows of files, and the rules a book must keep.

An archive is unpacked once into (book_id, path, content); documents are read once into
their declarations and references; the rules are anti joins over those tables. Every
broken rule is a row, and the verdict is the first of them by the order of the rules.
"""

from __future__ import annotations

import io
import re
import struct
import sys
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import decoded_bytes
from quire.functions.names import decoded, dirname, reference_kind, resolved, target
from quire.operators.books import manifest_by_id
from quire.sources.session import SLICE_ROWS, importable, slices, written

FILES = "book_id string, path string, ord int, content binary, error string"
CONTAINER_NS = "{urn:oasis:names:tc:opendocument:xmlns:container}"
OPF_NS = "{http://www.idpf.org/2007/opf}"
DC_NS = "{http://purl.org/dc/elements/1.1/}"
NCX_NS = "{http://www.daisy.org/z3986/2005/ncx/}"
#: Bytes of unpacked files that wait in a task before they go to Spark, and what a row counts for besides.
HELD, ROW = 8_000_000, 100
#: Bytes of a part of an archive, about: Spark's writer of Parquet holds a hundred rows before it looks at their size.
PART = 1 << 20
#: Tables of more rows aren't broadcast: Spark goes by the size of their files, which says little of rows that are much alike.
BROADCAST_ROWS = 20_000
#: An entry of an archive's table: sign, version, flags, method, checksum, sizes, lengths of name, extra and comment, disk, start.
ENTRY = struct.Struct("<4s2xHHH4xLLLHHHH6xL")
XML_KINDS = (".xhtml", ".html", ".htm", ".opf", ".ncx", ".xml")


def archives(spark: SparkSession, folder: str, pattern: str = "*.epub") -> DataFrame:
    """(book_id, content): packed books of a folder, named by their file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("book_id"), "content")


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, path, content): unpacked books, each in a folder of its own."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.regexp_replace(F.lit(folder), r"^[a-z]+:/+|/+$", "")
    inside = F.regexp_replace(F.element_at(F.split("path", F.concat(F.lit(r"\Q"), F.regexp_replace(root, "^/+", ""), F.lit(r"\E/")), 2), 2), "^/+", "")
    return found.select(F.substring_index(inside, "/", 1).alias("book_id"), F.regexp_replace(inside, "^[^/]*/", "").alias("path"), "content")


def dealt(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Rows of a book in one task, in order. The number of tasks is given, as the size of rows that are much alike says little of the work with them."""
    return rows.repartition(4 * max(4, rows.sparkSession.sparkContext.defaultParallelism), "book_id").sortWithinPartitions("book_id", *order)


def whole_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, BinaryIO]]:
    """(book_id, file) of rows (book_id, content) or, ordered, (book_id, content, part). An archive of several parts is put together on disk."""
    book, first, file = None, None, None
    for batch in batches:
        parts = batch.column(2).to_pylist() if batch.num_columns > 2 else [0] * batch.num_rows
        for own, content, part in zip(batch.column(0), batch.column(1), parts):
            data = content.as_buffer() if content.is_valid else pa.py_buffer(b"")
            if part:
                if file is None:
                    file = tempfile.TemporaryFile()
                    file.write(first)
                file.write(data)
                continue
            if first is not None:
                yield book, file or pa.BufferReader(first)
            if file is not None:
                file.close()
            book, first, file = own.as_py(), data, None
    if first is not None:
        yield book, file or pa.BufferReader(first)
    if file is not None:
        file.close()


class Unusual(Exception):
    """An archive that has more to it than files one after another and their table: zipfile reads it, and tells what is wrong."""


def table_of(at: Callable[[int, int], bytes], size: int) -> Iterator[tuple[int, str, int, int, int, int, int]]:
    """(place, path, method, checksum, packed size, size, start) of an archive's files, read off its table as they are asked for: a list of a million ZipInfo takes a gigabyte."""
    tail = at(max(0, size - 98), min(98, size))
    if len(tail) < 22 or tail[-22:-18] != b"PK\5\6":
        raise Unusual
    number, length, first, comment = struct.unpack("<HLLH", tail[-12:])
    end = size - 22
    if tail[-42:-38] == b"PK\6\7":
        if len(tail) < 98 or tail[:4] != b"PK\6\6":
            raise Unusual
        number, length, first = struct.unpack("<QQQ", tail[32:56])
        end = size - 98
    if comment or first + length != end:
        raise Unusual
    table, place, before = at(first, length), 0, 0
    for k in range(number):
        if place + 46 > length:
            raise Unusual
        sign, version, flags, method, crc, packed, whole, named, extra, said, disk, start = ENTRY.unpack_from(table, place)
        if sign != b"PK\1\2" or version > zipfile.MAX_EXTRACT_VERSION or flags & ~0x800 or method not in (0, 8) or extra or said or disk or start < before or packed == 0xFFFFFFFF or whole == 0xFFFFFFFF or start == 0xFFFFFFFF:
            raise Unusual
        name = table[place + 46 : place + 46 + named]
        try:
            path = name.decode("utf-8" if flags & 0x800 else "ascii")
        except UnicodeDecodeError:
            raise Unusual from None
        if "\0" in path or "\\" in path:
            raise Unusual
        head = at(start, 30 + named)
        if len(head) < 30 + named or head[:4] != b"PK\3\4" or head[6:8] != table[place + 8 : place + 10] or head[26:30] != struct.pack("<HH", named, 0) or head[30:] != name:
            raise Unusual
        before = start + 30 + named + packed
        if before > first:
            raise Unusual
        place += 46 + named
        if not path.endswith("/"):
            yield k, path, method, crc, packed, whole, before - packed
    if place != length:
        raise Unusual


def straight(at: Callable[[int, int], bytes], method: int, crc: int, packed: int, whole: int, start: int) -> bytes:
    """A file of table_of, unpacked."""
    data = at(start, packed)
    if method:
        if whole > 1032 * packed + 64:  # more than deflate can hold
            raise Unusual
        try:
            data = zlib.decompress(data, -15, whole or 1)
        except zlib.error:
            raise Unusual from None
    if len(data) != whole or zlib.crc32(data) != crc:
        raise Unusual
    return data


def members(file: BinaryIO, contents: bool = True) -> Iterator[tuple[str, int, bytes | None]]:
    """(path, place, content) of an archive's files, all or none: a large one is read through before its first file is given."""
    size = file.seek(0, io.SEEK_END)

    def at(start: int, n: int) -> bytes:
        file.seek(start)
        return file.read(n)

    try:
        if not contents:
            for _ in table_of(at, size):
                pass
            straightly = ((path, k, None) for k, path, *_ in table_of(at, size))
        elif sum(x[5] for x in table_of(at, size)) > HELD:
            for _, _, *where in table_of(at, size):
                straight(at, *where)
            straightly = ((path, k, straight(at, *where)) for k, path, *where in table_of(at, size))
        else:
            straightly = iter([(path, k, straight(at, *where)) for k, path, *where in table_of(at, size)])
    except Unusual:
        straightly = None
    if straightly is not None:
        yield from straightly
        return
    file.seek(0)
    # the archive isn't copied
    with zipfile.ZipFile(file) as z:
        listed = [(k, i) for k, i in enumerate(z.infolist()) if not i.is_dir()]
        if not contents:
            yield from ((i.filename, k, None) for k, i in listed)
        elif sum(i.file_size for _, i in listed) > HELD:
            if bad := z.testzip():
                raise zipfile.BadZipFile(f"Bad CRC-32 for file {bad!r}")
            yield from ((i.filename, k, z.read(i)) for k, i in listed)
        else:
            yield from [(i.filename, k, z.read(i)) for k, i in listed]


def rows_of(batches: Iterator[pa.RecordBatch], contents: bool = True) -> Iterator[list[tuple]]:
    """Rows of FILES, some at a time."""
    rows, size = [], 0
    for book_id, file in whole_archives(batches):
        try:
            for path, k, content in members(file, contents):
                if size > HELD:
                    yield rows
                    rows, size = [], 0
                rows.append((book_id, path, k, content, None))
                size += len(content or b"") + ROW
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, ValueError, EOFError, OSError) as e:
            rows.append((book_id, None, None, None, f"not a readable archive: {e}"))
            size += ROW
        if size > HELD:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def through(books: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow over whole archives: those of one part stay where they are, parts of others are dealt by book, in order."""
    importable(books.sparkSession)
    own = books.select(F.col("book_id").cast("string").alias("book_id"), "content", *(["part"] if "part" in books.columns else []))
    if "part" not in books.columns:
        return own.mapInArrow(run, schema)
    large = own.where("part > 0").select("book_id").distinct()
    n = large.limit(BROADCAST_ROWS + 1).count()
    if n == 0:
        return own.mapInArrow(run, schema)
    if n > BROADCAST_ROWS:
        return dealt(own, "part").mapInArrow(run, schema)
    large = F.broadcast(large)
    whole, cut = own.join(large, "book_id", "left_anti"), own.join(large, "book_id", "left_semi")
    return whole.mapInArrow(run, schema).unionByName(dealt(cut, "part").mapInArrow(run, schema))


def unpacked(books: DataFrame, contents: bool = True) -> DataFrame:
    """FILES of books(book_id, content[, part]), ord being the place in the archive; one that can't be read is one row with an error. Without contents, what the archive lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("book_id", pa.string()), ("path", pa.string()), ("ord", pa.int32()), ("content", pa.binary()), ("error", pa.string())])
        for rows in rows_of(batches, contents):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return through(books, run, FILES)


def header_error(content: Column) -> Column:
    """What is wrong with an archive's first bytes: it must start with an uncompressed file named mimetype."""
    return (
        F.when(F.coalesce(F.hex(F.substring(content, 1, 4)), F.lit("")) != "504B0304", "not a zip file")
        .when(F.hex(F.substring(content, 9, 2)) != "0000", "mimetype must be stored uncompressed")
        .when((F.hex(F.substring(content, 27, 2)) != "0800") | (F.hex(F.substring(content, 31, 8)) != F.hex(F.lit("mimetype").cast("binary"))), "mimetype must be the first file")
    )


READ = "book_id string, path string, error string, has_html boolean, has_body boolean, rootfiles array<struct<path:string,media_type:string>>, version string, unique_id string, direction string, metadata array<struct<name:string,content:string,id:string>>, manifest array<struct<id:string,href:string,media_type:string,properties:string>>, spine array<string>, labels array<struct<src:string,label:string>>, ncx_uid string, refs array<struct<attr:string,raw:string>>, has_manifest boolean, has_spine boolean"
REFERENCES = ("href", "src", "{http://www.w3.org/1999/xlink}href")


class Reading:
    """What one XML file says, gathered as its parser goes: no tree of it is kept, so a list of a hundred thousand items takes little more than its text."""

    def __init__(self, path: str) -> None:
        self.path, self.kind, self.depth, self.section = path, "", 0, ""
        self.out: dict = {}
        self.texts: list[list[str]] = []  # of open elements whose text is wanted
        self.wanted: list[int] = []  # their depths
        self.points: list[list] = []  # every navPoint: src and label
        self.open: list[tuple[int, list]] = []  # those that are open, with their depths

    def listen(self) -> list[str]:
        self.texts.append([])
        self.wanted.append(self.depth)
        return self.texts[-1]

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        self.depth += 1
        out = self.out
        if self.kind == "html" and self.depth > 2:  # most of what there is
            if attrs:
                out["refs"] += [(a.rpartition("}")[2], attrs[a].strip()) for a in REFERENCES if attrs.get(a)]
            return
        local = tag.rpartition("}")[2]
        if self.depth == 1:
            out["has_html"] = local == "html"
            self.kind = "container" if self.path == "META-INF/container.xml" else local if local in ("package", "ncx", "html") else ""
            if self.kind == "container":
                out["rootfiles"] = []
            elif self.kind == "package":
                out |= {"version": attrs.get("version"), "unique_id": attrs.get("unique-identifier"), "has_manifest": False, "has_spine": False, "metadata": [], "manifest": [], "spine": [], "direction": None}
            elif self.kind == "ncx":
                out |= {"ncx_uid": None, "labels": []}
            elif self.kind == "html":
                out |= {"has_body": False, "refs": []}
        if self.kind == "html":
            out["has_body"] |= self.depth == 2 and local == "body"
            out["refs"] += [(a.rpartition("}")[2], attrs[a].strip()) for a in REFERENCES if attrs.get(a)]
        elif self.kind == "container" and local == "rootfile":
            out["rootfiles"].append((attrs.get("full-path", ""), attrs.get("media-type", "")))
        elif self.kind == "ncx":
            if out["ncx_uid"] is None and attrs.get("name") == "dtb:uid":
                out["ncx_uid"] = attrs.get("content", "").strip()
            if tag.endswith("navPoint"):
                self.points.append([None, None])
                self.open.append((self.depth, self.points[-1]))
            if local == "content":
                for _, point in self.open:
                    point[0] = attrs.get("src", "") if point[0] is None else point[0]
            elif local == "text" and any(point[1] is None for _, point in self.open):
                said = self.listen()
                for _, point in self.open:
                    point[1] = said if point[1] is None else point[1]
        elif self.kind == "package":
            if self.depth == 2:  # of sections that repeat, the last counts
                self.section = local
                if local in ("metadata", "manifest", "spine"):
                    out[local] = []
                if local in ("manifest", "spine"):
                    out[f"has_{local}"] = True
                if local == "spine":
                    out["direction"] = attrs.get("page-progression-direction")
            elif self.depth == 3 and self.section == "metadata":
                content = attrs.get("content")
                out["metadata"].append((attrs.get("name") or attrs.get("property") or local, self.listen() if content is None else content, attrs.get("id")))
            elif self.depth == 3 and self.section == "manifest" and local == "item":
                kind = attrs.get("media-type")  # one string for all items of a kind
                out["manifest"].append((attrs.get("id"), attrs.get("href"), kind and sys.intern(kind), attrs.get("properties")))
            elif self.depth == 3 and self.section == "spine" and local == "itemref":
                out["spine"].append(attrs.get("idref"))

    def data(self, text: str) -> None:
        for said in self.texts:
            said.append(text)

    def end(self, tag: str) -> None:
        if self.wanted and self.wanted[-1] == self.depth:
            self.wanted.pop()
            said = self.texts.pop()
            said[:] = ["".join(said)]
        if self.open and self.open[-1][0] == self.depth:
            _, point = self.open.pop()
            if point[1] is not None:
                point[1] = "".join(point[1]).strip()
        self.depth -= 1

    def close(self) -> dict:
        out = self.out
        if self.kind == "ncx":
            out["labels"] = [(src, label) for src, label in self.points if src is not None and label is not None]
        elif self.kind == "package":
            out["metadata"] = [(name, content if isinstance(content, str) else "".join(content).strip(), id_) for name, content, id_ in out["metadata"]]
        return out


def read_document(path: str, content: bytes) -> dict:
    """What one XML file says (structs as tuples); the error if it isn't well-formed."""
    parser = ElementTree.XMLParser(target=Reading(path))
    try:
        parser.feed(content)
        return parser.close()
    except (ElementTree.ParseError, ValueError, LookupError) as e:
        return {"error": f"not well-formed: {e}"}


def documents(files: DataFrame) -> DataFrame:
    """READ of every XML file of files(book_id, path, content), each parsed once: by its name, or as it begins."""
    importable(files.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(READ))
    begins = F.hex(F.substring(F.col("content"), 1, 8))
    is_xml = begins.rlike("^(EFBBBF)?3C3F786D6C|^3C7061636B616765") | F.lower(F.col("path")).rlike("(" + "|".join(k.replace(".", r"\.") for k in XML_KINDS) + ")$")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [{"book_id": b, "path": p} | read_document(p, c or b"") for b, p, c in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

    return files.where(is_xml).select(F.col("book_id").cast("string").alias("book_id"), "path", "content").mapInArrow(run, READ)


_BEGINS = re.compile(rb"(?:\xef\xbb\xbf)?<\?xml|<package")
_NAMED = re.compile("(?:" + "|".join(map(re.escape, XML_KINDS)) + ")(?:\r\n|[\n\r\x85\u2028\u2029])?\\Z")


def examined(books: DataFrame) -> DataFrame:
    """READ of every file of books(book_id, content[, part]), for what a judgement asks: of one that isn't XML (is_xml) no more than its path, of the mimetype what it says (kind). Archives that can't be read have an unreadable instead of a path."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    read = f"{READ}, is_xml boolean, kind binary, unreadable string"
    schema = to_arrow_schema(_parse_datatype_string(read))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            for at in range(0, len(rows), SLICE_ROWS):
                found = []
                for book_id, path, _, content, error in rows[at : at + SLICE_ROWS]:
                    is_xml = path is not None and bool(_BEGINS.match(content) or _NAMED.search(path.lower()))
                    out = read_document(path, content) if is_xml else {}
                    found.append(out | {"book_id": book_id, "path": path, "is_xml": is_xml, "kind": content if path == "mimetype" else None, "unreadable": error})
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in found], f.type) for f in schema], schema=schema)

    return through(books, run, read)


def packages(read: DataFrame) -> DataFrame:
    """(book_id, opf_path, opf_raw, …): the package document that the container names, the one of the package's type first.

    opf_path is null where the name leaves the book or can't be decoded."""
    listed = read.where("path = 'META-INF/container.xml'").select("book_id", F.posexplode("rootfiles").alias("ord", "r")).where("r.path <> ''")
    other = F.col("r.media_type") != "application/oebps-package+xml"
    chosen = listed.groupBy("book_id").agg(F.min_by("r.path", F.struct(other, "ord")).alias("opf_raw")).withColumn("opf_path", resolved(F.lit(""), decoded(F.col("opf_raw"))))
    return chosen.join(read.withColumnRenamed("path", "opf_path"), ["book_id", "opf_path"], "left")


def manifests(package: DataFrame) -> DataFrame:
    """(book_id, ord, id, href, path, media_type, properties) of packages; path is null where the href leaves the book."""
    items = package.select("book_id", "opf_path", F.posexplode("manifest").alias("ord", "i")).select("book_id", "opf_path", "ord", "i.*")
    return items.select("book_id", "ord", "id", "href", resolved(dirname(F.col("opf_path")), decoded(F.col("href"))).alias("path"), "media_type", "properties")


def first_parts(books: DataFrame) -> DataFrame:
    """A row of each archive, its first bytes."""
    return books.where("part = 0") if "part" in books.columns else books


def unlike_files(found: DataFrame) -> DataFrame:
    """found, a table as it was written: of many rows it is sorted for joins, however small its files are."""
    return found.hint("merge") if found.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS else found


def violations(books: DataFrame) -> DataFrame:
    """(book_id, rule, item, step, place, error): every broken rule of books(book_id, content[, part]), a table as it was written, numbered in the order of judgement.

    Rule 10 is about the declared files, which are judged item by item (item is the place in the manifest or spine): whether the file is
    inside, there, well-formed, has a body, and where its references lead, in the order of the document (step)."""
    # many rules read the same rows: archives are opened, and documents parsed, once, and no content is kept
    found = written(examined(books), "files")
    many = found.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS
    sorted_ = lambda df: df.hint("merge") if many else df
    books = sorted_(first_parts(books).select(F.col("book_id").cast("string").alias("book_id"), header_error(F.col("content")).alias("header_error")))
    files, read = sorted_(found.select("book_id", "path", "kind", F.col("unreadable").alias("error"))), sorted_(found.where("is_xml").drop("is_xml", "kind", "unreadable"))
    there = files.where("path is not null").select("book_id", "path")
    package = sorted_(written(packages(read), "packages"))
    items = manifests(package)
    number = lambda c: (F.lit(c) if isinstance(c, int) else F.col(c)).cast("int")
    row = lambda df, rule, item, error, step=0, place="": df.select("book_id", F.lit(rule).alias("rule"), number(item).alias("item"), number(step).alias("step"), (F.col(place) if place else F.lit("")).alias("place"), (F.lit(error) if isinstance(error, str) else error).alias("error"))
    mimetype = files.where("path = 'mimetype'").select("book_id", F.trim(decoded_bytes(F.col("kind"))).alias("kind"))
    every = books.select("book_id")
    readable = every.join(files.where("path is null").select("book_id"), "book_id", "left_anti")
    opf = readable.join(package.withColumn("path_read", F.lit(True)), "book_id", "left").join(there.select("book_id", F.col("path").alias("opf_path"), F.lit(True).alias("present")), ["book_id", "opf_path"], "left").withColumn("path_read", F.coalesce("present", F.lit(False)))
    spine = package.select("book_id", F.posexplode("spine").alias("ord", "idref"))
    # of declarations that repeat an id, the last counts, at the place of the first
    declared = manifest_by_id(items.where("id is not null and href is not null").select("book_id", "ord", "id", "href", "media_type", "properties", "path"), "path")
    known = declared.select("book_id", F.col("id").alias("idref"))
    listed = declared.where("path is not null").groupBy("book_id", "path").agg(F.min("ord").alias("ord"))
    # a file is read as XML if its declaration or its name says so
    kind, tail = F.coalesce(F.col("media_type"), F.lit("")), F.lower(F.col("path"))
    marked = (kind == "application/xhtml+xml") | kind.endswith("+xml") | tail.rlike(r"\.(xhtml|xml|ncx)$")
    text = (kind == "application/xhtml+xml") | tail.endswith(".xhtml")
    read_as = declared.where(F.col("path").isNotNull() & marked).select("book_id", "path", "ord", text.alias("is_text"))
    pages = read.drop("manifest", "spine", "labels", "metadata", "rootfiles").join(read_as, ["book_id", "path"])
    unread = read_as.join(read.select("book_id", "path"), ["book_id", "path"], "left_anti").join(there, ["book_id", "path"], "left_semi")
    refs = pages.where("is_text").select("book_id", "ord", F.col("path").alias("doc"), F.posexplode("refs").alias("nth", "r")).select("book_id", "ord", "doc", (F.col("nth") + 3).alias("step"), F.col("r.raw").alias("raw")).where((reference_kind(F.col("raw")) == "internal") & (target(F.col("raw")) != ""))
    refs = refs.withColumn("plain", decoded(target(F.col("raw")))).withColumn("path", resolved(dirname(F.col("doc")), F.col("plain")))
    exempt = F.col("path").isin("mimetype") | F.col("path").startswith("META-INF/") | F.col("path").rlike(r"(^|/)\.DS_Store$")
    told = [
        row(books.where("header_error is not null"), 2, 0, F.col("header_error")),
        row(files.where("path is null"), 2, 1, F.col("error")),
        row(readable.join(mimetype, "book_id", "left").where("coalesce(kind, '') <> 'application/epub+zip'"), 3, 0, "mimetype is missing or wrong"),
        row(readable.join(there.where("path = 'META-INF/container.xml'"), "book_id", "left_anti"), 4, 0, "META-INF/container.xml is missing"),
        row(read.where("path = 'META-INF/container.xml' and error is not null"), 4, 1, F.col("error")),
        row(opf.where("opf_raw is null"), 4, 2, "the container names no package document"),
        row(opf.where("opf_raw is not null and opf_path is null"), 5, 0, F.concat(F.lit("leaves the container: "), "opf_raw")),
        row(opf.where("opf_path is not null").join(there.withColumnRenamed("path", "opf_path"), ["book_id", "opf_path"], "left_anti"), 5, 1, "the package document does not exist"),
        row(opf.where("error is not null"), 5, 2, F.col("error")),
        row(opf.where("path_read and error is null and not coalesce(has_manifest, false)"), 6, 0, "no manifest"),
        row(items.where("id is null or href is null"), 7, "ord", "a manifest item needs id and href"),
        row(opf.where("error is null and has_manifest and not has_spine"), 8, 0, "no spine"),
        row(spine.where("idref is null"), 9, "ord", "an itemref needs an idref"),
        row(spine.where("idref is not null").join(known, ["book_id", "idref"], "left_anti"), 9, "ord", F.concat(F.lit("spine names an undeclared item: "), "idref")),
        row(declared.where("path is null"), 10, "ord", F.concat(F.lit("leaves the container: "), "href")),
        row(declared.where("path is not null").join(there, ["book_id", "path"], "left_anti"), 10, "ord", F.concat(F.col("path"), F.lit(" does not exist"))),
        row(pages.where("error is not null"), 10, "ord", F.concat(F.col("path"), F.lit(" is "), "error"), 1),
        row(unread, 10, "ord", F.concat(F.col("path"), F.lit(" is not well-formed")), 1),
        row(pages.where("is_text and has_html and not has_body"), 10, "ord", F.concat(F.col("path"), F.lit(" has no body")), 2),
        row(refs.where("plain is null or path is null"), 10, "ord", F.concat(F.col("raw"), F.lit(" can't be resolved")), "step", "doc"),
        row(refs.where("path is not null").join(there, ["book_id", "path"], "left_anti"), 10, "ord", F.concat(F.col("raw"), F.lit(" has no file")), "step", "doc"),
        row(there.where(~exempt).join(listed, ["book_id", "path"], "left_anti").join(package.select("book_id", F.col("opf_path").alias("path")), ["book_id", "path"], "left_anti"), 14, 0, F.concat(F.lit("Orphan file: "), "path"), 0, "path"),
    ]
    out = told[0]
    for more in told[1:]:
        out = out.unionByName(more)
    return out


def verdicts(books: DataFrame) -> DataFrame:
    """(book_id, success, error): the first broken rule of each book."""
    first = violations(books).groupBy("book_id").agg(F.min_by("error", F.struct("rule", "item", "step", "place", "error")).alias("error"))
    return first_parts(books).select(F.col("book_id").cast("string").alias("book_id")).join(first, "book_id", "left").select("book_id", F.col("error").isNull().alias("success"), "error")


class Packing:
    """An archive as it is written: what waits to be taken as a part, and its table of contents as bytes."""

    def __init__(self) -> None:
        self.gone, self.held, self.table, self.number = 0, bytearray(), bytearray(), 0

    def add(self, path: str, content: bytes) -> None:
        name = path.encode("utf-8")
        flags, method, crc, start = 0 if path.isascii() else 0x800, 0 if path == "mimetype" else 8, zlib.crc32(content), self.gone + len(self.held)
        data = content
        if method:
            # as much window and memory as the file needs: to set up those of a large one takes longer than to pack a page
            bits = len(content).bit_length()
            deflate = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -min(15, max(9, bits)), min(8, max(1, bits - 6)))
            data = deflate.compress(content) + deflate.flush()
        # the first of January 1980
        common = struct.pack("<HHHHLLLHH", flags, method, 0, 33, crc, len(data), len(content), len(name), 0)
        self.held += b"PK\3\4\x14\0" + common + name + data
        far = struct.pack("<HHQ", 1, 8, start) if start >= 0xFFFFFFFF else b""
        self.table += b"PK\1\2\x14\3\x14\0" + common[:-2] + struct.pack("<HHHHLL", len(far), 0, 0, 0, 0o600 << 16, min(start, 0xFFFFFFFF)) + name + far
        self.number += 1

    def end(self) -> None:
        first, length, number = self.gone + len(self.held), len(self.table), self.number
        self.held += self.table
        if number >= 0xFFFF or first + length >= 0xFFFFFFFF:
            self.held += struct.pack("<4sQHHLLQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, number, number, length, first) + struct.pack("<4sLQL", b"PK\6\7", 0, first + length, 1)
        self.held += struct.pack("<4sHHHHLLH", b"PK\5\6", 0, 0, min(number, 0xFFFF), min(number, 0xFFFF), min(length, 0xFFFFFFFF), min(first, 0xFFFFFFFF), 0)

    def taken(self) -> bytearray:
        data, self.held = self.held, bytearray()
        self.gone += len(data)
        return data


def in_parts(files: DataFrame, most: int | None = PART) -> DataFrame:
    """(book_id, part, content): an archive of each book's files(book_id, path, content), mimetype first and stored, in parts of about `most` bytes.

    Files come in order, and a task holds no more than the part that it is at and the table of contents."""
    importable(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, archive, part, done, size = None, None, 0, [], 0

        def told() -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(data) for _, _, data in done)], dtype=np.int32)
            data = done[0][2] if len(done) == 1 else b"".join(data for _, _, data in done)
            whole = pa.Array.from_buffers(pa.binary(), len(done), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in done], pa.string()), pa.array([n for _, n, _ in done], pa.int32()), whole], ["book_id", "part", "content"])

        for batch in batches:
            for own, path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if archive is None or own != book:
                    if archive is not None:
                        archive.end()
                        done.append((book, part, archive.taken()))
                        size += len(done[-1][2])
                    book, archive, part = own, Packing(), 0
                archive.add(path, content.as_py() or b"")
                if most is not None and len(archive.held) >= most:
                    done.append((book, part, archive.taken()))
                    size += len(done[-1][2])
                    part += 1
                if size >= PART:
                    yield told()
                    done, size = [], 0
        if archive is not None:
            archive.end()
            done.append((book, part, archive.taken()))
        if done:
            yield told()

    own = files.select(F.col("book_id").cast("string").alias("book_id"), "path", "content")
    return dealt(own, F.col("path") != "mimetype", "path").mapInArrow(run, "book_id string, part int, content binary")


def packed(files: DataFrame) -> DataFrame:
    """(book_id, content): archives as in_parts makes them, each one value."""
    return in_parts(files, None).drop("part")


def volumes(read: DataFrame, drop_contents: bool = False) -> dict[str, DataFrame]:
    """Books as tables: volume, manifest, chapters with labels."""
    from quire.operators.books import cover_item, first_labels, reading_order

    package = packages(read)
    items = manifests(package)
    meta = package.select("book_id", F.posexplode("metadata").alias("ord", "m")).select("book_id", "ord", "m.*")
    value = lambda name: F.min_by(F.when(F.col("name") == name, F.col("content")), F.when(F.col("name") == name, F.col("ord"))).alias(name)
    fields = meta.groupBy("book_id").agg(*(value(n) for n in ("title", "creator", "language", "identifier")))
    spine = package.select("book_id", F.posexplode("spine").alias("ord", "idref"))
    chapters = reading_order(spine, items.drop("href").withColumnRenamed("path", "href"), drop_contents)
    # the contents file is the one declared as such
    listed = items.where("media_type = 'application/x-dtbncx+xml' and path is not null").groupBy("book_id").agg(F.min_by("path", "ord").alias("path"))
    ncx = read.where("labels is not null").join(listed, ["book_id", "path"]).select("book_id", F.col("path").alias("ncx_path"), F.posexplode("labels").alias("ord", "l"))
    labels = first_labels(ncx.select("book_id", resolved(dirname(F.col("ncx_path")), decoded(target(F.col("l.src")))).alias("src"), "ord", F.col("l.label").alias("label")))
    named = chapters.withColumnRenamed("href", "path").join(labels, ["book_id", "path"], "left").withColumn("label", F.coalesce("label", F.lit("")))
    uid = read.where("ncx_uid is not null").groupBy("book_id").agg(F.min("ncx_uid").alias("ncx_uid"))
    cover = cover_item(items.withColumn("href", F.col("path")), meta).select("book_id", F.col("href").alias("cover_path"))
    volume = package.select("book_id", "opf_path", "version", "direction").join(fields, "book_id", "left").join(uid, "book_id", "left").join(cover, "book_id", "left")
    return {"volume": volume, "manifest": items, "chapters": named, "metadata": meta}


def first_of_each(files: DataFrame) -> DataFrame:
    """files with one row per path, should an archive repeat one: the last."""
    w = Window.partitionBy("book_id", "path").orderBy(F.desc("ord"))
    return files.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
