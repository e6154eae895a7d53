"""Chapters brought into a rebuilt book: references, doctypes, bodies, links, pictographs, stylesheets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from quire.functions import trees as T
from quire.operators.books import carried, internal_references
from quire.sources.session import importable, slices

LEGACY = r"(?i)<!DOCTYPE\s+html\s+PUBLIC"
RELOCATED = "book_id string, path string, content string, title string, error string, body_repaired boolean, pictographs int, glyphs int, linked int, lines array<string>, shown array<string>"
EMOJI = ("strip", "glyph", "keep")
_TAG = re.compile(r"<(?:!--.*?-->|!\[CDATA\[.*?\]\]>|\?.*?\?>|![^>]*>|/?[A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>)", re.S)
_ATTR = re.compile(r"(\s)([\w:.-]+)(\s*=\s*)(\"[^\"]*\"|'[^']*')")


def is_legacy(source: Column) -> Column:
    return source.rlike(LEGACY)


def missing_body_repaired(source: str) -> tuple[str, bool]:
    """The children of html that aren't its head, in a body, if there is none."""
    if re.search(r"<body[\s>/]", source, re.I):
        return source, False
    m = re.search(r"<html\b[^>]*>", source, re.I)
    end = source.lower().rfind("</html")
    if not m or end < m.end():
        return source, False
    head = re.search(r"</head\s*>|<head\s*/>", source, re.I)
    at = head.end() if head and head.end() <= end else m.end()
    if not re.search(r"<[A-Za-z]", source[at:end]):
        return source, False
    return f"{source[:at]}<body>{source[at:end]}</body>{source[end:]}", True


def markup_steps(sources: DataFrame) -> DataFrame:
    """sources(…, source, value) with what each step of healing makes of a source: named references as numbers, numbers beyond ASCII
    as characters, a modern doctype, a body; of a value, its references decoded, and its lines. Nulls are empty; where
    a reference is unknown, error says so and the rest is null."""
    importable(sources.sparkSession)
    made = ("numeric", "literal", "doctype", "body", "plain", "error")
    schema = T_.StructType([*sources.schema.fields, *(T_.StructField(c, T_.StringType()) for c in made), T_.StructField("lines", T_.ArrayType(T_.StringType()))])
    at = [sources.columns.index(c) for c in ("source", "value")]

    def steps(source: str, value: str) -> dict:
        try:
            return {"numeric": T.numeric_entities(source), "literal": T.literal_refs(source), "doctype": T.modern_doctype(source), "body": missing_body_repaired(source)[0], "plain": T.plain_refs(value), "lines": lines_of(value)}
        except ValueError as e:
            return {"error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [steps(s or "", v or "") for s, v in zip(*(batch.column(k).to_pylist() for k in at))]
            new = [pa.array([r.get(c) for r in rows], pa.string()) for c in made] + [pa.array([r.get("lines") for r in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *made, "lines"])

    return sources.mapInArrow(run, schema)


def lines_of(source: str) -> list[str]:
    """Lines of a document's body, breaks counted as such."""
    body = re.search(r"<body\b[^>]*>(.*)</body\s*>", source, re.S | re.I)
    text = re.sub(r"<br\b[^>]*>", "\n", body[1] if body else source, flags=re.I)
    return [x for line in T.plain_refs(_TAG.sub("", text)).split("\n") if (x := line.strip())]


def glyph(href: str, name: str) -> str:
    """A picture of the size of a letter in the place of a pictograph."""
    return f'<img src="{T.escaped(href, True)}" alt="{T.escaped(name, True)}" style="height: 0.9em"/>'


def glyph_file(char: str) -> str:
    return f"glyph-{ord(char):x}.png"


def rewritten(source: str, hrefs: dict[str, str], labels: dict[str, str], emoji: str, names: dict[str, str], relink: bool, drawn: frozenset[str] = frozenset(), shown_: set[str] | None = None) -> tuple[str, int, int, int]:
    """Markup with its references, pictographs and contents lines changed, and how many of the last three there were.

    Pictographs that are drawn become pictures, and are added to shown_; others stay. Tags and texts are passed through as they are unless something in them changes."""
    out: list[str] = []
    removed = inlined = linked = 0
    anchors, in_body = 0, not re.search(r"<body[\s>]", source, re.I)

    def attribute(m: re.Match) -> str:
        nonlocal removed
        name, value = m[2], m[4][1:-1]
        new = value
        if name in ("href", "src", "xlink:href"):
            new = hrefs.get(T.plain_refs(value).strip(), value)
            new = T.escaped(new, True) if new is not value else value
        elif name in ("alt", "title") and emoji == "strip":
            new, n = T.without_pictographs(value)
            removed += n
        elif name in ("alt", "title") and emoji == "glyph":
            new = T._ONE.sub(lambda g: T.escaped(names.get(g[0][0], f"U+{ord(g[0][0]):X}"), True), value)
        return m[0] if new is value or new == value else f'{m[1]}{name}{m[3]}"{new}"'

    def text(t: str) -> str:
        nonlocal removed, inlined, linked
        if in_body and relink and not anchors and (key := re.sub(rf"[{T.SPACE}]+", "", t)) and (href := labels.get(T.plain_refs(key))):
            lead, bare, tail = re.match(r"(\s*)(.*?)(\s*)$", t, re.S).groups()
            linked += 1
            t = f'{lead}<a href="{T.escaped(href, True)}">{bare}</a>{tail}'
        if emoji == "strip":
            t, n = T.without_pictographs(t)
            removed += n
        elif emoji == "glyph":

            def shown(m: re.Match) -> str:
                nonlocal inlined
                char = m[0][0]
                if char not in drawn:
                    return m[0]
                inlined += 1
                if shown_ is not None:
                    shown_.add(char)
                return glyph(f"images/{glyph_file(char)}", names.get(char, f"U+{ord(char):X}"))

            t = T._ONE.sub(shown, t)
        return t

    at = 0
    for m in _TAG.finditer(source):
        out.append(text(source[at : m.start()]))
        tag = m[0]
        name = re.match(r"</?([A-Za-z][\w:.-]*)", tag)
        if name:
            low = name[1].lower()
            if low == "a" and not tag.endswith("/>"):
                anchors = max(0, anchors + (-1 if tag[1] == "/" else 1))
            in_body |= low == "body"
            tag = _ATTR.sub(attribute, tag)
        out.append(tag)
        at = m.end()
    out.append(text(source[at:]))
    return "".join(out), removed, inlined, linked


def keys_of(source: str) -> set[str]:
    """What of a document could be a label: its lines, and its texts between tags, without white space."""
    texts, at = [], 0
    for m in _TAG.finditer(source):
        texts.append(source[at : m.start()])
        at = m.end()
    squeezed = lambda x: re.sub(rf"[{T.SPACE}]+", "", x)
    return {k for k in (*map(squeezed, lines_of(source)), *(T.plain_refs(squeezed(t)) for t in (*texts, source[at:]))) if k}


def spoken(chapters: DataFrame) -> DataFrame:
    """(book_id, path, key): what of each of chapters(book_id, path, content) could be a label, once."""
    importable(chapters.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = []
            for content in batch.column(2).to_pylist():
                try:
                    keys.append(sorted(keys_of(missing_body_repaired(T.literal_refs(T.modern_doctype(content or "")))[0])))
                except ValueError:
                    keys.append([])  # an unknown reference makes an error row
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.string()))], ["book_id", "path", "keys"])

    own = chapters.select(F.col("book_id").cast("string").alias("book_id"), "path", "content").mapInArrow(run, "book_id string, path string, keys array<string>")
    return own.select("book_id", "path", F.explode("keys").alias("key"))


def relocated(chapters: DataFrame, targets: DataFrame, labels: DataFrame, emoji: str = "strip", names: dict[str, str] | None = None, relink: bool = True, drawn: frozenset[str] = frozenset()) -> DataFrame:
    """RELOCATED of chapters(book_id, path, content string, title).

    targets(book_id, path, raw, href): what each reference of a chapter becomes; labels
    (book_id, key, href): unambiguous labels of the book. A chapter that nothing changes
    comes back as it was but for its doctype; an unknown entity makes an error row.
    Contents lines are linked only on pages of which enough lines are labels. With emoji "glyph",
    the pictographs in drawn become pictures; shown lists those of each chapter.
    """
    if emoji not in EMOJI:
        raise ValueError(f"emoji must be one of {', '.join(EMOJI)}")
    importable(chapters.sparkSession)
    moves = targets.where("href is not null").groupBy("book_id", "path").agg(F.map_from_entries(F.collect_set(F.struct("raw", "href"))).alias("hrefs"))
    known = names or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.operators.books import LABEL_SHARE, LEAST_LINES

        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()))
        for batch in slices(batches):
            rows = []
            for book, path, content, title, hrefs, own in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    source = T.literal_refs(T.modern_doctype(content or ""))
                except ValueError as e:
                    rows.append((book, path, content, title, str(e), False, 0, 0, 0, [], []))
                    continue
                labels_ = dict(own or ())
                source, repaired = missing_body_repaired(source)
                lines = lines_of(source)
                hits = sum(re.sub(rf"[{T.SPACE}]+", "", x) in labels_ for x in lines)
                contents = relink and len(lines) >= LEAST_LINES and hits / len(lines) >= LABEL_SHARE
                shown: set[str] = set()
                new, removed, inlined, linked = rewritten(source, dict(hrefs or ()), labels_, emoji, known, contents, drawn, shown)
                if not title:
                    found = re.search(r"<title\b[^>]*>(.*?)</title\s*>", new, re.S | re.I)
                    title = (T.plain_refs(found[1]).strip() if found else "") or path.rpartition("/")[2]
                if emoji == "strip":
                    title = T.without_pictographs(title)[0]
                rows.append((book, path, new, title, None, repaired, removed, inlined, linked, lines, sorted(shown)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], [x.split()[0] for x in RELOCATED.split(", ")])

    joined = chapters.select("book_id", "path", "content", "title").join(moves, ["book_id", "path"], "left")
    if relink:
        # a chapter gets the labels that it could show, not all of its book: those are as many as the book's chapters
        own = spoken(chapters).join(labels.select(F.col("book_id").cast("string").alias("book_id"), "key", "href"), ["book_id", "key"])
        joined = joined.withColumn("book_id", F.col("book_id").cast("string")).join(own.groupBy("book_id", "path").agg(F.map_from_entries(F.collect_set(F.struct("key", "href"))).alias("labels")), ["book_id", "path"], "left")
    else:
        joined = joined.withColumn("labels", F.lit(None).cast("map<string,string>"))
    return joined.select(F.col("book_id").cast("string"), "path", "content", "title", "hrefs", "labels").mapInArrow(run, RELOCATED)


def targets(references: DataFrame, chapters: DataFrame, contents: DataFrame, files: DataFrame, resources: DataFrame) -> DataFrame:
    """(book_id, path, raw, href, error): the new form of every internal reference, its fragment kept.

    resources(book_id, path, name): the names under which resources are kept in the new book."""
    inside = internal_references(references)
    moved = carried(inside.where("error is null").select("book_id", "doc_path", "ord", "path"), chapters, contents, files)
    named = moved.join(resources.select("book_id", "path", "name"), ["book_id", "path"], "left")
    own = inside.select("book_id", "doc_path", "ord", "raw", F.col("error").alias("broken")).join(named, ["book_id", "doc_path", "ord"], "left")
    tail = F.substring("raw", F.length(F.substring_index("raw", "#", 1)) + 1, F.length("raw"))
    href = F.coalesce("href", F.when(F.col("resource") == "image", F.concat(F.lit("images/"), "name")).otherwise(F.col("name")))
    return own.select("book_id", F.col("doc_path").alias("path"), "raw", F.concat(href, tail).alias("href"), F.coalesce("broken", "error").alias("error"))


def healed_stylesheets(sheets: DataFrame) -> DataFrame:
    """sheets(book_id, path, css) with what was dropped; unchanged ones byte for byte as they were."""
    importable(sheets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done = [T.healed_stylesheet(c or "") for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string()))], ["book_id", "path", "css", "dropped"])

    return sheets.select(F.col("book_id").cast("string").alias("book_id"), "path", "css").mapInArrow(run, "book_id string, path string, css string, dropped array<string>")


def cover_pages(chapters: DataFrame, covers: DataFrame) -> DataFrame:
    """chapters(book_id, path, content) that are a cover: they say so, or hold nothing but the declared image (covers: book_id, cover_path)."""
    body = F.regexp_extract("content", r"(?is)<body\b[^>]*>(.*)</body", 1)
    bare = F.regexp_replace(F.regexp_replace(body, "(?s)<[^>]*>", ""), r"[\s\x{A0}\x{3000}\x{FEFF}]", "")
    says = F.col("content").rlike(r"""epub:type\s*=\s*["'][^"']*\bcover\b(?!-)[^"']*["']""")
    refs = F.regexp_extract_all(body, F.lit(r"""(?i)<(?:img|image)\b[^>]*?\s(?:src|xlink:href)=["']([^"']*)["']"""), F.lit(1))
    name = F.substring_index("cover_path", "/", -1)
    shows = (bare == "") & F.exists(refs, lambda r: F.substring_index(F.coalesce(F.try_url_decode(F.replace(r, F.lit("+"), F.lit("%2B"))), r), "/", -1) == name)
    joined = chapters.join(covers.select("book_id", "cover_path"), "book_id", "left")
    return joined.where(says | (F.col("cover_path").isNotNull() & shows)).select("book_id", "path")


def shrunk(images: DataFrame) -> DataFrame:
    """images(path, original_size, new_size) with what is kept: a re-encoded image only if it is smaller."""
    smaller = F.col("new_size") < F.col("original_size")
    return images.withColumn("kept_size", F.when(smaller, F.col("new_size")).otherwise(F.col("original_size"))).withColumn("saved", F.col("original_size") - F.col("kept_size"))


def shrink_totals(images: DataFrame) -> DataFrame:
    return shrunk(images).agg(F.count_if(F.col("saved") > 0).alias("shrunk"), F.sum("saved").alias("saved"))
