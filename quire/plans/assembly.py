"""Whole jobs: scanned pages, web sites, markdown files and broken books to sound packed books.

Every job returns tables: the archives that keep all rules, and the errors of the rest.
Many books go through at once; nothing is written until its archive has been judged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import names as N
from quire.functions import text as X
from quire.operators import bookmd, books as B, containers as C, ocr as O, pages as P, repair as R
from quire.operators.titles import merged_title
from quire.plans import documents as D
from quire.sources.session import written

CSS = "body { margin: 1em; line-height: 1.6; }\nh1, h2 { line-height: 1.3; }\nimg { max-width: 100%; }\n"
CONTAINER = '<?xml version="1.0" encoding="UTF-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">\n  <rootfiles>\n    <rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/>\n  </rootfiles>\n</container>'
META = {"version": "3.0", "title": None, "creator": None, "translator": None, "language": None, "uuid": None, "modified": "1970-01-01 00:00:00", "direction": "", "cover": "", "css": "style.css", "template": ""}


TEMPLATE = "template.xpgt"


@dataclass(frozen=True)
class Job:
    """archives(book_id, part, content) that keep all rules, those beyond a megabyte in parts; errors(book_id, error); report: what else there is to say."""

    archives: DataFrame
    errors: DataFrame
    report: DataFrame | None = None


def kept(df: DataFrame, name: str) -> DataFrame:
    return C.unlike_files(written(df, name))


def with_meta(books: DataFrame, language: str | None = None) -> DataFrame:
    """books with all columns of a package document; the identifier follows from id and title if none is given."""
    for name, value in META.items():
        default = F.lit(value).cast("timestamp" if name == "modified" else "string")
        books = books.withColumn(name, F.coalesce(F.col(name), default) if name in books.columns else default)
    books = books.withColumn("uuid", F.when(N.is_uuid(F.coalesce("uuid", F.lit(""))), F.lower("uuid")).otherwise(X.name_uuid(F.col("book_id").cast("string"), F.coalesce("title", F.lit("")))))
    return books.withColumn("language", F.coalesce(F.nullif("language", F.lit("")), F.lit(language).cast("string"))).select("book_id", *META)


def files_of(books: DataFrame, chapters: DataFrame, contents: DataFrame, images: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """(book_id, path, content): all files of the books.

    chapters(book_id, chapter_no, id, href, title); contents(book_id, href, content string);
    images(book_id, ord, name, content); sheets(book_id, css), else the common one."""
    row = lambda df, path, content: df.select("book_id", (F.lit(path) if isinstance(path, str) else path).alias("path"), (F.encode(content, "UTF-8") if not isinstance(content, str) else F.encode(F.lit(content), "UTF-8")).alias("content"))
    tables = D.contents_documents(books, chapters)
    out = row(books, "mimetype", "application/epub+zip").unionByName(row(books, "META-INF/container.xml", CONTAINER))
    out = out.unionByName(row(D.package_documents(books, chapters, images.select("book_id", "ord", "name")), "OEBPS/content.opf", F.col("opf")))
    out = out.unionByName(row(tables, "OEBPS/toc.ncx", F.col("ncx"))).unionByName(row(tables.join(books.where("version = '3.0'"), "book_id", "left_semi"), "OEBPS/nav.xhtml", F.col("nav")))
    styled = books.where("css <> ''").select("book_id", "css")
    css = styled.select("book_id", F.lit(CSS).alias("text")) if sheets is None else styled.join(sheets.select("book_id", F.col("css").alias("text")), "book_id", "left").select("book_id", F.coalesce("text", F.lit(CSS)).alias("text"))
    out = out.unionByName(row(css, "OEBPS/style.css", F.col("text")))
    out = out.unionByName(row(books.where("cover <> ''"), "OEBPS/cover.xhtml", D.cover_page(F.col("title"), N.encoded(F.col("cover")), F.col("language"))))
    out = out.unionByName(row(contents, F.concat(F.lit("OEBPS/"), "href"), F.col("content")))
    return out.unionByName(images.select("book_id", F.concat(F.lit("OEBPS/images/"), "name").alias("path"), "content"))


def judged(files: DataFrame, errors: DataFrame, report: DataFrame | None = None) -> Job:
    """Packs books without errors, and gives out those that are sound."""
    errors = written(errors.select(F.col("book_id").cast("string").alias("book_id"), "error").distinct(), "errors")
    packed = written(C.in_parts(files.withColumn("book_id", F.col("book_id").cast("string")).join(errors, "book_id", "left_anti")), "archives")
    verdicts = written(C.verdicts(packed), "verdicts")
    return Job(packed.join(verdicts.where("success"), "book_id", "left_semi"), errors.unionByName(verdicts.where("not success").select("book_id", "error")), report)


def scanned(pages: DataFrame, books: DataFrame, images: DataFrame, strip: bool = True) -> Job:
    """Scanned books: pages(book_id, pageIndex, type, imagePath, lines), books(book_id, title, …), images(book_id, name, content).

    The report says how many pictographs each book lost."""
    meta = kept(with_meta(books, "zh-Hant"), "meta")
    at = F.row_number().over(Window.partitionBy("book_id").orderBy("pageIndex")) - 1
    pages = pages.withColumn("page_no", at)
    lines = pages.where("type = 'text'").select("book_id", "page_no", F.posexplode("lines").alias("line_no", "l")).select("book_id", "page_no", "line_no", "l.*")
    plates = pages.where("type = 'image'").select("book_id", "page_no", F.concat(F.lit("images/"), N.plate_name(F.col("imagePath"))).alias("image_path"))
    # texts move once, to their book: its language comes to them there, before chapters are written
    found = O.chapters(O.paragraphs(lines), plates).join(meta.select("book_id", "language"), "book_id")
    clean = (lambda c: X.strip_pictographs(c)) if strip else (lambda c: c)
    counted = F.aggregate(F.transform("paragraphs", lambda p: X.count_pictographs(p["text"])), F.lit(0), lambda a, x: a + x)
    chapters = written(
        found.withColumns({"pictographs": counted, "title": clean(F.col("title")), "paragraphs": F.transform("paragraphs", lambda p: F.struct(clean(p["text"]).alias("text"), p["is_heading"].alias("is_heading")))})
        .withColumns({"href": F.format_string("%d.xhtml", "chapter_no"), "id": F.format_string("chapter%02d", "chapter_no")}),
        "chapters",
    )
    page = F.when(F.col("kind") == "image", D.image_page(F.col("title"), F.col("image_path"), F.col("title"), F.col("language"))).otherwise(D.chapter_page(F.col("title"), F.col("paragraphs"), F.lit("style.css"), F.col("language")))
    contents = chapters.select("book_id", "href", page.alias("content"))
    used = written(plates.select("book_id", N.basename(F.col("image_path")).alias("name")).where("name is not null").distinct(), "used")
    own = ordered_images(images.join(used, ["book_id", "name"], "left_semi"))
    report = chapters.groupBy("book_id").agg(F.sum("pictographs").alias("pictographs_removed"))
    return judged(files_of(meta, chapters, contents, own), D.package_errors(meta, chapters), report)


def ordered_images(images: DataFrame) -> DataFrame:
    return images.withColumn("ord", F.row_number().over(Window.partitionBy("book_id").orderBy("name"))).select("book_id", "ord", "name", "content")


def sites(chapters: DataFrame, books: DataFrame, images: DataFrame, options: P.Options = P.Options()) -> Job:
    """Web books: chapters(book_id, name, html) in the order of the first number of their names. The report is what each page lost."""
    meta = with_meta(books)
    number = F.regexp_extract(N.basename(F.col("name")), r"(\d+)", 1)
    unnumbered = chapters.where(number == "").select("book_id", F.concat("name", F.lit(" carries no chapter number")).alias("error"))
    order = Window.partitionBy("book_id").orderBy(N.number_key(number), F.collate(F.col("name"), "UNICODE"), "name")
    placed = chapters.where(number != "").withColumn("chapter_no", F.row_number().over(order)).withColumn("page_id", F.xxhash64("book_id", "name"))
    done = written(P.sanitised(placed, options).join(placed.drop("html"), "page_id"), "sanitised")
    named = done.where("error is null").withColumns({"href": F.format_string("%d.xhtml", "chapter_no"), "id": F.format_string("chapter%02d", "chapter_no")})
    contents = named.select("book_id", "href", F.col("xhtml").alias("content"))
    wanted = named.select("book_id", F.explode("images").alias("raw")).select("book_id", N.image_file(F.col("raw")).alias("name")).where("name is not null").distinct()
    cover = meta.select("book_id", F.regexp_extract("cover", "^images/(.*)$", 1).alias("name")).where("name <> ''")
    own = ordered_images(images.join(wanted.unionByName(cover).distinct(), ["book_id", "name"], "left_semi"))
    errors = D.package_errors(meta, named).unionByName(unnumbered).unionByName(done.where("error is not null").select("book_id", F.concat("name", F.lit(": "), "error").alias("error")))
    report = P.drop_report(done.select("page_id", "error", "arrived", "chrome", "survived")).join(done.select("page_id", "book_id", "chapter_no", "title"), "page_id").select("book_id", "chapter_no", "title", "category", "total", "chrome")
    return judged(files_of(meta, named, contents, own), errors, report)


def markdown(sources: DataFrame, images: DataFrame, modified: str | None = None) -> Job:
    """Markdown books: sources(book_id, source), images(book_id, name, content). Block kinds, levels and direction are kept.

    A preamble is a chapter of its own, named for the book. The report lists images that no file has.
    For books of several files each, see bookmd.together."""
    found = written(bookmd.parsed(sources), "markdown")
    meta = with_meta(found.select("book_id", "metadata.title", F.col("metadata.author").alias("creator"), "metadata.translator", F.col("metadata.lang").alias("language"), F.lit(modified).cast("timestamp").alias("modified"), F.coalesce("metadata.direction", F.lit("")).alias("direction"), F.when(F.coalesce("metadata.cover", F.lit("")) != "", F.concat(F.lit("images/"), N.basename(F.col("metadata.cover")))).alias("cover")))
    chapters = bookmd.chapters(found).select("book_id", F.col("chapter_no").alias("own_no"), "level", "title")
    blocks = bookmd.blocks(found).withColumn("own_no", F.coalesce("chapter_no", F.lit(0)))
    preambles = blocks.where("own_no = 0").select("book_id", "own_no").distinct().join(meta.select("book_id", "title"), "book_id").select("book_id", "own_no", F.lit(1).alias("level"), "title")
    every = chapters.unionByName(preambles).withColumn("chapter_no", F.row_number().over(Window.partitionBy("book_id").orderBy("own_no")))
    every = every.withColumns({"href": F.format_string("%d.xhtml", "chapter_no"), "id": F.format_string("chapter%02d", "chapter_no")})
    file_name = N.basename(F.col("href"))
    rendered = blocks.select("book_id", "own_no", "block_id", "parent_id", block_markup(file_name).alias("markup"))
    # quotes nest: a block's depth is told by its parents, and its quotes open and close around it
    body = rendered.groupBy("book_id", "own_no").agg(F.array_sort(F.collect_list(F.struct("block_id", "parent_id", "markup"))).alias("rows"))
    titled = every.join(body, ["book_id", "own_no"], "left").join(meta.select("book_id", "language"), "book_id")
    heading = F.concat(F.lit("  <h"), F.col("level").cast("string"), F.lit(">"), inline(F.col("title")), F.lit("</h"), F.col("level").cast("string"), F.lit(">\n"))
    content = F.concat(D.page_head(F.col("title"), F.col("language")), F.lit('\n  <link rel="stylesheet" href="style.css" type="text/css" />\n</head>\n<body>\n'), F.when(F.col("own_no") > 0, heading).otherwise(""), F.coalesce(nested(F.col("rows")), F.lit("")), F.lit("</body>\n</html>"))
    contents = titled.select("book_id", "href", content.alias("content"))
    wanted = blocks.where("kind = 'image'").select("book_id", file_name.alias("name")).distinct()
    missing = wanted.join(images.select("book_id", "name"), ["book_id", "name"], "left_anti")
    cover = meta.select("book_id", F.regexp_extract("cover", "^images/(.*)$", 1).alias("name")).where("name <> ''")
    own = ordered_images(images.join(wanted.unionByName(cover).distinct(), ["book_id", "name"], "left_semi"))
    return judged(files_of(meta, every, contents, own), D.package_errors(meta, every), missing)


def inline(text: Column) -> Column:
    """Text as markup, its links as such; all else is escaped by then."""
    safe = X.escape_attribute(text, apostrophe=True)
    return F.regexp_replace(safe, r"\[([^\]\n]+)\]\(([^)\s]+)\)", '<a href="$2">$1</a>')


def block_markup(file_name: Column) -> Column:
    kind = F.col("kind")
    items = F.array_join(F.transform(F.coalesce("items", F.array().cast("array<string>")), lambda x: F.concat(F.lit("<li>"), inline(x), F.lit("</li>"))), "")
    picture = F.concat(F.lit('<p><img src="images/'), N.encoded_part(file_name), F.lit('" alt="'), X.escape_attribute(F.coalesce("alt", F.lit(""))), F.lit('"/></p>'))
    level = F.col("level").cast("string")
    return (
        F.when(kind == "paragraph", F.concat(F.lit("<p>"), inline(F.col("text")), F.lit("</p>")))
        .when(kind == "heading", F.concat(F.lit("<h"), level, F.lit(">"), inline(F.col("text")), F.lit("</h"), level, F.lit(">")))
        .when(kind == "list", F.concat(F.lit("<ul>"), items, F.lit("</ul>")))
        .when(kind == "image", picture)
        .when(kind == "fence", F.concat(F.lit("<pre>"), X.escape_text(F.array_join(F.coalesce("items", F.array().cast("array<string>")), "\n")), F.lit("</pre>")))
        .otherwise("")  # a quote is opened and closed around its blocks
    )


def nested(rows: Column) -> Column:
    """Blocks in order, those with a parent within its quote. The open quotes are a stack of ids."""
    start = F.struct(F.lit("").alias("out"), F.array().cast("array<int>").alias("open"))

    def step(acc: Column, row: Column) -> Column:
        depth = F.when(row["parent_id"].isNull(), 0).otherwise(F.array_position(acc["open"], row["parent_id"]).cast("int"))
        closed = F.repeat(F.lit("</blockquote>\n"), F.size(acc["open"]) - depth)
        kept = F.slice(acc["open"], F.lit(1), depth)
        quote = row["markup"] == ""
        text = F.concat(acc["out"], closed, F.when(quote, "<blockquote>\n").otherwise(F.concat(row["markup"], F.lit("\n"))))
        return F.struct(text.alias("out"), F.when(quote, F.concat(kept, F.array(row["block_id"]))).otherwise(kept).alias("open"))

    return F.aggregate(rows, start, step, lambda acc: F.concat(acc["out"], F.repeat(F.lit("</blockquote>\n"), F.size(acc["open"]))))


def rebuilt(archives: DataFrame, members: DataFrame | None = None, drop_first: bool = False, emoji: str = "strip", names: dict[str, str] | None = None, modified: str | None = None, language: str = "zh-TW", pictures: DataFrame | None = None) -> Job:
    """Books taken apart and put together again as sound ones.

    archives(book_id, content) are volumes. members(book_id, new_id, volume_ord) says which
    become one book; without it each is healed for itself, and a cover page of its own gives
    way to a fresh one. drop_first leaves out each volume's first page, its contents; a
    volume must have more. A book may have one stylesheet and one page template. With emoji
    "glyph", pictures(glyph, content) are what pictographs become; those without one stay.
    The report lists the findings.
    """
    # pictographs are code points of one block: some thousands at most
    drawn = frozenset(r["glyph"][:1] for r in pictures.select("glyph").distinct().collect()) if emoji == "glyph" and pictures is not None else frozenset()
    files = kept(without_repeats(C.unpacked(archives)), "files")
    broken = files.where("path is null").select("book_id", "error")
    files = files.where("path is not null").drop("error")
    read = kept(C.documents(files), "documents")
    parts = C.volumes(read, drop_first)
    volume = kept(parts["volume"], "volumes")
    member = (members if members is not None else volume.select("book_id", F.col("book_id").alias("new_id"), F.lit(0).alias("volume_ord"))).select(F.col("book_id").cast("string").alias("book_id"), F.col("new_id").cast("string").alias("new_id"), "volume_ord")
    text = files.where(~N.is_image(F.col("path"))).select("book_id", "path", X.decoded_bytes(F.col("content")).alias("content"))
    spine = parts["chapters"].join(text, ["book_id", "path"], "left")
    if members is None:
        spine = spine.join(R.cover_pages(spine.where("content is not null"), volume.select("book_id", "cover_path")), ["book_id", "path"], "left_anti")
    spine = spine.join(member, "book_id")
    new_no = F.row_number().over(Window.partitionBy("new_id").orderBy("volume_ord", "book_id", "ord"))
    chapters = kept(spine.withColumn("chapter_no", new_no).withColumn("href", F.format_string("%d.xhtml", "chapter_no")), "chapters")

    # resources: equal images once for a new book, one healed stylesheet
    # windows and joins see digests; bytes are read again when the book is packed
    plates = kept(files.where(N.is_image(F.col("path"))).select("book_id", "path", F.sha2("content", 256).alias("digest"), "content"), "plates")
    placed = plates.drop("content").join(member, "book_id").withColumn("ord", F.row_number().over(Window.partitionBy("new_id").orderBy("volume_ord", "book_id", "path")))
    pool = placed.groupBy(F.col("new_id").alias("book_id"), "digest").agg(F.min_by("path", "ord").alias("path"), F.min("ord").alias("ord"))
    name = N.resource_name(F.col("path"))
    split = pool.select("book_id", "ord", "digest", F.regexp_replace(name, r"\.[^.]*$", "").alias("base"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("tail"))
    pool = kept(B.unique_names(split).select(F.col("book_id").alias("new_id"), "ord", "digest", "name"), "pool")
    renamed = placed.drop("ord").join(pool.drop("ord"), ["new_id", "digest"]).select("book_id", "path", "name", "new_id")
    sheets = kept(R.healed_stylesheets(text.where(F.lower("path").endswith(".css")).withColumnRenamed("content", "css")), "sheets")
    ordered_sheets = sheets.join(member, "book_id").withColumn("ord", F.row_number().over(Window.partitionBy("new_id").orderBy("volume_ord", "path")))
    many_sheets = B.more_than_one(ordered_sheets.select(F.col("new_id").alias("book_id"), "ord", "path", F.col("css").alias("content")))
    sheet = ordered_sheets.groupBy("new_id").agg(F.min_by("css", "ord").alias("css"))
    templates = files.where(F.lower("path").endswith(".xpgt")).join(member, "book_id").withColumn("ord", F.row_number().over(Window.partitionBy("new_id").orderBy("volume_ord", "path")))
    many_templates = B.more_than_one(templates.select(F.col("new_id").alias("book_id"), "ord", "path", "content"))
    template = templates.groupBy("new_id").agg(F.min_by("content", "ord").alias("content"))
    resources = renamed.select("book_id", "path", "name").unionByName(sheets.select("book_id", "path", F.lit("style.css").alias("name"))).unionByName(templates.select("book_id", "path", F.lit(TEMPLATE).alias("name")))

    own = chapters.where("path is not null").select("book_id", "path", "href")
    contents_pages = parts["chapters"].select("book_id", "path").limit(0)
    if drop_first:
        whole = C.volumes(read, False)["chapters"]
        contents_pages = whole.select("book_id", "path").join(own, ["book_id", "path"], "left_anti")
    # not from the parsed documents: what is to be repaired may not be well-formed
    quoted = F.regexp_extract_all("content", F.lit(r"""\s(?:xlink:)?(?:href|src)\s*=\s*("[^"]*"|'[^']*')"""), F.lit(1))
    raw = F.transform(quoted, lambda q: X.trim(X.unescape_basic(F.substring(q, F.lit(2), F.length(q) - 2))))
    listed = chapters.where("content is not null").select("book_id", F.col("path").alias("doc_path"), F.posexplode(F.array_distinct(raw)).alias("ord", "raw"))
    targets = kept(R.targets(listed, own, contents_pages, files.select("book_id", "path"), resources), "targets")
    labels = B.unambiguous_labels(chapters.where("label <> ''").select("book_id", "label", "href"))
    moved = kept(R.relocated(chapters.where("content is not null").select("book_id", "path", "content", F.col("label").alias("title")), targets, labels, emoji, names, relink=members is None, drawn=drawn), "relocated")

    first = volume.join(member, "book_id").groupBy("new_id").agg(*(F.min_by(c, F.struct(F.col(c).isNull(), "volume_ord", "book_id")).alias(c) for c in ("title", "creator", "language", "identifier", "direction", "cover_path")), F.min_by("book_id", F.struct(F.col("cover_path").isNull(), "volume_ord", "book_id")).alias("cover_book"))
    cover = first.join(renamed.select(F.col("book_id").alias("cover_book"), F.col("path").alias("cover_path"), "name"), ["cover_book", "cover_path"], "left")
    linked = targets.where(F.col("href").startswith(TEMPLATE)).join(member, "book_id").select("new_id").distinct().withColumn("template", F.lit(TEMPLATE))
    cover = cover.join(linked, "new_id", "left")
    title = F.col("title") if members is None else merged_title(F.col("title"))
    meta = with_meta(cover.select(F.col("new_id").alias("book_id"), title.alias("title"), "creator", "language", F.regexp_replace(F.coalesce("identifier", F.lit("")), "^urn:uuid:", "").alias("uuid"), F.lit(modified).cast("timestamp").alias("modified"), F.coalesce("direction", F.lit("")).alias("direction"), F.concat(F.lit("images/"), "name").alias("cover"), "template"), language)
    sound = chapters.join(moved.select("book_id", "path", F.col("title").alias("new_title"), F.col("content").alias("new_content")), ["book_id", "path"])
    bound = sound.select(F.col("new_id").alias("book_id"), "chapter_no", F.format_string("chapter%02d", "chapter_no").alias("id"), "href", F.col("new_title").alias("title"))
    contents = sound.select(F.col("new_id").alias("book_id"), "href", F.col("new_content").alias("content"))
    first_of = placed.join(pool.select("new_id", "digest", "ord", "name"), ["new_id", "digest", "ord"]).select("new_id", "book_id", "path", "ord", "name")
    images = first_of.join(plates.drop("digest"), ["book_id", "path"]).select(F.col("new_id").alias("book_id"), "ord", "name", "content")
    if drawn:
        used = moved.join(member, "book_id").select(F.col("new_id").alias("book_id"), F.explode("shown").alias("glyph")).distinct()
        code = F.ascii("glyph")
        by_glyph = pictures.groupBy(F.substring("glyph", 1, 1).alias("glyph")).agg(F.min("content").alias("content"))
        images = images.unionByName(used.join(by_glyph, "glyph").select("book_id", code.alias("ord"), F.concat(F.lit("glyph-"), F.lower(F.hex(code)), F.lit(".png")).alias("name"), "content"))

    told = lambda df, error: df.join(member, "book_id").select(F.col("new_id").alias("book_id"), error.alias("error"))
    errors = (
        D.package_errors(meta, bound)
        .unionByName(broken.join(member, "book_id", "left").select(F.coalesce("new_id", "book_id").alias("book_id"), "error"))
        .unionByName(told(chapters.where("error is not null").drop("new_id", "volume_ord"), F.col("error")))
        .unionByName(told(chapters.where("error is null and content is null").drop("new_id", "volume_ord"), F.concat(F.col("path"), F.lit(" does not exist"))))
        .unionByName(told(targets.where("error is not null"), F.concat(F.col("path"), F.lit(": "), F.col("raw"), F.lit(" "), F.col("error"))))
        .unionByName(told(moved.where("error is not null"), F.concat(F.col("path"), F.lit(": "), F.col("error"))))
        .unionByName(many_templates.select("book_id", F.concat(F.lit("more than one page template, the first is "), "first_path").alias("error")))
        .unionByName(told(volume.select("book_id").join(chapters.select("book_id"), "book_id", "left_anti"), F.concat("book_id", F.lit(" contributes no chapters"))))
        .unionByName(many_sheets.select("book_id", F.concat(F.lit("more than one stylesheet, the first is "), "first_path").alias("error")))
    )
    by_book = moved.join(member, "book_id").groupBy("new_id").agg(F.count_if("body_repaired").alias("bodies"), F.sum("pictographs").alias("pictographs"), F.sum("linked").alias("links"), F.count_if(F.col("linked") > 0).alias("contents_pages"))
    legacy = chapters.where(R.is_legacy(F.col("content"))).groupBy("new_id").agg(F.count("*").alias("legacy"))
    facts = volume.join(member, "book_id").groupBy("new_id").agg(F.min_by("version", "volume_ord").alias("version"), F.max(F.coalesce("direction", F.lit(""))).alias("page_direction"), F.min_by(F.coalesce("identifier", F.lit("")), "volume_ord").alias("identifier"), F.min_by(F.coalesce("ncx_uid", F.lit("")), "volume_ord").alias("ncx_uid"))
    found = facts.join(by_book, "new_id", "left").join(legacy, "new_id", "left").fillna(0, ["bodies", "pictographs", "links", "contents_pages", "legacy"]).withColumnRenamed("new_id", "book_id")
    dropped = sheets.join(member, "book_id").select(F.col("new_id").alias("book_id"), F.lit(99).alias("ord"), F.explode(F.transform("dropped", lambda x: F.concat(F.lit("dropped "), x))).alias("finding"))
    report = B.findings(found).unionByName(dropped)
    extra = template.join(linked, "new_id").select(F.col("new_id").alias("book_id"), F.lit(f"OEBPS/{TEMPLATE}").alias("path"), "content")
    return judged(files_of(meta, bound, contents, images, sheet.withColumnRenamed("new_id", "book_id")).unionByName(extra), errors, report)


def without_repeats(files: DataFrame) -> DataFrame:
    """Of an archive's repeated paths, one."""
    return C.first_of_each(files.where("path is not null")).unionByName(files.where("path is null"))


def healed(archives: DataFrame, **options) -> Job:
    """Each broken book as a sound one, its reading order kept."""
    return rebuilt(archives, **options)


def merged(archives: DataFrame, members: DataFrame, **options) -> Job:
    """Volumes of a series as one book each: their chapters in the order of volumes, without the volumes' contents pages."""
    return rebuilt(archives, members, drop_first=True, **options)
