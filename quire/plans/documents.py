"""Package documents as string plans: package, contents, navigation, chapters and pages.

Chapters: (book_id, chapter_no, id, href, title). All of a book's rows meet once, as
ordered arrays; identifiers and times are given, so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.names import encoded, is_uuid, manifest_id, media_type
from quire.functions.text import escape_attribute, escape_text, iso_seconds

XML = '<?xml version="1.0" encoding="UTF-8"?>'
VERSIONS, DIRECTIONS = ("2.0", "3.0"), ("ltr", "rtl", "default")


def versioned(books: DataFrame) -> DataFrame:
    """books whose version is 2.0 where none is given."""
    return books.withColumn("version", F.coalesce(F.nullif(F.col("version"), F.lit("")), F.lit("2.0")))


def ordered(rows: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """One string per key: its values in order, a line each."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))).alias("x")).select(*keys, F.array_join(F.col("x.v"), "\n").alias(name))


def credit(element: str, name: Column, role: str, version: Column, id_: str) -> Column:
    """Who made the book: the role as an attribute, or from version 3.0 as a refinement."""
    old = F.concat(F.lit(f'    <{element} opf:role="{role}">'), escape_text(name), F.lit(f"</{element}>"))
    new = F.concat(F.lit(f'    <{element} id="{id_}">'), escape_text(name), F.lit(f'</{element}>\n    <meta refines="#{id_}" property="role" scheme="marc:relators">{role}</meta>'))
    return F.when(F.coalesce(name, F.lit("")) == "", None).when(version == "2.0", old).otherwise(new)


def package_items(books: DataFrame, chapters: DataFrame, images: DataFrame) -> DataFrame:
    """(book_id, rank, ord, id, href, media_type, properties, in_spine): the manifest in its fixed order.

    images: (book_id, ord, name). Order: cover, its page, stylesheet, navigation, chapters, images, page template, contents.
    A column template of books names the page template, if there are any."""
    books = versioned(books)
    three = F.col("version") == "3.0"
    cover = F.coalesce(F.col("cover"), F.lit("")) != ""
    row = lambda rank, id_, href, kind, props, spine: (F.lit(rank).alias("rank"), F.lit(0).alias("ord"), F.lit(id_).alias("id"), href.alias("href"), kind.alias("media_type"), props.alias("properties"), F.lit(spine).alias("in_spine"))
    no = F.lit(None).cast("string")
    xhtml = F.lit("application/xhtml+xml")
    parts = [
        books.where(cover).select("book_id", *row(0, "cover-image", encoded(F.col("cover")), media_type(F.col("cover")), F.when(three, "cover-image"), False)),
        books.where(cover).select("book_id", *row(1, "cover-xhtml", F.lit("cover.xhtml"), xhtml, no, True)),
        books.where("css <> ''").select("book_id", *row(2, "css", encoded(F.col("css")), F.lit("text/css"), no, False)),
        books.where(three).select("book_id", *row(3, "nav", F.lit("nav.xhtml"), xhtml, F.lit("nav"), False)),
        chapters.select("book_id", F.lit(4).alias("rank"), F.col("chapter_no").alias("ord"), manifest_id(F.col("id")).alias("id"), F.col("href"), xhtml.alias("media_type"), no.alias("properties"), F.lit(True).alias("in_spine")),
        images.join(books.select("book_id", "cover"), "book_id").where(F.concat(F.lit("images/"), "name") != F.coalesce("cover", F.lit(""))).select("book_id", F.lit(5).alias("rank"), "ord", manifest_id(F.concat(F.lit("img-"), F.regexp_replace("name", r"\.[A-Za-z0-9]+$", ""))).alias("id"), encoded(F.concat(F.lit("images/"), "name")).alias("href"), media_type(F.col("name")).alias("media_type"), no.alias("properties"), F.lit(False).alias("in_spine")),
        books.select("book_id", *row(9, "ncx", F.lit("toc.ncx"), F.lit("application/x-dtbncx+xml"), no, False)),
    ]
    if "template" in books.columns:
        parts.append(books.where("template <> ''").select("book_id", *row(7, "page-template", encoded(F.col("template")), media_type(F.col("template")), no, False)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def package_errors(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, error): books whose package document can't be written as asked."""
    books = versioned(books)
    direction = F.coalesce(F.col("direction"), F.lit(""))
    n = chapters.groupBy("book_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("title"), F.lit("")) == "").alias("untitled"))
    checks = F.array(
        F.when(F.coalesce(F.col("title"), F.lit("")) == "", "title is required"),
        F.when(F.coalesce(F.col("language"), F.lit("")) == "", "language is required"),
        F.when(~F.coalesce(is_uuid(F.col("uuid")), F.lit(False)), "uuid must be a bare UUID"),
        F.when(~F.col("version").isin(*VERSIONS), "unsupported version"),
        F.when((direction != "") & ~direction.isin(*DIRECTIONS), "unknown page direction"),
        F.when((direction != "") & (F.col("version") == "2.0"), "page direction needs version 3.0"),
        F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, "a book needs chapters"),
        F.when(F.col("untitled") > 0, "a chapter has no title"),
    )
    return books.join(n, "book_id", "left").select("book_id", F.explode(checks).alias("error")).where("error is not null")


def package_documents(books: DataFrame, chapters: DataFrame, images: DataFrame) -> DataFrame:
    """(book_id, opf): the package document of each book.

    books: (book_id, version, title, creator, translator, language, uuid, modified, direction, cover, css)."""
    books = versioned(books)
    items = package_items(books, chapters, images)
    place = F.struct("rank", "ord", "id")
    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), escape_attribute(c), F.lit('"'))
    item = F.concat(F.lit("    <item"), attribute("id", F.col("id")), attribute("href", F.col("href")), attribute("media-type", F.col("media_type")), F.coalesce(attribute("properties", F.col("properties")), F.lit("")), F.lit("/>"))
    ref = F.concat(F.lit("    <itemref"), attribute("idref", F.col("id")), F.lit("/>"))
    lists = items.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("o"), item.alias("item"), F.when(F.col("in_spine"), ref).alias("ref")))).alias("x"))
    lists = lists.select("book_id", F.array_join(F.col("x.item"), "\n").alias("manifest"), F.array_join(F.col("x.ref"), "\n").alias("spine"))
    three = F.col("version") == "3.0"
    direction = F.coalesce(F.col("direction"), F.lit(""))
    wrap = lambda a, c, b: F.concat(F.lit(a), c, F.lit(b))
    metadata = F.array_join(F.array(
        wrap("    <dc:title>", escape_text(F.col("title")), "</dc:title>"),
        credit("dc:creator", F.col("creator"), "aut", F.col("version"), "creator"),
        credit("dc:contributor", F.col("translator"), "trl", F.col("version"), "translator"),
        wrap("    <dc:language>", escape_text(F.col("language")), "</dc:language>"),
        wrap('    <dc:identifier id="BookID">urn:uuid:', escape_text(F.col("uuid")), "</dc:identifier>"),
        F.when(three, wrap('    <meta property="dcterms:modified">', iso_seconds(F.col("modified")), "</meta>")),
        F.when(~three & (F.coalesce(F.col("cover"), F.lit("")) != ""), F.lit('    <meta name="cover" content="cover-image"/>')),
        F.when(direction == "rtl", F.lit('    <meta name="primary-writing-mode" content="horizontal-rl"/>')),
    ), "\n")
    opf = F.concat(
        F.lit(f'{XML}\n<package xmlns="http://www.idpf.org/2007/opf" unique-identifier="BookID"'), attribute("version", F.col("version")),
        F.lit('>\n  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">\n'), metadata,
        F.lit("\n  </metadata>\n  <manifest>\n"), F.col("manifest"), F.lit('\n  </manifest>\n  <spine toc="ncx"'),
        F.when(direction != "", attribute("page-progression-direction", direction)).otherwise(""), F.lit(">\n"), F.col("spine"), F.lit("\n  </spine>\n</package>"),
    )
    return books.join(lists, "book_id").select("book_id", opf.alias("opf"))


def contents_documents(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, ncx, nav): both forms of a book's table of contents."""
    no = F.col("chapter_no").cast("string")
    title, href = escape_text(F.col("title")), escape_attribute(F.col("href"))
    point = F.concat(F.lit('    <navPoint id="navPoint-'), no, F.lit('" playOrder="'), no, F.lit('">\n      <navLabel><text>'), title, F.lit('</text></navLabel>\n      <content src="'), href, F.lit('"/>\n    </navPoint>'))
    entry = F.concat(F.lit('      <li><a href="'), href, F.lit('">'), title, F.lit("</a></li>"))
    rows = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_no", point.alias("point"), entry.alias("entry")))).alias("x"))
    name, language = escape_text(F.col("title")), escape_attribute(F.coalesce(F.col("language"), F.lit("")))
    ncx = F.concat(
        F.lit(f'{XML}\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">\n  <head>\n    <meta name="dtb:uid" content="urn:uuid:'), escape_attribute(F.col("uuid")),
        F.lit('"/>\n    <meta name="dtb:depth" content="1"/>\n    <meta name="dtb:totalPageCount" content="0"/>\n    <meta name="dtb:maxPageNumber" content="0"/>\n  </head>\n  <docTitle>\n    <text>'), name,
        F.lit("</text>\n  </docTitle>\n  <navMap>\n"), F.array_join(F.col("x.point"), "\n"), F.lit("\n  </navMap>\n</ncx>"),
    )
    nav = F.concat(
        F.lit(f'{XML}\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"'),
        F.when(language != "", F.concat(F.lit(' xml:lang="'), language, F.lit('" lang="'), language, F.lit('"'))).otherwise(""),
        F.lit('>\n<head>\n  <meta charset="UTF-8"/>\n  <title>'), name, F.lit("</title>"),
        F.when(F.col("css") != "", F.concat(F.lit('\n  <link rel="stylesheet" type="text/css" href="'), escape_attribute(F.col("css")), F.lit('"/>'))).otherwise(""),
        F.lit('\n</head>\n<body>\n  <nav epub:type="toc" id="toc">\n    <h1>'), name, F.lit("</h1>\n    <ol>\n"), F.array_join(F.col("x.entry"), "\n"), F.lit("\n    </ol>\n  </nav>\n</body>\n</html>"),
    )
    return books.join(rows, "book_id").select("book_id", ncx.alias("ncx"), nav.alias("nav"))


def page_head(title: Column, language: Column, more: str = "") -> Column:
    lang = escape_attribute(language)
    return F.concat(F.lit(f'{XML}\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml"{more} xml:lang="'), lang, F.lit('" lang="'), lang, F.lit('">\n<head>\n  <meta charset="UTF-8" />\n  <title>'), escape_text(title), F.lit("</title>"))


def chapter_page(title: Column, paragraphs: Column, css: Column, language: Column) -> Column:
    """A text chapter: its title, and its paragraphs and headings in order."""
    body = F.array_join(F.transform(paragraphs, lambda p: F.when(p["is_heading"], F.concat(F.lit("  <h2>"), escape_text(p["text"]), F.lit("</h2>"))).otherwise(F.concat(F.lit("  <p>"), escape_text(p["text"]), F.lit("</p>")))), "\n")
    return F.concat(page_head(title, language), F.lit('\n  <link rel="stylesheet" href="'), escape_attribute(css), F.lit('" type="text/css" />\n</head>\n<body>\n  <h1>'), escape_text(title), F.lit("</h1>\n  <hr />\n"), body, F.lit("\n</body>\n</html>"))


def image_page(title: Column, src: Column, alt: Column, language: Column) -> Column:
    """A page that one image fills."""
    return F.concat(page_head(title, language), F.lit('\n  <style>body { margin: 0 } img { max-width: 100%; max-height: 100vh }</style>\n</head>\n<body>\n  <p><img src="'), escape_attribute(src), F.lit('" alt="'), escape_attribute(alt), F.lit('" /></p>\n</body>\n</html>'))


def cover_page(title: Column, image: Column, language: Column) -> Column:
    """The page of the cover, which says that it is one."""
    more = ' xmlns:epub="http://www.idpf.org/2007/ops"'
    return F.concat(page_head(title, F.when(F.coalesce(language, F.lit("")) == "", "en").otherwise(language), more), F.lit('\n</head>\n<body epub:type="cover">\n  <img src="'), escape_attribute(image), F.lit('" alt="'), escape_attribute(title), F.lit('" />\n</body>\n</html>'))
