"""Recognised lines to paragraphs, chapters and pages, by windows over geometry.

Lines: (book_id, page_no, line_no, text, x, y, width, height); boxes from 0 to 1, y
from the bottom. Pages of a book are numbered from 0 in reading order. All windows lie
within a book or a page of it, so one exchange by book serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import graphemes, join_lines, trim

# fixed values: the geometry of paragraphs, in page heights or mean line heights
FOOTER, HEADER = 0.06, 0.94
GAP, GAP_AFTER_STOP, INDENT, SIZE_CHANGE, HEADING_SIZE = 1.8, 0.95, 0.05, 1.45, 1.35
STOPS = r"[。！？?」「”“.!]$"
HEADING_LENGTH = 40
SECTION = 91
TEXT_PAGE = 120
SAME_LINE = 0.015
OPENING, PLATE, PART = "前言 / 開始閱讀", "插圖 (頁 {})", "第 {} 部分 (頁 {})"
CHAPTER_START = "章|第[一二三四五六]"

PAGE = ["book_id", "page_no"]
PAGES_SCHEMA = "pageIndex: int, type: string, imagePath: string, lines: array<struct<text:string,x:double,y:double,width:double,height:double>>"


def exploded(pages: DataFrame, book_id: str = "book_id") -> DataFrame:
    """Lines of scanned pages (PAGES_SCHEMA with a book id), numbered as they lie in the arrays."""
    line = F.posexplode("lines").alias("line_no", "line")
    return pages.select(F.col(book_id).alias("book_id"), F.col("pageIndex").alias("page_no"), line).select("book_id", "page_no", "line_no", "line.*")


def in_reading_order(lines: DataFrame) -> DataFrame:
    """Lines renumbered from top to bottom, those of one height from left to right."""
    top = Window.partitionBy(*PAGE).orderBy(F.desc("y"), "x", "line_no")
    banded = lines.withColumn("step", (F.coalesce(F.lag("y").over(top) - F.col("y"), F.lit(0.0)) >= SAME_LINE).cast("int"))
    banded = banded.withColumn("band", F.sum("step").over(top))
    across = Window.partitionBy(*PAGE).orderBy("band", "x", F.desc("y"), "line_no")
    return banded.withColumn("line_no", F.row_number().over(across) - 1).drop("step", "band")


def body_lines(lines: DataFrame) -> DataFrame:
    """Without running headers and footers."""
    return lines.where(F.col("y").between(FOOTER, HEADER))


def paragraphs(lines: DataFrame) -> DataFrame:
    """(book_id, page_no, para_no, text, is_heading)."""
    page = Window.partitionBy(*PAGE)
    order = page.orderBy("line_no")
    kept = body_lines(lines).withColumn("mean", F.avg("height").over(page))
    before = F.lag(F.struct("text", "x", "y", "height")).over(order)
    gap = F.col("before.y") - (F.col("y") + F.col("height"))
    breaks = (
        (gap > F.col("mean") * GAP)
        | (trim(F.col("before.text")).rlike(STOPS) & (gap > F.col("mean") * GAP_AFTER_STOP))
        | (F.col("x") - F.col("before.x") > INDENT)
        | (F.greatest(F.col("before.height"), F.col("height")) > F.col("mean") * SIZE_CHANGE)
    )
    numbered = kept.withColumn("before", before).withColumn("para_no", F.sum(F.coalesce(breaks & F.col("before").isNotNull(), F.lit(False)).cast("int")).over(order))
    rows = numbered.groupBy(*PAGE, "para_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("lines"), F.max("height").alias("height"), F.first("mean").alias("mean"))
    text = join_lines(F.col("lines.text"))
    heading = (F.size("lines") == 1) & (F.col("height") > F.col("mean") * HEADING_SIZE)
    return rows.select(*PAGE, "para_no", text.alias("text"), heading.alias("tall")).select(*PAGE, "para_no", "text", (F.col("tall") & (graphemes(F.col("text")) < HEADING_LENGTH)).alias("is_heading"))


def page_kinds(lines: DataFrame) -> DataFrame:
    """(book_id, page_no, n_graphemes, kind): image if there is too little text."""
    n = F.sum(line_graphemes())
    return lines.groupBy(*PAGE).agg(n.alias("n_graphemes")).withColumn("kind", page_kind(F.col("n_graphemes")))


def line_graphemes() -> Column:
    return graphemes(F.coalesce("text", F.lit("")))


def page_kind(n_graphemes: Column) -> Column:
    return F.when(n_graphemes < TEXT_PAGE, "image").otherwise("text")


def is_chapter_start(text: Column, is_heading: Column) -> Column:
    return is_heading & (text.rlike(CHAPTER_START) | F.lower(text).contains("chapter"))


def chapters(paras: DataFrame, plates: DataFrame) -> DataFrame:
    """(book_id, chapter_no, kind, title, paragraphs, image_path): the structure of books.

    paras: (book_id, page_no, para_no, text, is_heading); plates: (book_id, page_no,
    image_path), of which page 0 and those without a path contribute nothing. A plate is
    a chapter; text after it is another; a chapter heading after text starts one; and a
    section ends after so many paragraphs.
    """
    empty = F.lit(None)
    shown = plates.where((F.col("page_no") > 0) & F.col("image_path").isNotNull())
    stream = paras.select(*PAGE, "para_no", "text", "is_heading", empty.cast("string").alias("image_path")).unionByName(shown.select(*PAGE, F.lit(0).alias("para_no"), empty.cast("string").alias("text"), F.lit(False).alias("is_heading"), "image_path"))
    order = Window.partitionBy("book_id").orderBy("page_no", "para_no")
    plate = F.col("image_path").isNotNull()
    marked = stream.withColumns({"plate": plate, "after_plate": F.coalesce(F.lag(plate).over(order), F.lit(False)), "first": F.row_number().over(order) == 1})
    heads = is_chapter_start(F.col("text"), F.col("is_heading")) & ~F.col("after_plate") & ~F.col("first")
    marked = marked.withColumn("heads", F.coalesce(heads & ~F.col("plate"), F.lit(False)))
    marked = marked.withColumn("seg", F.sum((F.col("plate") | F.col("after_plate") | F.col("heads")).cast("int")).over(order))
    within = Window.partitionBy("book_id", "seg").orderBy("page_no", "para_no")
    marked = marked.withColumn("chunk", F.floor((F.row_number().over(within) - 1) / SECTION))
    # the page that an after-plate chapter is named for is the plate's
    marked = marked.withColumn("plate_page", F.lag("page_no").over(order))
    rows = marked.groupBy("book_id", "seg", "chunk").agg(
        F.min_by(F.struct("plate", "after_plate", "heads", "text", "page_no", "plate_page", "image_path"), F.struct("page_no", "para_no")).alias("head"),
        F.array_sort(F.collect_list(F.when(~F.col("plate"), F.struct("page_no", "para_no", "text", "is_heading")))).alias("paragraphs"),
    )
    no = F.row_number().over(Window.partitionBy("book_id").orderBy("seg", "chunk"))
    named = rows.withColumn("chapter_no", no)
    title = (
        F.when(F.col("head.plate"), F.format_string(PLATE.replace("{}", "%d"), F.col("head.page_no") + 1))
        .when(F.col("chunk") > 0, F.format_string(PART.replace("{}", "%d"), F.col("chapter_no"), F.col("head.page_no") + 1))
        .when(F.col("head.after_plate"), F.format_string(PART.replace("{}", "%d"), F.col("chapter_no"), F.col("head.plate_page") + 1))
        .when(F.col("head.heads"), F.col("head.text"))
        .otherwise(OPENING)
    )
    return named.select("book_id", "chapter_no", F.when(F.col("head.plate"), "image").otherwise("text").alias("kind"), title.alias("title"), F.transform("paragraphs", lambda p: F.struct(p["text"].alias("text"), p["is_heading"].alias("is_heading"))).alias("paragraphs"), F.col("head.image_path").alias("image_path"))


def summary(lines: DataFrame) -> DataFrame:
    """(book_id, pages, text_pages, image_pages, characters)."""
    kinds = page_kinds(lines)
    return kinds.groupBy("book_id").agg(F.count("*").alias("pages"), F.count_if(F.col("kind") == "text").alias("text_pages"), F.count_if(F.col("kind") == "image").alias("image_pages"), F.sum("n_graphemes").alias("characters"))


def preview(lines: DataFrame, most: int = 14) -> DataFrame:
    """The first lines of each book's first text page."""
    text_pages = page_kinds(lines).where("kind = 'text'").groupBy("book_id").agg(F.min("page_no").alias("page_no"))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy("line_no"))
    return lines.join(text_pages, PAGE, "left_semi").withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
