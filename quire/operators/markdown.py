"""Markdown read as a relation: lines become blocks by built-in functions alone.

A second reading of what `functions.bookmd` reads line after line in Python, so that each
can be held against the other. A line's kind is a matter of the line itself, but for
fences: a fence closes only at one of its own sign, at least as long and without more, so
what a line is depends on those before it. That is folded over the lines that look like
fences, few of all. Runs of lines are islands: a block begins where a line's kind isn't
that of the line before. All that stays within a book's row, as arrays. Quotes hold lines of their own, which are read in a next round,
one for each depth of quotes there is.

Nulls: a null source is an empty book. A null book_id is a book of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.bookmd import BLANKS, KNOWN
from quire.sources.session import written

BLOCK_COLUMNS = ("book_id", "chapter_no", "block_id", "parent_id", "ord", "kind", "level", "text", "marker", "items", "href", "alt", "form", "info")


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def pieces(source: Column) -> Column:
    return F.split(F.replace(F.coalesce(source, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")


def matter(lines: Column) -> Column:
    """How many lines are front matter: up to the second line of three dashes, if the first line is such."""
    close = F.array_position(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), bare), "---")
    return F.when((bare(lines[0]) == "---") & (close > 0), close.cast("int") + 1).otherwise(0)


def metadata(books: DataFrame) -> DataFrame:
    """(book_id, metadata): the known keys, the last of each, and the others in order."""
    lines = books.select(F.col("book_id").cast("string").alias("book_id"), pieces(F.col("source").cast("string")).alias("lines"))
    named = F.filter(F.slice("lines", 2, F.greatest(matter(F.col("lines")) - 2, F.lit(0))), lambda x: x.contains(":"))
    pair = lambda x: F.struct(bare(F.substring_index(x, ":", 1)).alias("key"), bare(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value"))
    found = lines.select("book_id", F.transform(named, pair).alias("pairs"))
    last = lambda k: F.try_element_at(F.filter("pairs", lambda p: p["key"] == k), F.lit(-1))["value"]
    own = [(F.coalesce(last(k), F.lit("")) if k in ("title", "lang", "direction") else last(k)).alias(k) for k in KNOWN]
    return found.select("book_id", F.struct(*own, F.filter("pairs", lambda p: ~p["key"].isin(*KNOWN)).alias("extras")).alias("metadata"))


def fences(lines: Column) -> Column:
    """(first, last) of each fence, by lines from 0; last is the number of lines where none closes it."""
    sign = lambda x: F.regexp_extract(bare(x), r"(?s)^(`{3,}|~{3,})(.*)$", 1)
    marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), sign(x).alias("sign"), (bare(x) == sign(x)).alias("plain"))), lambda m: m["sign"] != "")
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def step(acc: Column, m: Column) -> Column:
        closes = m["plain"] & (F.left(m["sign"], F.lit(1)) == F.left(acc["sign"], F.lit(1))) & (F.length(m["sign"]) >= F.length(acc["sign"]))
        opened = F.struct(m["sign"].alias("sign"), m["at"].alias("at"), acc["out"].alias("out"))
        closed = F.struct(none.alias("sign"), acc["at"].alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("first"), m["at"].alias("last")))).alias("out"))
        return F.when(acc["sign"].isNull(), opened).when(closes, closed).otherwise(acc)

    def rest(acc: Column) -> Column:
        return F.when(acc["sign"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["at"].alias("first"), F.size(lines).alias("last")))))

    return F.aggregate(marks, F.struct(none.alias("sign"), F.lit(0).alias("at"), empty.alias("out")), step, rest)


def level(units: DataFrame) -> DataFrame:
    """Blocks (book_id, path, …, inner) of units (book_id, path, lines): path is that of the unit and the block's first line; inner the lines of a quote.

    A unit's lines stay in its row: kinds, runs and blocks are arrays made of each other."""

    def kind_of(x: Column, i: Column) -> Column:
        t = bare(x)
        image = (t.startswith("![[") & t.endswith("]]")) | t.rlike(r"(?s)^!\[[^\]]*\]\(.*\)$")
        fenced = F.exists("fences", lambda f: i.between(f["first"], f["last"]))
        kind = F.when(fenced, "fence").when(t == "", "blank").when(t.startswith(">"), "quote").when(t.rlike("^#{1,6} "), "heading").when(image, "image").when(t.rlike("^[*+-] "), "list").otherwise("paragraph")
        return F.struct(t.alias("t"), kind.alias("kind"), F.when(fenced, x).alias("line"))

    def marked(x: Column, i: Column) -> Column:
        at = lambda k: F.get("own", k)["kind"]
        within = (x["kind"] == "blank") & (at(i - 1) == "quote") & (at(i + 1) == "quote")
        return F.struct(x["t"].alias("t"), F.when(within, "quote").otherwise(x["kind"]).alias("kind"), F.when(x["kind"] == "list", F.left(x["t"], F.lit(1))).alias("marker"), x["line"].alias("line"))

    def begins(i: Column) -> Column:
        x, before = F.get("own", i), F.get("own", i - 1)
        same = F.coalesce((before["kind"] == x["kind"]) & before["marker"].eqNullSafe(x["marker"]), F.lit(False))
        return F.when(x["kind"] == "blank", False).when(x["kind"] == "fence", F.exists("fences", lambda f: f["first"] == i)).when(x["kind"].isin("heading", "image"), True).otherwise(~same)

    def block(i: Column, k: Column) -> Column:
        x, stop = F.get("own", i), F.coalesce(F.get("starts", k + 1), F.size("own"))
        return F.struct(i.alias("first"), x["kind"].alias("kind"), x["marker"].alias("marker"), F.filter(F.slice("own", i + 1, stop - i), lambda y: y["kind"] == x["kind"]).alias("own"), F.exists("fences", lambda f: (f["first"] == i) & (f["last"] < F.size("own"))).alias("closed"))

    numbers = F.when(F.size("own") > 0, F.sequence(F.lit(0), F.size("own") - 1)).otherwise(F.array().cast("array<int>"))
    rows = units.withColumn("fences", fences(F.col("lines"))).withColumn("own", F.transform("lines", kind_of)).withColumn("own", F.transform("own", marked)).withColumn("starts", F.filter(numbers, begins))
    found = rows.select("book_id", "path", F.explode(F.transform("starts", block)).alias("block")).select("book_id", "path", "block.*")
    lines, kind = F.col("own"), F.col("kind")
    head = lines[0]["t"]
    of = lambda k, c: F.when(kind == k, c)
    after = lambda c, at: bare(F.substring(c, at, F.length(c)))
    sign = F.regexp_extract(head, r"^(`+|~+)", 1)
    wiki, target = head.startswith("![["), F.substring(head, F.lit(4), F.length(head) - 5)
    inline = lambda k: F.regexp_extract(head, r"(?s)^!\[([^\]]*)\]\((.*)\)$", k)
    inside = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - F.when(F.col("closed"), 2).otherwise(1), F.lit(0))), lambda x: x["line"])
    hashes = F.length(F.regexp_extract(head, "^(#+)", 1))
    return found.select(
        "book_id",
        F.concat("path", F.array("first")).alias("path"),
        "kind",
        of("heading", hashes).alias("level"),
        F.when(kind == "paragraph", F.array_join(F.transform(lines, lambda x: x["t"]), " ")).when(kind == "heading", after(head, hashes + 2)).alias("text"),
        F.coalesce("marker", of("fence", F.left(sign, F.lit(1)))).alias("marker"),
        F.when(kind == "list", F.transform(lines, lambda x: after(x["t"], F.lit(3)))).when(kind == "fence", inside).alias("items"),
        of("image", F.when(wiki, F.substring_index(target, "|", 1)).otherwise(inline(2))).alias("href"),
        of("image", F.when(wiki, F.when(target.contains("|"), F.substring(target, F.instr(target, "|") + 1, F.length(target)))).otherwise(F.nullif(inline(1), F.lit("")))).alias("alt"),
        of("image", F.when(wiki, "wiki").otherwise("inline")).alias("form"),
        of("fence", after(head, F.length(sign) + 1)).alias("info"),
        of("quote", F.transform(lines, lambda x: F.regexp_replace(x["t"], "^> ?", ""))).alias("inner"),
    )


def read(books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chapters (book_id, chapter_no, level, title) and blocks (BLOCK_COLUMNS) of books (book_id, source)."""
    lines = books.select(F.col("book_id").cast("string").alias("book_id"), pieces(F.col("source").cast("string")).alias("lines"))
    body = F.slice("lines", matter(F.col("lines")) + 1, F.size("lines"))
    units = lines.select("book_id", F.array().cast("array<int>").alias("path"), body.alias("lines"))
    every, depth = None, 0
    while True:
        depth += 1
        found = written(level(units), "markdown-blocks")
        own = found.drop("inner")
        every = own if every is None else every.unionByName(own)
        quotes = found.where("kind = 'quote'").select("book_id", "path", F.col("inner").alias("lines"))
        if quotes.isEmpty():
            break
        units = quotes
    w = Window.partitionBy("book_id").orderBy("path")
    top = (F.col("kind") == "heading") & (F.size("path") == 1)
    placed = every.repartition("book_id").withColumn("top", top).withColumn("chapter_no", F.nullif(F.sum(F.col("top").cast("int")).over(w), F.lit(0)).cast("int")).withColumn("block_id", (F.sum((~F.col("top")).cast("int")).over(w) - 1).cast("int"))
    chapters = placed.where("top").select("book_id", "chapter_no", "level", F.col("text").alias("title"))
    blocks = placed.where("not top")
    # in reading order, a block's parent is the last block one level up
    parent = F.lit(None).cast("int")
    for d in range(2, depth + 1):
        parent = F.when(F.size("path") == d, F.last(F.when(F.size("path") == d - 1, F.col("block_id")), ignorenulls=True).over(w)).otherwise(parent)
    siblings = Window.partitionBy("book_id", "chapter_no", F.slice("path", 1, F.size("path") - 1)).orderBy("path")
    blocks = blocks.withColumn("parent_id", parent).withColumn("ord", (F.row_number().over(siblings) - 1).cast("int"))
    return chapters, blocks.select(*BLOCK_COLUMNS)


def disagreements(books: DataFrame, found: DataFrame) -> DataFrame:
    """(book_id, side, …): blocks that only this reading ("left") or only that of `bookmd.parsed` ("right") has, book by book.

    Both sides meet as a row for each book. A book without an id, or that one side lacks, isn't compared."""
    columns = BLOCK_COLUMNS[1:]
    own = read(books)[1].groupBy("book_id").agg(F.collect_list(F.struct(*columns)).alias("own"))
    other = found.select("book_id", F.transform("blocks", lambda b: F.struct(*(b[c].alias(c) for c in columns))).alias("other"))
    none = lambda c, like: F.coalesce(c, F.filter(like, lambda _: F.lit(False)))
    both = other.join(own, "book_id", "left").select("book_id", "other", none(F.col("own"), F.col("other")).alias("own"))
    side = lambda a, b, name: F.transform(F.array_except(a, b), lambda x: F.struct(F.lit(name).alias("side"), x.alias("x")))
    rows = both.select("book_id", F.explode(F.concat(side("own", "other", "left"), side("other", "own", "right"))).alias("d"))
    return rows.select("book_id", "d.side", "d.x.*")
