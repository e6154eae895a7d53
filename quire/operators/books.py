"""Books as tables: reading order, labels, contents pages, shared resources, guards.

manifest(book_id, ord, id, href, media_type, properties), spine(book_id, ord, idref),
ncx(book_id, ord, src, label), files(book_id, path), references(book_id, doc_path, ord, raw).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.names import decoded, dirname, is_image, extension, number_key, reference_kind, resolved, target
from quire.functions.text import squeeze
from quire.sources.session import written

# fixed values: when a page counts as a contents page
LABEL_SHARE, LEAST_LINES = 0.8, 3
EXEMPT = ("mimetype",)


def manifest_by_id(manifest: DataFrame, *more: str) -> DataFrame:
    """One row per id: the last declaration at the place of the first."""
    return manifest.groupBy("book_id", "id").agg(F.min("ord").alias("ord"), F.max_by(F.struct("href", "media_type", "properties", *more), "ord").alias("last")).select("book_id", "ord", "id", "last.*")


def reading_order(spine: DataFrame, manifest: DataFrame, drop_first: bool = False) -> DataFrame:
    """(book_id, ord, idref, href, error): the spine with its files, without navigation documents."""
    joined = spine.join(manifest_by_id(manifest).drop("ord").withColumnRenamed("id", "idref"), ["book_id", "idref"], "left")
    reading = joined.where(~F.coalesce(F.array_contains(F.split("properties", r"\s+"), "nav"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy("ord"))
    out = reading.withColumn("rank", rank).where(F.col("rank") > (1 if drop_first else 0))
    return out.select("book_id", "ord", "idref", "href", F.when(F.col("href").isNull(), F.concat(F.lit("spine names an undeclared item: "), "idref")).alias("error"))


def first_labels(ncx: DataFrame) -> DataFrame:
    """(book_id, path, label): of several labels of a file, the first that isn't empty."""
    return ncx.where("label <> ''").groupBy("book_id", target(F.col("src")).alias("path")).agg(F.min_by("label", "ord").alias("label"))


def labelled(chapters: DataFrame, ncx: DataFrame) -> DataFrame:
    """chapters(book_id, path) with their label, empty where there is none."""
    return chapters.join(first_labels(ncx), ["book_id", "path"], "left").withColumn("label", F.coalesce("label", F.lit("")))


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Declared files that the container lacks."""
    return manifest.select("book_id", "id", "href").join(files.select("book_id", F.col("path").alias("href")), ["book_id", "href"], "left_anti")


def orphans(files: DataFrame, manifest: DataFrame, package: Column | None = None) -> DataFrame:
    """Files of the container that no manifest declares, but for what the container itself needs."""
    path = F.col("path")
    exempt = path.isin(*EXEMPT) | path.startswith("META-INF/") | path.endswith(".opf") | path.rlike(r"(^|/)\.DS_Store$")
    return files.select("book_id", "path").where(~exempt).join(manifest.select("book_id", F.col("href").alias("path")), ["book_id", "path"], "left_anti")


def internal_references(references: DataFrame) -> DataFrame:
    """References within the book: resolved path, or an error if it can't be decoded or leaves the container."""
    ref = references.where(reference_kind(F.col("raw")) == "internal").withColumn("decoded", decoded(target(F.col("raw"))))
    path = resolved(dirname(F.col("doc_path")), F.col("decoded"))
    error = F.when(F.col("decoded").isNull(), "cannot be decoded").when(path.isNull(), "leaves the container")
    return ref.select("book_id", "doc_path", "ord", "raw", path.alias("path"), error.alias("error"))


def dangling(references: DataFrame, files: DataFrame) -> DataFrame:
    """Internal references to no file."""
    return internal_references(references).where("error is null").join(files.select("book_id", "path"), ["book_id", "path"], "left_anti")


def carried(references: DataFrame, chapters: DataFrame, contents: DataFrame, files: DataFrame) -> DataFrame:
    """Where each resolved reference goes in a rebuilt book: its chapter's new file, else the
    navigation for the old contents page, else a resource by its kind, else an error."""
    found = (
        references.join(chapters.select("book_id", "path", F.col("href").alias("chapter_href")), ["book_id", "path"], "left")
        .join(contents.select("book_id", "path", F.lit("nav.xhtml").alias("nav_href")), ["book_id", "path"], "left")
        .join(files.select("book_id", "path", F.lit(True).alias("present")), ["book_id", "path"], "left")
    )
    kind = F.when(is_image(F.col("path")), "image").when(extension(F.col("path")) == ".css", "stylesheet").when(extension(F.col("path")) == ".xpgt", "template")
    resource = F.when(F.col("present"), kind)
    return found.select("book_id", "doc_path", "ord", "path", F.coalesce("chapter_href", "nav_href").alias("href"), F.when(F.col("chapter_href").isNull() & F.col("nav_href").isNull(), resource).alias("resource"), F.when(F.coalesce("chapter_href", "nav_href").isNull() & F.col("present").isNull(), "missing").when(F.coalesce("chapter_href", "nav_href", resource).isNull(), "cannot be carried").alias("error"))


def cover_item(manifest: DataFrame, metadata: DataFrame) -> DataFrame:
    """(book_id, id, href): the item that the metadata names as cover, else the first that says so itself."""
    named = metadata.where("name = 'cover'").groupBy("book_id").agg(F.min_by("content", "ord").alias("cover_id"))
    items = manifest.join(named, "book_id", "left")
    by_name = F.col("id") == F.col("cover_id")
    own = F.array_contains(F.split(F.coalesce("properties", F.lit("")), r"\s+"), "cover-image")
    chosen = items.where(F.coalesce(by_name, F.lit(False)) | own)
    return chosen.groupBy("book_id").agg(F.min_by(F.struct("id", "href"), F.struct(~F.coalesce(by_name, F.lit(False)), F.col("ord"))).alias("c")).select("book_id", "c.*")


def rootfile(rootfiles: DataFrame) -> DataFrame:
    """(container_id, path): the first root file of the package's media type, else the first at all."""
    other = F.col("media_type") != "application/oebps-package+xml"
    return rootfiles.where("path <> ''").groupBy("container_id").agg(F.min_by("path", F.struct(other, F.col("ord"))).alias("path"))


def unambiguous_labels(labels: DataFrame) -> DataFrame:
    """(book_id, key, href): labels without white space that lead to one place only."""
    keyed = labels.withColumn("key", squeeze(F.col("label"))).where("key <> ''")
    return keyed.groupBy("book_id", "key").agg(F.min("href").alias("href"), F.max("href").alias("last")).where("href = last").drop("last")


def contents_pages(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """(book_id, doc_path, lines, matched, share, is_contents) of pages' lines(book_id, doc_path, line, or key without empty ones) against the book's labels (book_id, key)."""
    keyed = lines if "key" in lines.columns else lines.withColumn("key", squeeze(F.col("line"))).where("key <> ''")
    # equal lines of a page once, before anything moves: a line that all pages have is a small group
    keyed = keyed.groupBy("book_id", "key", "doc_path").agg(F.count("*").alias("n"))
    known = labels.select("book_id", "key").distinct().withColumn("known", F.lit(1))
    scored = keyed.join(known, ["book_id", "key"], "left").groupBy("book_id", "doc_path").agg(F.sum("n").alias("lines"), F.sum(F.when(F.col("known").isNotNull(), F.col("n")).otherwise(0)).alias("matched"))
    enough = F.col("lines") >= LEAST_LINES
    scored = scored.withColumn("matched", F.when(enough, F.col("matched")).otherwise(0)).withColumn("share", F.col("matched") / F.col("lines"))
    return scored.withColumn("is_contents", enough & (F.col("share") >= LABEL_SHARE))


def pooled(resources: DataFrame) -> DataFrame:
    """(book_id, digest, path, ord, copies): equal contents once, under the first path.

    resources: (book_id, ord, path, content)."""
    hashed = resources.withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))
    return hashed.groupBy("book_id", "digest").agg(F.min_by("path", "ord").alias("path"), F.min("ord").alias("ord"), F.count("*").alias("copies"))


def more_than_one(resources: DataFrame) -> DataFrame:
    """(book_id, distinct, first_path): books with more than one content where one is allowed."""
    return pooled(resources).groupBy("book_id").agg(F.count("*").alias("contents"), F.min_by("path", "ord").alias("first_path")).where("contents > 1")


def unique_names(items: DataFrame, suffix: str = "-") -> DataFrame:
    """items(book_id, ord, base, tail) with name: base + tail, or base-2 + tail and on, for what is taken.

    Numbering by rank is right unless a numbered name is also someone's base: those books
    alone are named item by item.
    """
    w = Window.partitionBy("book_id", "base", "tail").orderBy("ord")
    ranked = items.withColumn("n", F.row_number().over(w))
    plain = F.concat("base", "tail")
    named = ranked.withColumn("name", F.when(F.col("n") == 1, plain).otherwise(F.concat("base", F.lit(suffix), F.col("n").cast("string"), "tail")))
    clashing = named.groupBy("book_id").agg(F.count_distinct("name").alias("names"), F.count("*").alias("items")).where("names < items").select("book_id")
    easy = named.join(clashing, "book_id", "left_anti").select(*items.columns, "name")

    def in_turn(group):
        taken, out = set(), []
        group = group.sort_values("ord")
        for base, tail in zip(group["base"], group["tail"]):
            name, n = base + tail, 2
            while name in taken:
                name, n = f"{base}{suffix}{n}{tail}", n + 1
            taken.add(name)
            out.append(name)
        return group.assign(name=out)

    from pyspark.sql.types import StringType, StructField, StructType

    hard = items.join(clashing, "book_id", "left_semi").select(*items.columns)
    return easy.unionByName(hard.groupBy("book_id").applyInPandas(in_turn, StructType([*items.schema.fields, StructField("name", StringType())])))


def numbered(chapters: DataFrame, order: list[str]) -> DataFrame:
    """chapters(book_id, …) with their number, new file, padded id and play order over all volumes."""
    n = F.row_number().over(Window.partitionBy("book_id").orderBy(*order))
    return chapters.withColumn("chapter_no", n).withColumns({"href": F.format_string("%d.xhtml", "chapter_no"), "chapter_id": F.format_string("chapter%02d", "chapter_no"), "play_order": F.col("chapter_no")})


def findings(books: DataFrame) -> DataFrame:
    """(book_id, ord, finding): what is wrong with each book, in the order it is reported.

    books: (book_id, version, page_direction, identifier, ncx_uid, legacy, bodies, pictographs, links, contents_pages)."""
    many = lambda c: F.when(F.col(c) == 1, "").otherwise("s")
    count = lambda c: F.col(c).cast("string")
    rows = [
        F.when((F.col("version") != "3.0") & (F.col("page_direction") != ""), F.concat(F.lit("EPUB "), "version", F.lit(" declares a reading direction, which that version doesn't know"))),
        F.when((F.col("ncx_uid") != "") & (F.col("identifier") != "") & (F.col("ncx_uid") != F.col("identifier")), F.lit("contents list and package name different identifiers")),
        F.when(F.col("legacy") > 0, F.concat(count("legacy"), F.lit(" chapter"), many("legacy"), F.lit(" with an outdated document type"))),
        F.when(F.col("bodies") > 0, F.concat(count("bodies"), F.lit(" document"), many("bodies"), F.lit(" whose content stands outside the body"))),
        F.when(F.col("pictographs") > 0, F.concat(count("pictographs"), F.lit(" pictographs taken out"))),
        F.when(F.col("links") > 0, F.concat(count("links"), F.lit(" lines of contents pages linked"))),
        F.when(F.col("contents_pages") > 1, F.concat(count("contents_pages"), F.lit(" pages look like contents and stay unchanged"))),
    ]
    found = books.select("book_id", F.posexplode(F.array(*rows)).alias("ord", "finding"))
    return found.where(F.col("finding").isNotNull())


def guards(books: DataFrame, parts: DataFrame, least: int = 1) -> DataFrame:
    """Books with fewer parts than they need."""
    n = parts.groupBy("book_id").agg(F.count("*").alias("n"))
    return books.select("book_id").join(n, "book_id", "left").select("book_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def duplicates(items: DataFrame, *keys: str) -> DataFrame:
    return items.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that one side has and the other lacks."""
    a, b = (x.select(key).distinct().withColumn(side, F.lit(True)) for x, side in ((left, "in_left"), (right, "in_right")))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))
    return both.where("not (in_left and in_right)")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side, repeats counted. Both sides are shuffled once, with their numbers."""
    n = "n_" + max(left.columns, key=len)  # a name of no column
    both = left.withColumn(n, F.lit(1)).unionByName(right.withColumn(n, F.lit(-1)))
    counted = both.groupBy(*left.columns).agg(F.sum(n).alias(n)).where(F.col(n) != 0)
    each = counted.withColumn("side", F.when(F.col(n) > 0, "left").otherwise("right")).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.abs(n))))
    return each.drop(n)


def in_order(names: DataFrame, group: str, name: str, locale: str = "UNICODE") -> DataFrame:
    """names with place: by the first number in a name, then as the locale orders names (a collation of Spark, such as UNICODE, de or es), then by bytes.

    Names without a number have no place. place is ten times the number's rank, and the rank among equal numbers."""
    number = number_key(F.regexp_extract(name, r"(\d+)", 1))
    by_number = Window.partitionBy(group, F.col("place_number").isNull()).orderBy("place_number")
    within = Window.partitionBy(group, "place_number").orderBy(F.collate(F.col(name), locale), name)
    ranked = names.withColumn("place_number", number).withColumn("place", 10 * (F.dense_rank().over(by_number) - 1) + F.row_number().over(within))
    return ranked.withColumn("place", F.when(F.col("place_number").isNotNull(), F.col("place"))).drop("place_number")


def reachable(edges: DataFrame) -> DataFrame:
    """(a, b): the transitive closure of (a, b).

    Each round joins only the pairs that the last one found to all that are known, which doubles the length of paths: a chain of n takes
    log n rounds, no two old pairs meet again, and the rounds end when one finds nothing."""
    known = new = written(edges.select("a", "b").where("a is not null and b is not null").distinct(), "closure")
    while not new.isEmpty():
        longer = new.alias("x").join(known.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b").distinct()
        new = written(longer.join(known, ["a", "b"], "left_anti"), "closure")
        known = known.unionByName(new)
    return known
