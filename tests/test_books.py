import io
import zipfile
import zlib

import pytest

from quire.functions import bookmd as M
from quire.operators import bookmd, books as B, containers as C, repair as R

OPF = '<package xmlns="http://www.idpf.org/2007/opf" version="2.0" unique-identifier="b"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title><dc:identifier id="b">i</dc:identifier></metadata><manifest><item id="c" href="style.css" media-type="text/css"/><item id="x" href="index.xhtml" media-type="application/xhtml+xml"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="ncx"><itemref idref="x"/></spine></package>'
CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
PAGE = '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>p</title></head><body><p>x</p>{}</body></html>'
NCX = '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><head><meta name="dtb:uid" content="i"/></head><navMap><navPoint><navLabel><text>L</text></navLabel><content src="index.xhtml"/></navPoint></navMap></ncx>'
GOOD = {"mimetype": "application/epub+zip", "META-INF/container.xml": CONTAINER, "OEBPS/content.opf": OPF, "OEBPS/style.css": "p{}", "OEBPS/index.xhtml": PAGE.format('<a href="#f">f</a><a href="https://x/">e</a><a href="index.xhtml#f">r</a>'), "OEBPS/toc.ncx": NCX}


def packed(files, stored=True):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        for path, text in files.items():
            z.writestr(path, text, zipfile.ZIP_STORED if path == "mimetype" and stored else zipfile.ZIP_DEFLATED)
    return sink.getvalue()


CASES = {
    "valid": (packed(GOOD), None),
    "missing file": (packed({k: v for k, v in GOOD.items() if k != "OEBPS/style.css"}), "does not exist"),
    "orphan": (packed(GOOD | {"orphan.txt": "x"}), "Orphan file"),
    "compressed": (packed({"mimetype": "application/epub+zip" * 3} | GOOD, stored=False), "uncompressed"),
    "order": (packed(dict(reversed(GOOD.items()))), "mimetype must"),
    "malformed": (packed(GOOD | {"OEBPS/index.xhtml": "<html><body><p>a & b</body></html>"}), "not well-formed"),
    "no body": (packed(GOOD | {"OEBPS/index.xhtml": '<html xmlns="http://www.w3.org/1999/xhtml"><p>x</p></html>'}), "no body"),
    "dead link": (packed(GOOD | {"OEBPS/index.xhtml": PAGE.format('<a href="gone.xhtml">x</a>')}), "has no file"),
    "escape": (packed(GOOD | {"OEBPS/content.opf": OPF.replace("style.css", "../../secret.txt")}), "leaves the container"),
    "undeclared": (packed(GOOD | {"OEBPS/content.opf": OPF.replace('idref="x"', 'idref="y"')}), "undeclared"),
    "no container": (packed({k: v for k, v in GOOD.items() if "META" not in k}), "container.xml is missing"),
    "no manifest": (packed(GOOD | {"OEBPS/content.opf": OPF.replace("manifest", "manifeste")}), "no manifest"),
    "no spine": (packed(GOOD | {"OEBPS/content.opf": OPF.replace("<spine", "<spin").replace("</spine", "</spin")}), "no spine"),
    "not a zip": (b"hello", "not a zip"),
    "empty": (b"", "not a zip"),
    "null": (None, "not a zip"),
}


def test_every_rule_fires(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "book_id string, content binary")
    got = {r.book_id: r for r in C.verdicts(df).collect()}
    for name, (_, want) in CASES.items():
        r = got[name]
        assert r.success == (want is None), (name, r.error)
        assert want is None or want in r.error, (name, r.error)


def test_volume_and_round_trip(spark):
    df = spark.createDataFrame([("b", packed(GOOD))], "book_id string, content binary")
    files = C.unpacked(df)
    v = C.volumes(C.documents(files))
    assert v["volume"].collect()[0].title == "T"
    assert [(r.path, r.label) for r in v["chapters"].collect()] == [("OEBPS/index.xhtml", "L")]
    assert C.verdicts(C.packed(files)).collect()[0].success


def test_names_and_first_wins(spark):
    items = spark.createDataFrame([(1, 1, "a", ""), (1, 2, "a", ""), (1, 3, "a-2", ""), (2, 1, "a", ".png"), (2, 2, "a", ".png")], "book_id int, ord int, base string, tail string")
    got = {(r.book_id, r.ord): r.name for r in B.unique_names(items).collect()}
    assert got == {(1, 1): "a", (1, 2): "a-2", (1, 3): "a-2-2", (2, 1): "a.png", (2, 2): "a-2.png"}
    manifest = spark.createDataFrame([("b", 0, "x", "one", "t", None), ("b", 1, "y", "two", "t", None), ("b", 2, "x", "three", "t", "nav")], "book_id string, ord int, id string, href string, media_type string, properties string")
    assert [(r.id, r.ord, r.href) for r in B.manifest_by_id(manifest).orderBy("ord").collect()] == [("x", 0, "three"), ("y", 1, "two")]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 9)], "a int, b int")
    assert {tuple(r) for r in B.reachable(edges).collect()} == {(1, 2), (2, 3), (3, 4), (1, 3), (2, 4), (1, 4), (9, 9)}


BOOK = """---
title: A & <B>
lang: zh-Hant
direction: rtl
author: Nobody
writing-mode: vertical
---

> # quoted heading
> p

Words
wrapped here.

# One [Nav](https://n.com)

* a
* [b](x?q=a&b=c)
- c

![[p.png|alt|more]]

![](q.png)

```py
# no heading
```

## Two

# Three
> a [l](z)
>
> b
"""


def test_markdown(spark):
    found = bookmd.parsed(spark.createDataFrame([("b", BOOK), ("e", ""), ("n", None)], "book_id string, source string")).cache()
    row = found.where("book_id = 'b'").collect()[0]
    assert row.is_fixpoint and row.metadata.direction == "rtl" and [tuple(e) for e in row.metadata.extras] == [("writing-mode", "vertical")]
    assert [(c.level, c.title) for c in row.chapters] == [(1, "One [Nav](https://n.com)"), (2, "Two"), (1, "Three")]
    rows = bookmd.blocks(found).where("book_id = 'b'").orderBy("block_id").collect()
    assert [r.kind for r in rows] == ["quote", "heading", "paragraph", "paragraph", "list", "list", "image", "image", "fence", "quote", "paragraph", "paragraph"]
    assert rows[3].text == "Words wrapped here." and (rows[6].href, rows[6].alt) == ("p.png", "alt|more") and rows[7].alt is None
    kept = bookmd.data_columns(found).where("book_id = 'b'").collect()[0]
    assert sorted(kept.links) == ["https://n.com", "x?q=a&b=c", "z"]
    assert M.inline_xhtml("a < [b](c'd) & [x]") == 'a &lt; <a href="c&apos;d">b</a> &amp; [x]'


def test_relocation(spark):
    body = '<html><head><title>t</title></head><body><p>🚀 Hi <a href="c2.xhtml#x">n</a><img src="../i/a.png" alt="📊 x"/></p></body></html>'
    bare = "<html><head/><p>x&nbsp;y</p></html>"
    contents = "<html><body>Title<br/>One<br/>Two<br/>Three<br/>Four</body></html>"
    chapters = spark.createDataFrame([("b", "t/c1.xhtml", body, ""), ("b", "t/c2.xhtml", bare, "C2"), ("b", "t/toc.xhtml", contents, "Toc"), ("b", "t/bad.xhtml", "<p>&nope;</p>", "")], "book_id string, path string, content string, title string")
    refs = spark.createDataFrame([("b", "t/c1.xhtml", 0, "c2.xhtml#x"), ("b", "t/c1.xhtml", 1, "../i/a.png"), ("b", "t/c1.xhtml", 2, "gone.xhtml")], "book_id string, doc_path string, ord int, raw string")
    known = spark.createDataFrame([("b", "t/c1.xhtml", "1.xhtml"), ("b", "t/c2.xhtml", "2.xhtml")], "book_id string, path string, href string")
    none = known.select("book_id", "path").limit(0)
    files = spark.createDataFrame([("b", "i/a.png"), ("b", "t/c2.xhtml")], "book_id string, path string")
    pool = spark.createDataFrame([("b", "i/a.png", "a-2.png")], "book_id string, path string, name string")
    targets = R.targets(refs, known, none, files, pool)
    assert {r.raw: (r.href, r.error) for r in targets.collect()} == {"c2.xhtml#x": ("2.xhtml#x", None), "../i/a.png": ("images/a-2.png", None), "gone.xhtml": (None, "missing")}
    labels = spark.createDataFrame([("b", k, f"{n}.xhtml") for n, k in enumerate(("One", "Two", "Three", "Four"), 1)], "book_id string, key string, href string")
    got = {r.path: r for r in R.relocated(chapters, targets, labels).collect()}
    one = got["t/c1.xhtml"]
    assert one.content.startswith("<!DOCTYPE html>\n") and "<p>Hi <a" in one.content and 'href="2.xhtml#x"' in one.content and 'src="images/a-2.png"' in one.content and 'alt="x"' in one.content and one.pictographs == 2 and one.title == "t"
    assert got["t/c2.xhtml"].body_repaired and "<body><p>x y</p></body>" in got["t/c2.xhtml"].content
    assert got["t/toc.xhtml"].linked == 4 and '<a href="1.xhtml">One</a>' in got["t/toc.xhtml"].content and "Title<br/>" in got["t/toc.xhtml"].content
    assert "nope" in got["t/bad.xhtml"].error
    again = R.relocated(spark.createDataFrame([("b", "t/toc.xhtml", got["t/toc.xhtml"].content, "Toc")], "book_id string, path string, content string, title string"), targets, labels).collect()[0]
    assert again.linked == 0 and again.content == got["t/toc.xhtml"].content
    glyphs = {r.path: r for r in R.relocated(chapters, targets, labels, emoji="glyph", names={"🚀": "rocket"}, drawn=frozenset("🚀")).collect()}
    assert glyphs["t/c1.xhtml"].glyphs == 1 and 'alt="rocket"' in glyphs["t/c1.xhtml"].content
    with pytest.raises(ValueError):
        R.relocated(chapters, targets, labels, emoji="other")


def test_cover_pages(spark):
    rows = [("b", "a", '<html><body epub:type="cover"><img src="x.png"/></body></html>'), ("b", "c", '<html><body> <img src="i/c%20v.jpg"/></body></html>'), ("b", "d", '<html><body>text<img src="i/c v.jpg"/></body></html>')]
    chapters = spark.createDataFrame(rows, "book_id string, path string, content string")
    covers = spark.createDataFrame([("b", "OEBPS/i/c v.jpg")], "book_id string, cover_path string")
    assert {r.path for r in R.cover_pages(chapters, covers).collect()} == {"a", "c"}


def test_large_archives_go_in_parts(spark):
    # before, an archive was one value of a row, as large as its book
    import os

    files = {("large", "mimetype"): b"application/epub+zip", ("small", "mimetype"): b"x", ("large", "none"): b""} | {("large", f"p{k}.png"): os.urandom(300_000) for k in range(12)}
    df = spark.createDataFrame([(b, p, c) for (b, p), c in files.items()], "book_id string, path string, content binary")
    packed = C.in_parts(df, 1_000_000)
    parts = packed.collect()
    assert sorted((r.book_id, r.part) for r in parts) == [*(("large", k) for k in range(4)), ("small", 0)] and max(len(r.content) for r in parts) < 1_400_000
    whole = {r.book_id: bytes(r.content) for r in C.packed(df).collect()}
    assert b"".join(bytes(r.content) for r in sorted(parts, key=lambda r: (r.book_id, r.part)) if r.book_id == "large") == whole["large"]
    assert {(r.book_id, r.path): bytes(r.content) for r in C.unpacked(packed).collect()} == files
    cut = C.unpacked(packed.where("book_id = 'small' or part < 3")).collect()
    assert [(r.book_id, r.path) for r in cut if r.error] == [("large", None)] and len(cut) == 2
    assert {r.book_id: r.error for r in C.verdicts(packed).collect()} == {"large": "META-INF/container.xml is missing", "small": "mimetype is missing or wrong"}


def test_long_lists_are_read_without_a_tree():
    # before, the tree of a contents list took some twenty times its text
    import tracemalloc

    points = "".join(f"<navPoint id='n{k}'><navLabel><text>Part {k}</text></navLabel><content src='{k}.xhtml'/></navPoint>" for k in range(20_000))
    source = f"<ncx><head><meta name='dtb:uid' content='u'/></head><navMap>{points}</navMap></ncx>".encode()
    tracemalloc.start()
    told = C.read_document("toc.ncx", source)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told["ncx_uid"] == "u" and told["labels"][:2] == [("0.xhtml", "Part 0"), ("1.xhtml", "Part 1")] and len(told["labels"]) == 20_000
    assert peak < 6 * len(source), peak / len(source)


def test_tables_of_many_rows_are_not_broadcast(spark, monkeypatch):
    # before, the chapters of large books were broadcast by the size of their files, which compress well
    from pyspark.sql import functions as F

    from quire.sources.session import written

    monkeypatch.setattr(C, "BROADCAST_ROWS", 100)
    many, few = (C.unlike_files(written(spark.range(n), "t")) for n in (200, 50))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(many.join(many.withColumnRenamed("id", "b"), F.col("id") == F.col("b"))) and "BroadcastHashJoin" in plan(few.join(few.withColumnRenamed("id", "b"), F.col("id") == F.col("b")))


def test_a_judgement_writes_no_contents(spark, tmp_path):
    """The archives and their files were written again before."""
    import glob
    import os

    from quire.sources.session import own_dir, written

    df = spark.createDataFrame([("a", "mimetype", b"application/epub+zip"), ("a", "x.txt", os.urandom(400_000))], "book_id string, path string, content binary")
    packed = written(C.packed(df), "packed")
    size = lambda: sum(map(os.path.getsize, glob.glob(f"{own_dir(spark)}/*/*.parquet")))
    before = size()
    C.violations(packed)
    assert size() - before < 100_000


def test_archives_are_read_as_zipfile_reads_them():
    """Sound ones, and two thousand that are broken at a place or two."""
    import random

    def by_zipfile(data):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(i.filename, k, z.read(i)) for k, i in enumerate(z.infolist()) if not i.is_dir()]

    def told(read, data):
        try:
            return list(read(data))
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, ValueError, EOFError, OSError, zlib.error) as e:
            return type(e)

    files = [("mimetype", b"application/epub+zip"), ("ü/x", b"abc" * 50), ("e", b""), ("d/r.xml", bytes(range(256)))]
    mine, theirs = C.Packing(), io.BytesIO()
    with zipfile.ZipFile(theirs, "w") as z:
        for path, content in files:
            mine.add(path, content)
            z.writestr(path, content)
        z.mkdir("empty")
    mine.end()
    seeds = [bytes(mine.held), theirs.getvalue()]
    wanted = [(path, k, content) for k, (path, content) in enumerate(files)]
    assert all(by_zipfile(s) == list(C.members(io.BytesIO(s))) == wanted for s in seeds)
    rand = random.Random(1)
    for _ in range(2000):
        data = bytearray(rand.choice(seeds))
        for _ in range(rand.choice((1, 2))):
            data[rand.randrange(len(data))] = rand.randrange(256)
        assert told(lambda d: C.members(io.BytesIO(d)), bytes(data)) == told(by_zipfile, bytes(data))


def test_a_table_of_many_files_takes_little_memory():
    """Its entries were objects of zipfile before, some 600 bytes each."""
    import tracemalloc

    tracemalloc.start()
    archive = C.Packing()
    for k in range(70_000):  # more than the short form of the table can count
        archive.add(f"f{k}", b"")
    archive.end()
    data = bytes(archive.taken())
    assert tracemalloc.get_traced_memory()[1] < 32_000_000
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    assert sum(1 for _ in C.members(io.BytesIO(data), contents=False)) == 70_000
    assert tracemalloc.get_traced_memory()[1] - held < 16_000_000
    tracemalloc.stop()
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None


def test_small_files_are_packed_and_read_faster_than_by_zipfile():
    import time

    files = [("mimetype", b"application/epub+zip"), *((f"t{k}.xhtml", b"<html><body>x</body></html>" * 6) for k in range(400))]

    def packed():
        archive = C.Packing()
        for path, content in files:
            archive.add(path, content)
        archive.end()
        return bytes(archive.taken())

    def by_zipfile():
        sink = io.BytesIO()
        with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in files:
                z.writestr(path, content)

    def read_by_zipfile():
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(i.filename, k, z.read(i)) for k, i in enumerate(z.infolist())]

    def fastest(work):
        times = []
        for _ in range(7):
            start = time.perf_counter()
            work()
            times.append(time.perf_counter() - start)
        return min(times)

    data = packed()
    assert list(C.members(io.BytesIO(data))) == read_by_zipfile() == [(path, k, content) for k, (path, content) in enumerate(files)]
    assert fastest(packed) < 0.85 * fastest(by_zipfile) and fastest(lambda: list(C.members(io.BytesIO(data)))) < 0.85 * fastest(read_by_zipfile)


def test_items_of_a_kind_share_its_name():
    items = "".join(f'<item id="i{k}" href="{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(9))
    read = C.read_document("a.opf", f"<package><manifest>{items}<item/></manifest><spine/></package>".encode())
    assert len({id(kind) for _, _, kind, _ in read["manifest"][:9]}) == 1 and read["manifest"][9] == (None, None, None, None)
