"""Whole jobs end in books that keep every rule, or in errors."""

import io
import zipfile

from pyspark.sql import functions as F
from test_books import GOOD, OPF, packed

from quire.operators import containers as C
from quire.operators.pages import Options
from quire.plans import assembly as A

PNG = b"\x89PNG\r\n\x1a\n1"


def opened(job, book_id):
    row = next(r for r in job.archives.collect() if r.book_id == book_id)
    with zipfile.ZipFile(io.BytesIO(bytes(row.content))) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        return {n: z.read(n) for n in z.namelist()}


def text(files, name):
    return files[f"OEBPS/{name}"].decode()


def test_scanned(spark):
    line = lambda t, y: {"text": t, "x": 0.1, "y": y, "width": 0.5, "height": 0.02}
    pages = [("b", 0, "image", None, []), ("b", 1, "text", None, [line("🚀 Hello", 0.8), line("World <x>", 0.77)]), ("b", 2, "image", "images/page_3.jpeg", []), ("b", 3, "text", None, [line("after", 0.5)]), ("bad", 0, "text", None, [line("x", 0.5)])]
    df = spark.createDataFrame(pages, "book_id string, pageIndex int, type string, imagePath string, lines array<struct<text:string,x:double,y:double,width:double,height:double>>")
    books = spark.createDataFrame([("b", "T & U"), ("bad", None)], "book_id string, title string")
    images = spark.createDataFrame([("b", "page_3.jpeg", b"\xff\xd8x"), ("b", "other.jpeg", b"y")], "book_id string, name string, content binary")
    job = A.scanned(df, books, images)
    files = opened(job, "b")
    assert "<p>Hello World &lt;x&gt;</p>" in text(files, "1.xhtml") and 'src="images/page_3.jpeg"' in text(files, "2.xhtml") and "OEBPS/images/other.jpeg" not in files
    assert "T &amp; U" in text(files, "toc.ncx") and "第 3 部分 (頁 3)" in text(files, "nav.xhtml")
    assert [(r.book_id, r.error) for r in job.errors.collect()] == [("bad", "title is required")]
    assert {r.book_id: r.pictographs_removed for r in job.report.collect()}["b"] == 1


def test_sites(spark):
    chapters = [("s", "ch10.html", "<h1>Ten</h1><p>x"), ("s", "ch2.html", "<nav><a href=q>n</a></nav><h1>Two &amp; AT&T</h1><img src='../images/a.png'>"), ("broken", "ch1.html", "<h1>x</h1><img src='images/gone.png'>"), ("odd", "intro.html", "<p>x")]
    df = spark.createDataFrame(chapters, "book_id string, name string, html string")
    books = spark.createDataFrame([(b, b, "en") for b in ("s", "broken", "odd")], "book_id string, title string, language string")
    images = spark.createDataFrame([("s", "a.png", PNG)], "book_id string, name string, content binary")
    job = A.sites(df, books, images, Options(rewrites={"../images/": "images/"}))
    files = opened(job, "s")
    assert "Two &amp; AT&amp;T" in text(files, "1.xhtml") and "Ten" in text(files, "2.xhtml") and files["OEBPS/images/a.png"] == PNG
    errors = {r.book_id: r.error for r in job.errors.collect()}
    assert "has no file" in errors["broken"] and "odd" in errors and "s" not in errors
    assert {(r.book_id, r.category, r.total, r.chrome) for r in job.report.collect()} == {("s", "links", 1, 1)}


def test_markdown(spark):
    source = "---\ntitle: M\nlang: ja\ndirection: rtl\nauthor: A\ntranslator: B\n---\n\nBefore\n\n# One [l](https://x/?a=1&b=2)\n\n> quoted\n> > deep\n>\n> again\n\nafter\n\n- a\n- b\n\n![[p.png|alt]]\n\n```\n<raw>\n```\n\n## Two\n"
    sources = spark.createDataFrame([("m", source), ("none", "no title")], "book_id string, source string")
    images = spark.createDataFrame([("m", "p.png", PNG)], "book_id string, name string, content binary")
    job = A.markdown(sources, images)
    files = opened(job, "m")
    assert "<p>Before</p>" in text(files, "1.xhtml")
    two = text(files, "2.xhtml")
    assert '<a href="https://x/?a=1&amp;b=2">l</a>' in two and "<blockquote>\n<p>quoted</p>\n<blockquote>\n<p>deep</p>\n</blockquote>\n<p>again</p>\n</blockquote>\n<p>after</p>" in two and "<pre>&lt;raw&gt;</pre>" in two and 'alt="alt"' in two
    assert 'page-progression-direction="rtl"' in text(files, "content.opf") and ">B</dc:contributor>" in text(files, "content.opf")
    assert {r.book_id for r in job.errors.collect()} == {"none"}


LEGACY = '<?xml version="1.0"?>\n<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.1//EN" "x"><html xmlns="http://www.w3.org/1999/xhtml"><head><title>p</title></head><p>🚀 x&nbsp;y</p><img src="i/a.png"/><img src="i/b.png"/></html>'


def broken():
    opf = OPF.replace('<item id="ncx"', '<item id="i1" href="i/a.png" media-type="image/png"/><item id="i2" href="i/b.png" media-type="image/png"/><item id="ncx"').replace('<spine toc="ncx">', '<spine toc="ncx" page-progression-direction="rtl">')
    return GOOD | {"OEBPS/content.opf": opf, "OEBPS/index.xhtml": LEGACY, "OEBPS/style.css": "@font-face { src: url(res:///x.ttf) }\nbody { color: red; }", "OEBPS/toc.ncx": GOOD["OEBPS/toc.ncx"].replace('content="i"', 'content="j"'), "OEBPS/i/a.png": PNG, "OEBPS/i/b.png": PNG}


def test_heal_and_idempotence(spark):
    df = spark.createDataFrame([("h", packed(broken())), ("dead", packed(GOOD | {"OEBPS/index.xhtml": LEGACY.replace("i/a.png", "gone.png").replace("i/b.png", "gone.png")})), ("junk", b"x")], "book_id string, content binary")
    job = A.healed(df)
    files = opened(job, "h")
    page = text(files, "1.xhtml")
    assert "<!DOCTYPE html>" in page and "<body>" in page and "🚀" not in page and page.count('src="images/a.png"') == 2 and sum(n.startswith("OEBPS/images/") for n in files) == 1
    assert "font-face" not in text(files, "style.css") and 'page-progression-direction="rtl"' in text(files, "content.opf")
    findings = " ".join(r.finding for r in job.report.where("book_id = 'h'").collect())
    for part in ("EPUB 2.0", "identifiers", "1 chapter with", "1 document whose", "1 pictographs", "dropped font"):
        assert part in findings, part
    assert {r.book_id for r in job.errors.collect()} == {"dead", "junk"}
    again = A.healed(job.archives)
    assert text(opened(again, "h"), "1.xhtml") == page and again.report.where("book_id = 'h'").count() == 0


def test_merge(spark):
    contents = '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>c</title></head><body><a href="index.xhtml">x</a></body></html>'
    opf = OPF.replace('<item id="x"', '<item id="t" href="t.xhtml" media-type="application/xhtml+xml"/><item id="x"').replace('<itemref idref="x"/>', '<itemref idref="t"/><itemref idref="x"/>').replace(">T<", ">傳 卷一<")
    volume = GOOD | {"OEBPS/content.opf": opf, "OEBPS/t.xhtml": contents, "OEBPS/index.xhtml": GOOD["OEBPS/index.xhtml"].replace('<a href="#f">', '<a href="t.xhtml">')}
    df = spark.createDataFrame([("v1", packed(volume)), ("v2", packed(volume))], "book_id string, content binary")
    members = spark.createDataFrame([("v1", "series", 1), ("v2", "series", 2)], "book_id string, new_id string, volume_ord int")
    job = A.merged(df, members)
    files = opened(job, "series")
    assert {"OEBPS/1.xhtml", "OEBPS/2.xhtml"} <= set(files) and "OEBPS/3.xhtml" not in files
    assert 'href="nav.xhtml"' in text(files, "1.xhtml") and 'href="2.xhtml#f"' in text(files, "2.xhtml")
    assert "<dc:title>傳 卷</dc:title>" in text(files, "content.opf")
    assert not job.errors.collect() and C.verdicts(job.archives).collect()[0].success


def test_chapters_get_only_labels_they_could_show(spark):
    # before, each chapter came with all labels of its book: their product grew with the square of a book
    from quire.operators import repair as R

    pages = [("b", f"t{i}.xhtml", f"<html><head><title>x</title></head><body><p>Part {i}</p>\n<p>a &amp; {i}</p></body></html>", f"Part {i}") for i in range(50)]
    pages.append(("b", "toc.xhtml", "<html><head><title>x</title></head><body><p>Part 1</p>\n<p>Part  2</p>\n<p><b>a &amp; 3</b></p></body></html>", "Contents"))
    pages.append(pages[-1])  # a spine may name a file twice
    chapters = spark.createDataFrame(pages, "book_id string, path string, content string, title string")
    labels = spark.createDataFrame([("b", f"{name}{i}", f"{n}-{i}.xhtml") for i in range(50) for n, name in enumerate(("Part", "a&"))], "book_id string, key string, href string")
    none = chapters.select("book_id", "path", F.lit("").alias("raw"), F.lit(None).cast("string").alias("href")).where("false")
    keys = {(r.path, r.key) for r in R.spoken(chapters).join(labels, ["book_id", "key"]).collect()}
    assert keys == {(f"t{i}.xhtml", k) for i in range(50) for k in (f"Part{i}", f"a&{i}")} | {("toc.xhtml", k) for k in ("Part1", "Part2", "a&3")}
    done = {r.path: r for r in R.relocated(chapters, none, labels).collect()}
    assert done["toc.xhtml"].linked == 3 and '<a href="0-1.xhtml">Part 1</a>' in done["toc.xhtml"].content and '<a href="1-3.xhtml">a &amp; 3</a>' in done["toc.xhtml"].content
    assert done["t7.xhtml"].linked == 0
