"""More queries over the driver's tables: names, checks, markup, readers and whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import names as N
from quire.functions import text as X
from quire.operators import bookmd, books as B, containers as C, images as I, ocr as O, pages as P, repair as R, titles as Ti
from quire.plans import assembly as A, documents as D
from quire.plans.inputs import OCR_LINES, PAGE_TITLES, SPACE, ocr_book, ocr_lines, page_titles, spread, table
from quire.plans.queries import _CHAPTERS, _WEAK, esc, esc_attr, sql_trim
from quire.sources import files as S, tables as Ta
from quire.sources.session import own_dir, written
from quire.streaming import landing as L

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _pick(key: str, *values: str | None) -> F.Column:
    """One of the values, by the key."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _sql_pick(key: str, *values: str | None) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"list_element([{quoted}], ({key} % {len(values)} + 1)::INT)"


def _bytes(c: F.Column | str) -> F.Column:
    return F.encode(F.lit(c) if isinstance(c, str) else c, "UTF-8")


# ---- names ------------------------------------------------------------------

_PATHS = ("images/page_1.jpeg", "images/a%20b.png", "images/sub/x.png", "other/x.png", "images/..", "images/%zz.png", "../img/Größe 1.PNG", "../img/old/p.gif", "-_-.svg")


@query(f"SELECT p_partkey, path, nullif(CASE WHEN regexp_extract(path, '^images/([A-Za-z0-9._-]+)$', 1) NOT IN ('.', '..') THEN regexp_extract(path, '^images/([A-Za-z0-9._-]+)$', 1) END, '') AS plate, CASE path WHEN 'images/page_1.jpeg' THEN 'page_1.jpeg' WHEN 'images/a%20b.png' THEN 'a b.png' WHEN 'images/..' THEN '..' END AS file, CASE WHEN path LIKE '../img/old/%' THEN 'old/' || path[12:] WHEN path LIKE '../img/%' THEN 'images/' || path[8:] ELSE path END AS moved, CASE path WHEN 'images/page_1.jpeg' THEN 'page_1.jpeg' WHEN 'images/a%20b.png' THEN 'a-20b.png' WHEN 'images/sub/x.png' THEN 'x.png' WHEN 'other/x.png' THEN 'x.png' WHEN 'images/%zz.png' THEN 'zz.png' WHEN '../img/Größe 1.PNG' THEN 'Gr-e-1.png' WHEN '../img/old/p.gif' THEN 'p.gif' ELSE 'image' || CASE WHEN path = '-_-.svg' THEN '.svg' ELSE '' END END AS kept FROM (SELECT p_partkey, {_sql_pick('p_partkey', *_PATHS)} AS path FROM part) WHERE path <> 'images/..' UNION ALL SELECT p_partkey, 'images/..', NULL, '..', 'images/..', 'image' FROM part WHERE {_sql_pick('p_partkey', *_PATHS)} = 'images/..'")
def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "part").select("p_partkey", _pick("p_partkey", *_PATHS).alias("path"))
    path = F.col("path")
    return paths.select("p_partkey", "path", N.plate_name(path).alias("plate"), N.image_file(path).alias("file"), Ta.rewritten_prefix(path, {"../img/": "images/", "../img/old/": "old/"}).alias("moved"), N.resource_name(path).alias("kept"))


_HOSTS = ("localhost", "LOCALHOST:3000", "127.0.0.1", "127.1.2.3:80", "[::1]:8080", "example.com", "127.0.0.1.example.com", "localhost.example")


@query(f"SELECT s_suppkey, host, regexp_matches(lower(host), '^(localhost|\\[::1\\]|127(\\.\\d{{1,3}}){{3}})(:\\d+)?$') AS is_local FROM (SELECT s_suppkey, {_sql_pick('s_suppkey', *_HOSTS)} AS host FROM supplier)")
def local_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "supplier").select("s_suppkey", _pick("s_suppkey", *_HOSTS).alias("host"))
    return hosts.select("s_suppkey", "host", N.is_local_host(F.col("host")).alias("is_local"))


@query("SELECT doc_id, h[1:8] || '-' || h[9:12] || '-4' || h[14:16] || '-' || '89ab'[(('0x' || h[17:17])::INT % 4) + 1] || h[18:20] || '-' || h[21:32] AS uuid FROM (SELECT doc_id, sha256(source || chr(31) || text) AS h FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)")
def name_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    return docs.select("doc_id", X.name_uuid(F.col("source"), F.col("text")).alias("uuid"))


@query("SELECT n_nationkey, g AS glyph, CASE WHEN n_nationkey % 3 = 0 THEN 'smile ' || n_nationkey ELSE printf('U+%X', 128512 + n_nationkey) END AS name FROM (SELECT n_nationkey, chr(128512 + n_nationkey::INT) || CASE WHEN n_nationkey % 2 = 0 THEN chr(65039) ELSE '' END AS g FROM nation)")
def pictograph_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    char = F.decode(F.unhex(F.lpad(F.hex(F.lit(128512) + F.col("n_nationkey")), 8, "0")), "UTF-32")
    nation = table(spark, sf_dir, "nation").withColumn("bare", char)
    glyphs = nation.select("n_nationkey", F.concat("bare", F.when(F.col("n_nationkey") % 2 == 0, "️").otherwise("")).alias("glyph"))
    # the annotations' file of a language, as it is read
    folder = f"{own_dir(spark)}/names-{written(nation.limit(1), 'mark').inputFiles()[0][-12:]}"
    entry = F.concat(F.lit('"'), "bare", F.lit('":{"tts":["smile '), F.col("n_nationkey").cast("string"), F.lit('"]}'))
    nation.where("n_nationkey % 3 = 0").agg(F.concat(F.lit('{"annotations":{"annotations":{'), F.array_join(F.collect_list(entry), ","), F.lit("}}}")).alias("value")).coalesce(1).write.mode("overwrite").text(folder)
    return Ta.named(glyphs, Ta.pictograph_names(spark, f"{folder}/*.txt")).select("n_nationkey", "glyph", "name")


# ---- titles -----------------------------------------------------------------


@query(f"""WITH RECURSIVE {PAGE_TITLES}, t AS (SELECT 'page-' || page_id AS title_id, title FROM titles UNION ALL SELECT 'part-' || p_partkey, p_name || ' of the ' || p_type FROM part UNION ALL SELECT 'cjk-' || p_partkey, p_brand[1:4] || '：' || p_size FROM part UNION ALL SELECT 'one-' || p_partkey, '題' || p_size FROM part),
e AS (SELECT title_id, {sql_trim('title')} AS title FROM t), w AS (SELECT title_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM (SELECT title_id, regexp_split_to_array(title, '{SPACE}+') AS ws FROM e WHERE regexp_matches(title, '{SPACE}'))),
g AS (SELECT *, greatest(sum((NOT list_contains({_WEAK}, lower(regexp_replace(word, '[^\\p{{L}}\\p{{N}}]', '', 'g'))))::INT) OVER (PARTITION BY title_id ORDER BY i), 1)::BIGINT AS line_no FROM w WHERE word <> ''),
l AS (SELECT title_id, list(line ORDER BY line_no) AS lines FROM (SELECT title_id, line_no, string_agg(word, ' ' ORDER BY i) AS line FROM g GROUP BY ALL) GROUP BY title_id),
m AS (SELECT title_id, lines FROM l UNION ALL SELECT title_id, list_concat(list_concat(lines[1:k - 1], [lines[k] || ' ' || lines[k + 1]]), lines[k + 2:]) FROM (SELECT title_id, lines, list_position(lens, list_min(lens)) AS k FROM (SELECT title_id, lines, list_transform(range(1, len(lines)), lambda i: length(lines[i]) + length(lines[i + 1])) AS lens FROM m WHERE len(lines) > 3)))
SELECT title_id, lines FROM m WHERE len(lines) <= 3 UNION ALL SELECT title_id, CASE WHEN title_id LIKE 'cjk%' THEN string_split(title, '：') END FROM e WHERE NOT regexp_matches(title, '{SPACE}')""")
def titles_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in three lines at most, by their language."""
    part = table(spark, sf_dir, "part")
    named = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string")).alias("title_id")
    every = page_titles(spark, sf_dir).select(named("page-", "page_id"), "title")
    every = every.unionByName(part.select(named("part-", "p_partkey"), F.concat("p_name", F.lit(" of the "), "p_type").alias("title")))
    every = every.unionByName(part.select(named("cjk-", "p_partkey"), F.concat(F.substring("p_brand", 1, 4), F.lit("："), F.col("p_size").cast("string")).alias("title")))
    every = every.unionByName(part.select(named("one-", "p_partkey"), F.concat(F.lit("題"), F.col("p_size").cast("string")).alias("title")))
    return Ti.set_titles(every, 3)


@query(f"WITH {PAGE_TITLES} SELECT page_id, regexp_matches({sql_trim('title')}, '{SPACE}') AS word_broken FROM titles")
def word_broken_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_titles(spark, sf_dir).select("page_id", X.is_word_broken(F.col("title")).alias("word_broken"))


# ---- checks -----------------------------------------------------------------

_VERSIONS, _DIRECTIONS, _UUIDS = (None, "", "2.0", "3.0", "4.0"), ("", "ltr", "rtl", "default", "up", None), ("00000000-0000-7000-8000-000000000001", "0" * 36, "00000000-0000-0000-0000-0000000000AB", None)


@query(f"""WITH b AS (SELECT c_custkey AS book_id, CASE WHEN c_custkey % 7 > 0 THEN c_name END AS title, CASE WHEN c_custkey % 11 > 0 THEN 'en' ELSE '' END AS language, {_sql_pick('c_custkey', *_UUIDS)} AS uuid, coalesce(nullif({_sql_pick('c_custkey', *_VERSIONS)}, ''), '2.0') AS version, coalesce({_sql_pick('c_custkey', *_DIRECTIONS)}, '') AS direction FROM customer),
n AS (SELECT o_custkey AS book_id, count(*) AS n, count(*) FILTER (o_orderkey % 50 = 0) AS untitled FROM orders GROUP BY ALL)
SELECT book_id, unnest(list_filter([CASE WHEN title IS NULL THEN 'title is required' END, CASE WHEN language = '' THEN 'language is required' END, CASE WHEN NOT coalesce(regexp_matches(uuid, '^[0-9a-fA-F]{{8}}-([0-9a-fA-F]{{4}}-){{3}}[0-9a-fA-F]{{12}}$'), false) THEN 'uuid must be a bare UUID' END, CASE WHEN version NOT IN ('2.0', '3.0') THEN 'unsupported version' END, CASE WHEN direction NOT IN ('', 'ltr', 'rtl', 'default') THEN 'unknown page direction' END, CASE WHEN direction <> '' AND version = '2.0' THEN 'page direction needs version 3.0' END, CASE WHEN n IS NULL THEN 'a book needs chapters' END, CASE WHEN untitled > 0 THEN 'a chapter has no title' END], lambda x: x IS NOT NULL)) AS error FROM b LEFT JOIN n USING (book_id)""")
def package_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_name")).alias("title"), F.when(F.col("c_custkey") % 11 > 0, "en").otherwise("").alias("language"), _pick("c_custkey", *_UUIDS).alias("uuid"), _pick("c_custkey", *_VERSIONS).alias("version"), _pick("c_custkey", *_DIRECTIONS).alias("direction"))
    chapters = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.when(F.col("o_orderkey") % 50 > 0, "x").alias("title"))
    return D.package_errors(books, chapters)


@query("SELECT doc_id, length(c) AS length, CASE WHEN length(c) > 6000 THEN 'too large' WHEN length(c) = 0 THEN 'empty' WHEN c[1:5] <> '%PDF-' THEN 'not a PDF' END AS refused FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN hex(text) ELSE '%PDF-' || hex(text) END AS c FROM documents WHERE text IS NOT NULL)")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.hex(F.encode("text", "UTF-8"))
    content = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, code).otherwise(F.concat(F.lit("%PDF-"), code))
    uploads = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", _bytes(content).alias("content")).withColumn("length", F.length("content").cast("long"))
    return L.checked(uploads, 6000).select("doc_id", "length", "refused")


@query("SELECT sha256(n_name) AS sha256, n_name, CASE WHEN n_nationkey % 5 = 0 THEN 'another checksum' WHEN n_nationkey % 7 = 0 THEN 'missing' END AS error FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 7 = 0")
def checksum_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    own = nation.where("n_nationkey % 7 > 0 or n_nationkey % 5 = 0").select(F.concat(F.lit("assets/"), "n_name").alias("path"), _bytes(F.when(F.col("n_nationkey") % 5 == 0, "changed").otherwise(F.col("n_name"))).alias("content"))
    pins = nation.select(F.col("n_name").alias("name"), F.upper(F.sha2("n_name", 256)).alias("sha256"))
    return Ta.wrong_checksums(own, pins).join(pins, "name").select(F.lower("sha256").alias("sha256"), F.col("name").alias("n_name"), "error")


@query("SELECT count(*) FILTER (n < o) AS shrunk, sum(greatest(o - n, 0))::BIGINT AS saved FROM (SELECT (p_retailprice * 100)::BIGINT AS o, p_size * 3000 AS n FROM part)")
def shrink_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select(F.col("p_name").alias("path"), F.round(F.col("p_retailprice") * 100).cast("long").alias("original_size"), (F.col("p_size") * 3000).cast("long").alias("new_size"))
    return R.shrink_totals(sizes).select(F.col("shrunk").cast("long"), F.col("saved").cast("long"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS a, c_custkey // 3 AS b FROM customer WHERE c_custkey > 0), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r")
def reachable_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("a"), F.floor(F.col("c_custkey") / 3).cast("long").alias("b"))
    return B.reachable(edges)


# ---- pictures ---------------------------------------------------------------


@query("SELECT p_partkey, list_element(['png', 'gif', 'jpeg', 'svg', NULL], (p_partkey % 5 + 1)::INT) AS format, CASE WHEN p_partkey % 5 < 4 THEN (p_size * 7)::INT END AS width, CASE WHEN p_partkey % 5 < 4 THEN p_size::INT END AS height FROM part")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, high = F.col("p_size") * 7, F.col("p_size")
    big = lambda c, n: F.lpad(F.hex(c), n, "0")
    little = lambda c: F.concat(F.substring(big(c, 4), 3, 2), F.substring(big(c, 4), 1, 2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(wide, 8), big(high, 8))
    gif = F.concat(F.lit("474946383961"), little(wide), little(high))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFDB0004AABBFFC0001108"), big(high, 4), big(wide, 4), F.lit("0301"))
    svg = F.hex(F.concat(F.lit('<?xml version="1.0"?><svg height="'), high.cast("string"), F.lit('px" width="'), wide.cast("string"), F.lit('"/>')))
    kinds = F.element_at(F.array(png, gif, jpeg, svg, F.lit("00")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return S.image_sizes(table(spark, sf_dir, "part").select("p_partkey", F.unhex(kinds).alias("content"))).select("p_partkey", "format", "width", "height")


@query("""WITH p AS (SELECT p_partkey, (p_size % 9)::INT AS n FROM part), i AS (SELECT p_partkey, n, n / 100.0 AS ink FROM p)
SELECT p_partkey, CASE WHEN n > 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS least, round(n / 100.0, 9)::DOUBLE AS ink, CASE WHEN n > 0 THEN 1 END AS left_, CASE WHEN n > 0 THEN n END AS right_, list_filter([CASE WHEN n = 0 THEN 'too little contrast' END, CASE WHEN n <= 3 THEN 'too little ink' END], lambda x: x IS NOT NULL) AS errors FROM i""")
def cover_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White squares of ten by ten with a black line in the middle."""
    n = (F.col("p_size") % 9).cast("int")
    line = F.concat(F.lit("FF"), F.repeat(F.lit("00"), n), F.repeat(F.lit("FF"), 9 - n))
    data = F.unhex(F.concat(F.repeat(F.lit("FF"), F.lit(50)), line, F.repeat(F.lit("FF"), F.lit(40))))
    pictures = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.lit(10).alias("width"), F.lit(10).alias("height"), F.lit(1).alias("channels"), data.alias("data"))
    inked = I.ink(pictures)
    errors = I.shelf_verdicts(inked).groupBy("name").agg(F.sort_array(F.collect_list("error")).alias("errors"))
    return inked.join(errors, "name", "left").select(F.col("name").cast("long").alias("p_partkey"), "least", F.round("ink", 9).alias("ink"), F.col("left").alias("left_"), F.col("right").alias("right_"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


# ---- markup -----------------------------------------------------------------

_HTML = "'<!DOCTYPE html PUBLIC \"-//W3C//DTD XHTML 1.0 Strict//EN\" \"x\">' || chr(10) || '<html><head><title>t</title></head><p>&nbsp;&mdash;&amp;&#x6d3b;&#38;' || {t} || '</p></html>'"


@query(f"SELECT doc_id, md5(replace(replace({_HTML.format(t=esc('text'))}, '&nbsp;', '&#160;'), '&mdash;', '&#8212;')) AS numeric_, md5(replace(replace(replace({_HTML.format(t=esc('text'))}, '&#x6d3b;', '活'), '&nbsp;', '&nbsp;'), '&mdash;', '&mdash;')) AS literal, md5('&nbsp;—&活&' || text) AS plain, md5('<!DOCTYPE html>' || chr(10) || '<html><head><title>t</title></head><p>&#160;&#8212;&amp;&#x6d3b;&#38;' || {esc('text')} || '</p></html>') AS doctype, md5(replace({_HTML.format(t=esc('text'))}, '</head><p>', '</head><body><p>')[:-8] || '</body></html>') AS body, true AS legacy, len(list_filter(string_split('&nbsp;—&活&' || text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\x0B\\f\\r\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]'))) AS lines FROM documents WHERE text IS NOT NULL")
def markup_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What healing does to references, doctypes and bodies, step by step."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    source = F.concat(F.lit('<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Strict//EN" "x">\n<html><head><title>t</title></head><p>&nbsp;&mdash;&amp;&#x6d3b;&#38;'), X.escape_text(F.col("text")), F.lit("</p></html>"))
    plain = F.concat(F.lit("&nbsp;&#8212;&amp;&#x6d3b;&#38;"), X.escape_text(F.col("text")))
    steps = R.markup_steps(docs.select("doc_id", source.alias("source"), plain.alias("value")))
    return steps.select("doc_id", F.md5("numeric").alias("numeric_"), F.md5("literal").alias("literal"), F.md5("plain").alias("plain"), F.md5("doctype").alias("doctype"), F.md5("body").alias("body"), R.is_legacy(F.col("source")).alias("legacy"), F.size("lines").cast("long").alias("lines"))


_XHTML = f"""'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '{P.DOCTYPE}' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="fr" lang="fr"><head><title>T &amp; ' || doc_id || '</title><link rel="stylesheet" type="text/css" href="style.css"/></head><body class="lead"><h1 class="aside">T &amp; ' || doc_id || '</h1><p>' || {esc('t')} || '</p><div><img src="images/a.png" alt="x"/>loose <b>b</b></div></body></html>' || chr(10)"""


@query(f"SELECT doc_id AS page_id, 'T & ' || doc_id AS title, md5({_XHTML}) AS digest, 2::INT AS pictographs, ['images/a.png'] AS images FROM (SELECT doc_id, replace(text, chr(13), chr(10)) AS t FROM documents WHERE text IS NOT NULL) WHERE trim(t, ' ' || chr(9) || chr(10)) <> '' AND NOT regexp_matches(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{1F000}}-\\x{{1FAFF}}\\x{{FFFE}}\\x{{FFFF}}]')")
def sanitised_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages around every text: comments, navigation, foreign attributes, empty divisions and pictographs go; the rest is sound markup."""
    docs = table(spark, sf_dir, "documents").where("text is not null").withColumn("t", F.replace("text", F.lit("\r"), F.lit("\n")))
    docs = docs.where((F.regexp_replace("t", "[ \t\n]", "") != "") & ~F.col("t").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{1F000}-\x{1FAFF}\x{FFFE}\x{FFFF}]"))
    html = F.concat(F.lit('<!DOCTYPE html><html><head><title>old</title></head><body class="hero none"><!-- c --><nav><a href="q">n</a></nav><h1 class="note zz" style="color: red" onclick="go()">T &amp; '), F.col("doc_id").cast("string"), F.lit(" 🚀</h1><div><span><p class='none'>"), X.escape_text(F.col("t")), F.lit('</p></span></div><img src="../images/a.png" alt="🧠 x">loose <b>b</b></body></html>'))
    from quire.plans.trees import CLASS_MAP

    options = P.Options(language="fr", class_map=CLASS_MAP, rewrites={"../images/": "images/"})
    done = P.sanitised(docs.select(F.col("doc_id").alias("page_id"), html.alias("html")), options)
    return done.select("page_id", "title", F.md5("xhtml").alias("digest"), "pictographs", "images")


_ONE_PAGE = lambda title, alt: f"""'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<!DOCTYPE html>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml"' || {alt} || ' xml:lang="en" lang="en">' || chr(10) || '<head>' || chr(10) || '  <meta charset="UTF-8" />' || chr(10) || '  <title>' || {esc(title)} || '</title>'"""


@query(f"""WITH p AS (SELECT p_partkey, p_name || ' & "' || p_size || '"' AS t FROM part) SELECT p_partkey, md5({_ONE_PAGE('t', "''")} || chr(10) || '  <style>body {{ margin: 0 }} img {{ max-width: 100%; max-height: 100vh }}</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '  <p><img src="images/a.png" alt="' || {esc_attr('t')} || '" /></p>' || chr(10) || '</body>' || chr(10) || '</html>') AS plate, md5({_ONE_PAGE('t', "' xmlns:epub=\"http://www.idpf.org/2007/ops\"'")} || chr(10) || '</head>' || chr(10) || '<body epub:type="cover">' || chr(10) || '  <img src="images/a.png" alt="' || {esc_attr('t')} || '" />' || chr(10) || '</body>' || chr(10) || '</html>') AS cover FROM p""")
def picture_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("p_name", F.lit(' & "'), F.col("p_size").cast("string"), F.lit('"'))
    rows = table(spark, sf_dir, "part").select("p_partkey", title.alias("t"))
    src = F.lit("images/a.png")
    return rows.select("p_partkey", F.md5(D.image_page(F.col("t"), src, F.col("t"), F.lit("en"))).alias("plate"), F.md5(D.cover_page(F.col("t"), src, F.lit(""))).alias("cover"))


@query("SELECT c_custkey::VARCHAR AS book_id, 'x' || c_nationkey AS path FROM customer WHERE c_custkey % 4 < 2 OR c_custkey % 4 = 2 AND c_nationkey % 2 = 0")
def cover_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that say that they are a cover, hold nothing but its picture, or another one, or text."""
    k = F.col("c_custkey") % 4
    image = F.when(F.col("c_nationkey") % 2 == 0, "a%20b.png").otherwise("c.png")
    body = F.when(k == 0, '<body epub:type="frontmatter cover"><p>x</p></body>').when(k == 1, '<body><div><img alt="" src="images/a%20b.png"/>&#160;</div></body>'.replace("&#160;", " ")).when(k == 2, F.concat(F.lit('<body><svg><image xlink:href="'), image, F.lit('"/></svg></body>'))).otherwise('<body epub:type="cover-image">text</body>')
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("book_id"), F.concat(F.lit("x"), F.col("c_nationkey").cast("string")).alias("path"), body.alias("content"))
    return R.cover_pages(rows, rows.select("book_id", F.lit("OEBPS/images/a b.png").alias("cover_path")))


@query("SELECT c_custkey::VARCHAR AS book_id, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 3 + c_custkey % 3 END AS linked, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS pictographs, md5('<!DOCTYPE html>' || chr(10) || '<html><head><title>Contents</title></head><body>' || CASE WHEN c_custkey % 2 = 0 THEN '<p>gone </p>' ELSE '<p>stays</p>' END || chr(10) || list_aggregate(list_transform(range(1, (4 + c_custkey % 3)::INT), lambda i: CASE WHEN c_custkey % 3 = 0 THEN '<p>Part ' || i || '</p>' ELSE '<p><a href=\"' || i || '.xhtml\">Part ' || i || '</a></p>' END), 'string_agg', chr(10)) || '</body></html>') AS digest FROM customer")
def links_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which three, four or five lines are labels of the book and one isn't: from four in five on they are contents."""
    numbers = F.sequence(F.lit(1), (3 + F.col("c_custkey") % 3).cast("int"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("book_id"), "c_custkey")
    lines = F.array_join(F.transform(numbers, lambda i: F.concat(F.lit("<p>Part "), i.cast("string"), F.lit("</p>"))), "\n")
    first = F.when(F.col("c_custkey") % 2 == 0, "<p>gone 🚀 🧠</p>\n").otherwise("<p>stays</p>\n")
    page = F.concat(F.lit("<!DOCTYPE html>\n<html><head><title>Contents</title></head><body>"), first, lines, F.lit("</body></html>"))
    labels = customer.select("book_id", F.explode(numbers).alias("i")).select("book_id", F.concat(F.lit("Part "), F.col("i").cast("string")).alias("label"), F.concat(F.col("i").cast("string"), F.lit(".xhtml")).alias("href"))
    chapters = customer.select("book_id", F.lit("c.xhtml").alias("path"), page.alias("content"), F.lit("Contents").alias("title"))
    none = chapters.select("book_id", "path", F.lit("").alias("raw"), F.lit(None).cast("string").alias("href")).where("false")
    done = R.relocated(chapters, none, B.unambiguous_labels(labels))
    return done.select("book_id", F.col("linked").cast("long"), F.col("pictographs"), F.md5("content").alias("digest"))


# ---- folders ----------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    from uuid import uuid4

    return f"{own_dir(spark)}/{name}-{uuid4().hex}"


def _site(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a chapter a nation, a picture a region, a markdown file a nation, a class map and a book's files."""
    folder = _folder(spark, "site")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_nationkey").cast("string")
    S.write_books(nation.select(F.concat(F.lit("ch"), key, F.lit(".HTML")).alias("name"), _bytes(F.concat(F.lit("<h1>"), "n_name", F.lit("</h1>"))).alias("content")), f"{folder}/chapters")
    S.write_books(region.select(F.concat("r_name", F.lit(".png")).alias("name"), _bytes("png").alias("content")).unionByName(region.select(F.concat("r_name", F.lit(".txt")).alias("name"), _bytes("txt").alias("content"))), f"{folder}/images")
    S.write_books(nation.select(F.when(F.col("n_nationkey") == 0, "README.md").otherwise(F.concat("n_name", F.lit(".md"))).alias("name"), _bytes(F.concat(F.lit("---\ntitle: "), "n_name", F.lit("\nmood: calm\n---\n# One\n"))).alias("content")), f"{folder}/books")
    S.write_books(spark.range(1).select(F.lit("map.json").alias("name"), _bytes('{"a": "b", "c": "d e"}').alias("content")), f"{folder}/maps")
    return folder


@query("SELECT 'chapter' AS kind, 'ch' || n_nationkey || '.HTML' AS name, '<h1>' || n_name || '</h1>' AS text FROM nation UNION ALL SELECT 'image', r_name || '.png', 'png' FROM region UNION ALL SELECT 'markdown', n_name || '.md', n_name || ' calm' FROM nation WHERE n_nationkey > 0 UNION ALL SELECT 'class', 'a', 'b' UNION ALL SELECT 'class', 'c', 'd e' UNION ALL SELECT 'unpacked', 'books', count(*)::VARCHAR FROM nation UNION ALL SELECT 'unpacked', 'chapters', count(*)::VARCHAR FROM nation UNION ALL SELECT 'unpacked', 'images', (2 * count(*))::VARCHAR FROM region UNION ALL SELECT 'unpacked', 'maps', '1' UNION ALL SELECT 'listed', 'files', (SELECT 2 * count(*) + 1 FROM nation) + (SELECT 2 * count(*) FROM region) || ''")
def folder_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _site(spark, sf_dir)
    chapters, images = S.site(spark, folder)
    row = lambda df, kind, name, text: df.select(F.lit(kind).alias("kind"), name.alias("name"), text.alias("text"))
    books = bookmd.parsed(bookmd.scan(spark, f"{folder}/books"))
    unpacked = C.folder_files(spark, folder).groupBy("book_id").agg(F.count("*").cast("string").alias("n"))
    out = [
        row(chapters, "chapter", F.col("name"), F.col("html")), row(images, "image", F.col("name"), X.decoded_bytes(F.col("content"))),
        row(books, "markdown", F.col("book_id"), F.concat_ws(" ", "metadata.title", F.col("metadata.extras")[0]["value"])),
        row(Ta.class_map(spark, f"{folder}/maps"), "class", F.col("site_class"), F.col("book_class")),
        row(unpacked, "unpacked", F.col("book_id"), F.col("n")),
        row(S.listing(spark, folder).agg(F.count("*").cast("string").alias("n")), "listed", F.lit("files"), F.col("n")),
    ]
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


_KINDS_OF = "CASE WHEN page_no % 3 = 0 THEN 'image' ELSE 'text' END"


@query(f"WITH {OCR_LINES} SELECT book_id, page_no AS \"pageIndex\", {_KINDS_OF} AS type, 'images/page_' || (page_no + 1) || '.png' AS \"imagePath\", count(*) AS n, md5(string_agg(text, chr(10) ORDER BY line_no)) AS digest FROM lines GROUP BY book_id, page_no")
def ocr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned books written as JSON and read again, their plates found by name or by number."""
    lines = ocr_lines(spark, sf_dir)
    at = F.struct("line_no", "text", "x", "y", "width", "height")
    pages = lines.groupBy("book_id", "page_no").agg(F.array_sort(F.collect_list(at)).alias("l"))
    page = F.struct(F.col("page_no").alias("pageIndex"), F.when(F.col("page_no") % 3 == 0, "image").otherwise("text").alias("type"), F.when(F.col("page_no") % 3 > 0, F.concat(F.lit("out/page_"), (F.col("page_no") + 1).cast("string"), F.lit(".png"))).alias("imagePath"), F.transform("l", lambda x: F.struct(x["text"].alias("text"), x["x"].alias("x"), x["y"].alias("y"), x["width"].alias("width"), x["height"].alias("height"))).alias("lines"))
    folder = _folder(spark, "ocr")
    S.write_books(pages.groupBy("book_id").agg(F.to_json(F.collect_list(page)).alias("t")).select(F.concat("book_id", F.lit(".json")).alias("name"), _bytes(F.col("t")).alias("content")), folder)
    read = S.ocr_books(spark, folder)
    images = pages.select("book_id", F.format_string("page_%d.png", F.col("page_no") + 1).alias("name"))
    found = S.with_plates(read, images)
    return found.select("book_id", "pageIndex", "type", "imagePath", F.size("lines").cast("long").alias("n"), F.md5(F.array_join(F.transform("lines", lambda x: x["text"]), "\n")).alias("digest"))


@query("SELECT sha256('%PDF-' || n_name) AS upload_id, 'n' || n_nationkey || '.pdf' AS name, 5 + length(n_name) AS length FROM nation WHERE n_nationkey % 3 > 0")
def landing_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landing folder run through as a stream: refused uploads leave nothing, the others one outcome each, once."""
    folder, out, marks = (_folder(spark, x) for x in ("landing", "landed", "landing-marks"))
    content = F.concat(F.when(F.col("n_nationkey") % 3 > 0, "%PDF-").otherwise("PDF"), "n_name")
    S.write_books(table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".pdf")).alias("name"), _bytes(content).alias("content")), folder)
    for _ in range(2):  # the second run finds nothing new
        stream = L.once(L.accepted(L.arrivals(spark, folder)), "upload_id", ["path"], "path").where("first")
        L.converted(stream, lambda rows: rows, out, marks).awaitTermination()
    return spark.read.parquet(f"{out}/*").select("upload_id", "name", "length")


# ---- packed books -----------------------------------------------------------


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, path, content): a sound book for each region and market segment, its chapters the customers', with contents page and template."""
    customer = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    chapters = customer.select(F.concat_ws("-", F.col("n_regionkey").cast("string"), "c_mktsegment").alias("book_id"), "c_custkey", F.col("c_name").alias("title"))
    w = Window.partitionBy("book_id").orderBy("c_custkey")
    chapters = written(chapters.withColumn("chapter_no", F.row_number().over(w)).select("book_id", "chapter_no", "title", F.format_string("c%d", "chapter_no").alias("id"), F.format_string("t%d.xhtml", "chapter_no").alias("href")), "volume-chapters")
    books = chapters.groupBy("book_id").agg(F.count("*").alias("n"))
    row = lambda df, path, content: df.select("book_id", (F.lit(path) if isinstance(path, str) else path).alias("path"), _bytes(content).alias("content"))
    item = F.concat(F.lit('<item id="'), "id", F.lit('" href="'), "href", F.lit('" media-type="application/xhtml+xml"/>'))
    ref = F.concat(F.lit('<itemref idref="'), "id", F.lit('"/>'))
    point = F.concat(F.lit("<navPoint><navLabel><text/></navLabel><content src='"), "href", F.lit("'/></navPoint><navPoint><navLabel><text>"), X.escape_text(F.col("title")), F.lit("</text></navLabel><content src='"), "href", F.lit("'/></navPoint>"))
    lists = chapters.groupBy("book_id").agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_no", c.alias("v")))), lambda x: x["v"]), "").alias(n) for n, c in (("items", item), ("refs", ref), ("points", point))))
    opf = F.concat(F.lit('<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="2.0" unique-identifier="b"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>'), "book_id", F.lit('</dc:title><dc:identifier id="b">00000000-0000-7000-8000-000000000001</dc:identifier><dc:language>en</dc:language></metadata><manifest><item id="toc" href="contents.list" media-type="application/x-dtbncx+xml"/><item id="s" href="s.css" media-type="text/css"/><item id="pt" href="p.xpgt" media-type="application/vnd.adobe-page-template+xml"/><item id="c0" href="contents.xhtml" media-type="application/xhtml+xml"/>'), "items", F.lit('</manifest><spine toc="toc"><itemref idref="c0"/>'), "refs", F.lit("</spine></package>"))
    ncx = F.concat(F.lit('<?xml version="1.0"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><head><meta name="dtb:uid" content="x"/></head><navMap>'), "points", F.lit("</navMap></ncx>"))
    page = lambda body: F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><head><title>x</title><link rel="stylesheet" href="s.css"/><link rel="stylesheet" href="p.xpgt"/></head><body>'), body, F.lit("</body></html>"))
    files = row(books, "mimetype", "application/epub+zip")
    files = files.unionByName(row(books, "META-INF/container.xml", '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="a%20b/./package.xml" media-type="application/oebps-package+xml"/></rootfiles></container>'))
    files = files.unionByName(row(lists, "a b/package.xml", opf)).unionByName(row(lists, "a b/contents.list", ncx))
    files = files.unionByName(row(books, "a b/s.css", "p { margin: 0 }")).unionByName(row(books, "a b/p.xpgt", '<?xml version="1.0"?><t/>'))
    files = files.unionByName(row(books, "a b/contents.xhtml", page(F.lit('<p><a href="t1.xhtml">1</a></p>'))))
    return files.unionByName(row(chapters, F.concat(F.lit("a b/"), "href"), page(F.concat(F.lit('<p>🚀 <a href="contents.xhtml">up</a> '), X.escape_text(F.col("title")), F.lit("</p>")))))


_VOLUMES = "v AS (SELECT n_regionkey || '-' || c_mktsegment AS book_id, n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


def _pages_of(job: A.Job) -> DataFrame:
    """Per book: the chapter pages of its archive, and whether it is sound; errors of the others."""
    files = C.unpacked(job.archives, contents=False)
    pages = files.where(F.col("path").rlike(r"^OEBPS/\d+\.xhtml$")).groupBy("book_id").agg(F.count("*").alias("pages"))
    return pages.select("book_id", "pages", F.lit(None).cast("string").alias("error")).unionByName(job.errors.groupBy("book_id").agg(F.lit(0).cast("long").alias("pages"), F.min("error").alias("error")))


@query(f"WITH {_VOLUMES} SELECT book_id, n + 1 AS pages, NULL::VARCHAR AS error, 1 AS templates, n AS pictographs_found FROM v")
def healed_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books that are sound but for their style, healed: page template and all chapters stay."""
    job = A.healed(C.packed(_volumes(spark, sf_dir)))
    templates = C.unpacked(job.archives, contents=False).where("path like 'OEBPS/%.xpgt'").groupBy("book_id").agg(F.count("*").cast("int").alias("templates"))
    found = job.report.where("finding like '%pictographs taken out'").select("book_id", F.regexp_extract("finding", "^([0-9]+)", 1).cast("long").alias("pictographs_found"))
    return _pages_of(job).join(templates, "book_id").join(found, "book_id")


@query(f"WITH {_VOLUMES} SELECT book_id, n AS drawn, 1 AS pictures FROM v")
def drawn_pictographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with pictures in the place of pictographs."""
    pictures = spark.range(2).select(F.element_at(F.array(F.lit("🚀"), F.lit("🧠")), (F.col("id") + 1).cast("int")).alias("glyph"), F.unhex(F.lit("89504E470D0A1A0A")).alias("content"))
    job = A.healed(C.packed(_volumes(spark, sf_dir)), emoji="glyph", pictures=pictures, names={"🚀": "rocket"})
    files = written(C.unpacked(job.archives), "drawn")
    shown = files.where(F.col("path").rlike(r"^OEBPS/\d+\.xhtml$")).groupBy("book_id").agg(F.count_if(X.decoded_bytes(F.col("content")).contains('<img src="images/glyph-1f680.png" alt="rocket"')).alias("drawn"))
    return shown.join(files.where("path like 'OEBPS/images/%'").groupBy("book_id").agg(F.count("*").cast("int").alias("pictures")), "book_id")


@query(f"WITH {_VOLUMES} SELECT n_regionkey::VARCHAR AS book_id, sum(n)::BIGINT AS pages, NULL::VARCHAR AS error FROM v GROUP BY ALL")
def merged_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of a region as one book, without their contents pages."""
    volumes = written(C.packed(_volumes(spark, sf_dir)), "merge-volumes")
    members = volumes.select("book_id", F.substring_index("book_id", "-", 1).alias("new_id"), F.lit(1).alias("volume_ord"))
    return _pages_of(A.merged(volumes, members))


_RULES = ["", "not a zip file", "mimetype must be stored uncompressed", "mimetype must be the first file", "mimetype is missing or wrong", "META-INF/container.xml is missing", "the container names no package document", "the package document does not exist", "no manifest", "a manifest item needs id and href", "no spine", "an itemref needs an idref", "spine names an undeclared item: gone", "leaves the container: ../../x.css", "a b/s.css does not exist", "not-well-formed", "a b/t1.xhtml has no body", "gone.xhtml has no file", "%zz can''t be resolved", "Orphan file: a b/extra.txt", "late"]


@query("WITH v AS (SELECT c_custkey AS book_id FROM customer) SELECT book_id::VARCHAR AS book_id, e = '' AS success, CASE e WHEN '' THEN NULL WHEN 'late' THEN 'a b/t3.xhtml has no body' WHEN 'not-well-formed' THEN 'a b/t1.xhtml is not well-formed' ELSE e END AS error FROM (SELECT book_id, list_element([" + ", ".join(f"'{r}'" for r in _RULES) + f"], (book_id % {len(_RULES)} + 1)::INT) AS e FROM v)")
def book_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book for each customer, every one of which but some breaks one rule; the last breaks two, in its third and in its twelfth item."""
    rule = (F.col("c_custkey") % len(_RULES)).cast("int")
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("book_id"), rule.alias("rule"))
    is_ = lambda n: F.col("rule") == n
    row = lambda df, path, content: df.select("book_id", (F.lit(path) if isinstance(path, str) else path).alias("path"), _bytes(content).alias("content"))
    numbers = books.select("book_id", "rule", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("i"))
    items = "".join(f'<item id="i{i}" href="t{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(1, 13))
    head = '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="2.0"><metadata/>'
    tag = F.when(is_(8), "manifold").otherwise("manifest")
    css = F.when(is_(13), "../../x.css").otherwise("s.css")
    opf = F.concat(F.lit(head), F.lit("<"), tag, F.lit(">"), F.lit(items), F.lit('<item id="s" href="'), css, F.lit('" media-type="text/css"/>'), F.when(is_(9), '<item href="x"/>').otherwise(""), F.lit("</"), tag, F.lit(">"), F.when(is_(10), "").otherwise(F.concat(F.lit('<spine><itemref idref="i1"/>'), F.when(is_(11), "<itemref/>").when(is_(12), '<itemref idref="gone"/>').otherwise(""), F.lit("</spine>"))), F.lit("</package>"))
    files = row(books, "mimetype", F.when(is_(4), "application/zip").otherwise("application/epub+zip"))
    container = F.when(is_(6), "<container><rootfiles/></container>").when(is_(7), '<container><rootfiles><rootfile full-path="gone.opf"/></rootfiles></container>').otherwise('<container><rootfiles><rootfile full-path="x.pdf" media-type="x"/><rootfile full-path="a%20b/package.xml" media-type="application/oebps-package+xml"/></rootfiles></container>')
    files = files.unionByName(row(books.where("rule <> 5"), "META-INF/container.xml", container)).unionByName(row(books, "a b/package.xml", opf)).unionByName(row(books.where("rule not in (13, 14)"), "a b/s.css", "p {}")).unionByName(row(books.where("rule = 19"), "a b/extra.txt", "x"))
    first = F.col("i") == 1
    body = F.when(first & is_(17), '<body><a href="gone.xhtml">x</a></body>').when(first & is_(18), '<body><a href="%zz">x</a></body>').when((first & is_(16)) | (F.col("i").isin(3, 12) & is_(20)), "<p>x</p>").otherwise('<body><a href="t12.xhtml#a">x</a><a href="https://x.example/">y</a></body>')
    page = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><head><title>x</title></head>'), body, F.when(first & is_(15), "<p>").otherwise(""), F.lit("</html>"))
    packed = C.packed(files.unionByName(row(numbers, F.format_string("a b/t%d.xhtml", "i"), page))).join(books, "book_id")
    code = F.hex("content")
    broken = F.when(is_(1), _bytes("hello")).when(is_(2), F.unhex(F.concat(F.substring(code, 1, 16), F.lit("0800"), F.substring(code, F.lit(21), F.length(code))))).when(is_(3), F.unhex(F.concat(F.substring(code, 1, 60), F.lit("4D"), F.substring(code, F.lit(63), F.length(code))))).otherwise(F.col("content"))
    found = C.verdicts(written(packed.select("book_id", broken.alias("content")), "books"))
    return found.select("book_id", "success", F.regexp_replace("error", r"is not well-formed: .*", "is not well-formed").alias("error"))


@query("SELECT source AS book_id, count(*) AS pages, NULL::VARCHAR AS error, count(*) AS pictographs FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source")
def site_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web books: every text is a page of its source's book."""
    docs = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    chapters = docs.select(F.col("source").alias("book_id"), F.concat(F.lit("ch"), F.col("doc_id").cast("string"), F.lit(".html")).alias("name"), F.concat(F.lit("<nav><a href='q'>n</a></nav><h1>Page "), F.col("doc_id").cast("string"), F.lit("</h1><p>"), X.escape_text(F.col("text")), F.lit("</p>")).alias("html"))
    books = docs.select(F.col("source").alias("book_id")).distinct().select("book_id", F.concat(F.lit("Book "), "book_id").alias("title"), F.lit("en").alias("language"))
    job = A.sites(chapters, books, spark.createDataFrame([], "book_id string, name string, content binary"))
    lost = job.report.where("category = 'links'").groupBy("book_id").agg(F.sum("total").alias("pictographs"))
    return _pages_of(job).join(lost, "book_id")


@query(f"SELECT c.book_id, count(*) AS pages, NULL::VARCHAR AS error FROM ({_CHAPTERS}) c GROUP BY c.book_id")
def scanned_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned books from the lines of all texts, with plates for pages of few characters."""
    # pages aren't written: lines meet by book, and all of the job that follows finds them there
    lines = ocr_lines(spark, sf_dir, O.line_graphemes().alias("n"))
    at = F.struct("line_no", "text", "x", "y", "width", "height")
    pages = lines.groupBy("book_id", "page_no").agg(F.array_sort(F.collect_list(at)).alias("lines"), O.page_kind(F.sum("n")).alias("kind"))
    name = F.format_string("page_%d.jpeg", F.col("page_no") + 1)
    pages = pages.select("book_id", F.col("page_no").alias("pageIndex"), F.col("kind").alias("type"), F.when(F.col("kind") == "image", F.concat(F.lit("images/"), name)).alias("imagePath"), F.transform("lines", lambda x: F.struct(x["text"].alias("text"), x["x"].alias("x"), x["y"].alias("y"), x["width"].alias("width"), x["height"].alias("height"))).alias("lines"))
    images = written(pages.where("type = 'image'").select("book_id", F.substring_index("imagePath", "/", -1).alias("name"), F.unhex(F.lit("FFD8FF")).alias("content")), "scan-plates")
    books = table(spark, sf_dir, "documents").where("text is not null").select(ocr_book()).distinct().withColumn("title", F.concat(F.lit("Scan "), "book_id"))
    return _pages_of(A.scanned(pages, books, images))


@query("SELECT n_regionkey::VARCHAR AS book_id, 1 + count(*) FILTER (n_nationkey % 4 > 0) + count(*) FILTER (n_nationkey % 4 IN (2, 3)) - 1 AS pages, NULL::VARCHAR AS error, list(n_name || '.md' ORDER BY n_name) FILTER (n_nationkey % 4 = 0) AS nothing FROM nation GROUP BY ALL")
def markdown_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as markdown books of a file for each nation: nothing in it, a chapter, a preamble and a chapter, or a preamble and one below a quote."""
    k = F.col("n_nationkey") % 4
    front = F.concat(F.lit("---\ntitle: Region "), F.col("n_regionkey").cast("string"), F.lit("\nlang: en\n---\n"))
    body = F.when(k == 0, "").when(k == 1, "# One\n\ntext\n").when(k == 2, "before\n\n# Two\n").otherwise("> quoted\n\n# Three\n\n- a\n- b\n")
    files = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("book_id"), F.concat("n_name", F.lit(".md")).alias("file"), F.concat(front, body).alias("source"))
    books = written(bookmd.together(files), "together")
    job = A.markdown(books, spark.createDataFrame([], "book_id string, name string, content binary"))
    return _pages_of(job).join(books.select("book_id", F.when(F.size("nothing") > 0, F.col("nothing")).alias("nothing")), "book_id")


@query("SELECT p_partkey::VARCHAR AS book_id, [p_type, 'Second'] AS titles, [1, 2] AS levels, [p_name || ' [l](' || p_size || '.html)', 'Inside', 'quoted', 'one', 'two'] AS texts, ['x ' || p_size || '.png'] AS hrefs, ['A plate'] AS alts, [p_size || '.html'] AS links, p_name AS payload_title, p_name AS payload_text FROM part")
def markdown_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every conversion of a markdown book must keep, as columns and as JSON."""
    size = F.col("p_size").cast("string")
    source = F.concat(F.lit("---\ntitle: "), "p_name", F.lit("\n---\n\n# "), "p_type", F.lit("\n\n"), "p_name", F.lit(" [l]("), size, F.lit(".html)\n\n> ### Inside\n> quoted\n\n* one\n* two\n\n![[x "), size, F.lit(".png|A plate]]\n\n```\n# code\n```\n\n## Second\n"))
    found = bookmd.data_columns(bookmd.parsed(spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("book_id"), source.alias("source"))))
    payload = lambda path: F.get_json_object("payload", path)
    return found.select("book_id", "titles", "levels", "texts", F.col("images.href").alias("hrefs"), F.col("images.alt").alias("alts"), "links", payload("$.metadata.title").alias("payload_title"), F.regexp_extract(payload("$.texts[0]"), r"^(.*) \[l\]", 1).alias("payload_text"))
