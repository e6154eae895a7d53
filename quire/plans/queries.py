"""Queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import names as N
from quire.functions import text as X
from quire.operators import books as B
from quire.operators import ocr as O
from quire.operators import titles as Ti
from quire.plans import documents as D
from quire.sources.session import written
from quire.plans.inputs import OCR_LINES, PAGE_LINKS, PAGE_TITLES, SPACE, ocr_lines, page_links, page_titles, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def esc(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def esc_attr(c: str) -> str:
    return f"""replace({esc(c)}, '"', '&quot;')"""


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


# ---- text -------------------------------------------------------------------


@query(f"SELECT doc_id, md5({esc('text')}) AS text_digest, md5({esc_attr('text')}) AS attribute_digest, length({esc_attr('text')}) AS n FROM documents")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = X.escape_text(F.col("text")), X.escape_attribute(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(a).alias("text_digest"), F.md5(b).alias("attribute_digest"), F.length(b).cast("long").alias("n"))


_P = r"(?:[\x{1F000}-\x{1FAFF}]\x{FE0F}?)+"


_AROUND = "'🚀 ' || replace(text, chr(10), ' 🧠🧠️ ' || chr(10)) || '👁' || text || '　📊'"


@query(f"SELECT doc_id, md5(replace(regexp_replace(regexp_replace(t, '({SPACE}){SPACE}*{_P}{SPACE}+|{SPACE}*{_P}{SPACE}*', chr(57344) || '\\1' || chr(57345), 'g'), chr(57344) || '{SPACE}' || chr(57345), ' ', 'g'), chr(57344) || chr(57345), '')) AS digest, len(regexp_extract_all(t, '[\\x{{1F000}}-\\x{{1FAFF}}]\\x{{FE0F}}?')) AS n FROM (SELECT doc_id, {_AROUND} AS t FROM documents)")
def strip_pictographs_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("🚀 "), F.replace("text", F.lit("\n"), F.lit(" 🧠🧠️ \n")), F.lit("👁"), "text", F.lit("　📊"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.strip_pictographs(t)).alias("digest"), X.count_pictographs(t).cast("long").alias("n"))


@query("SELECT source, list_sort(list_distinct(flatten(list([p1, p2])))) AS glyphs, count(*) AS n FROM (SELECT source, chr(128512 + (doc_id % 50)::INT) AS p1, chr(128640 + (doc_id % 30)::INT) AS p2 FROM documents) GROUP BY source")
def book_pictographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    glyph = lambda base, mod: F.decode(F.unhex(F.lpad(F.hex(F.lit(base) + F.col("doc_id") % mod), 8, "0")), "UTF-32")
    t = F.concat(F.lit("x "), glyph(128512, 50), F.lit("️ y "), glyph(128640, 30))
    found = docs.select("source", F.explode(X.pictographs(t)).alias("g"), "doc_id")
    return found.groupBy("source").agg(F.array_sort(F.collect_set("g")).alias("glyphs"), F.count_distinct("doc_id").alias("n"))


@query("SELECT doc_id, length_grapheme(text)::BIGINT AS graphemes, length(text)::BIGINT AS code_points FROM documents")
def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.graphemes(F.col("text")).cast("long").alias("graphemes"), F.length("text").cast("long").alias("code_points"))


@query(f"SELECT doc_id, md5(regexp_replace(t, '{SPACE}', '', 'g')) AS key, md5({sql_trim(f'''regexp_replace(t, '{SPACE}+', ' ', 'g')''')}) AS flat FROM (SELECT doc_id, '　' || text || chr(160) || ' ' AS t FROM documents)")
def label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("　"), "text", F.lit("\xa0 "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.squeeze(t)).alias("key"), F.md5(X.collapse(t)).alias("flat"))


@query("SELECT p_partkey, replace(url_encode(p_name || ' & (100%) é+ö'), '%28', '(').replace('%29', ')') AS coded, p_name || ' & (100%) é+ö' AS back FROM part")
def href_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = N.encoded(F.concat("p_name", F.lit(" & (100%) é+ö")))
    return table(spark, sf_dir, "part").select("p_partkey", coded.alias("coded"), N.decoded(coded).alias("back"))


@query("SELECT o_orderkey, 'attachment; filename=\"' || t || '.epub\"; filename*=UTF-8''''' || replace(url_encode(t), '+', '%2B') || '.epub' AS header FROM (SELECT o_orderkey, o_orderpriority || ' ' || o_orderstatus AS t FROM orders)")
def download_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", N.download_header(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).alias("header"))


@query("SELECT event_id, 'U+' || lpad(upper(hex(unicode(event_type))), 4, '0') AS label, CASE WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0) WHEN n >= 1024 THEN floor(n / 1024.0 + 0.5)::INT || ' KB' ELSE n || ' B' END AS size, (25 + floor((event_id % 37)::DOUBLE / 37 * 65))::INT AS percent FROM (SELECT *, event_id * 1013 AS n FROM events)".replace("upper(hex(unicode(event_type)))", "printf('%X', unicode(event_type))"))
def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("OCR on page "), (F.col("event_id") % 37).cast("string"), F.lit("/37"))
    return table(spark, sf_dir, "events").select("event_id", X.code_point_label(F.col("event_type")).alias("label"), X.byte_size(F.col("event_id") * 1013).alias("size"), X.progress_percent(line).alias("percent"))


@query("SELECT l, CASE WHEN l LIKE 'ja%' THEN 'ja' WHEN l LIKE 'zh%' THEN 'zh-Hant' ELSE 'en' END AS locale, CASE WHEN l = 'fr' THEN 'vertical' ELSE 'horizontal' END AS layout, n FROM (SELECT lower(lang) AS l, count(*) AS n FROM documents GROUP BY ALL)")
def locales_and_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = table(spark, sf_dir, "documents").groupBy(F.lower("lang").alias("l")).agg(F.count("*").alias("n"))
    return langs.select("l", N.annotation_locale(F.col("l")).alias("locale"), N.layout_of(F.when(F.col("l") == "fr", "RTL").otherwise("ltr")).alias("layout"), "n")


@query("WITH f AS (SELECT p_partkey, replace(p_name, ' ', '_') || list_element(['.PNG', '.jpeg', '.css', '.xpgt', '.xhtml', '.txt', ''], (p_partkey % 7 + 1)::INT) AS name FROM part) SELECT p_partkey, name, CASE lower(regexp_extract(name, '[.][^.]*$')) WHEN '.png' THEN 'image/png' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.css' THEN 'text/css' WHEN '.xpgt' THEN 'application/vnd.adobe-page-template+xml' WHEN '.xhtml' THEN 'application/xhtml+xml' END AS media_type, lower(regexp_extract(name, '[.][^.]*$')) IN ('.png', '.jpeg') AS is_image FROM f")
def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = F.array(*map(F.lit, [".PNG", ".jpeg", ".css", ".xpgt", ".xhtml", ".txt", ""]))
    named = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.element_at(tails, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("name"))
    return named.select("p_partkey", "name", N.media_type(F.col("name")).alias("media_type"), N.is_image(F.col("name")).alias("is_image"))


# ---- scanned books ----------------------------------------------------------

_STOPS = "[。！？?」「”“.!]$"
_PARAS = f"""
k AS (SELECT *, avg(height) OVER (PARTITION BY book_id, page_no) AS mean FROM lines WHERE y BETWEEN 0.06 AND 0.94),
p AS (SELECT *, lag(text) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(height) OVER w AS ph FROM k WINDOW w AS (PARTITION BY book_id, page_no ORDER BY line_no)),
b AS (SELECT *, sum(CASE WHEN py - (y + height) > mean * 1.8 OR (regexp_matches({sql_trim('pt')}, '{_STOPS}') AND py - (y + height) > mean * 0.95) OR x - px > 0.05 OR greatest(ph, height) > mean * 1.45 AND ph IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, page_no ORDER BY line_no) AS para_no FROM p),
t AS (SELECT *, {sql_trim('text')} AS s FROM b),
j AS (SELECT *, lag(s) OVER (PARTITION BY book_id, page_no, para_no ORDER BY line_no) AS ps FROM t WHERE s <> ''),
paras AS (SELECT a.book_id, a.page_no, a.para_no, coalesce(x.text, '') AS text, a.n = 1 AND a.height > a.mean * 1.35 AND length_grapheme(coalesce(x.text, '')) < 40 AS is_heading
  FROM (SELECT book_id, page_no, para_no, count(*) AS n, max(height) AS height, first(mean) AS mean FROM b GROUP BY ALL) a
  LEFT JOIN (SELECT book_id, page_no, para_no, string_agg(CASE WHEN regexp_matches(ps, '[a-zA-Z0-9]$') AND regexp_matches(s, '^[a-zA-Z0-9]') THEN ' ' ELSE '' END || s, '' ORDER BY line_no) AS text FROM j GROUP BY ALL) x USING (book_id, page_no, para_no))
"""
_KINDS = "kinds AS (SELECT book_id, page_no, sum(length_grapheme(coalesce(text, '')))::BIGINT AS n_graphemes, CASE WHEN sum(length_grapheme(coalesce(text, ''))) < 120 THEN 'image' ELSE 'text' END AS kind FROM lines GROUP BY ALL)"


@query(f"WITH {OCR_LINES}, {_PARAS} SELECT book_id, page_no, para_no, md5(text) AS digest, length(text) AS n, is_heading FROM paras")
def ocr_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.paragraphs(ocr_lines(spark, sf_dir)).select("book_id", "page_no", "para_no", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"), "is_heading")


@query(f"WITH {OCR_LINES}, {_KINDS} SELECT * FROM kinds")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.page_kinds(ocr_lines(spark, sf_dir))


@query(f"WITH {OCR_LINES}, {_KINDS} SELECT book_id, count(*) AS pages, count(*) FILTER (kind = 'text') AS text_pages, count(*) FILTER (kind = 'image') AS image_pages, sum(n_graphemes)::BIGINT AS characters FROM kinds GROUP BY book_id")
def ocr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.summary(ocr_lines(spark, sf_dir))


@query(f"WITH {OCR_LINES}, {_KINDS} SELECT book_id, page_no, line_no, text FROM lines SEMI JOIN (SELECT book_id, min(page_no) AS page_no FROM kinds WHERE kind = 'text' GROUP BY book_id) f USING (book_id, page_no) QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY line_no) <= 14")
def ocr_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.preview(ocr_lines(spark, sf_dir)).select("book_id", "page_no", "line_no", "text")


@query(f"WITH {OCR_LINES}, s AS (SELECT *, lag(y) OVER w - y >= 0.015 AS step FROM lines WINDOW w AS (PARTITION BY book_id, page_no ORDER BY y DESC, x, line_no)), b AS (SELECT *, sum(coalesce(step, false)::INT) OVER (PARTITION BY book_id, page_no ORDER BY y DESC, x, line_no) AS band FROM s) SELECT book_id, page_no, md5(text) AS digest, (row_number() OVER (PARTITION BY book_id, page_no ORDER BY band, x, y DESC, line_no) - 1)::INT AS line_no FROM b")
def ocr_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.in_reading_order(ocr_lines(spark, sf_dir)).select("book_id", "page_no", F.md5("text").alias("digest"), F.col("line_no").cast("int").alias("line_no"))


_CHAPTERS = f"""
WITH {OCR_LINES}, {_PARAS}, {_KINDS},
st AS (SELECT book_id, page_no, para_no, text, is_heading, NULL AS image_path FROM paras SEMI JOIN (SELECT * FROM kinds WHERE kind = 'text') x USING (book_id, page_no)
  UNION ALL SELECT book_id, page_no, 0, NULL, false, 'images/page_' || (page_no + 1) || '.jpeg' FROM kinds WHERE kind = 'image' AND page_no > 0),
m AS (SELECT *, image_path IS NOT NULL AS plate, coalesce(lag(image_path IS NOT NULL) OVER w, false) AS after_plate, row_number() OVER w = 1 AS first, lag(page_no) OVER w AS plate_page FROM st WINDOW w AS (PARTITION BY book_id ORDER BY page_no, para_no)),
h AS (SELECT *, coalesce(NOT plate AND is_heading AND (regexp_matches(text, '章|第[一二三四五六]') OR contains(lower(text), 'chapter')) AND NOT after_plate AND NOT first, false) AS heads FROM m),
g AS (SELECT *, sum((plate OR after_plate OR heads)::INT) OVER (PARTITION BY book_id ORDER BY page_no, para_no) AS seg FROM h),
c AS (SELECT *, (row_number() OVER (PARTITION BY book_id, seg ORDER BY page_no, para_no) - 1) // 91 AS chunk FROM g),
f AS (SELECT book_id, seg, chunk, min_by(struct_pack(plate, after_plate, heads, text, page_no, plate_page), (page_no, para_no)) AS hd, count(*) FILTER (NOT plate) AS paragraphs, md5(coalesce(string_agg(text, chr(10) ORDER BY page_no, para_no), '')) AS digest FROM c GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY seg, chunk) AS no FROM f)
SELECT book_id, no::INT AS chapter_no, CASE WHEN hd.plate THEN 'image' ELSE 'text' END AS kind, CASE WHEN hd.plate THEN '插圖 (頁 ' || (hd.page_no + 1) || ')' WHEN chunk > 0 THEN '第 ' || no || ' 部分 (頁 ' || (hd.page_no + 1) || ')' WHEN hd.after_plate THEN '第 ' || no || ' 部分 (頁 ' || (hd.plate_page + 1) || ')' WHEN hd.heads THEN hd.text ELSE '前言 / 開始閱讀' END AS title, paragraphs, digest FROM n
"""


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ocr_lines(spark, sf_dir)
    kinds = O.page_kinds(lines)
    paras = O.paragraphs(lines).join(kinds.where("kind = 'text'"), ["book_id", "page_no"], "left_semi")
    plates = kinds.where("kind = 'image'").select("book_id", "page_no", F.format_string("images/page_%d.jpeg", F.col("page_no") + 1).alias("image_path"))
    return O.chapters(paras, plates)


@query(_CHAPTERS)
def ocr_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array_join(F.transform("paragraphs", lambda p: p["text"]), "\n")
    return _chapters(spark, sf_dir).select("book_id", "chapter_no", "kind", "title", F.size("paragraphs").cast("long").alias("paragraphs"), F.md5(texts).alias("digest"))


@query(f"WITH {OCR_LINES}, {_PARAS} SELECT book_id, page_no, md5('<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<!DOCTYPE html>' || chr(10) || '<html xmlns=\"http://www.w3.org/1999/xhtml\" xml:lang=\"zh-Hant\" lang=\"zh-Hant\">' || chr(10) || '<head>' || chr(10) || '  <meta charset=\"UTF-8\" />' || chr(10) || '  <title>' || {esc('book_id')} || '</title>' || chr(10) || '  <link rel=\"stylesheet\" href=\"style.css\" type=\"text/css\" />' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '  <h1>' || {esc('book_id')} || '</h1>' || chr(10) || '  <hr />' || chr(10) || string_agg(CASE WHEN is_heading THEN '  <h2>' || {esc('text')} || '</h2>' ELSE '  <p>' || {esc('text')} || '</p>' END, chr(10) ORDER BY para_no) || chr(10) || '</body>' || chr(10) || '</html>') AS digest FROM paras GROUP BY book_id, page_no")
def chapter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = O.paragraphs(ocr_lines(spark, sf_dir))
    rows = paras.groupBy("book_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("para_no", "text", "is_heading"))).alias("p"))
    return rows.select("book_id", "page_no", F.md5(D.chapter_page(F.col("book_id"), F.col("p"), F.lit("style.css"), F.lit("zh-Hant"))).alias("digest"))


# ---- web pages --------------------------------------------------------------

_KIND = r"CASE WHEN raw = '' THEN 'empty' WHEN raw LIKE '#%' THEN 'fragment' WHEN raw LIKE '//%' THEN 'host' WHEN regexp_matches(raw, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN 'scheme' ELSE 'internal' END"


@query(f"WITH {PAGE_LINKS} SELECT doc_path, ord::INT AS ord, raw, {_KIND} AS kind, split_part(raw, '#', 1) AS target, substr(raw, length(split_part(raw, '#', 1)) + 1) AS fragment FROM links")
def link_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    return page_links(spark, sf_dir).select("doc_path", "ord", "raw", N.reference_kind(raw).alias("kind"), N.target(raw).alias("target"), N.fragment(raw).alias("fragment"))


@query(f"WITH {PAGE_LINKS} SELECT book_id, doc_path, ord::INT AS ord, regexp_replace(split_part(raw, '#', 1), '^/', '') AS path FROM links WHERE {_KIND} = 'internal' AND raw LIKE '/%' ANTI JOIN_MARK".replace(" ANTI JOIN_MARK", " AND NOT EXISTS (FROM pages WHERE page_id // 100 = book_id AND 'p' || page_id = regexp_replace(split_part(raw, '#', 1), '^/', ''))"))
def internal_targets_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sites write absolute paths: as a container they lie beside the pages
    links = page_links(spark, sf_dir).where("raw like '/%' and raw not like '//%'")
    relative = links.withColumn("doc_path", F.concat(F.lit("./"), "doc_path")).withColumn("raw", F.regexp_replace("raw", "^/", "../"))
    files = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 100).cast("long").alias("book_id"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"))
    return B.dangling(relative, files).select("book_id", F.regexp_replace("doc_path", r"^\./", "").alias("doc_path"), "ord", "path")


@query(f"WITH {PAGE_TITLES} SELECT page_id, title FROM titles")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_titles(spark, sf_dir).select("page_id", "title")


#: The SQL's largest number; those beyond it come last, by name.
_HUGEINT = (1 << 127) - 1


@query("SELECT page_id, url, CASE WHEN d <> '' THEN row_number() OVER (PARTITION BY site, d = '' ORDER BY TRY_CAST(d AS HUGEINT), b) END AS place, CASE WHEN d = '' THEN 'no number' END AS error FROM (SELECT *, regexp_extract(b, '([0-9]+)', 1) AS d, regexp_extract(url, '^https?://([^/]+)', 1) AS site FROM (SELECT *, regexp_extract(url, '[^/]*$') AS b FROM pages))")
def chapter_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: those whose name has no number are errors and have no place. Pages of a site with equal names, whose order the SQL leaves open, go by page_id."""
    name = N.basename(F.col("url"))
    number = F.regexp_extract(name, r"(\d+)", 1)
    site = Window.partitionBy(F.regexp_extract("url", "^https?://([^/]+)", 1), number == "").orderBy(N.number_key(number, _HUGEINT).asc_nulls_last(), name, "page_id")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.when(number != "", F.row_number().over(site)).cast("long").alias("place"), F.when(number == "", "no number").alias("error"))


# ---- titles -----------------------------------------------------------------

_WEAK = "[" + ", ".join(f"'{w}'" for w in X.WEAK_WORDS) + "]"


@query(f"WITH {PAGE_TITLES}, t AS (SELECT 'page-' || page_id AS title_id, title FROM titles UNION ALL SELECT 'part-' || p_partkey, p_name FROM part), w AS (SELECT title_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM (SELECT title_id, regexp_split_to_array({sql_trim('title')}, '{SPACE}+') AS ws FROM t)), g AS (SELECT *, greatest(sum((NOT list_contains({_WEAK}, lower(regexp_replace(word, '[^\\p{{L}}\\p{{N}}]', '', 'g'))))::INT) OVER (PARTITION BY title_id ORDER BY i), 1)::BIGINT AS line_no FROM w WHERE word <> '') SELECT title_id, line_no, string_agg(word, ' ' ORDER BY i) AS line FROM g GROUP BY ALL")
def title_lines_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string")).alias("title_id")
    pages = page_titles(spark, sf_dir).select(named("page-", "page_id"), "title")
    return Ti.title_lines(pages.unionByName(table(spark, sf_dir, "part").select(named("part-", "p_partkey"), F.col("p_name").alias("title"))))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE [split_part(p_name, ' ', 1), p_type] END AS parts, CASE WHEN p_partkey % 3 = 1 THEN p_name ELSE '上下' END AS merged FROM part")
def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.substring_index("p_name", " ", 1)
    k = F.col("p_partkey") % 3
    title = F.when(k == 0, F.concat(head, F.lit(" ："), "p_type")).when(k == 1, F.concat(head, F.lit("——　"), "p_type")).otherwise(F.concat(head, F.lit("：")))
    merged = Ti.merged_title(F.when(k == 1, F.concat("p_name", F.lit("十二"))).otherwise(F.concat(F.lit("上下"), (F.col("p_partkey")).cast("string"))))
    return table(spark, sf_dir, "part").select("p_partkey", Ti.subtitle_split(title).alias("parts"), F.when(k == 1, F.col("p_name")).otherwise(merged).alias("merged"))


# ---- books ------------------------------------------------------------------


@query(f"WITH {PAGE_TITLES} SELECT book_id, regexp_replace(title, '{SPACE}', '', 'g') AS key, min('p' || page_id) AS href FROM titles WHERE regexp_replace(title, '{SPACE}', '', 'g') <> '' GROUP BY ALL HAVING count(DISTINCT page_id) = 1")
def label_map_unambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.unambiguous_labels(page_titles(spark, sf_dir).select("book_id", F.col("title").alias("label"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("href")))


_LINES = f"l AS (SELECT source AS book_id, 'd' || doc_id AS doc_path, regexp_replace(unnest(string_split(text, chr(10))), '{SPACE}', '', 'g') AS key FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_LINES}, k AS (SELECT book_id, key FROM l WHERE key <> '' GROUP BY ALL HAVING count(DISTINCT doc_path) > 1), s AS (SELECT book_id, doc_path, count(*) AS lines, count(*) FILTER ((book_id, key) IN (SELECT (book_id, key) FROM k)) AS m FROM l WHERE key <> '' GROUP BY ALL) SELECT book_id, doc_path, lines, CASE WHEN lines >= 3 THEN m ELSE 0 END AS matched, round((CASE WHEN lines >= 3 THEN m ELSE 0 END)::DOUBLE / lines, 9) AS share, lines >= 3 AND m::DOUBLE / lines >= 0.8 AS is_contents FROM s")
def contents_page_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select(F.col("source").alias("book_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_path"), F.explode(F.split("text", "\n")).alias("line"))
    # a line moves as the digest of its key, which is made once
    keyed = written(lines.withColumn("key", X.squeeze(F.col("line"))).where("key <> ''").select("book_id", "doc_path", F.unhex(F.md5("key")).alias("key")), "line-keys")
    labels = keyed.distinct().groupBy("book_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    return B.contents_pages(keyed, labels).withColumn("share", F.round("share", 9))


@query("SELECT source AS book_id, sha256(text) AS digest, min_by('d' || doc_id, doc_id) AS path, min(doc_id) AS ord, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def content_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pooled(_resources(spark, sf_dir))


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(F.col("source").alias("book_id"), F.col("doc_id").alias("ord"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


@query("SELECT source AS book_id, count(DISTINCT text) AS contents, min_by('d' || doc_id, doc_id) AS first_path FROM documents WHERE text IS NOT NULL GROUP BY source HAVING count(DISTINCT text) > 1")
def singleton_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.more_than_one(_resources(spark, sf_dir))


@query("SELECT lang || '-' || doc_id // 100 AS book_id, doc_id, (row_number() OVER w)::INT AS chapter_no, (row_number() OVER w) || '.xhtml' AS href, printf('chapter%02d', row_number() OVER w) AS chapter_id, (row_number() OVER w)::INT AS play_order FROM documents WINDOW w AS (PARTITION BY lang, doc_id // 100 ORDER BY source, doc_id)")
def merged_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.numbered(table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("-"), F.floor(F.col("doc_id") / 100).cast("string")).alias("book_id"), "doc_id", "source"), ["source", "doc_id"]).drop("source")


@query("WITH b AS (SELECT p_brand AS book_id, p_partkey AS ord, CASE WHEN regexp_matches(h, '^[A-Za-z_]') THEN h ELSE 'id-' || h END AS base FROM (SELECT *, regexp_replace(CASE WHEN p_partkey % 2 = 0 THEN p_size || ' ' ELSE '' END || split_part(p_name, ' ', 1), '[^A-Za-z0-9_.-]', '-', 'g') AS h FROM part)) SELECT book_id, ord, base, base || CASE WHEN row_number() OVER w > 1 THEN '-' || row_number() OVER w ELSE '' END AS name FROM b WINDOW w AS (PARTITION BY book_id, base ORDER BY ord)")
def manifest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" "))).otherwise(""), F.substring_index("p_name", " ", 1))
    items = table(spark, sf_dir, "part").select(F.col("p_brand").alias("book_id"), F.col("p_partkey").alias("ord"), N.manifest_id(hint).alias("base"), F.lit("").alias("tail"))
    return B.unique_names(items).drop("tail")


def _shelf(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books, chapters and images after nations, customers and suppliers."""
    nation = table(spark, sf_dir, "nation")
    text = lambda c: c.cast("string")
    odd = F.col("n_nationkey") % 2 == 1
    books = nation.select(F.col("n_nationkey").alias("book_id"), F.when(odd, "3.0").otherwise("2.0").alias("version"), F.concat(F.lit("The <Book> of "), "n_name").alias("title"), F.concat(F.lit("A & "), "n_name").alias("creator"), F.when(F.col("n_nationkey") % 3 == 0, "T").alias("translator"), F.lit("en").alias("language"), F.format_string("00000000-0000-4000-8000-%012d", "n_nationkey").alias("uuid"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("modified"), F.when(odd, "rtl").otherwise("").alias("direction"), F.when(F.col("n_nationkey") % 5 == 0, "images/cover.jpg").otherwise("").alias("cover"), F.lit("style.css").alias("css"))
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    chapters = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("book_id"), F.row_number().over(w).alias("chapter_no"), F.concat(F.lit("c"), text(F.col("c_custkey"))).alias("id"), F.concat(text(F.row_number().over(w)), F.lit(".xhtml")).alias("href"), F.concat("c_mktsegment", F.lit(" & <"), "c_name", F.lit(">")).alias("title"))
    images = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("book_id"), F.col("s_suppkey").cast("int").alias("ord"), F.concat(F.lit("s"), text(F.col("s_suppkey")), F.lit(".png")).alias("name"))
    return books, chapters, images


_SHELF = """
books AS (SELECT n_nationkey AS book_id, CASE WHEN n_nationkey % 2 = 1 THEN '3.0' ELSE '2.0' END AS version, 'The <Book> of ' || n_name AS title, 'A & ' || n_name AS creator, CASE WHEN n_nationkey % 3 = 0 THEN 'T' END AS translator, printf('00000000-0000-4000-8000-%012d', n_nationkey) AS uuid, CASE WHEN n_nationkey % 2 = 1 THEN 'rtl' ELSE '' END AS direction, CASE WHEN n_nationkey % 5 = 0 THEN 'images/cover.jpg' ELSE '' END AS cover FROM nation),
chapters AS (SELECT c_nationkey AS book_id, row_number() OVER w AS chapter_no, 'c' || c_custkey AS id, (row_number() OVER w) || '.xhtml' AS href, c_mktsegment || ' & <' || c_name || '>' AS title FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
items AS (SELECT book_id, 0 AS rank, 0 AS ord, 'cover-image' AS id, cover AS href, 'image/jpeg' AS media_type, CASE WHEN version = '3.0' THEN 'cover-image' END AS properties, false AS in_spine FROM books WHERE cover <> ''
 UNION ALL SELECT book_id, 1, 0, 'cover-xhtml', 'cover.xhtml', 'application/xhtml+xml', NULL, true FROM books WHERE cover <> ''
 UNION ALL SELECT book_id, 2, 0, 'css', 'style.css', 'text/css', NULL, false FROM books
 UNION ALL SELECT book_id, 3, 0, 'nav', 'nav.xhtml', 'application/xhtml+xml', 'nav', false FROM books WHERE version = '3.0'
 UNION ALL SELECT book_id, 4, chapter_no, id, href, 'application/xhtml+xml', NULL, true FROM chapters
 UNION ALL SELECT s_nationkey, 5, s_suppkey, 'img-s' || s_suppkey, 'images/s' || s_suppkey || '.png', 'image/png', NULL, false FROM supplier
 UNION ALL SELECT book_id, 9, 0, 'ncx', 'toc.ncx', 'application/x-dtbncx+xml', NULL, false FROM books)
"""


@query(f"WITH {_SHELF} SELECT book_id, rank, ord::INT AS ord, id, href, media_type, properties, in_spine FROM items")
def manifest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.package_items(*_shelf(spark, sf_dir))


_OPF = f"""
WITH {_SHELF}, m AS (SELECT book_id, string_agg('    <item id="' || id || '" href="' || href || '" media-type="' || media_type || '"' || CASE WHEN properties IS NULL THEN '' ELSE ' properties="' || properties || '"' END || '/>', chr(10) ORDER BY rank, ord, id) AS manifest, string_agg(CASE WHEN in_spine THEN '    <itemref idref="' || id || '"/>' END, chr(10) ORDER BY rank, ord, id) AS spine FROM items GROUP BY book_id)
SELECT book_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<package xmlns="http://www.idpf.org/2007/opf" unique-identifier="BookID" version="' || version || '">' || chr(10) || '  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">' || chr(10) ||
concat_ws(chr(10), '    <dc:title>' || {esc('title')} || '</dc:title>', CASE WHEN version = '2.0' THEN '    <dc:creator opf:role="aut">' || {esc('creator')} || '</dc:creator>' ELSE '    <dc:creator id="creator">' || {esc('creator')} || '</dc:creator>' || chr(10) || '    <meta refines="#creator" property="role" scheme="marc:relators">aut</meta>' END,
 CASE WHEN translator IS NULL THEN NULL WHEN version = '2.0' THEN '    <dc:contributor opf:role="trl">T</dc:contributor>' ELSE '    <dc:contributor id="translator">T</dc:contributor>' || chr(10) || '    <meta refines="#translator" property="role" scheme="marc:relators">trl</meta>' END,
 '    <dc:language>en</dc:language>', '    <dc:identifier id="BookID">urn:uuid:' || uuid || '</dc:identifier>', CASE WHEN version = '3.0' THEN '    <meta property="dcterms:modified">2024-01-02T03:04:05Z</meta>' END, CASE WHEN version = '2.0' AND cover <> '' THEN '    <meta name="cover" content="cover-image"/>' END, CASE WHEN direction = 'rtl' THEN '    <meta name="primary-writing-mode" content="horizontal-rl"/>' END)
|| chr(10) || '  </metadata>' || chr(10) || '  <manifest>' || chr(10) || manifest || chr(10) || '  </manifest>' || chr(10) || '  <spine toc="ncx"' || CASE WHEN direction <> '' THEN ' page-progression-direction="' || direction || '"' ELSE '' END || '>' || chr(10) || spine || chr(10) || '  </spine>' || chr(10) || '</package>' AS opf FROM books JOIN m USING (book_id)
"""


@query(_OPF)
def package_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.package_documents(*_shelf(spark, sf_dir))


@query(f"""WITH {_SHELF}, c AS (SELECT book_id, string_agg('    <navPoint id="navPoint-' || chapter_no || '" playOrder="' || chapter_no || '">' || chr(10) || '      <navLabel><text>' || {esc('title')} || '</text></navLabel>' || chr(10) || '      <content src="' || href || '"/>' || chr(10) || '    </navPoint>', chr(10) ORDER BY chapter_no) AS points, string_agg('      <li><a href="' || href || '">' || {esc('title')} || '</a></li>', chr(10) ORDER BY chapter_no) AS entries FROM chapters GROUP BY book_id)
SELECT book_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">' || chr(10) || '  <head>' || chr(10) || '    <meta name="dtb:uid" content="urn:uuid:' || uuid || '"/>' || chr(10) || '    <meta name="dtb:depth" content="1"/>' || chr(10) || '    <meta name="dtb:totalPageCount" content="0"/>' || chr(10) || '    <meta name="dtb:maxPageNumber" content="0"/>' || chr(10) || '  </head>' || chr(10) || '  <docTitle>' || chr(10) || '    <text>' || {esc('title')} || '</text>' || chr(10) || '  </docTitle>' || chr(10) || '  <navMap>' || chr(10) || points || chr(10) || '  </navMap>' || chr(10) || '</ncx>' AS ncx,
'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<!DOCTYPE html>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="en" lang="en">' || chr(10) || '<head>' || chr(10) || '  <meta charset="UTF-8"/>' || chr(10) || '  <title>' || {esc('title')} || '</title>' || chr(10) || '  <link rel="stylesheet" type="text/css" href="style.css"/>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '  <nav epub:type="toc" id="toc">' || chr(10) || '    <h1>' || {esc('title')} || '</h1>' || chr(10) || '    <ol>' || chr(10) || entries || chr(10) || '    </ol>' || chr(10) || '  </nav>' || chr(10) || '</body>' || chr(10) || '</html>' AS nav FROM books JOIN c USING (book_id)""")
def ncx_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    books, chapters, _ = _shelf(spark, sf_dir)
    return D.contents_documents(books, chapters)


@query("SELECT n_nationkey AS book_id, 'no chapters' AS error FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey IS NOT NULL)")
def chapters_required_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all customers: nothing where every nation has some."""
    books = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("book_id"))
    return B.guards(books, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("book_id"))).select("book_id", F.lit("no chapters").alias("error"))


@query("SELECT book_id, 'no chapters' AS error FROM (SELECT 4 * n_nationkey + unnest(range(4)) AS book_id FROM nation) WHERE book_id NOT IN (SELECT 4 * c_nationkey + c_custkey * c_custkey % 4 FROM customer WHERE c_nationkey IS NOT NULL)")
def books_without_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four books a nation, with all customers as chapters: by the remainder of their squares, which is never 2 or 3."""
    books = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select((4 * F.col("n_nationkey") + F.col("k")).alias("book_id"))
    parts = table(spark, sf_dir, "customer").select((4 * F.col("c_nationkey") + F.col("c_custkey") * F.col("c_custkey") % 4).alias("book_id"))
    return B.guards(books, parts).select(F.col("book_id").cast("long").alias("book_id"), F.lit("no chapters").alias("error"))


@query("WITH d AS (SELECT source AS book_id, count(*) FILTER (doc_id % 11 = 0) AS legacy, count(*) FILTER (doc_id % 101 = 0) AS bodies, 0 AS pictographs, count(*) FILTER (doc_id % 7 = 0) AS links, count(*) FILTER (doc_id % 89 = 0) AS pages FROM documents GROUP BY source) SELECT book_id, 2::INT AS ord, legacy || ' chapter' || CASE WHEN legacy = 1 THEN '' ELSE 's' END || ' with an outdated document type' AS finding FROM d WHERE legacy > 0 UNION ALL SELECT book_id, 3, bodies || ' document' || CASE WHEN bodies = 1 THEN '' ELSE 's' END || ' whose content stands outside the body' FROM d WHERE bodies > 0 UNION ALL SELECT book_id, 5, links || ' lines of contents pages linked' FROM d WHERE links > 0 UNION ALL SELECT book_id, 6, pages || ' pages look like contents and stay unchanged' FROM d WHERE pages > 1 UNION ALL SELECT book_id, 0, 'EPUB 2.0 declares a reading direction, which that version doesn''t know' FROM d WHERE legacy % 2 = 1")
def repair_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = lambda n: F.count_if(F.col("doc_id") % n == 0)
    books = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("book_id")).agg(every(11).alias("legacy"), every(101).alias("bodies"), F.lit(0).alias("pictographs"), every(7).alias("links"), every(89).alias("contents_pages"))
    books = books.withColumns({"version": F.lit("2.0"), "page_direction": F.when(F.col("legacy") % 2 == 1, "rtl").otherwise(""), "identifier": F.lit("x"), "ncx_uid": F.lit("x")})
    return B.findings(books)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders, one for each number."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_shipdate", "l_returnflag")))


def _container(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as containers: their lines are files, some of them undeclared, some missing; the spine in line order."""
    lines = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("t"), F.col("l_linenumber").cast("string"), F.lit(".xhtml")).alias("path"), "l_partkey")
    files = lines.where("l_partkey % 13 <> 0").select("book_id", "path")
    manifest = lines.where("l_partkey % 17 <> 0").select("book_id", "ord", F.concat(F.lit("i"), F.col("ord").cast("string")).alias("id"), F.col("path").alias("href"), F.lit("application/xhtml+xml").alias("media_type"), F.when(F.col("l_partkey") % 19 == 0, "scripted nav").alias("properties"))
    spine = lines.select("book_id", "ord", F.concat(F.lit("i"), F.col("ord").cast("string")).alias("idref"))
    return files, manifest, spine


_CONTAINER = "l AS (SELECT l_orderkey AS book_id, l_linenumber AS ord, 't' || l_linenumber || '.xhtml' AS path, l_partkey FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_shipdate) AS l_shipdate, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)), files AS (SELECT book_id, path FROM l WHERE l_partkey % 13 <> 0), manifest AS (SELECT book_id, ord, 'i' || ord AS id, path AS href, l_partkey % 19 = 0 AS nav FROM l WHERE l_partkey % 17 <> 0)"


@query(f"WITH {_CONTAINER} SELECT book_id, id, href FROM manifest m WHERE NOT EXISTS (FROM files f WHERE f.book_id = m.book_id AND f.path = m.href)")
def manifest_files_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, manifest, _ = _container(spark, sf_dir)
    return B.missing_files(manifest, files).select("book_id", "id", "href")


@query(f"WITH {_CONTAINER} SELECT book_id, path FROM files f WHERE NOT EXISTS (FROM manifest m WHERE f.book_id = m.book_id AND f.path = m.href)")
def container_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, manifest, _ = _container(spark, sf_dir)
    return B.orphans(files, manifest).select("book_id", "path")


@query(f"WITH {_CONTAINER} SELECT book_id, ord, idref, href, CASE WHEN href IS NULL THEN 'spine names an undeclared item: ' || idref END AS error FROM (SELECT l.book_id, l.ord, 'i' || l.ord AS idref, m.href, coalesce(m.nav, false) AS nav FROM l LEFT JOIN manifest m ON m.book_id = l.book_id AND m.ord = l.ord) WHERE NOT nav QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY ord) > 1")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, manifest, spine = _container(spark, sf_dir)
    return B.reading_order(spine, manifest, drop_first=True).select("book_id", "ord", "idref", "href", "error")


@query("WITH n AS (SELECT l_orderkey AS book_id, 't' || (l_partkey % 4) AS path, l_linenumber AS ord, l_shipdate::DATE::VARCHAR AS label FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_shipdate) AS l_shipdate, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)) SELECT c.book_id, c.path, coalesce(f.label, '') AS label FROM (SELECT o_orderkey AS book_id, 't' || (o_custkey % 4) AS path FROM orders) c LEFT JOIN (SELECT book_id, path, min_by(label, ord) AS label FROM n GROUP BY ALL) f USING (book_id, path)")
def chapter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ncx = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("book_id"), F.concat(F.lit("t"), (F.col("l_partkey") % 4).cast("string"), F.lit("#a")).alias("src"), F.col("l_linenumber").alias("ord"), F.to_date("l_shipdate").cast("string").alias("label"))
    chapters = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book_id"), F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string")).alias("path"))
    return B.labelled(chapters, ncx).select("book_id", "path", "label")


@query("WITH r AS (SELECT o_orderkey AS book_id, 'a.xhtml' AS doc_path, (o_custkey % 100)::INT AS ord, list_element(['c1.xhtml', 'toc.xhtml', 'i.png', 's.css', 'x.bin', 'none.gif'], (o_orderkey % 6 + 1)::INT) AS path FROM orders) SELECT *, CASE path WHEN 'c1.xhtml' THEN '1.xhtml' WHEN 'toc.xhtml' THEN 'nav.xhtml' END AS href, CASE path WHEN 'i.png' THEN 'image' WHEN 's.css' THEN 'stylesheet' END AS resource, CASE path WHEN 'x.bin' THEN 'cannot be carried' WHEN 'none.gif' THEN 'missing' END AS error FROM r")
def carried_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = F.array(*map(F.lit, ["c1.xhtml", "toc.xhtml", "i.png", "s.css", "x.bin", "none.gif"]))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book_id"), F.lit("a.xhtml").alias("doc_path"), (F.col("o_custkey") % 100).cast("int").alias("ord"), F.element_at(paths, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("path"))
    own = lambda *names: orders.select("book_id", F.explode(F.array(*map(F.lit, names))).alias("path"))
    return B.carried(orders, own("c1.xhtml").withColumn("href", F.lit("1.xhtml")), own("toc.xhtml"), own("c1.xhtml", "toc.xhtml", "i.png", "s.css", "x.bin"))


@query("SELECT l_orderkey AS book_id, min_by(struct_pack(id := 'i' || l_linenumber, href := 'f' || l_partkey), CASE WHEN l_linenumber = 1 + o % 3 THEN 0 ELSE 1 END * 100 + l_linenumber).id AS id, min_by(struct_pack(id := 'i' || l_linenumber, href := 'f' || l_partkey), CASE WHEN l_linenumber = 1 + o % 3 THEN 0 ELSE 1 END * 100 + l_linenumber).href AS href FROM (SELECT *, l_orderkey AS o FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_shipdate) AS l_shipdate, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)) WHERE l_linenumber = 1 + o % 3 OR l_partkey % 5 = 0 GROUP BY l_orderkey")
def cover_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("i"), F.col("l_linenumber").cast("string")).alias("id"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("href"), F.when(F.col("l_partkey") % 5 == 0, "cover-image").alias("properties"))
    metadata = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book_id"), F.lit(0).alias("ord"), F.lit("cover").alias("name"), F.concat(F.lit("i"), (F.lit(1) + F.col("o_orderkey") % 3).cast("string")).alias("content"))
    return B.cover_item(manifest, metadata)


@query("SELECT l_orderkey AS container_id, min_by('p' || l_partkey, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 100 END + l_linenumber) AS path FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_shipdate) AS l_shipdate, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def rootfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("container_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), F.when(F.col("l_returnflag") == "R", "application/oebps-package+xml").otherwise("text/plain").alias("media_type"))
    return B.rootfile(rows)


@query("SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_left, b.k IS NOT NULL AS in_right FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def coverage_gaps_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.coverage(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_left, b.k IS NOT NULL AS in_right FROM (SELECT DISTINCT 2 * o_custkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT 3 * c_custkey AS k FROM customer) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def keys_on_one_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the customers of all orders against thrice all customers: what isn't divisible by six is on one side only."""
    return B.coverage(table(spark, sf_dir, "orders").select((2 * F.col("o_custkey")).alias("k")), table(spark, sf_dir, "customer").select((3 * F.col("c_custkey")).alias("k")), "k")


@query("(SELECT l_returnflag, l_linestatus, 'left' AS side FROM lineitem WHERE l_orderkey % 2 = 0 EXCEPT ALL SELECT l_returnflag, l_linestatus, 'left' FROM lineitem WHERE l_orderkey % 2 = 1) UNION ALL (SELECT l_returnflag, l_linestatus, 'right' FROM lineitem WHERE l_orderkey % 2 = 1 EXCEPT ALL SELECT l_returnflag, l_linestatus, 'right' FROM lineitem WHERE l_orderkey % 2 = 0)")
def parser_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    return B.differences(rows.where("l_orderkey % 2 = 0").drop("l_orderkey"), rows.where("l_orderkey % 2 = 1").drop("l_orderkey"))


@query("SELECT o_custkey, o_orderkey, count(*) AS n FROM (SELECT o_custkey, o_orderkey // 8 AS o_orderkey FROM orders) GROUP BY ALL HAVING count(*) > 1")
def duplicate_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.floor(F.col("o_orderkey") / 8).cast("long").alias("o_orderkey"))
    return B.duplicates(rows, "o_custkey", "o_orderkey")


@query("SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id, count(*) - 1 AS refused FROM events GROUP BY user_id")
def single_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.streaming.landing import claims

    return claims(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "refused")
