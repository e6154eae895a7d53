import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import names as N
from quire.functions import text as X
from quire.functions import trees as T
from quire.operators import titles as Ti


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).collect()[0].x


@pytest.mark.parametrize("raw, want", [("🌊 潮汐表", "潮汐表"), ("看海 🌙 的人", "看海 的人"), ("※◦\U00020bb7", "※◦\U00020bb7"), ("a 🚀 🧠b", "a b"), ("x🚀y", "xy"), ("🚀", ""), ("", ""), ("a 🚀 b", "a  b"), ("a 👁️　b", "a b")])
def test_pictographs(spark, raw, want):
    assert one(spark, raw, X.strip_pictographs) == want
    assert T.without_pictographs(raw)[0] == want


def test_pictographs_in_column_and_tree_agree(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", " ", "　", "🚀", "🧠️", "b", "\n"]) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.strip_pictographs(F.col("t")).alias("x")).collect()
    assert not [(r.t, r.x) for r in got if T.without_pictographs(r.t)[0] != r.x]


def test_escapes_and_sizes(spark):
    assert one(spark, "a & b < c > d", X.escape_text) == "a &amp; b &lt; c &gt; d"
    assert one(spark, 'say "hi" & <bye>', X.escape_attribute) == "say &quot;hi&quot; &amp; &lt;bye&gt;"
    assert [one(spark, n, X.byte_size, "long") for n in (5, 2048, 3 << 20)] == ["5 B", "2 KB", "3.00 MB"]
    assert one(spark, " 　x y　", X.collapse) == "x y"
    assert one(spark, "🚀", X.code_point_label) == "U+1F680"
    assert one(spark, "OCR on page 3/4", X.progress_percent) == 73
    assert one(spark, None, X.escape_text) is None


def test_paths(spark):
    df = spark.createDataFrame([("a/b/", "../c.png", "a/c.png"), ("a/", "../../x", None), ("", "./y", "y"), ("a/", "/z", None), ("a/", "b//c", "a/b/c")], "d string, p string, want string")
    assert not [r for r in df.select("*", N.resolved(F.col("d"), F.col("p")).alias("x")).collect() if r.x != r.want]


def test_references(spark):
    kinds = {"": "empty", "#a": "fragment", "//h/x": "host", "mailto:x": "scheme", "a.html#b": "internal", "a:b": "scheme"}
    for raw, kind in kinds.items():
        assert one(spark, raw, N.reference_kind) == kind
    assert one(spark, "a+b%20c", N.decoded) == "a+b c"
    assert one(spark, "%zz", N.decoded) is None
    assert one(spark, "a/../b", N.encoded) is None
    assert one(spark, "第1話 [修].xhtml", N.encoded) == "%E7%AC%AC1%E8%A9%B1%20%5B%E4%BF%AE%5D.xhtml"
    assert one(spark, "images/a%20b.png", N.image_file) == "a b.png"
    assert one(spark, "../x/a.png", N.image_file) is None
    assert [one(spark, u, N.unloadable) for u in ("res:///x", "'http://a'", "data:font/x", "//h/x", "a.otf", "")] == [True, True, False, True, False, False]
    assert one(spark, "a-b c!.PNG", N.resource_name) == "a-b-c.png"
    assert one(spark, '書"', N.download_header) == "attachment; filename=\"_.epub\"; filename*=UTF-8''%E6%9B%B8%22.epub"


TITLES = {"The House of Reeds": ["The House of", "Reeds"], "West to East": ["West to", "East"], "Mend Torn Old Nets": ["Mend", "Torn", "Old", "Nets"], "Walking, Slow and Far": ["Walking,", "Slow and", "Far"], "Lichens": None, "海邊筆記：潮汐": ["海邊筆記", "潮汐"], "雨——傘": ["雨", "傘"], "霧：": None}


def test_titles(spark):
    df = spark.createDataFrame(list(enumerate(TITLES)), "title_id int, title string")
    got = {r.title_id: r.lines for r in Ti.set_titles(df).collect()}
    assert [got[k] for k in range(len(TITLES))] == list(TITLES.values())
    friends = spark.createDataFrame([(1, "How to Win Friends and Influence People")], "title_id int, title string")
    assert len(Ti.set_titles(friends, 3).collect()[0].lines) == 3


def test_entities_and_doctype():
    old = '<?xml version="1.0"?>\n<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.1//EN" "x"><p>a&nbsp;&mdash;&amp;</p>'
    assert T.modern_doctype(old) == '<?xml version="1.0"?>\n<!DOCTYPE html><p>a&#160;&#8212;&amp;</p>'
    with pytest.raises(ValueError):
        T.numeric_entities("&notarealentity;")
    assert T.literal_refs("&#x6d3b;&#38;&#60;") == "活&#38;&#60;"
    assert T.plain_refs("&amp;&nbsp;&#65;") == "&&nbsp;A"


def test_stylesheets():
    css = "@font-face { font-family: 'X'; src: url(res:///f.ttf); }\nbody{-epub-writing-mode:vertical-rl}"
    out, dropped = T.healed_stylesheet(css)
    assert "font-face" not in out and "vertical-rl" in out and len(dropped) == 1
    keep = "@font-face { src: url(fonts/a.otf) } p { background: url('data:x'); } q { background: url(i.png); }"
    assert T.healed_stylesheet(keep) == (keep, [])
    out, dropped = T.healed_stylesheet("p { background: url(https://x/y.png); color:#000; }")
    assert "https" not in out and "color:#000;" in out and dropped


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pbidv \"='&;ah", max_size=60))
def test_any_markup_becomes_well_formed(source):
    from xml.etree import ElementTree

    out = T.serialised(T.parsed(source))
    ElementTree.fromstring(out)
    assert re.match("<html", out)


def test_long_runs_are_read_once(spark):
    """A matcher that recurses once a repeat, or begins anew at every blank, would not come back from these."""
    n = 1_000_000
    df = spark.createDataFrame([(0, "a " + "🚀" * n + " b"), (1, "a" + " " * n + "b"), (2, "🚀 " * 100_000 + "x"), (3, " " * n)], "k int, t string")
    got = {r.k: (r.stripped, r.trimmed) for r in df.select("k", X.strip_pictographs(F.col("t")).alias("stripped"), F.length(X.trim(F.col("t"))).alias("trimmed")).collect()}
    assert got[0][0] == "a b" and got[1] == ("a" + " " * n + "b", n + 2) and got[2][0] == "x" and got[3][1] == 0


def test_byte_sizes_round_halves_to_even(spark):
    # 131,072 x 1,013 bytes are 126.625 MB: the formatter's half up made 126.63 of it
    sizes = [131072 * 1013, 393216 * 1013, *(k * (1 << 17) for k in range(8, 40)), (1 << 20) - 1, (2 << 20) - 1, 1023, 1024, 1535, 1536, 10**15 + 7]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", X.byte_size(F.col("n")).alias("size")).collect()
    for n, size in rows:
        assert size == (f"{n / (1 << 20):.2f} MB" if n >= 1 << 20 else f"{int(n / 1024 + 0.5)} KB" if n >= 1024 else f"{n} B")


def test_graphemes_of_plain_text_are_its_characters(spark):
    texts = ["", "abc", "a\r\nb", "\r\r\n\n", "e\u0301x", "\x00\x7f\t", "👩‍🚀!", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(X.graphemes(F.col("t")).alias("n")).collect()] == [0, 3, 3, 3, 2, 3, 2, None]
