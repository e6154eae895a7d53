import random

from quire.operators import ocr as O

LINE = "book_id string, page_no int, line_no int, text string, x double, y double, width double, height double"


def lines(spark, rows):
    return spark.createDataFrame([("b", p, k, t, x, y, 0.5, h) for p, k, t, x, y, h in rows], LINE)


def test_furniture_goes_and_gaps_break(spark):
    rows = [(0, 0, "Running header", 0.1, 0.97, 0.02), (0, 1, "First line of paragraph one.", 0.1, 0.80, 0.03), (0, 2, "still paragraph one", 0.1, 0.76, 0.03), (0, 3, "Paragraph two begins here.", 0.1, 0.50, 0.03), (0, 4, "42", 0.1, 0.02, 0.02)]
    found = O.paragraphs(lines(spark, rows)).orderBy("para_no").collect()
    assert [r.text for r in found] == ["First line of paragraph one.still paragraph one", "Paragraph two begins here."]


def test_joins_by_script(spark):
    from pyspark.sql import functions as F

    from quire.functions.text import join_lines

    cases = [(["Hello", "World"], "Hello World"), (["你好", "世界"], "你好世界"), (["A", "", "B"], "A B"), (["價", "錢"], "價錢"), ([], ""), ([None, "x"], "x")]
    df = spark.createDataFrame([(a, b) for a, b in cases], "l array<string>, want string")
    assert not df.where(join_lines(F.col("l")) != F.col("want")).collect()


def test_astral_heading_counts_characters(spark):
    tall = [(0, 0, "\U00020000" * 25, 0.1, 0.9, 0.05), (0, 1, "plain text of the page", 0.1, 0.7, 0.02), (0, 2, "more of it", 0.1, 0.67, 0.02)]
    assert [r.is_heading for r in O.paragraphs(lines(spark, tall)).orderBy("para_no").collect()] == [True, False]


def brute_chapters(paras, plates):
    """Chapters of one book, one element at a time."""
    stream = sorted([(p, k, "text", t, h) for p, k, t, h in paras] + [(p, 0, "plate", None, False) for p in plates if p > 0])
    out, current, pending = [], None, None
    for page, _, kind, text, heading in stream:
        if kind == "plate":
            out.append([f"插圖 (頁 {page + 1})", 0])
            current, pending = None, page
            continue
        starts = heading and ("章" in text or "chapter" in text.lower())
        if current is None:
            title = "前言 / 開始閱讀" if pending is None else f"第 {len(out) + 1} 部分 (頁 {pending + 1})"
            current = [title, 0]
            out.append(current)
        elif starts:
            current = [text, 0]
            out.append(current)
        elif current[1] == 91:
            current = [f"第 {len(out) + 1} 部分 (頁 {page + 1})", 0]
            out.append(current)
        current[1] += 1
    return out


def test_chapters_against_a_loop(spark):
    rng = random.Random(5)
    paras, plates, want = [], [], {}
    for b in range(30):
        own, own_plates = [], []
        for page in range(rng.randint(1, 12)):
            if rng.random() < 0.3:
                own_plates.append(page)
                continue
            for k in range(rng.choice([1, 3, 40])):
                own.append((page, k, rng.choice(["第一章", "Chapter two", "text", "more"]), rng.random() < 0.2))
        want[str(b)] = brute_chapters(own, own_plates)
        paras += [(str(b), *r) for r in own]
        plates += [(str(b), p, f"images/page_{p}.jpeg") for p in own_plates]
    got = O.chapters(spark.createDataFrame(paras, "book_id string, page_no int, para_no int, text string, is_heading boolean"), spark.createDataFrame(plates, "book_id string, page_no int, image_path string"))
    found = {}
    for r in got.orderBy("book_id", "chapter_no").collect():
        found.setdefault(r.book_id, []).append([r.title, len(r.paragraphs)])
    assert found == {b: c for b, c in want.items() if c}


def test_reading_order_and_kinds(spark):
    rows = [(0, 0, "right", 0.6, 0.801, 0.02), (0, 1, "left", 0.1, 0.800, 0.02), (0, 2, "below" * 30, 0.1, 0.7, 0.02), (1, 0, "few", 0.1, 0.5, 0.02)]
    df = lines(spark, rows)
    assert [r.text[:5] for r in O.in_reading_order(df).where("page_no = 0").orderBy("line_no").collect()] == ["left", "right", "below"]
    assert {r.page_no: r.kind for r in O.page_kinds(df).collect()} == {0: "text", 1: "image"}
    assert O.paragraphs(df.limit(0)).count() == 0
