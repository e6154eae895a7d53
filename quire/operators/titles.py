"""Titles set in lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import SPACE, WEAK_WORDS, is_word_broken, trim


def is_weak(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}]", "")).isin(WEAK_WORDS)


def title_lines(titles: DataFrame) -> DataFrame:
    """(title_id, line_no, line): a strong word starts a line, weak ones join the line before, or the first after."""
    words = titles.select("title_id", F.posexplode(F.split(trim(F.col("title")), f"{SPACE}+")).alias("i", "word")).where("word <> ''")
    order = Window.partitionBy("title_id").orderBy("i")
    grouped = words.withColumn("line_no", F.greatest(F.sum((~is_weak(F.col("word"))).cast("int")).over(order), F.lit(1)))
    return grouped.groupBy("title_id", "line_no").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "word")))["word"], " ").alias("line"))


def capped(lines: Column, most: int) -> Column:
    """At most so many lines: the two neighbours that are shortest together become one, the first of equals."""

    def shorter(lines: Column, _: Column) -> Column:
        # a struct is least by length, then by place
        pairs = F.transform(F.slice(lines, F.lit(1), F.size(lines) - 1), lambda x, i: F.struct((F.length(x) + F.length(F.element_at(lines, i + 2))).alias("length"), (i + 1).alias("at")))
        at = F.array_min(pairs)["at"]
        one = F.concat_ws(" ", F.element_at(lines, at), F.element_at(lines, at + 1))
        return F.concat(F.slice(lines, F.lit(1), at - 1), F.array(one), F.slice(lines, at + 2, F.size(lines)))

    times = F.size(lines) - max(1, most)
    return F.when(F.size(lines) <= max(1, most), lines).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(times, F.lit(1))), lines, shorter))


def subtitle_split(title: Column) -> Column:
    """[title, subtitle] around a full-width colon or a double dash; null for one phrase."""
    pattern = rf"^(.+?){SPACE}*(?:：|——){SPACE}*(.+)$"
    head, tail = (trim(F.regexp_extract(trim(title), pattern, k)) for k in (1, 2))
    return F.when((head != "") & (tail != ""), F.array(head, tail))


def set_titles(titles: DataFrame, most: int = 4) -> DataFrame:
    """(title_id, lines): English titles in lines, others at their subtitle or null."""
    english = titles.where(is_word_broken(F.col("title")))
    lines = title_lines(english).groupBy("title_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"].alias("lines"))
    others = titles.where(~F.coalesce(is_word_broken(F.col("title")), F.lit(False)))
    return lines.select("title_id", capped(F.col("lines"), most).alias("lines")).unionByName(others.select("title_id", subtitle_split(F.col("title")).alias("lines")))


def merged_title(first: Column, language_default: str = "") -> Column:
    """A title for several volumes: the first one's without its number, unless nothing is left."""
    bare = F.regexp_replace(first, "[一二三四五六七八九十0-9]+$", "")
    return F.coalesce(F.nullif(trim(bare), F.lit("")), first)
