"""Text functions with Unicode white space, grapheme counts and exact escapes.

White space here is that of the Unicode standard with the byte-order mark, which
neither \\s nor trim() covers in Spark; see SPACE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
PICTOGRAPH = r"[\x{1F000}-\x{1FAFF}]\x{FE0F}?"
#: Private-use marks for one-pass stripping; a text that has them is marked by the next two.
MARKS = (("\ue000", "\ue001"), ("\uf8f0", "\uf8f1"))
#: Words too weak to stand on a title line of their own.
WEAK_WORDS = "a an the as at by for from in into of off on onto out over to up upon with within without and but nor or so yet".split()


def decoded_bytes(content: Column) -> Column:
    """Bytes as UTF-8 text; what isn't becomes replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def trim(c: Column) -> Column:
    # only the first blank of a run starts the search for the end, so long runs are read once
    return F.regexp_replace(c, rf"^{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return trim(F.regexp_replace(c, f"{SPACE}+", " "))


def squeeze(c: Column) -> Column:
    """Without any white space: the key under which labels are compared."""
    return F.regexp_replace(c, SPACE, "")


def graphemes(c: Column) -> Column:
    """Length in user-perceived characters."""
    plain = (F.octet_length(c) == F.char_length(c)) & ~F.contains(c, F.lit("\r\n"))
    return F.when(plain, F.char_length(c)).otherwise(F.regexp_count(c, F.lit(r"\X")))


def escape_text(c: Column) -> Column:
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(ref))
    return c


def escape_attribute(c: Column, apostrophe: bool = False) -> Column:
    c = F.replace(escape_text(c), F.lit('"'), F.lit("&quot;"))
    return F.replace(c, F.lit("'"), F.lit("&apos;")) if apostrophe else c


def unescape_basic(c: Column) -> Column:
    """The references that a title usually has, the ampersand last."""
    for ref, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(ref), F.lit(raw))
    return c


def strip_pictographs(c: Column) -> Column:
    """Without pictographs and the white space beside them, but for one blank where there was some on both sides."""

    def by(start: str, end: str) -> Column:
        # possessive: a matcher that may go back deepens its stack with every pictograph of a run
        p = f"(?:{PICTOGRAPH})++"
        marked = F.regexp_replace(c, f"(?:(?<!{SPACE})|\\G)(?:({SPACE}){SPACE}*+{p}{SPACE}++|{SPACE}*+{p}{SPACE}*+)", f"{start}$1{end}")
        return F.replace(F.regexp_replace(marked, f"{start}{SPACE}{end}", " "), F.lit(start + end), F.lit(""))

    (a, b), other = MARKS
    return F.when(~c.rlike(PICTOGRAPH), c).when(c.contains(a) | c.contains(b), by(*other)).otherwise(by(a, b))


def count_pictographs(c: Column) -> Column:
    return F.regexp_count(c, F.lit(PICTOGRAPH))


def pictographs(c: Column) -> Column:
    """Distinct pictographs, without variation selectors."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({PICTOGRAPH})"), F.lit(1)), lambda x: F.replace(x, F.lit("️"), F.lit(""))))


def code_point_label(c: Column) -> Column:
    """U+XXXX of the first character."""
    code = F.hex(F.ascii(c))
    return F.concat(F.lit("U+"), F.when(F.length(code) < 4, F.lpad(code, 4, "0")).otherwise(code))


def join_lines(lines: Column) -> Column:
    """Lines as one text: a blank only between Latin letters or digits, none between others; empty lines pass."""
    kept = F.filter(F.transform(lines, lambda x: trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.aggregate(kept, F.lit(""), lambda acc, x: F.concat(acc, F.when(acc.rlike("[a-zA-Z0-9]$") & x.rlike("^[a-zA-Z0-9]"), " ").otherwise(""), x))


def is_word_broken(title: Column) -> Column:
    return trim(title).rlike(SPACE)


def byte_size(n: Column) -> Column:
    """A whole count of bytes for people; a half of a hundredth goes to the even one."""
    rest = n % (1 << 20) * 100
    over, cents = rest % (1 << 20), F.shiftright(rest.cast("long"), 20)
    up = (over > 1 << 19) | ((over == 1 << 19) & (cents % 2 == 1))
    hundredths = F.shiftright(n.cast("long"), 20) * 100 + cents + up.cast("int")
    megabytes = F.format_string("%d.%02d MB", F.floor(hundredths / 100).cast("long"), hundredths % 100)
    return F.when(n >= 1 << 20, megabytes).when(n >= 1 << 10, F.format_string("%.0f KB", n / 1024.0)).otherwise(F.format_string("%d B", n))


def iso_seconds(ts: Column) -> Column:
    """A UTC timestamp as the package document wants it."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def name_uuid(*parts: Column) -> Column:
    """A stable identifier in the form of a version-4 UUID, from what it names."""
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def progress_percent(line: Column) -> Column:
    """Percent done that a progress line "OCR on page c/t" stands for: recognition takes the share from 25 to 90."""
    c, t = (F.regexp_extract(line, r"(?i)OCR on page (\d+)/(\d+)", k).cast("int") for k in (1, 2))
    return F.when(line.rlike(r"(?i)OCR on page \d+/\d+"), (F.lit(25) + F.floor(c / t * 65)).cast("int"))
