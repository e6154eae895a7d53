"""References, paths, file names, media types and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
IMAGE_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".svg": "image/svg+xml"}
FILE_TYPES = IMAGE_TYPES | {".xhtml": "application/xhtml+xml", ".html": "application/xhtml+xml", ".css": "text/css", ".ncx": "application/x-dtbncx+xml", ".xpgt": "application/vnd.adobe-page-template+xml"}
#: Any version and variant, without a prefix.
UUID = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def reference_kind(ref: Column) -> Column:
    """empty, fragment, host, scheme or internal."""
    return F.when(ref.isNull() | (ref == ""), "empty").when(ref.startswith("#"), "fragment").when(ref.startswith("//"), "host").when(ref.rlike(SCHEME), "scheme").otherwise("internal")


def target(ref: Column) -> Column:
    return F.substring_index(ref, "#", 1)


def fragment(ref: Column) -> Column:
    """What follows the first #, with it; empty if there is none."""
    return F.substring(ref, F.length(target(ref)) + 1, F.length(ref))


def unloadable(url: Column) -> Column:
    """A url() value that a book can't hold: another host or scheme, unless it is data."""
    bare = F.regexp_replace(trim(url), "^[\"']|[\"']$", "")
    return (bare != "") & ~bare.startswith("data:") & (bare.startswith("//") | bare.rlike(SCHEME))


def number_key(digits: Column, most: int | None = None) -> Column:
    """What whole numbers of any length are sorted and compared by; null for no digits, and for those beyond `most`."""
    bare = F.regexp_replace(digits, "^0+(?=.)", "")
    key = F.struct(F.length(bare).alias("length"), bare.alias("digits"))
    within = digits != ""
    return F.when(within if most is None else within & (key <= F.struct(F.lit(len(str(most))).alias("length"), F.lit(str(most)).alias("digits"))), key)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The folder with its slash; empty at the root."""
    return F.regexp_replace(path, r"[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1))


def resolved(folder: Column, path: Column) -> Column:
    """path as seen from folder, with . and .. worked off; null if absolute or outside the container."""
    parts = F.split(F.concat(folder, path), "/")
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(False).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        stack, out = acc["stack"], acc["out"]
        up = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.struct(F.when(part.isin("", "."), stack).when(part == "..", up).otherwise(F.concat(stack, F.array(part))).alias("stack"), (out | ((part == "..") & (F.size(stack) == 0))).alias("out"))

    done = F.aggregate(parts, start, step)
    return F.when(path.startswith("/") | done["out"], None).otherwise(F.array_join(done["stack"], "/"))


def encoded_part(c: Column) -> Column:
    """Percent-encoded as a path segment: letters, digits and - _ . ! ~ * ' ( ) stay."""
    c = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, raw in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def encoded(path: Column) -> Column:
    """A path with its segments encoded; null if any is empty, . or .."""
    parts = F.split(path, "/")
    return F.when(F.exists(parts, lambda p: p.isin("", ".", "..")), None).otherwise(F.array_join(F.transform(parts, encoded_part), "/"))


def decoded(ref: Column) -> Column:
    """Percent-decoded, plus signs as they are; null if it can't be."""
    return F.try_url_decode(F.replace(ref, F.lit("+"), F.lit("%2B")))


def media_type(path: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in FILE_TYPES.items() for x in kv)), extension(path))


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_TYPES)


def image_file(ref: Column) -> Column:
    """The bare file name of a reference to images/, decoded; null for any other."""
    found = F.regexp_extract(decoded(ref), "^images/([^/]+)$", 1)
    return F.when(found != "", found)


def plate_name(path: Column) -> Column:
    """The file name of a scanned plate under images/, of plain characters; else null."""
    name = F.regexp_extract(path, r"^images/([A-Za-z0-9._-]+)$", 1)
    return F.when((name != "") & ~name.isin(".", ".."), name)


def manifest_id(hint: Column) -> Column:
    """A hint as an XML id: other characters become dashes, and a letter or _ leads."""
    clean = F.regexp_replace(hint, r"[^A-Za-z0-9_.\-]", "-")
    return F.when(clean.rlike("^[A-Za-z_]"), clean).otherwise(F.concat(F.lit("id-"), clean))


def resource_name(path: Column) -> Column:
    """The file name under which a resource is kept: plain characters, extension in lower case."""
    stem = F.regexp_replace(F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", ""), r"[^A-Za-z0-9_\-]+", "-")
    return F.concat(F.when(stem.rlike("[A-Za-z0-9]"), F.regexp_replace(stem, "^-+|-+$", "")).otherwise("image"), extension(path))


def download_header(title: Column) -> Column:
    """The header that names a download: 80 characters of the title, plain and encoded."""

    def or_book(c: Column) -> Column:
        return F.when(c == "", "book").otherwise(c)

    name = or_book(trim(F.substring(title, 1, 80)))
    plain = or_book(trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r'["\\]', ""), r"[\x{10000}-\x{10FFFF}]", "__"), r"[^\x20-\x7E]", "_")))
    coded = encoded_part(name)
    for raw, code in (("'", "%27"), ("(", "%28"), (")", "%29"), ("*", "%2A"), ("!", "%21")):
        coded = F.replace(coded, F.lit(raw), F.lit(code))
    return F.concat(F.lit('attachment; filename="'), plain, F.lit(".epub\"; filename*=UTF-8''"), coded, F.lit(".epub"))


def is_uuid(c: Column) -> Column:
    return c.rlike(UUID)


def annotation_locale(language: Column) -> Column:
    """The table of names for pictographs that a language tag asks for."""
    tag = F.lower(F.coalesce(language, F.lit("")))
    return F.when(tag.startswith("ja"), "ja").when(tag.startswith("zh"), "zh-Hant").otherwise("en")


def layout_of(direction: Column) -> Column:
    return F.when(F.lower(direction) == "rtl", "vertical").otherwise("horizontal")


def is_pdf(content: Column, most: int = 512 * 1024 * 1024) -> Column:
    """An upload that may be taken: it starts as a PDF does and isn't too long."""
    return (F.hex(F.substring(content, 1, 5)) == "255044462D") & (F.length(content) <= most)


def is_local_host(host: Column) -> Column:
    """A loopback name or address, with any port."""
    bare = F.lower(F.regexp_replace(host, r":\d+$", ""))
    return bare.isin("localhost", "[::1]", "::1") | bare.rlike(r"^127(\.\d{1,3}){3}$")
