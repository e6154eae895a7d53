"""Books in markdown: front matter, nested blocks, and back to text without loss.

A block is a dict of kind (heading, paragraph, quote, list, image, fence) and what that
kind has; a quote holds blocks. Serialising what was parsed, again and again, gives the
same text from the first time on.
"""

from __future__ import annotations

import re

from quire.functions.trees import escaped

KNOWN = ("title", "lang", "direction", "author", "translator", "cover")
LINK = re.compile(r"\[([^\]\n]+)\]\(([^)\s]+)\)")
BLANKS = " \t　\xa0"


def front_matter(lines: list[str]) -> tuple[dict, list[str]]:
    """Metadata with its unknown keys in order, and the lines after it."""
    meta: dict = {"title": "", "lang": "", "direction": "", "extras": []}
    if not lines or lines[0].strip(BLANKS) != "---":
        return meta, lines
    close = next((k for k in range(1, len(lines)) if lines[k].strip(BLANKS) == "---"), None)
    if close is None:
        return meta, lines
    for line in lines[1:close]:
        key, colon, value = line.partition(":")
        if not colon:
            continue
        key, value = key.strip(BLANKS), value.strip(BLANKS)
        if key in KNOWN:
            meta[key] = value
        else:
            meta["extras"].append({"key": key, "value": value})
    return meta, lines[close + 1 :]


def fence(t: str) -> tuple[str, int, str] | None:
    m = re.match(r"(`{3,}|~{3,})(.*)$", t)
    return (m[1][0], len(m[1]), m[2].strip(BLANKS)) if m else None


def heading(t: str) -> tuple[int, str] | None:
    m = re.match(r"(#{1,6}) (.*)$", t)
    return (len(m[1]), m[2].strip(BLANKS)) if m else None


def item(t: str) -> tuple[str, str] | None:
    m = re.match(r"([*+-]) (.*)$", t)
    return (m[1], m[2].strip(BLANKS)) if m else None


def embed(t: str) -> dict | None:
    if t.startswith("![[") and t.endswith("]]"):
        href, bar, alt = t[3:-2].partition("|")
        return {"kind": "image", "href": href, "alt": alt if bar else None, "form": "wiki"}
    m = re.match(r"!\[([^\]]*)\]\((.*)\)$", t)
    return {"kind": "image", "href": m[2], "alt": m[1] or None, "form": "inline"} if m else None


def blocks(lines: list[str]) -> list[dict]:
    out: list[dict] = []
    i, bare = 0, [x.strip(BLANKS) for x in lines]
    n = len(lines)
    while i < n:
        t = bare[i]
        if not t:
            i += 1
        elif f := fence(t):
            i += 1
            body = []
            while i < n:
                c = fence(bare[i])
                i += 1
                if c and c[0] == f[0] and c[1] >= f[1] and not c[2]:
                    break
                body.append(lines[i - 1])
            out.append({"kind": "fence", "marker": f[0], "info": f[2], "items": body})
        elif t[0] == ">":
            inner = []
            while i < n and (bare[i][:1] == ">" or not bare[i] and i + 1 < n and bare[i + 1][:1] == ">"):
                inner.append(re.sub("^> ?", "", bare[i]))
                i += 1
            out.append({"kind": "quote", "blocks": blocks(inner)})
        elif h := heading(t):
            out.append({"kind": "heading", "level": h[0], "text": h[1]})
            i += 1
        elif e := embed(t):
            out.append(e)
            i += 1
        elif first := item(t):
            items = []
            while i < n and (x := item(bare[i])) and x[0] == first[0]:
                items.append(x[1])
                i += 1
            out.append({"kind": "list", "marker": first[0], "items": items})
        else:
            run = [t]
            i += 1
            while i < n and bare[i] and bare[i][0] != ">" and not (heading(bare[i]) or fence(bare[i]) or item(bare[i]) or embed(bare[i])):
                run.append(bare[i])
                i += 1
            out.append({"kind": "paragraph", "text": " ".join(run)})
    return out


def parsed(source: str) -> dict:
    """metadata, preamble (blocks before the first heading) and chapters (level, title, blocks)."""
    meta, lines = front_matter(source.replace("\r\n", "\n").split("\n"))
    preamble: list[dict] = []
    chapters: list[dict] = []
    for b in blocks(lines):
        if b["kind"] == "heading":
            chapters.append({"level": b["level"], "title": b["text"], "blocks": []})
        else:
            (chapters[-1]["blocks"] if chapters else preamble).append(b)
    return {"metadata": meta, "preamble": preamble, "chapters": chapters}


def rendered(found: list[dict]) -> list[str]:
    out: list[str] = []
    for b in found:
        kind = b["kind"]
        if kind == "heading":
            out.append("#" * b["level"] + " " + b["text"])
        elif kind == "paragraph":
            out.append(b["text"])
        elif kind == "quote":
            out += [f"> {x}" if x else ">" for x in rendered(b["blocks"])]
        elif kind == "list":
            out += [f"{b['marker']} {x}" for x in b["items"]]
        elif kind == "image":
            bar = "" if b["alt"] is None else f"|{b['alt']}"
            out.append(f"![[{b['href']}{bar}]]" if b["form"] == "wiki" else f"![{b['alt'] or ''}]({b['href']})")
        else:
            out += [b["marker"] * 3 + b["info"], *b["items"], b["marker"] * 3]
        out.append("")
    return out


def serialised(book: dict) -> str:
    meta = book["metadata"]
    head = ["---", f"title: {meta['title']}"]
    head += [f"{k}: {meta[k]}" for k in ("author", "translator") if meta.get(k) is not None]
    head += [f"lang: {meta['lang']}", f"direction: {meta['direction']}"]
    head += [f"cover: {meta['cover']}"] if meta.get("cover") is not None else []
    head += [f"{e['key']}: {e['value']}" for e in meta["extras"]]
    lines = [*head, "---", "", *rendered(book["preamble"])]
    for c in book["chapters"]:
        lines += ["#" * c["level"] + " " + c["title"], "", *rendered(c["blocks"])]
    return "\n".join(lines).rstrip("\n") + "\n"


def links(text: str) -> list[tuple[str, str]]:
    return LINK.findall(text)


def inline_xhtml(text: str) -> str:
    """Text as markup: its links as such, all else escaped."""
    out, at = [], 0
    for m in LINK.finditer(text):
        href = escaped(m[2], True).replace("'", "&apos;")
        out += [escaped(text[at : m.start()]), f'<a href="{href}">{escaped(m[1])}</a>']
        at = m.end()
    return "".join([*out, escaped(text[at:])])


def block_rows(book: dict) -> list[dict]:
    """Blocks as rows of ids and parents; chapter_no is null for the preamble."""
    rows: list[dict] = []

    def put(found: list[dict], chapter: int | None, parent: int | None) -> None:
        for k, b in enumerate(found):
            own = len(rows)
            rows.append({"chapter_no": chapter, "block_id": own, "parent_id": parent, "ord": k, "kind": b["kind"], "level": b.get("level"), "text": b.get("text"), "marker": b.get("marker"), "items": b.get("items"), "href": b.get("href"), "alt": b.get("alt"), "form": b.get("form"), "info": b.get("info")})
            if b["kind"] == "quote":
                put(b["blocks"], chapter, own)

    put(book["preamble"], None, None)
    for n, c in enumerate(book["chapters"], 1):
        put(c["blocks"], n, None)
    return rows
