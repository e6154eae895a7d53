"""XHTML out of trees of pages, and repairs of markup as text.

Plain Python on one document at a time; operators/pages.py applies it to columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import entities

from quire.functions.html5 import VOID, Node, parsed

BODY_BLOCKS = frozenset("address blockquote del div dl fieldset form h1 h2 h3 h4 h5 h6 hr ins noscript ol p pre table ul".split())

SPACE = "\\s\ufeff"
_PICTOGRAPH = re.compile(f"([{SPACE}]*)(?:[\U0001f000-\U0001faff]\ufe0f?)+([{SPACE}]*)")
_ONE = re.compile("[\U0001f000-\U0001faff]\ufe0f?")


def xml_name(name: str) -> str:
    """A name that XML takes; prefixes that nothing declares become part of it."""
    return re.sub(r"[^A-Za-z0-9_.\u00b7-\uffef-]", "_", name) if not re.fullmatch(r"xml:lang|xmlns(:[A-Za-z]+)?|[A-Za-z_][A-Za-z0-9_.-]*", name) else name


def escaped(text: str, quote: bool = False) -> str:
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]", "", text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;") if quote else text


def serialised(node: Node) -> str:
    """Well-formed XHTML; characters beyond ASCII stay as they are."""
    out: list[str] = []
    stack: list[Node | str | tuple[str]] = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, tuple):
            out.append(item[0])
        elif isinstance(item, str):
            out.append(escaped(item))
        else:
            tag = xml_name(item.tag)
            names = {xml_name(k): v for k, v in item.attrs.items() if re.match(r"[A-Za-z_]", k)}
            out.append(f"<{tag}" + "".join(f' {k}="{escaped(v, True)}"' for k, v in names.items()))
            if item.tag in VOID and not item.children:
                out.append("/>")
            else:
                out.append(">")
                stack.append((f"</{tag}>",))
                stack.extend(reversed(item.children))
    return "".join(out)


def without_pictographs(text: str) -> tuple[str, int]:
    """The text without pictographs, and how many there were."""
    n = len(_ONE.findall(text))
    return (_PICTOGRAPH.sub(lambda m: " " if m[1] and m[2] else "", text), n) if n else (text, 0)


def numeric_entities(source: str) -> str:
    """Named references beyond the five of XML as numbers; an unknown one is an error."""

    def number(m: re.Match) -> str:
        if m[1] in ("amp", "lt", "gt", "quot", "apos"):
            return m[0]
        found = entities.html5.get(m[1] + ";")
        if found is None:
            raise ValueError(f"&{m[1]}; is no known entity")
        return "".join(f"&#{ord(c)};" for c in found)

    return re.sub(r"&([A-Za-z][A-Za-z0-9]*);", number, source)


def decoded_refs(text: str, kept, named: dict[str, str]) -> str:
    """References as their characters: numbers unless kept(code) says otherwise, and the names given; others stay."""
    out, at = [], 0
    while (amp := text.find("&", at)) >= 0:
        end = text.find(";", amp, amp + 64)
        # nothing that long is a reference
        body, char = text[amp + 1 : max(end, amp)], None
        if body.startswith("#"):
            digits, base = (body[2:], 16) if body[1:2] in ("x", "X") else (body[1:], 10)
            if digits and all(d in "0123456789abcdefABCDEF"[: 10 if base == 10 else 22] for d in digits):
                code = int(digits, base)
                char = chr(code) if code <= 0x10FFFF and not kept(code) else None
        else:
            char = named.get(body)
        out.append(text[at:amp])
        out.append("&" if char is None else char)
        at = amp + 1 if char is None else end + 1
    return "".join(out) + text[at:]


def literal_refs(xml: str) -> str:
    """Numeric references to characters beyond ASCII as those characters; others stay."""
    return decoded_refs(xml, lambda code: code < 0x80 or 0xD800 <= code <= 0xDFFF, {})


def plain_refs(value: str) -> str:
    """The five references of XML and numeric ones decoded; others stay."""
    return decoded_refs(value, lambda code: False, {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"})


def modern_doctype(source: str) -> str:
    """Named references as numbers, and the doctype of HTML in place of any other."""
    source = numeric_entities(source)
    start = source.lower().find("<!doctype")
    if start >= 0:
        # its end is the first > outside brackets, which hold declarations of their own
        end, depth = start, 0
        while end < len(source) and (depth or source[end] != ">"):
            depth += {"[": 1, "]": -1}.get(source[end], 0)
            end += 1
        return source[:start] + "<!DOCTYPE html>" + source[end + 1 :]
    declared = re.match(r"\s*<\?xml\b.*?\?>\s*", source, re.S)
    body = source[declared.end() :] if declared else source
    return (declared[0] if declared else "") + "<!DOCTYPE html>\n" + body


def unloadable(url: str) -> bool:
    value = re.sub(r"^['\"]|['\"]$", "", url.strip())
    return bool(value) and not value.startswith("data:") and (value.startswith("//") or bool(re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", value)))


def declarations(css: str) -> Iterator[tuple[str, str, str, list[str]]]:
    """(selector, text, kind, urls) of a stylesheet's parts in turn, which make it up again: kind is "open" or "close"
    for braces with what leads up to them, "declared" for what a semicolon ends, "rest" for the last."""
    selectors: list[str] = []
    start, urls = 0, []
    for m in re.finditer(r"url\(([^)]*)\)|[{};]", css, re.I):
        if m[1] is not None:
            urls.append(m[1])
            continue
        text = css[start : m.end()]
        if m[0] == "{":
            selectors.append(text[:-1].strip())
        yield selectors[-1] if selectors else "", text, {"{": "open", "}": "close", ";": "declared"}[m[0]], urls
        if m[0] == "}" and selectors:
            selectors.pop()
        start, urls = m.end(), []
    yield selectors[-1] if selectors else "", css[start:], "rest", urls


def healed_stylesheet(css: str) -> tuple[str, list[str]]:
    """A stylesheet without what can't load in a book, and what that was.

    A declaration goes if its last url can't load, and stays if no semicolon ends it; a font goes if none of its urls can load."""
    kept: list[str] = []
    dropped: list[str] = []
    font: list[tuple[str, str, list[str]]] | None = None
    for selector, text, kind, urls in declarations(css):
        if font is None and kind == "open" and selector.lower().endswith("@font-face"):
            at = text.lower().rindex("@font-face")
            kept.append(text[:at])
            font, text = [], text[at:]
        if font is not None:
            font.append((text, kind, urls))
            if kind == "close":
                every = [u.strip() for _, _, own in font for u in own]
                if every and all(map(unloadable, every)):
                    names = [t.partition(":")[2].strip(" \t\n\r;}") for t, _, _ in font if t.partition(":")[0].strip().lower() == "font-family"]
                    dropped.append(f"font {names[0] if names else '(no name)'}: {', '.join(every)}")
                else:
                    kept += [t for t, _, _ in font]
                font = None
        elif kind == "declared" and urls and unloadable(urls[-1]) and ":" in text[: text.lower().index("url(")]:
            dropped.append(f"{text.partition(':')[0].strip()}: {urls[-1].strip()}")
        else:
            kept.append(text)
    kept += [t for t, _, _ in font or []]
    return (re.sub(r"\n{3,}", "\n\n", "".join(kept)) if dropped else css), dropped
