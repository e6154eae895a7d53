"""Trees of HTML pages as the living standard builds them: plain Python on one page at a time.

What the standard says of tokens, insertion modes, scopes, implied ends, the list of active
formatting elements with the adoption of misnested ones, foster parents of what stands
loose in tables, templates and foreign elements is followed, with these liberties, none
of which moves an element: comments and doctypes leave no node, white space before the
body is dropped, framesets are ignored (there is always one html, head and body), scripts
are off, and names within svg and math stay in the case in which they are written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "space")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, space: str = "") -> None:
        self.tag, self.attrs, self.children, self.parent, self.space = tag, attrs or {}, [], None, space

    def add(self, child: Node | str) -> None:
        self.insert(len(self.children), child)

    def insert(self, at: int, child: Node | str) -> None:
        """Puts a child before the one at `at`; texts that meet grow together."""
        if isinstance(child, Node):
            child.parent = self
        elif at and isinstance(self.children[at - 1], str):
            self.children[at - 1] += child
            return
        self.children.insert(at, child)

    def place(self, child: Node) -> int:
        """Where a child is, looked for from the end."""
        return next(k for k in range(len(self.children) - 1, -1, -1) if self.children[k] is child)

    def leave(self) -> None:
        if self.parent is not None:
            del self.parent.children[self.parent.place(self)]
            self.parent = None

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(out)


# fixed values of the standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split())
SPECIAL = BLOCKS | HEADINGS | frozenset("applet area base basefont bgsound body br button caption col colgroup dd dt embed form frame frameset head hr html iframe img input keygen li link listing marquee meta noembed noframes noscript object param plaintext pre script select source style table tbody td template textarea tfoot th thead title tr track wbr xmp".split()) - {"dialog", "search"}
HEAD = frozenset("base basefont bgsound link meta noframes script style template title".split())
RAW = frozenset("iframe noembed noframes script style xmp".split())
RCDATA = frozenset(("textarea", "title"))
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE = frozenset("applet caption html marquee object table td template th mi mn mo ms mtext annotation-xml foreignObject desc".split())
ITEM_SCOPE, BUTTON_SCOPE, TABLE_SCOPE = SCOPE | {"ol", "ul"}, SCOPE | {"button"}, frozenset(("html", "table", "template"))
BODIES = frozenset(("tbody", "tfoot", "thead"))
FOSTERED = BODIES | {"table", "tr"}
PARTS = BODIES | {"caption", "col", "colgroup", "td", "th", "tr"}
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split())
TEXT_POINTS = frozenset(("mi", "mo", "mn", "ms", "mtext"))
QUIRKS = ("-//ietf//dtd html", "-//w3c//dtd html 3", "-//w3c//dtd html 4.0 ", "-//w3c//dtd w3 html", "-//netscape", "-//microsoft", "-//w3o//dtd")

BLANKS = " \t\n\f\r"
_NAME = re.compile(r"[A-Za-z][^ \t\n\f\r/>]*")
_ATTRIBUTE = re.compile(r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*")
_EQUALS = re.compile(r"[ \t\n\f\r]*=[ \t\n\f\r]*")
_BARE = re.compile(r"[^ \t\n\f\r>]*")
_REF = re.compile(r"&(?:#[xX]?[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);?(?=(.?))", re.S)


def attribute(value: str) -> str:
    """A value with its references decoded; a name without its semicolon isn't one before a letter, digit or equals sign."""
    loose = lambda m: not m[0].endswith(";") and m[0][1] != "#" and (m[1] == "=" or m[1].isalnum() and m[1].isascii())
    return _REF.sub(lambda m: m[0] if loose(m) else unescape(m[0]), value) if "&" in value else value


class Tokens:
    """(kind, name, attributes, whether closed in itself) of a page: kinds are text, start and end. `raw` is set by who reads them."""

    def __init__(self, source: str) -> None:
        self.source = source.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
        self.at, self.raw, self.foreign, self.quirks = 0, "", False, True

    def __iter__(self) -> Iterator[tuple[str, str, dict[str, str], bool]]:
        source, size = self.source, len(self.source)
        while self.at < size:
            if self.raw:
                name, begun = self.raw, self.at
                end = re.compile(f"</{name}(?=[ \t\n\f/>])", re.I).search(source, begun) if name != "plaintext" else None
                self.at, self.raw = end.start() if end else size, ""
                if self.at > begun:
                    text = source[begun : self.at]
                    yield "text", unescape(text) if name in RCDATA else text, {}, False
                continue
            begun = self.at
            while (tag := source.find("<", self.at)) >= 0 and not self.opens(tag):
                self.at = tag + 1
            stop = tag if tag >= 0 else size
            self.at = stop
            if stop > begun:
                yield "text", unescape(source[begun:stop]), {}, False
            elif (token := self.markup()) is not None:
                yield token

    def opens(self, at: int) -> bool:
        """Whether markup begins at this sign."""
        after = self.source[at + 1 : at + 3]
        return after[:1] in ("!", "?") and after != "" or after[:1].isalpha() and after[:1].isascii() or after[:1] == "/" and len(after) > 1

    def markup(self) -> tuple[str, str, dict[str, str], bool] | None:
        """The tag here, or None for what leaves nothing; goes on behind it."""
        source, at = self.source, self.at
        if source.startswith("<!--", at):
            end = re.compile("-->|--!>|(?<=<!--)-?>").search(source, at + 4)
            self.at = end.end() if end else len(source)
            return None
        if self.foreign and source.startswith("<![CDATA[", at):
            end = source.find("]]>", at)
            self.at = end + 3 if end >= 0 else len(source)
            return "text", source[at + 9 : end if end >= 0 else len(source)], {}, False
        ending = source[at + 1] == "/"
        named = _NAME.match(source, at + 1 + ending)
        if not named:
            end = source.find(">", at)
            self.at = end + 1 if end >= 0 else len(source)
            if re.match("<!doctype", source[at : at + 9], re.I):
                said = source[at + 9 : self.at - 1].strip().lower()
                public = re.match(r"""html\s+public\s*["']([^"']*)["']\s*(.?)""", said)
                self.quirks = not re.match(r"html\b", said) or bool(public and (public[1].startswith(QUIRKS) or not public[2] and public[1].startswith(("-//w3c//dtd html 4.01 transitional", "-//w3c//dtd html 4.01 frameset"))))
            return None
        foreign = self.foreign or named[0].lower() in ("svg", "math")
        attrs: dict[str, str] = {}
        pos, size = named.end(), len(source)
        while True:
            while pos < size and source[pos] in BLANKS + "/":
                pos += 1
            if pos >= size:
                self.at = size
                return None  # a tag that never ends
            if source[pos] == ">":
                break
            key = _ATTRIBUTE.match(source, pos)
            pos, value = key.end(), ""
            if equals := _EQUALS.match(source, pos):
                pos = equals.end()
                quote = source[pos : pos + 1]
                if quote in ("'", '"') and quote:
                    end = source.find(quote, pos + 1)
                    if end < 0:
                        self.at = size
                        return None
                    value, pos = source[pos + 1 : end], end + 1
                else:
                    bare = _BARE.match(source, pos)
                    value, pos = bare[0], bare.end()
            attrs.setdefault(key[0] if foreign else key[0].lower(), attribute(value))
        self.at = pos + 1
        return "end" if ending else "start", named[0], {} if ending else attrs, source[pos - 1] == "/"


class Tree:
    def __init__(self, source: str) -> None:
        self.tokens = Tokens(source)
        self.html, self.head, self.body = Node("html"), Node("head"), Node("body")
        self.html.add(self.head)
        self.html.add(self.body)
        self.stack: list[Node] = [self.html]
        self.active: list[Node | None] = []  # None is a marker
        self.templates: list[str] = []
        self.form: Node | None = None
        self.mode, self.after_text = "before_head", ""
        self.foster = self.newline = False
        for kind, name, attrs, closed in self.tokens:
            if self.newline:
                self.newline = False
                if kind == "text" and not (name := name.removeprefix("\n")):
                    continue
            self.process(kind, name, attrs, closed)
            self.tokens.foreign = bool(self.current.space)

    # ---- the stack of open elements

    @property
    def current(self) -> Node:
        return self.stack[-1]

    def process(self, kind: str, name: str, attrs: dict[str, str], closed: bool) -> None:
        if self.in_foreign(kind, name):
            self.foreign(kind, name, attrs, closed)
        else:
            getattr(self, self.mode)(kind, name if kind == "text" else name.lower(), attrs, closed)

    def spot(self, target: Node | None = None) -> tuple[Node, int]:
        """Where a new node goes: into the current element, or before a table that can't have it."""
        target = target or self.current
        if not (self.foster and target.tag in FOSTERED):
            return target, len(target.children)
        at = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k].tag in ("table", "template")), 0)
        found = self.stack[at]
        if found.tag == "table" and found.parent is not None:
            return found.parent, found.parent.place(found)
        target = self.stack[max(at - (found.tag == "table"), 0)]
        return target, len(target.children)

    def put(self, text: str) -> None:
        parent, at = self.spot()
        parent.insert(at, text)

    def open(self, tag: str, attrs: dict[str, str] | None = None, space: str = "") -> Node:
        node = Node(tag, dict(attrs or {}), space)
        parent, at = self.spot()
        parent.insert(at, node)
        self.stack.append(node)
        return node

    def void(self, tag: str, attrs: dict[str, str]) -> None:
        self.open(tag, attrs)
        self.stack.pop()

    def raw(self, tag: str, attrs: dict[str, str]) -> None:
        self.open(tag, attrs)
        self.tokens.raw, self.after_text, self.mode = tag, self.mode, "text"

    def within(self, tags: frozenset | set | tuple, scope: frozenset = SCOPE) -> bool:
        for node in reversed(self.stack):
            if node.tag in tags and not node.space:
                return True
            if node.tag in scope:
                return False
        return False

    def pop_to(self, *tags: str) -> None:
        while self.stack.pop().tag not in tags:
            pass

    def imply(self, but: str = "") -> None:
        while self.current.tag in IMPLIED and self.current.tag != but:
            self.stack.pop()

    def close(self, *tags: str, but: str = "") -> None:
        self.imply(but)
        self.pop_to(*tags)

    def close_p(self) -> None:
        if self.within({"p"}, BUTTON_SCOPE):
            self.close("p", but="p")

    def back_to(self, *tags: str) -> None:
        while self.current.tag not in (*tags, "template", "html"):
            self.stack.pop()

    # ---- active formatting elements

    def clear_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def activate(self, node: Node) -> None:
        same = []
        for k in range(len(self.active) - 1, -1, -1):
            other = self.active[k]
            if other is None:
                break
            if other.tag == node.tag and other.attrs == node.attrs:
                same.append(k)
        if len(same) >= 3:
            del self.active[same[-1]]
        self.active.append(node)

    def has(self, where: list, node: Node) -> bool:
        return any(x is node for x in where)

    def drop(self, where: list, node: Node) -> None:
        for k in range(len(where) - 1, -1, -1):
            if where[k] is node:
                del where[k]
                return

    def reopen(self) -> None:
        """Formatting that is active but closed goes on."""
        at = len(self.active)
        while at and self.active[at - 1] is not None and not self.has(self.stack, self.active[at - 1]):
            at -= 1
        for k in range(at, len(self.active)):
            self.active[k] = self.open(self.active[k].tag, self.active[k].attrs)

    def adopt(self, tag: str) -> None:
        """Ends a formatting element that blocks may have been begun within."""
        if self.current.tag == tag and not self.has(self.active, self.current):
            self.stack.pop()
            return
        for _ in range(8):
            ended = None
            for node in reversed(self.active):
                if node is None or node.tag == tag:
                    ended = node
                    break
            if ended is None:
                self.other_end(tag)
                return
            if not self.has(self.stack, ended):
                self.drop(self.active, ended)
                return
            at = next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k] is ended)
            if any(n.tag in SCOPE for n in self.stack[at + 1 :]):
                return
            block_at = next((k for k in range(at + 1, len(self.stack)) if self.stack[k].tag in SPECIAL and not self.stack[k].space), None)
            if block_at is None:
                del self.stack[at:]
                self.drop(self.active, ended)
                return
            block, above = self.stack[block_at], self.stack[at - 1]
            mark = next(k for k, n in enumerate(self.active) if n is ended)
            last, k = block, block_at
            for step in range(1, block_at - at):
                k -= 1
                node = self.stack[k]
                place = next((i for i, n in enumerate(self.active) if n is node), None)
                if step > 3 and place is not None:
                    del self.active[place]
                    mark -= place < mark
                    place = None
                if place is None:
                    del self.stack[k]
                    continue
                again = Node(node.tag, dict(node.attrs))
                self.active[place] = self.stack[k] = again
                if last is block:
                    mark = place + 1
                last.leave()
                again.add(last)
                last = again
            last.leave()
            was, self.foster = self.foster, True
            parent, place = self.spot(above)
            self.foster = was
            parent.insert(place, last)
            again = Node(ended.tag, dict(ended.attrs))
            for child in block.children:
                again.add(child)
            block.children = []
            block.add(again)
            mark -= next(k for k, n in enumerate(self.active) if n is ended) < mark
            self.drop(self.active, ended)
            self.active.insert(mark, again)
            self.drop(self.stack, ended)
            self.stack.insert(next(k for k, n in enumerate(self.stack) if n is block) + 1, again)

    def other_end(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self.imply(tag)
                del self.stack[k:]
                return
            if self.stack[k].tag in SPECIAL:
                return

    # ---- before the body

    def to_body(self) -> None:
        self.stack, self.mode = [self.html, self.body], "in_body"

    def merged(self, node: Node, attrs: dict[str, str]) -> None:
        node.attrs = attrs | node.attrs

    def before_head(self, kind, name, attrs, closed) -> None:
        if kind == "text":
            name = name.lstrip(BLANKS)
            if not name:
                return
        elif kind == "start" and name == "html":
            self.merged(self.html, attrs)
            return
        elif kind == "end" and name not in ("head", "body", "html", "br"):
            return
        self.stack, self.mode = [self.html, self.head], "in_head"
        if kind == "start" and name == "head":
            self.merged(self.head, attrs)
        elif kind != "end" or name != "head":
            self.process(kind, name, attrs, closed)
        else:
            self.stack, self.mode = [self.html], "after_head"

    def in_head(self, kind, name, attrs, closed) -> None:
        if kind == "text" and not name.strip(BLANKS):
            return
        if kind == "start":
            if name == "html":
                self.merged(self.html, attrs)
                return
            if name in ("script", "style", "noframes", "title"):
                self.raw(name, attrs)
                return
            if name == "template":
                self.open(name, attrs)
                self.active.append(None)
                self.mode = "in_template"
                self.templates.append(self.mode)
                return
            if name in HEAD:
                self.void(name, attrs)
                return
            if name == "noscript" and self.mode == "in_head":
                self.open(name, attrs)
                self.mode = "in_noscript"
                return
            if name == "head":
                return
        elif kind == "end":
            if name == "template":
                if self.within({"template"}, frozenset()):
                    while self.current.tag in IMPLIED | PARTS:
                        self.stack.pop()
                    self.pop_to("template")
                    self.clear_to_marker()
                    self.templates.pop()
                    self.reset()
                return
            if name not in ("head", "body", "html", "br"):
                return
        if self.mode != "in_head":
            return
        self.stack, self.mode = [self.html], "after_head"
        if kind != "end" or name != "head":
            self.process(kind, name, attrs, closed)

    def in_noscript(self, kind, name, attrs, closed) -> None:
        if kind == "text" and not name.strip(BLANKS) or kind == "start" and name in ("basefont", "bgsound", "link", "meta", "noframes", "style"):
            self.in_head(kind, name, attrs, closed)
        elif kind == "end" and name == "noscript":
            self.stack.pop()
            self.mode = "in_head"
        elif not (kind == "start" and name in ("head", "noscript") or kind == "end" and name != "br"):
            self.stack.pop()
            self.mode = "in_head"
            self.process(kind, name, attrs, closed)

    def after_head(self, kind, name, attrs, closed) -> None:
        if kind == "text" and not name.strip(BLANKS):
            return
        if kind == "start":
            if name == "html":
                self.merged(self.html, attrs)
                return
            if name == "body":
                self.merged(self.body, attrs)
                self.to_body()
                return
            if name in HEAD:
                self.stack.append(self.head)
                self.in_head(kind, name, attrs, closed)
                self.drop(self.stack, self.head)
                return
            if name in ("head", "frameset"):
                return
        elif kind == "end":
            if name == "template":
                self.in_head(kind, name, attrs, closed)
                return
            if name not in ("body", "html", "br"):
                return
        self.to_body()
        self.process(kind, name.lstrip(BLANKS) if kind == "text" else name, attrs, closed)

    def text(self, kind, name, attrs, closed) -> None:
        if kind == "text":
            self.current.add(name)
        else:
            self.stack.pop()
            self.mode = self.after_text

    # ---- the body

    def in_body(self, kind, name, attrs, closed) -> None:
        if kind == "text":
            self.reopen()
            self.put(name)
        elif kind == "start":
            self.start(name, attrs, closed)
        else:
            self.end(name)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag == "html" or tag == "body":
            if not self.templates:
                self.merged(self.html if tag == "html" else self.body, attrs)
        elif tag in HEAD:
            self.in_head("start", tag, attrs, closed)
        elif tag in PARTS or tag in ("frame", "frameset", "head"):
            return
        elif tag in BLOCKS or tag in HEADINGS or tag in ("pre", "listing"):
            self.close_p()
            if tag in HEADINGS and self.current.tag in HEADINGS:
                self.stack.pop()
            self.open(tag, attrs)
            self.newline = tag in ("pre", "listing")
        elif tag == "form":
            if self.form is None or self.templates:
                self.close_p()
                node = self.open(tag, attrs)
                self.form = self.form if self.templates else node
        elif tag in ("li", "dd", "dt"):
            same = {"li"} if tag == "li" else {"dd", "dt"}
            for node in reversed(self.stack):
                if node.tag in same:
                    self.close(node.tag, but=node.tag)
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
            self.close_p()
            self.open(tag, attrs)
        elif tag == "plaintext":
            self.close_p()
            self.open(tag, attrs)
            self.tokens.raw = tag
        elif tag == "button":
            if self.within({"button"}):
                self.close("button")
            self.reopen()
            self.open(tag, attrs)
        elif tag in FORMATTING:
            if tag == "a":
                before = None
                for node in reversed(self.active):
                    if node is None or node.tag == "a":
                        before = node
                        break
                if before is not None:
                    self.adopt("a")
                    self.drop(self.active, before)
                    self.drop(self.stack, before)
            self.reopen()
            if tag == "nobr" and self.within({"nobr"}):
                self.adopt("nobr")
                self.reopen()
            self.activate(self.open(tag, attrs))
        elif tag in ("applet", "marquee", "object"):
            self.reopen()
            self.open(tag, attrs)
            self.active.append(None)
        elif tag == "table":
            if not self.tokens.quirks:
                self.close_p()
            self.open(tag, attrs)
            self.mode = "in_table"
        elif tag in ("area", "br", "embed", "image", "img", "input", "keygen", "wbr"):
            self.reopen()
            self.void("img" if tag == "image" else tag, attrs)
        elif tag in ("param", "source", "track"):
            self.void(tag, attrs)
        elif tag == "hr":
            self.close_p()
            self.void(tag, attrs)
        elif tag in ("textarea", "xmp", "iframe", "noembed"):
            if tag == "xmp":
                self.close_p()
                self.reopen()
            self.raw(tag, attrs)
            self.newline = tag == "textarea"
        elif tag == "select":
            self.reopen()
            self.open(tag, attrs)
            self.mode = "in_select_in_table" if self.mode in ("in_table", "in_caption", "in_table_body", "in_row", "in_cell") else "in_select"
        elif tag in ("optgroup", "option"):
            if self.current.tag == "option":
                self.stack.pop()
            self.reopen()
            self.open(tag, attrs)
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self.within({"ruby"}):
                self.imply("rtc" if tag in ("rp", "rt") else "")
            self.open(tag, attrs)
        else:
            self.reopen()
            self.open(tag, attrs, tag if tag in ("svg", "math") else "")
            if closed and self.current.space:
                self.stack.pop()

    def end(self, tag: str) -> None:
        if tag == "template":
            self.in_head("end", tag, {}, False)
        elif tag in ("body", "html"):
            if self.within({"body"}):
                self.mode = "after_body"
        elif tag == "p":
            if not self.within({"p"}, BUTTON_SCOPE):
                self.open("p")
            self.close("p", but="p")
        elif tag in BLOCKS or tag in ("button", "listing", "pre"):
            if self.within({tag}):
                self.close(tag)
        elif tag == "form":
            node = self.form
            if self.templates:
                if self.within({"form"}):
                    self.close("form")
                return
            self.form = None
            if node is not None and self.has(self.stack, node) and self.within({"form"}):
                self.imply()
                self.drop(self.stack, node)
        elif tag in ("li", "dd", "dt"):
            if self.within({tag}, ITEM_SCOPE if tag == "li" else SCOPE):
                self.close(tag, but=tag)
        elif tag in HEADINGS:
            if self.within(HEADINGS):
                self.close(*HEADINGS)
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in ("applet", "marquee", "object"):
            if self.within({tag}):
                self.close(tag)
                self.clear_to_marker()
        elif tag == "br":
            self.start("br", {}, False)
        else:
            self.other_end(tag)

    def after_body(self, kind, name, attrs, closed) -> None:
        if kind == "text" and not name.strip(BLANKS):
            self.in_body(kind, name, attrs, closed)
        elif not (kind == "end" and name == "html"):
            self.mode = "in_body"
            self.process(kind, name, attrs, closed)

    # ---- tables

    def fostered(self, kind, name, attrs, closed) -> None:
        self.foster = True
        self.in_body(kind, name, attrs, closed)
        self.foster = False

    def again(self, mode: str, *token) -> None:
        self.mode = mode
        self.process(*token)

    def in_table(self, kind, name, attrs, closed) -> None:
        token = (kind, name, attrs, closed)
        if kind == "text":
            if name.strip(BLANKS) or self.current.tag not in FOSTERED:
                self.fostered(*token)
            else:
                self.put(name)
        elif kind == "start" and name in PARTS:
            self.back_to("table")
            if name == "caption":
                self.active.append(None)
                self.open(name, attrs)
                self.mode = "in_caption"
            elif name == "colgroup" or name == "col":
                self.open("colgroup", attrs if name == "colgroup" else {})
                self.mode = "in_colgroup"
                if name == "col":
                    self.process(*token)
            elif name in BODIES:
                self.open(name, attrs)
                self.mode = "in_table_body"
            else:
                self.open("tbody")
                self.again("in_table_body", *token)
        elif name == "table":
            if self.within({"table"}, TABLE_SCOPE):
                self.pop_to("table")
                self.reset()
                if kind == "start":
                    self.process(*token)
        elif name in ("style", "script") and kind == "start" or name == "template":
            self.in_head(*token)
        elif kind == "start" and name == "input" and attrs.get("type", "").lower() == "hidden":
            self.void(name, attrs)
        elif kind == "start" and name == "form":
            if self.form is None and not self.templates:
                self.form = self.open(name, attrs)
                self.stack.pop()
        elif not (kind == "end" and (name in PARTS or name in ("body", "html"))):
            self.fostered(*token)

    def in_caption(self, kind, name, attrs, closed) -> None:
        ends = kind == "end" and name == "caption"
        if ends or kind == "start" and name in PARTS or kind == "end" and name == "table":
            if self.within({"caption"}, TABLE_SCOPE):
                self.close("caption")
                self.clear_to_marker()
                self.mode = "in_table"
                if not ends:
                    self.process(kind, name, attrs, closed)
        elif not (kind == "end" and (name in PARTS or name in ("body", "html"))):
            self.in_body(kind, name, attrs, closed)

    def in_colgroup(self, kind, name, attrs, closed) -> None:
        if kind == "text" and not name.strip(BLANKS):
            self.put(name)
        elif kind == "start" and name == "col":
            self.void(name, attrs)
        elif name == "template":
            self.in_head(kind, name, attrs, closed)
        elif not (kind == "end" and name == "col") and self.current.tag == "colgroup":
            self.stack.pop()
            self.mode = "in_table"
            if not (kind == "end" and name == "colgroup"):
                self.process(kind, name, attrs, closed)

    def in_table_body(self, kind, name, attrs, closed) -> None:
        if kind == "start" and name in ("tr", "td", "th"):
            self.back_to(*BODIES)
            self.open("tr", attrs if name == "tr" else {})
            self.mode = "in_row"
            if name != "tr":
                self.process(kind, name, attrs, closed)
        elif kind == "end" and name in BODIES:
            if self.within({name}, TABLE_SCOPE):
                self.back_to(*BODIES)
                self.stack.pop()
                self.mode = "in_table"
        elif kind == "start" and name in PARTS or kind == "end" and name == "table":
            if self.within(BODIES, TABLE_SCOPE):
                self.back_to(*BODIES)
                self.stack.pop()
                self.again("in_table", kind, name, attrs, closed)
        elif not (kind == "end" and (name in PARTS or name in ("body", "html"))):
            self.in_table(kind, name, attrs, closed)

    def in_row(self, kind, name, attrs, closed) -> None:
        ends = kind == "end" and name == "tr"
        if kind == "start" and name in ("td", "th"):
            self.back_to("tr")
            self.open(name, attrs)
            self.active.append(None)
            self.mode = "in_cell"
        elif ends or kind == "start" and name in PARTS or kind == "end" and (name == "table" or name in BODIES and self.within({name}, TABLE_SCOPE)):
            if self.within({"tr"}, TABLE_SCOPE):
                self.back_to("tr")
                self.stack.pop()
                self.mode = "in_table_body"
                if not ends:
                    self.process(kind, name, attrs, closed)
        elif not (kind == "end" and (name in PARTS or name in ("body", "html"))):
            self.in_table(kind, name, attrs, closed)

    def in_cell(self, kind, name, attrs, closed) -> None:
        if kind == "end" and name in ("td", "th"):
            if self.within({name}, TABLE_SCOPE):
                self.close(name)
                self.clear_to_marker()
                self.mode = "in_row"
        elif kind == "start" and name in PARTS or kind == "end" and (name in FOSTERED and self.within({name}, TABLE_SCOPE)):
            if self.within({"td", "th"}, TABLE_SCOPE):
                self.close("td", "th")
                self.clear_to_marker()
                self.again("in_row", kind, name, attrs, closed)
        elif not (kind == "end" and (name in PARTS or name in FOSTERED or name in ("body", "html"))):
            self.in_body(kind, name, attrs, closed)

    # ---- selects, templates, foreign elements

    def in_select(self, kind, name, attrs, closed) -> None:
        if kind == "text":
            self.put(name)
        elif kind == "start" and name in ("option", "optgroup", "hr"):
            if self.current.tag == "option":
                self.stack.pop()
            if name != "option" and self.current.tag == "optgroup":
                self.stack.pop()
            self.open(name, attrs)
            if name == "hr":
                self.stack.pop()
        elif kind == "end" and name in ("option", "optgroup"):
            if name == "optgroup" and self.current.tag == "option" and self.stack[-2].tag == "optgroup":
                self.stack.pop()
            if self.current.tag == name:
                self.stack.pop()
        elif name == "select" or kind == "start" and name in ("input", "keygen", "textarea"):
            self.pop_to("select")
            self.reset()
            if name != "select":
                self.process(kind, name, attrs, closed)
        elif name == "template" or kind == "start" and name == "script":
            self.in_head(kind, name, attrs, closed)

    def in_select_in_table(self, kind, name, attrs, closed) -> None:
        if kind != "text" and name in FOSTERED | {"caption", "td", "th"}:
            if kind == "start" or self.within({name}, TABLE_SCOPE):
                self.pop_to("select")
                self.reset()
                self.process(kind, name, attrs, closed)
        else:
            self.in_select(kind, name, attrs, closed)

    def in_template(self, kind, name, attrs, closed) -> None:
        if kind == "text":
            self.in_body(kind, name, attrs, closed)
        elif kind == "end" or name in HEAD:
            if kind == "start" or name == "template":
                self.in_head(kind, name, attrs, closed)
        else:
            mode = {"col": "in_colgroup", "tr": "in_table_body", "td": "in_row", "th": "in_row"}.get(name, "in_table" if name in PARTS else "in_body")
            self.templates[-1] = mode
            self.again(mode, kind, name, attrs, closed)

    def reset(self) -> None:
        """The mode that goes with what is open."""
        modes = {"td": "in_cell", "th": "in_cell", "tr": "in_row", "tbody": "in_table_body", "tfoot": "in_table_body", "thead": "in_table_body", "caption": "in_caption", "colgroup": "in_colgroup", "table": "in_table", "head": "in_head", "body": "in_body", "html": "after_head"}
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[k].tag
            if tag == "select":
                self.mode = "in_select_in_table" if any(n.tag == "table" for n in self.stack[:k]) else "in_select"
                return
            if tag == "template":
                self.mode = self.templates[-1]
                return
            if tag in modes:
                self.mode = modes[tag]
                return

    def in_foreign(self, kind: str, name: str) -> bool:
        node = self.current
        if not node.space:
            return False
        if kind != "end":
            if node.space == "math" and node.tag in TEXT_POINTS and not (kind == "start" and name in ("mglyph", "malignmark")):
                return False
            if node.space == "svg" and node.tag in ("foreignObject", "desc", "title"):
                return False
            if node.tag == "annotation-xml" and (kind == "start" and name.lower() == "svg" or node.attrs.get("encoding", "").lower() in ("text/html", "application/xhtml+xml")):
                return False
        return True

    def foreign(self, kind: str, name: str, attrs: dict[str, str], closed: bool) -> None:
        lower = name.lower() if kind != "text" else ""
        if kind == "text":
            self.put(name)
        elif kind == "start" and (lower in BREAKS_OUT or lower == "font" and {"color", "face", "size"} & set(attrs)) or kind == "end" and lower in ("br", "p"):
            while self.current.space and self.current.tag not in ("foreignObject", "desc", "title") and self.current.tag not in TEXT_POINTS:
                self.stack.pop()
            getattr(self, self.mode)(kind, lower, attrs, closed)
        elif kind == "start":
            self.open(name, attrs, self.current.space)
            if closed:
                self.stack.pop()
        else:
            for k in range(len(self.stack) - 1, 0, -1):
                if not self.stack[k].space:
                    getattr(self, self.mode)(kind, lower, attrs, closed)
                    return
                if self.stack[k].tag.lower() == lower:
                    del self.stack[k:]
                    return


def parsed(source: str) -> Node:
    """The html element of a page, whose children are its head and its body."""
    return Tree(source).html
