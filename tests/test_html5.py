"""Trees of pages: what the standard makes of misnested, unclosed and misplaced markup."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions.html5 import VOID, Tokens, parsed
from quire.operators import pages as P


def shown(node):
    if isinstance(node, str):
        return node
    return f"<{node.tag}" + "".join(f' {k}="{v}"' for k, v in node.attrs.items()) + ">" + "".join(map(shown, node.children)) + ("" if node.tag in VOID else f"</{node.tag}>")


def body(source):
    return "".join(map(shown, parsed(source).children[1].children))


CELL = "<table><tbody><tr><td>{}</td></tr></tbody></table>"


@pytest.mark.parametrize(("source", "want"), [
    # what stands loose in a table goes before it
    ("<table>lost<tr><td>1</table>", "lost" + CELL.format("1")), ("<table><p>a<tr><td>1</table>b", "<p>a</p>" + CELL.format("1") + "b"), ("<table> <tr><td>1</table>", "<table> <tbody><tr><td>1</td></tr></tbody></table>"),
    ("<table><tr>x<td>1</table>", "x" + CELL.format("1")), ("<b><table>t<td>u</b></table>v", "<b>t" + CELL.format("u") + "v</b>"), ("<table><b>x<tr><td>y</table>z", "<b>x</b><table><tbody><tr><td>y</td></tr></tbody></table><b>z</b>"),
    ("<div><table><div>a</table>", "<div><div>a</div><table></table></div>"), ("<table><input type=hidden><input><tr></table>", '<input><table><input type="hidden"><tbody><tr></tr></tbody></table>'),
    # implied parts of tables
    ("<table><td>1<td>2", "<table><tbody><tr><td>1</td><td>2</td></tr></tbody></table>"), ("<table><col><tr><td>1", "<table><colgroup><col></colgroup><tbody><tr><td>1</td></tr></tbody></table>"), ("<table><caption>c<p>d<tr><th>1", "<table><caption>c<p>d</p></caption><tbody><tr><th>1</th></tr></tbody></table>"),
    ("<table><thead><tr><td>1<tbody><tr><td>2<tfoot><td>3</table>", "<table><thead><tr><td>1</td></tr></thead><tbody><tr><td>2</td></tr></tbody><tfoot><tr><td>3</td></tr></tfoot></table>"), ("<table><tr><td>1</tr></tbody>x</table>", "x" + CELL.format("1")),
    ("<table><tr><td><table><tr><td>1</table>2</table>3", CELL.format(CELL.format("1") + "2") + "3"), ("<table><tr><td>a<table>b", CELL.format("ab<table></table>")), ("<table>a<table>b", "a<table></table>b<table></table>"), ("<td>a</td>b", "ab"), ("<table><tr><td>a</div>b</span>c</table>", CELL.format("abc")),
    ("<!doctype html><p>a<table></table>", "<p>a</p><table></table>"), ("<p>a<table></table>", "<p>a<table></table></p>"), ("<!doctype html public '-//W3C//DTD HTML 4.01//EN' 'x'><p>a<table></table>", "<p>a</p><table></table>"), ("<!doctype html public '-//W3C//DTD HTML 4.01 Transitional//EN'><p>a<table></table>", "<p>a<table></table></p>"),
    # formatting that ends within blocks it holds, or begins in them
    ("<b><p>a</b>b</p>", "<b></b><p><b>a</b>b</p>"), ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"), ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"), ("<p><b>a<p>b</b>c", "<p><b>a</b></p><p><b>b</b>c</p>"),
    ("<b><i><p>x</b>y</i>z", "<b><i></i></b><i></i><p><i><b>x</b>y</i>z</p>"),
    ("<a>x<div>y<a>z", "<a>x</a><div><a>y</a><a>z</a></div>"), ("<a href=1>x<table><tr><td><a href=2>y</a></table>z", '<a href="1">x<table><tbody><tr><td><a href="2">y</a></td></tr></tbody></table>z</a>'), ("<a>1<a>2</a>3</a>", "<a>1</a><a>2</a>3"), ("<nobr>a<nobr>b", "<nobr>a</nobr><nobr>b</nobr>"),
    ("<b><b><b><b><b>x</b></b></b></b></b><p>y", "<b><b><b><b><b>x</b></b></b></b></b><p>y</p>"), ("<p><b><b><b><b>x<p>y", "<p><b><b><b><b>x</b></b></b></b></p><p><b><b><b>y</b></b></b></p>"), ("<i>a</b>b</i>", "<i>ab</i>"), ("<object><b>x</object>y</b>z", "<object><b>x</b></object>yz"), ("<b>a<object></b>c</object>d", "<b>a<object>c</object>d</b>"),
    # paragraphs, lists, headings
    ("<p>a<p>b", "<p>a</p><p>b</p>"), ("a</p>b", "a<p></p>b"), ("<p>a<div>b</p>c</div>", "<p>a</p><div>b<p></p>c</div>"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"), ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"), ("<li><div><li>x", "<li><div></div></li><li>x</li>"), ("<li><blockquote><li>x", "<li><blockquote><li>x</li></blockquote></li>"), ("<li><p>a<li>b", "<li><p>a</p></li><li>b</li>"),
    ("<h1>a<h2>b</h1>c", "<h1>a</h1><h2>b</h2>c"), ("<h1>a<p>b</h2>c", "<h1>a<p>b</p></h1>c"), ("<pre>\n\na</pre>", "<pre>\na</pre>"), ("<p>a<hr>b", "<p>a</p><hr>b"), ("a</br>b", "a<br>b"), ("<image src=x>", '<img src="x">'), ("<div>a</span>b</div>", "<div>ab</div>"), ("<ruby>a<rt>b<rp>c</ruby>", "<ruby>a<rt>b</rt><rp>c</rp></ruby>"),
    # what can't be nested
    ("<button>a<button>b", "<button>a</button><button>b</button>"), ("<form>a<form>b</form>c</form>d", "<form>ab</form>cd"), ("<form><div></form>a</div>b", "<form><div>a</div></form>b"), ("<select><option>a<option>b<div>c</select>d", "<select><option>a</option><option>bc</option></select>d"), ("<select><optgroup><option>a<optgroup>b", "<select><optgroup><option>a</option></optgroup><optgroup>b</optgroup></select>"), ("<select>a<input>b", "<select>a</select><input>b"), ("<select><select>a", "<select></select>a"), ("<table><tr><td><select>a<td>b", "<table><tbody><tr><td><select>a</select></td><td>b</td></tr></tbody></table>"),
    # texts that hold no markup
    ("<textarea>\n<b>&amp;</textarea>x", "<textarea><b>&</textarea>x"), ("x<script>if (a < b) '</p>'</script>y", "x<script>if (a < b) '</p>'</script>y"), ("x<style>a{}</styles></style>y", "x<style>a{}</styles></style>y"), ("x<title>&lt;<i></title>y", "x<title><<i></title>y"), ("<xmp><b>&amp;</xmp>x", "<xmp><b>&amp;</xmp>x"), ("a<plaintext></plaintext>b", "a<plaintext></plaintext>b</plaintext>"),
    # tokens
    ("a<!--x-->b<!---->c<!-->d<!--e--!>f", "abcdf"), ("a<?php x ?>b<!x>c</>d</ x>e", "abcde"), ("a < b <3 <", "a < b <3 <"), ("a<b", "a"), ("<p title='a\"b' title=c ID=x y = z/>q", '<p title="a"b" id="x" y="z/">q</p>'), ("<p =a b>q", '<p =a="" b="">q</p>'), ("<p a='1>q", ""), ("&copy &notit; &amp;amp; &#x41;&#0;&bogus;", "© ¬it; &amp; A�&bogus;"), ("<a href='?a&copy=1&lt;&amp'>x", '<a href="?a&copy=1<&">x</a>'),
    # templates and foreign elements
    ("x<template><tr><td>y</template>z", "x<template><tr><td>y</td></tr></template>z"), ("<svg viewBox='0 0 1 1'><path d=x /><title>t<b>u</b></title></svg>v", '<svg viewBox="0 0 1 1"><path d="x"></path><title>t<b>u</b></title></svg>v'), ("<svg><g><p>out", "<svg><g></g></svg><p>out</p>"), ("<math><mi>x<b>y</b></mi></math>z", "<math><mi>x<b>y</b></mi></math>z"), ("<svg><![CDATA[a<b]]></svg>", "<svg>a<b</svg>"), ("a<div/>b", "a<div>b</div>"), ("<svg><foreignObject><p>a</p></foreignObject></svg>b", "<svg><foreignObject><p>a</p></foreignObject></svg>b"), ("<svg><foreignObject><p>a</foreignObject></svg>b", "<svg><foreignObject><p>ab</p></foreignObject></svg>"),
])
def test_bodies(source, want):
    assert body(source) == want


@pytest.mark.parametrize(("source", "want"), [
    ("", "<html><head></head><body></body></html>"), ("x", "<html><head></head><body>x</body></html>"), ("<title>a</title>b", "<html><head><title>a</title></head><body>b</body></html>"), ("<link><p>x<link>", "<html><head><link></head><body><p>x<link></p></body></html>"),
    ("<html lang=a><body class=b><html lang=c dir=d><body class=e id=f>x</body>y</html>z", '<html lang="a" dir="d"><head></head><body class="b" id="f">xyz</body></html>'), ("</p><head a=1><meta></head><style>s</style><base>x", '<html><head a="1"><meta><style>s</style><base></head><body>x</body></html>'),
    ("<frameset><frame></frameset>", "<html><head></head><body></body></html>"), ("<noscript><link><p>x</noscript>y", "<html><head><noscript><link></noscript></head><body><p>xy</p></body></html>"), ("<!doctype html>\n <head> <title>t</title> </head> <body> x </body> ", "<html><head><title>t</title></head><body> x  </body></html>"),
])
def test_documents(source, want):
    assert shown(parsed(source)) == want


PIECES = ["<p>", "</p>", "<b>", "</b>", "<i x=1>", "</i>", "<a href=q>", "</a>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<h1>", "</h2>", "<button>", "<form>", "</form>", "<object>", "</object>", "<br>", "<img>", "<svg>", "<g/>", "</svg>", "<!--c-->", "x", " y ", "&amp;", "</body>", "<nobr>", "<math>", "<mi>", "</html>"]
TABLES = ["<table>", "</table>", "<tr>", "<td>", "</td>", "<caption>", "<col>", "<tbody>", "</tr>", "<select>", "<option>", "</select>", "<template>", "</template>", "<style>", "</style>", "<title>", "<head>", "<frameset>", "<textarea>", "<script>", "</script>", "<input type=hidden>", "<plaintext>", "<![CDATA[", "<", "</", "'>"]


def whole(root):
    assert [c.tag for c in root.children] == ["head", "body"]
    nodes = list(root.walk())
    assert sum(n.tag in ("html", "head", "body") and not n.space for n in nodes) == 3 and len({id(n) for n in nodes}) == len(nodes)
    assert all(c.parent is n for n in nodes for c in n.children if not isinstance(c, str))
    assert not any(isinstance(a, str) and isinstance(b, str) for n in nodes for a, b in zip(n.children, n.children[1:]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES + TABLES), max_size=40))
def test_any_input_is_one_page(pieces):
    whole(parsed("".join(pieces)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40))
def test_texts_stay_in_order_outside_tables(pieces):
    source = "".join(pieces)
    root = parsed(source)
    whole(root)
    texts = "".join(name for kind, name, *_ in Tokens(source) if kind == "text")
    assert re.sub(r"\s", "", root.text()) == re.sub(r"\s", "", texts)


@settings(max_examples=200, deadline=None)
@given(st.text("<>/!-='\"& ab\n\0é", max_size=60))
def test_any_characters(source):
    whole(parsed(source))


def test_a_sound_page_is_parsed_to_itself():
    rng = random.Random(3)

    def block(depth):
        kind = rng.choice(("p", "blockquote", "ul", "table")) if depth else "p"
        if kind == "p":
            return "<p>" + "".join(rng.choice(("x", "<b>y</b>", "<br>", '<a href="z"><i>w</i></a>')) for _ in range(3)) + "</p>"
        inner = "".join(block(depth - 1) for _ in range(rng.randint(1, 3)))
        return {"blockquote": f"<blockquote>{inner}</blockquote>", "ul": f"<ul><li>{inner}</li></ul>", "table": f"<table><tbody><tr><td>{inner}</td></tr></tbody></table>"}[kind]

    for _ in range(100):
        source = block(4)
        assert body("<!doctype html>" + source) == source


def test_long_pages():
    assert len(list(parsed("<b>" * 3000 + "x").walk())) == 3003
    assert parsed("<div>" * 3000 + "y").text() == "y"
    assert parsed("<p>" * 100_000).children[1].children[-1].tag == "p"
    assert len(body("<table>" + "a<b>c" * 300)) > 600
    assert parsed("&" * 200_000).text() == "&" * 200_000 and parsed("<" * 200_000).text() == "<" * 200_000


def test_census_counts_the_tree():
    html = "<!doctype html><table><a href=1>l</a><tr><td><img><h2>h<h3>i</table><blockquote><li>a<li>b</blockquote><a>no</a>"
    assert P.census(parsed(html)) == [1, 1, 2, 2, 1, 1]
    got = P.sanitised_page(html, P.Options())
    assert got["survived"] == got["arrived"] == [1, 1, 2, 2, 1, 1]
    assert '<div><a href="1">l</a></div><table>' in got["xhtml"] and "</blockquote>" in got["xhtml"]
