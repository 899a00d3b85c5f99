"""HTML text: broken tables, heads and visibility, bounded padding, and random pages against a reference of their own."""

import random
import re

import pytest
from pyspark.sql import functions as F

from riskframes.llm import html_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><form><tr><td>inside form</td></tr></form></table>", "inside form"),
        ("<table><tr><form><td>cell</form><td>b</table>", "cell  b"),
        ("<table>loose<tr><td>x</table>", "loose\n\nx"),
        ("<table><tr>stray<td>x</table>", "stray\n\nx"),
        ("<table><div>divtext</div><tr><td>x</table>", "divtext\n\nx"),
        ("<table><tr><td>x</td><p>late<tr><td>y</table>z", "late\n\nx\ny\n\nz"),
        ("<table><tr><td>a</td><table><tr><td>second</table>", "a\n\nsecond"),
        ("<table><tr><td>a<table><tr><td>n</table>b</table>", "a\n\nn\n\nb"),
        ("<table><tbody><td>a<td>b<tfoot><tr><td>c</table>", "a  b\nc"),
        ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span>no</div>", "yes"),
        ("<div style='display:none'>no<span style='visibility:visible;display:block'>no</span></div>a", "a"),
        ("<p style='backface-visibility:hidden'>seen<p hidden style='display:block'>too<p style='display:none;display:block'>three", "seen\n\ntoo\n\nthree"),
        ("<table><tr style='visibility:collapse'><td>no<td style='visibility:visible'>yes<tr><td>aa<td>b</table>", "    yes\naa  b"),
        ("<table><tr><td>a<td rowspan=2>b<tr><td>c<tr><td>d<td>e</table>", "a  b\nc\nd  e"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
        ("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c<tr><td>d<td>e<td>f</table>", "a     b\n      c\nd  e  f"),
        ("<head><title>T</title><p>Hello", "Hello"),
        ("<head><title>T</title>Hello", "Hello"),
        ("<head><noscript>no</noscript><meta name=x><body>Hello", "Hello"),
        ("<p title=don't>rest of page<p a='x>y'>z", "rest of page\n\nz"),
        ("<p title=\"a>b\" data-x = 'c>d' e=>z", "z"),
        ("x<svg><title>no</title><text>yes</text></svg><math><mi>m</mi></math>", "xyesm"),
    ],
)
def test_pages(page, text):
    assert html_text.visible_text(page) == text


def test_padding_is_bounded():
    long = "<table><tr><td>" + "x" * 20000 + "".join(f"<tr><td>{k}<td>b" for k in range(200)) + "</table>"
    assert len(html_text.visible_text(long)) < 2 * len(long)
    hang = "<table><tr>" + "".join(f"<td rowspan=65534>{'y' * 60}" for _ in range(300)) + "".join(f"<tr><td>{k}" for k in range(2000)) + "</table>"
    out = html_text.visible_text(hang)
    assert len(out) < 6 * len(hang) and all(str(k) in out for k in range(2000))
    wide = "<table>" + "".join(f"<tr><td colspan=1000>{k}<td>b" for k in range(500)) + "</table>"
    assert len(html_text.visible_text(wide)) < 2 * len(wide)
    lines = "<table><tr>" + f"<td>{'z' * 70}" * 90 + "<td>" + "q<br>" * 2000 + "</table>"
    assert len(html_text.visible_text(lines)) < 8 * len(lines)


def test_deep_tables_keep_their_text():
    page = "<table><tr><td>a" * 60 + "deep" + "</table>" * 60
    assert html_text.visible_text(page).split() == ["a"] * 59 + ["adeep"]


class Page:
    """A random page, written with optional end tags left out at random, beside the words that it shows."""

    def __init__(self, seed):
        self.r, self.n, self.out, self.words = random.Random(seed), 0, [], []
        if self.r.random() < 0.5:
            self.out.append("<!DOCTYPE html><html><head><title>wt</title><style>p{}</style>" + self.r.choice(["", "</head>", "</head><body>", "<body>"]))
        self.blocks(0, True)

    def word(self, shown):
        self.n += 1
        if shown:
            self.words.append(f"w{self.n}")
        return f"w{self.n}"

    def inline(self, depth, seen, shown=True):
        for _ in range(self.r.randint(1, 3)):
            kind = self.r.randrange(8)
            if kind < 4 or depth > 5:
                self.out.append(" " + self.word(seen and shown) + " ")
                continue
            style, s, d = self.r.choice([("", seen, shown), (" style='visibility: hidden'", False, shown), (' style="color:red;visibility:visible"', True, shown), (" style=display:none", seen, False), (" hidden", seen, False)])
            name = self.r.choice(["b", "i", "span", "em"])
            self.out.append(f"<{name}{style}>")
            self.inline(depth + 1, s, d)
            self.out.append(f"</{name}>")
            if self.r.random() < 0.2:
                self.out.append("<script>var w0 = '<p>';</script><!-- w0 <b> -->")

    def blocks(self, depth, seen, shown=True):
        for _ in range(self.r.randint(1, 3)):
            kind = self.r.randrange(6)
            style, s, d = self.r.choice([("", seen, shown)] * 3 + [(" style='visibility:hidden'", False, shown), (" style='visibility: visible'", True, shown), (" hidden", seen, False)])
            if kind == 0 or depth > 4:
                self.out.append(f"<p{style}>")
                self.inline(depth, s, d)
                self.out.append(self.r.choice(["", "</p>"]) if style == "" else "</p>")
            elif kind == 1:
                self.out.append(f"<div{style}>")
                self.blocks(depth + 1, s, d)
                self.out.append("</div>")
            elif kind == 2:
                self.out.append(f"<ul{style}>")
                for _ in range(self.r.randint(1, 3)):
                    self.out.append("<li>")
                    self.inline(depth, s, d)
                    if self.r.random() < 0.3:
                        self.blocks(depth + 2, s, d)
                    self.out.append(self.r.choice(["", "</li>"]))
                self.out.append("</ul>")
            elif kind == 3:
                self.out.append(f"<table{style}>")
                if self.r.random() < 0.3:
                    self.out.append("<caption>")
                    self.inline(depth, s, d)
                    self.out.append("</caption>")
                for _ in range(self.r.randint(1, 4)):
                    self.out.append(self.r.choice(["", "<tbody>"]) + "<tr>")
                    for _ in range(self.r.randint(1, 4)):
                        self.out.append(self.r.choice(["<td>", "<th>", "<td colspan=2>", "<td rowspan=2>"]))
                        self.inline(depth, s, d)
                        self.out.append(self.r.choice(["", "</td>"]))
                    self.out.append(self.r.choice(["", "</tr>"]))
                self.out.append("</table>")
            elif kind == 4:
                self.out.append(f"<dl{style}><dt>")
                self.inline(depth, s, d)
                self.out.append("<dd>")
                self.inline(depth, s, d)
                self.out.append("</dl>")
            else:
                self.out.append(f"<h2{style}>")
                self.inline(depth, s, d)
                self.out.append("</h2>")


def test_random_pages_show_all_visible_words_and_no_others():
    for seed in range(1500):
        page = Page(seed)
        html = "".join(page.out)
        got = html_text.visible_text(html)
        assert re.findall(r"w\w+", got) == page.words, html


def test_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(1, "<p>a", "x", "y")], "page_id long, html string, text string, n_chars string")
    assert [tuple(r) for r in html_text.extract(df).collect()] == [(1, "a", 1)]
    assert html_text.extract(df.select(F.col("text").alias("kind"), "page_id", "html"), keep=("kind",)).columns == ["page_id", "kind", "text", "n_chars"]
