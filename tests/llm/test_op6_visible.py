"""HTML layout against words that a generator knows to be visible, and pages that would take a slow reader forever."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandwork.llm import op6_html

INLINE, BLOCK = ["b", "i", "span", "a", "em"], ["div", "section", "article", "blockquote", "p", "h2", "ul", "ol", "table", "pre", "unknown-tag"]
HIDING = ["<{0} hidden>", "<{0} style='color:red; display: none'>", "<{0} class='x gone y'>", '<{0} id="off" title="a > b">']


def made(rng, depth, words, shown=True):
    """A random element; `words` takes those that show."""
    word = f"w{rng.randrange(10**6)}"
    if depth == 0 or rng.random() < 0.2:
        if shown:
            words.append(word)
        return rng.choice([word, f" {word} ", f"{word}<!-- <b> no -->", f"{word}<br>"]) + " "
    tag = rng.choice(INLINE if rng.random() < 0.3 else BLOCK)
    hidden = rng.random() < 0.15
    shown = shown and not hidden
    start = (rng.choice(HIDING) if hidden else rng.choice(["<{0}>", "<{0} class=other data-x='<b>'>", "<{0}\n id = z >"])).format(tag)
    inner = lambda: made(rng, depth - 1, words, shown)
    many = range(rng.randrange(1, 4))
    if tag in ("ul", "ol"):
        body = "".join(f"<li>{inner()}" + rng.choice(["", "</li>"]) for _ in many)
    elif tag == "table":
        body = "".join("<tr>" + "".join(f"<td>{inner()}" for _ in many) for _ in many)
    elif tag in ("p", "h2"):  # a block inside would end it
        body = "".join(made(rng, 0, words, shown) for _ in many)
    else:
        body = "".join(inner() for _ in many)
    return f"{start}{body}</{tag}>"


@pytest.mark.parametrize("seed", range(40))
def test_all_visible_words_in_no_other_number(seed):
    rng, words = random.Random(seed), []
    body = "".join(made(rng, rng.randrange(1, 7), words) for _ in range(4))
    page = f"<!doctype html><head><title>no</title><style>/* x */ .gone, #off {{ display:none }} @media print {{ div {{ display:none }} }}</style></head><body>{body}"
    got = [x.strip("-.0123456789") and x for x in op6_html.render(page)[0].split()]
    assert sorted(x for x in got if x and x.startswith("w")) == sorted(words)


@pytest.mark.parametrize("seed", range(10))
def test_columns_of_random_tables_are_aligned(seed):
    rng = random.Random(seed)
    n, m = rng.randrange(2, 8), rng.randrange(2, 6)
    cells = [["x" * rng.randrange(1, 90) if rng.random() < 0.9 else "" for _ in range(m)] for _ in range(n)]
    page = "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in cells) + "</table>"
    widths = [max(len(row[k]) for row in cells) for k in range(m)]
    want = ["  ".join(c.ljust(w) for c, w in zip(row, widths) if w).rstrip() for row in cells]
    assert op6_html.render(page)[0].split("\n") == "\n".join(want).strip("\n").split("\n")


@pytest.mark.parametrize("depth", [0, 119, 130, 5000])
def test_hidden_text_stays_hidden(depth):
    assert op6_html.render("<div>" * depth + "<div hidden>SECRET</div>vis")[0] == "vis"
    assert "SECRET" not in op6_html.render("<div hidden>" + "<div>" * depth + "SECRET" + "</div>" * depth + "</div>vis")[0]


PAGES = {
    "tags that nothing closes": "<a " * 330_000,
    "quotes that nothing closes": '<a b="' * 160_000,
    "comments that nothing closes": "<!--" * 250_000,
    "end tags beyond a table": "<span><table><tr><td>" + "<b>" * 100_000 + "</span>" * 60_000,
    "paragraphs beyond a button": "<p><button>" + "<b>" * 100_000 + "<div></div>" * 50_000,
    "one preformatted line": "<pre>" + "a<b>b</b>" * 100_000,
    "style without rules": "<style>" + "/*" * 200_000 + "a" * 400_000,
    "spans": "<table><tr>" + "<td colspan=1000 rowspan=9>x" * 20_000,
    "quotes in quotes": "<blockquote>x" * 80_000,
    "lists in lists": "<ul><li>x" * 110_000,
    "lists in lists, text inside": "<ul><li>" * 120_000 + "x",
    "answers in answers": "<dl><dd>x" * 110_000,
    "tables in tables": "<table><tr><td>x" * 60_000,
    "preformatted in preformatted": "<pre>x" * 160_000,
    "tables beside rows": "<table><div>x" * 70_000,
    "a wide head over a long table": "<table><tr>" + f"<td>{'x' * 60} y" * 500 + "<tr><td colspan=499>a<td>b" * 3_000,
    "a long word in a long table": "<table>" + f"<tr><td>{'x' * 300_000}<td>y" + "<tr><td>a<td>b" * 20_000,
}


@pytest.mark.parametrize("name", PAGES)
def test_long_pages_take_time_in_proportion(name):
    start = time.perf_counter()
    text, _ = op6_html.render(PAGES[name])
    assert time.perf_counter() - start < 20 and len(text) < 300 * len(PAGES[name])


def test_deep_indents_are_a_number():
    lines = op6_html.render("<blockquote>x" * 200)[0].split("\n")
    shown = [x for x in lines if x]
    assert len(shown) == 200 and [len(x) - 1 for x in shown[:101]] == [2 * k for k in range(1, 102)][:100] + [len(shown[100]) - 1]
    assert shown[0] == "  x" and shown[99] == " " * 200 + "x" and shown[199] == " " * 200 + "[400] x"


def test_marks_stand_before_the_first_line_of_nested_items():
    page = "<ul><li><ol start=9><li><blockquote>a<p>b</blockquote><li>c</ol><li><p hidden>no</p><li>d<p>e<table><tr><td>f<td>g</table></ul>h"
    assert op6_html.render(page)[0] == "- 9.   a\n\n       b\n  10. c\n- d\n\n  e\n\n  f  g\n\nh"
    assert op6_html.render("<ul><li><li>  <li>x</ul>")[0] == "- x" and op6_html.render("<p>a<table><tr><td><p>b<p>c<tr><td>d</table>e")[0] == "a\n\nb\n\nc\nd\n\ne"


def test_columns_are_aligned_whatever_their_widths():
    word = "x" * 5000
    lines = op6_html.render(f"<table><tr><td>{word}<td>one" + "<tr><td>a<td>two" * 2000 + "</table>")[0].split("\n")
    at = lines[0].index("one")
    assert at == op6_html.LINE // 2 + 2 and all(x.index("two") == at for x in lines[-2000:])
    assert "".join(lines[:5]).replace("one", "").replace(" ", "") == word


def test_open_tags_are_no_text():
    assert op6_html.render('<p class="a>text</p>')[0] == "" and op6_html.render("yes<b")[0] == "yes"
    assert op6_html.render("1 < 2 <3 a<b>c</b>")[0] == "1 < 2 <3 ac"
    assert op6_html.render("<span hidden/>no</span>yes")[0] == "yes"


def test_no_rows_and_repeated_rows(spark):
    pages = spark.createDataFrame([("<p>a", 1), ("<p>a", 1), (None, 1), ("x" * 500_000, 2)], "html string, page_id int")
    out = [r["t"]["text"] for r in pages.select(op6_html.extract(F.col("html")).alias("t")).collect()]
    assert out[0] == out[1] == "a" and out[2] == "" and len(out[3]) == 500_000
    assert pages.limit(0).select(op6_html.extract(F.col("html")).alias("t")).count() == 0
