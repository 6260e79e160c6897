import pytest

import corpus_pipeline
from tidemark.llm import html_text

CASES = {
    "<p>a<p>b &amp; c<br>d": "a\n\nb & c\nd",
    "<ul><li>one<li>two<ol><li>x<li>y</ol><li>three</ul>": "- one\n- two\n  1. x\n  2. y\n- three",
    "<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>": "a     bbb\ncccc  d",
    "x<script>var a='</p>'</script><style>p{}</style>y": "xy",
    "<div hidden>no</div><p style='display: none'>no</p><span aria-hidden=true>no</span>yes": "yes",
    "<pre>a\n  b</pre>": "a\n  b",
    "a   b\n\n c": "a b c",
    "<!-- no --><!DOCTYPE html><title>no</title>1 < 2": "1 < 2",
    "<b>bold<i>both</b>after": "boldbothafter",
    "": "",
    None: "",
    "<table><tr><td colspan=2>a<td>b<tr><td>cc<td>dd<td>ee</table>": "a       b\ncc  dd  ee",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>": "yes",
    "<style>.x, p.y{display:none} #z{visibility:hidden}</style><i class='q x'>no</i><p class=y>no</p><div class=y>yes</div><i id=z>no</i>": "yes",
    "<details><summary>more</summary>no<p>no</p></details>a": "more\na",
    "<details open><summary>more</summary>yes</details>a": "more\nyes\na",
    "pick <select><option>a<option selected>b<option>c</select> now": "pick b now",
    "pick <select><option>a</option><option>b</option></select> now": "pick a now",
    "<p hidden>no</p><p style='display:block' hidden>yes</p>": "yes",
    "<textarea><p>raw</textarea>": "<p>raw",
    "<style>@media print {.x{display:none}} @media screen and (max-width: 600px){.x{display:none}}</style><p class=x>seen": "seen",
    "<style>@media screen {.x{display:none}} .y{display:none}</style><p class=x>no<p class=y>no<p>yes": "yes",
    "<style media=print>p{display:none}</style><p>seen": "seen",
    "<style>@import url(a;b); @font-face{src:x} .q::before{content:'}'} .x{display:none}</style><i class=x>no</i><i class=q>yes</i>": "yes",
    "<style>@supports (display:grid){@media all{.x{display:none}} @media print{.y{display:none}}}</style><i class=x>no</i><i class=y>yes</i>": "yes",
    "<!-- <style>p{display:none}</style> --><p>seen": "seen",
    "<ol start=3><li>c<li value=9>i<li>j</ol><ol><li>a</ol>": "3. c\n9. i\n10. j\n\n1. a",
    "<textarea>hi</textarea><button>Go</button>": "hi Go",
    "<a title='>'>x</a><a title=\">y": "xy",
    "<table><tr><td><ul><li>in</ul></td><td>b</td></tr></table>end": "- in  b\n\nend",
}


@pytest.mark.parametrize("source", list(CASES))
def test_visible_text(source):
    assert html_text.visible_text(source) == CASES[source]


def test_broken_pages_do_not_crash():
    import random

    rng, parts = random.Random(3), ["<p>", "</p>", "<table>", "</table>", "<td>", "<tr>", "<li>", "<ul>", "</ul>", "<", ">", "&amp", "<!--", "-->", "<a href='x", "text ", "</td>", "<script>", "</div>", "<br/>", "<pre>", "\n"]
    for _ in range(2000):
        assert isinstance(html_text.visible_text("".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))), str)


def test_deep_pages_end():
    assert html_text.visible_text("<div>" * 20_000 + "x") == "x"


@pytest.mark.parametrize("part", ["<div>", "<b>x", "<p>x", "<table><tr><td>", "<ul><li>a", "<td rowspan=900 colspan=900>x<tr>", "<details><summary>", "<select><option>x", "</b></p></div>x"])
def test_time_grows_with_the_page(part):
    """Four times the page takes about four times as long, not sixteen times."""
    import time

    took = []
    for n in (5_000, 20_000):
        began = time.process_time()
        html_text.visible_text(part * n + "x")
        took.append(time.process_time() - began)
    assert took[1] < 9 * took[0] + 0.3


@pytest.mark.parametrize("page", ["<a " * 340_000 + '"', "<style>" + "a" * 1_000_000, "<style " * 150_000, "<style>" + '"' * 1_000_000, "<style>" + "@media x{" * 110_000, "<a \">\" " * 120_000 + "'", "<a '>" * 200_001, "<p style='" * 100_000, "<table>" + "<tr><td rowspan=9999>x" * 8000])
def test_a_megabyte_of_anything_ends_soon(page):
    import time

    began = time.process_time()
    assert len(html_text.visible_text(page)) < 60 * len(page)
    assert time.process_time() - began < 6


def tree(rng, depth=0):
    """A random element as (name, hidden, children); leaves are words."""
    if depth > 4 or rng.random() < 0.3:
        return rng.choice(["one", "two words", "x", "longer text here"])
    name = rng.choice(["div", "p", "b", "ul", "ol", "table", "section", "h2", "br"] if depth < 3 else ["b", "i", "br"])
    if name in ("ul", "ol"):
        children = [("li", rng.random() < 0.1, [tree(rng, depth + 2) for _ in range(rng.randint(1, 2))]) for _ in range(rng.randint(1, 3))]
    elif name == "table":
        children = [("tr", False, [("td", False, [tree(rng, depth + 3)]) for _ in range(rng.randint(1, 3))]) for _ in range(rng.randint(1, 3))]
    elif name == "br":
        children = []
    else:
        inner = [tree(rng, depth + (2 if name in ("p", "h2") else 1)) for _ in range(rng.randint(1, 3))]
        children = [c for c in inner if isinstance(c, str) or name not in ("p", "h2", "b", "i") or c[0] in ("b", "i", "br")]
    return name, rng.random() < 0.12, children


def written_out(node):
    if isinstance(node, str):
        return node
    name, hidden, children = node
    return f"<{name}{' hidden' if hidden else ''}>" + ("" if name == "br" else "".join(map(written_out, children)) + f"</{name}>")


def rendered(nodes, lists=0):
    """The slow way: lines of a list of nodes, by breaks and texts in order."""
    events = []

    def visit(node, lists, number):
        if isinstance(node, str):
            events.append(("text", node, lists))
            return
        name, hidden, children = node
        if hidden:
            return
        if name == "br":
            events.append(("br", 0, lists))
            return
        inline, gap = name in ("b", "i"), 1 if name in ("p", "h2", "table") or (name in ("ul", "ol") and not lists) else 0
        if not inline:
            events.append(("break", gap, lists))
        if name == "table":
            rows = [[" ".join(x.strip() for x in rendered(cell[2]) if x.strip()) for cell in row[2]] for row in children]
            wide = [max(len(r[i]) for r in rows if i < len(r)) for i in range(max(map(len, rows)))]
            for r in rows:
                line = "  ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip()
                events.extend([("raw", line, lists)] * bool(line) + [("break", 0, lists)])
        own = 0
        for c in children if name != "table" else []:
            if name in ("ul", "ol") and not c[1]:
                own += 1
                events.append(("mark", f"{own}. " if name == "ol" else "- ", lists + 1))
            visit(c, lists + (name in ("ul", "ol")), own)
        if not inline:
            events.append(("break", gap, lists))

    for n in nodes:
        visit(n, lists, 0)
    out, line, gap, mark = [], "", 0, ""
    for kind, x, deep in [*events, ("break", 0, 0)]:
        if kind == "mark":
            if line.strip():
                out.append(line.rstrip())
            line, mark = "", x
        elif kind in ("text", "raw"):
            if not line:
                out += [""] * (gap if out else 0)
                gap, line, mark = 0, "  " * max(0, deep - 1) + mark if deep else "", ""
            line += x
        elif kind == "br" and not line.strip():
            gap = max(gap, 1)
        else:
            if line.strip():
                out.append(line.rstrip())
            line, gap = "", max(gap, x)
    return out


def test_trees_equal_the_slow_renderer():
    import random

    rng = random.Random(12)
    for _ in range(3000):
        nodes = [tree(rng) for _ in range(rng.randint(1, 4))]
        source = "".join(map(written_out, nodes))
        assert html_text.visible_text(source) == "\n".join(rendered(nodes)), source


def test_extract_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>x", "old"), (2, None, None, None)], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in html_text.extract(df).orderBy("page_id").collect()] == [(1, "u", "x"), (2, None, "")]
    assert html_text.extract(df.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = docs
    ids = {n: {r["doc_id"] for r in d.select("doc_id").distinct().collect()} for n, d in seen.items()}
    assert ids["personal_data"] == ids["near_duplicates"] == ids["mixing"] == ids["packing"] < ids["toxicity"]
    assert seen["near_duplicates"].count() == len(ids["near_duplicates"])


def test_stages_bear_odd_and_empty_tables(spark, odd_docs, no_docs, sf_dir):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for df in (docs, no_docs.select(docs.columns)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf_dir)
            df = spark.createDataFrame(df.collect(), df.schema)
