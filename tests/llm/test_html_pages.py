"""HTML extraction: hostile pages, visibility, and random trees against a plain renderer."""

import random
import time

import pytest
from pyspark.sql import functions as F

from batchloom.llm import html_text
from test_llm import empty_docs

MB = 1 << 20


@pytest.mark.parametrize("piece", ["<!--", "<a ", "<![", '"', "<a x='", '<a b="', "</ ", "</a ", "<", "<?", "&#", "&#9", "&amp", "<script>", "<title>", "<a =", "<a\t/"])
def test_a_megabyte_of_one_piece(piece):
    begun = time.process_time()
    html_text.render(piece * (MB // len(piece)))
    assert time.process_time() - begun < 8  # a second or less on an idle machine


@pytest.mark.parametrize("page", [
    "<table>" + "<td rowspan=9999>x" * 8000 + "<tr><td>y" * 8000, "<table>" + "<td colspan=1000 rowspan=9999>x" * 3000 + "<tr><td>y" * 8000,
    "<table>" + "".join(f"<td rowspan={k}>x" for k in range(1, 900)) + "<tr><td>y" * 2000, "<p>" * 60_000, "<li>" * 60_000, "<div>" * 60_000 + "x",
])
def test_hostile_layouts_end(page):
    begun = time.process_time()
    assert len(html_text.render(page)) < 30 * MB
    assert time.process_time() - begun < 30


@pytest.mark.parametrize("html, want", [
    ("<details>x<summary>s</summary>y</details>z", "s\nz"), ("<details open>x<summary>s</summary>y</details>z", "x\ns\ny\nz"), ("<details>x</details>y", "y"),
    ("<p style='--display:none'>a", "a"), ("<p style='display:none-x'>a", "a"), ("<p style='color:red;DISPLAY : none'>a<p>b", "b"),
    ("<table><table><tr><td>a<td>b<tr><td>c<td>d</table></table>", "a  b\nc  d"), ("<table><tr><td>a<td><table><tr><td>b<td>c</table></table>", "a  b  c"),
    ("a<!--b", "a"), ("a<!-->b", "ab"), ("a<!--->b", "ab"), ("a<!--b--!>c", "ac"), ("a<b x='>'>c", "ac"), ("a</b x='>'>c", "ac"), ("a<b x='y", "a"), ("a</>b</ c>d", "abd"),
    ("1 < 2 <3 a<é", "1 < 2 <3 a<é"), ("<textarea>a <b>c</b> &amp;</textarea>", "a <b>c</b> &"), ("<script>a</scripty></SCRIPT >b", "b"),
    ("&#" + "9" * 6000 + ";&#" + "0" * 6000 + "65;&#x110000;&nosuch;&lt", "�A�&nosuch;<"), ("<p title='&lt;'/>a<BR/>b", "a\nb"), ("<a hidden='x' HIDDEN>a</a>b", "b"),
    ("<table><tr><td rowspan=3>a<td rowspan=2>b<td>c<tr><td>d<tr><td>e</table>", "a  b  c\n      d\n   e"),
])
def test_tokens_and_visibility(html, want):
    assert html_text.render(html) == want


def tree(rng, depth, inline=False):
    """A random tree as (tag, attributes, children); leaves are words."""
    tags = ["span", "b", "i", "a"] if inline else ["div", "section", "p", "span", "b", "article", "hidden", "none", "template"]
    out = []
    for _ in range(rng.randint(1, 4)):
        if depth == 0 or rng.random() < 0.4:
            out.append(f"w{rng.randrange(1000)}")
        else:
            tag = rng.choice(tags)
            out.append((tag, tree(rng, depth - 1, inline or tag in ("p", "span", "b", "i", "a"))))
    return out


def written(nodes, rng, whole):
    """HTML of a tree; without ``whole``, end tags are left out where HTML allows it, and comments and cases vary."""
    text = ""
    for k, node in enumerate(nodes):
        if isinstance(node, str):
            text += f" {node} "
            continue
        tag, inner = node[0], written(node[1], rng, whole)
        name, extra = {"hidden": ("div", " hidden"), "none": ("div", " style='color:red;display:none'")}.get(tag, (tag, ""))
        follows = nodes[k + 1] if k + 1 < len(nodes) else None
        last = k + 1 == len(nodes) or (not isinstance(follows, str) and follows[0] in ("div", "section", "p", "article", "hidden", "none"))
        if whole:
            text += f"<{name}{extra}>{inner}</{name}>"
        else:
            name = rng.choice([name, name.upper()])
            text += rng.choice(["", "<!-- > x -->", "<?y?>", "</nosuch>"]) + f"<{name}{extra} x=\"<b>\" y>{inner}" + ("" if tag == "p" and last else f"</{name}\n>")
    return text


def blocks(nodes):
    """Lines of words, by the rule that blocks stand on lines of their own; an empty line marks a margin."""
    lines, run, due = [], [], False

    def close():
        nonlocal run, due
        if run:
            if due and lines:
                lines.append("")
            lines.append(" ".join(run))
            run, due = [], False

    def walk(some):
        nonlocal due
        for node in some:
            if isinstance(node, str):
                run.append(node)
            elif node[0] in ("hidden", "none", "template"):
                continue
            elif node[0] in ("span", "b", "i", "a"):
                walk(node[1])
            else:
                close()
                due = due or node[0] == "p"
                walk(node[1])
                close()
                due = due or node[0] == "p"

    walk(nodes)
    close()
    return "\n".join(lines)


def test_random_trees():
    rng = random.Random(8)
    for _ in range(400):
        nodes = tree(rng, 4)
        want = blocks(nodes)
        assert html_text.render(written(nodes, rng, True)) == want
        assert html_text.render("<!doctype html><head><title>t</title>" + "<body>" + written(nodes, rng, False)) == want


def test_random_bytes_end():
    rng = random.Random(2)
    for _ in range(3000):
        html_text.render("".join(rng.choices(["<", ">", "/", "!", "-", "a", "td", "table", "'", '"', "=", " ", "&", "#", ";", "x", "script", "[", "?", "p", "li"], k=40)))


def test_extract_empty_and_clashes(spark):
    none = empty_docs(spark).withColumnsRenamed({"doc_id": "page_id", "text": "html", "lang": "text", "source": "n_lines"})
    assert html_text.extract(none).count() == 0 and html_text.extract(none).columns == ["page_id", "text", "n_chars", "n_lines"]
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "<p>é<p>x")], "page_id long, html string").withColumn("n_chars", F.lit("x"))
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"], r["n_lines"]) for r in html_text.extract(odd).collect()) == [
        ("1", "", 0, 0), ("1", "", 0, 0), ("2", "é\n\nx", 4, 3), ("None", "", 0, 0)]
