import html
import random
import re

import pytest
from llm_fixtures import prose

from campusledger.llm import wrapper as w


def para(seed, n=30):
    return " ".join(prose(seed, n).split())


def page(i, host="h.example.com", body=None, frame=True):
    paras = [para(i * 10 + k) for k in range(2 + i % 4)]
    inner = body or "<h1>%s</h1>" % para(i, 5) + "".join(f"<p>{html.escape(p)}</p>" for p in paras)
    if not frame:
        return (i, f"https://{host}/{i}", f"<html><body>{inner}</body></html>")
    return (i, f"https://{host}/{i}", f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';"
            f"</script></head><body><nav><ul><li><a href='/x'>{para(i + 77, 2)}</a></li></ul></nav>"
            f"<div class='box'>Always the same words</div><div class='ad'>{para(i + 99, 4)}</div>"
            f"<div class='text'>{inner}</div><div>Copyright of the host</div>"
            f"<section id='comments'><p>{para(i + 55)}</p></section><footer>{para(i + 33, 4)}</footer></body></html>")


def table(spark, rows):
    return spark.createDataFrame([(*r, "h", "s") for r in rows], "page_id long, url string, html string, host string, seed string")


def test_template_goes_slots_stay(spark):
    rows = [page(i) for i in range(12)]
    out = {x["page_id"]: x for x in w.extract(table(spark, rows)).collect()}
    for i in range(12):
        want = [para(i, 5)] + [para(i * 10 + k) for k in range(2 + i % 4)]
        assert out[i]["text"] == "\n\n".join(want), i
        assert out[i]["n_chars"] == len(out[i]["text"]) and out[i]["url"] == rows[i][1]


def test_copies_of_an_article_do_not_become_template(spark):
    body = "<article><h1>Title</h1><p>first words of it</p><p>the longest paragraph of this article by far</p></article>"
    out = w.extract(table(spark, [page(i, "copy.example.com", body, False) for i in range(9)])).collect()
    assert {x["text"] for x in out} == {"Title\n\nfirst words of it\n\nthe longest paragraph of this article by far"}


def test_markup(spark):
    cases = {
        1: ("<article><h1>A&amp;B &lt;x&gt; &eacute;</h1><p><b>one  two<br>three<p>four\n\t<i>fi</i>ve</p>tail</article>",
            "A&B <x> é\n\none two three\n\nfour five\n\ntail"),
        2: ("<p>alone</p>", "alone"),
        3: ("", ""),
        4: (None, ""),
        5: ("<main><header><h1>Head</h1></header><ul><li>a<li>b<ul><li>c</ul></ul><form>f<input></form><script>x</script>"
            "<table><tr><td>p<td>q</table><aside>no</aside></main><p>outside</p>", "Head\n\na\n\nb\n\nc\n\np\n\nq"),
        6: ("just text", "just text"),
        7: ("<article><div class='Share_Box share'>no</div><p>yes &am x</p><!-- no --><p>  </p></article", "yes &am x"),
        8: ("<div role='navigation'>no</div><div>yes</div></div></p><div hidden id>two", "yes\n\ntwo"),
    }
    rows = [(i, f"http://host{i}.example.com/", h) for i, (h, _) in cases.items()]
    rows += [(20, None, "<p>x</p>"), (21, "not a url", "<p>y</p>"), (2, "http://host2.example.com/", "<p>alone</p>")]
    out = w.extract(table(spark, rows)).collect()
    assert len(out) == len(rows)
    got = {x["page_id"]: x["text"] for x in out}
    assert got == {**{i: t for i, (_, t) in cases.items()}, 20: "x", 21: "y"}
    assert w.extract(table(spark, [])).collect() == []


def brute_match(a, b):
    """Nodes matched by the best order-preserving matching, straight from the definition."""
    if a.label != b.label:
        return 0
    best = {}

    def go(i, j):
        if i == len(a.children) or j == len(b.children):
            return 0
        if (i, j) not in best:
            best[i, j] = max(go(i + 1, j), go(i, j + 1), brute_match(a.children[i], b.children[j]) + go(i + 1, j + 1))
        return best[i, j]
    return 1 + go(0, 0)


def random_tree(r, depth=0):
    label = r.choice(["div", "p", "#text"])
    n = w.Node(label, "t" if label == "#text" else None)
    if label != "#text" and depth < 4:
        n.children = [random_tree(r, depth + 1) for _ in range(r.randrange(5))]
    return n


def numbered(tree):
    blocks, stack = [], [tree]
    while stack:
        n = stack.pop()
        if n.text is not None:
            n.number = len(blocks)
            blocks.append(n)
        stack.extend(reversed(n.children))
    return blocks


@pytest.mark.parametrize("cells", [1, 5, 1 << 20])
def test_weights_are_those_of_the_definition(monkeypatch, cells):
    monkeypatch.setattr(w, "_CELLS", cells)
    r = random.Random(1)
    for _ in range(120):
        a, b = w.Node("div"), w.Node("div")
        a.children, b.children = ([random_tree(r) for _ in range(r.randrange(6))] for _ in range(2))
        numbered(a), numbered(b)
        m = w.Matcher()
        m.number(a), m.number(b)
        assert m.weight(a.shape, b.shape) == brute_match(a, b)
        pairs = m.align(a, b)
        assert sorted(pairs.values()) == [pairs[k] for k in sorted(pairs)] and len(set(pairs.values())) == len(pairs)
        places = m._pairs(tuple(c.shape for c in a.children), tuple(c.shape for c in b.children))
        assert sum(m.weight(a.children[i].shape, b.children[j].shape) for i, j in places) == brute_match(a, b) - 1


def test_deep_and_long_pages(spark):
    deep = "<div>" * 20_000 + "words" + "</div>" * 20_000
    half = "<div>" * 9_000 + "other words" + "</div><p>more</p>" * 9_000
    many = "".join(f"<p>{i}</p>" if i % 3 else f"<div>{i}</div>" for i in range(6_000))
    some = "".join(f"<div>x{i}</div>" if i % 4 else f"<p>x{i}</p>" for i in range(6_000))
    rows = [(i, "http://one.example.com/", h) for i, h in enumerate((deep, half, many, some))]
    out = {x["page_id"]: x["text"] for x in w.extract(table(spark, rows)).collect()}
    assert out[0] == "words" and out[1].startswith("other words\n\nmore") and out[2].startswith("0\n\n1\n\n2")
    assert out[2].count("\n\n") == out[3].count("\n\n") == 5_999


def test_a_second_layout_without_names(spark):
    """Menus and notices of a layout that does not match the seed are told by host, path and text."""
    def first(i):
        return f"<div><b>Menu one</b></div><table><tr><td>{para(i, 40)}</td></tr></table>"

    def second(i):
        return f"<section><h2>Menu two</h2></section><blockquote>{para(100 + i, 40)}</blockquote><section><h5>Legal words</h5></section>"

    rows = [(i, "https://two.example.com/", f"<html><body>{(first if i % 2 else second)(i)}</body></html>") for i in range(16)]
    out = {x["page_id"]: x["text"] for x in w.extract(table(spark, rows)).collect()}
    assert out == {i: para(i if i % 2 else 100 + i, 40) for i in range(16)}


def test_against_the_article_markup(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"(?s)<article>(.*)</article>", r["html"])[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        want[r["page_id"]] = "\n\n".join(b for b in blocks if b)
    assert {x["page_id"]: x["text"] for x in w.extract(pages).collect()} == want
