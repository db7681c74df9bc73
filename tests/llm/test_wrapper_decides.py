"""What role words leave, what templates take away, and pages that are long or broken."""

import random
import time

import pytest

from noticework.llm import wrappers
from noticework.llm.wrappers import align, extract_main_text, main_text, read_shape


@pytest.mark.parametrize("inside", ['<p class="market-share">Shares rose.</p>', '<div class="related-work">Shares rose.</div>', '<div id="search-results-of-1990">Shares rose.</div>',
                                    '<p class="notice-of-sale">Shares rose.</p>', '<div class="top">Shares rose.</div>'])
def test_subjects_in_class_names_stay(inside):
    assert main_text(f"<article><p>First.</p>{inside}</article>", None, set()) == "First.\nShares rose."


@pytest.mark.parametrize("other", ['<ul class="commentlist"><li>Me too</li></ul>', '<div id="disqus_thread">Me too</div>', '<div class="share-buttons">Tell</div>', '<div class="fb-comments">Me</div>',
                                   '<div class="relatedPosts related-posts">More</div>', '<article class="teaser"><p>Next</p></article>', '<div class="ad-slot">Buy</div>', '<aside>Aside</aside>'])
def test_other_parts_go(other):
    assert main_text(f"<article><p>First words of it.</p>{other}</article>" if "teaser" not in other else f"<article><p>First words of it.</p></article>{other}", None, set()) == "First words of it."


def test_marks_outside_articles():
    body = "<div><h1>Title</h1><p>" + "Long text stands here. " * 5 + "</p></div>"
    assert main_text('<div id="top">Site name</div>' + body + '<div class="foot">Copyright</div>', None, set()).startswith("Title\nLong")
    assert "Site" not in main_text('<div id="top">Site name</div>' + body, None, set())


def _host(layout, n, first=0):
    rows = []
    for i in range(first, first + n):
        if layout == "a":
            rows.append((i, "http://h.example/" + str(i), f"<div><b>Old brand</b><p>Best prices in town</p></div><div><h1>Head {i}</h1><p>Story number {i} told</p></div>"))
        else:
            cells = "".join(f"<tr><td>Cell {i} {j}</td></tr>" for j in range(3))
            rows.append((i, "http://h.example/" + str(i), f"<section><ul><li>Fixed slogan</li></ul></section><table>{cells}</table><dl><dt>Key {i}</dt></dl>"))
    return rows


def test_each_layout_of_a_host_has_its_template(spark):
    pages = _host("a", 9) + _host("b", 6, 100)
    rows = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(rows) == 15
    assert rows[3] == "Head 3\nStory number 3 told"
    assert rows[102] == "Cell 102 0\nCell 102 1\nCell 102 2\nKey 102"


def test_a_node_that_few_pages_have_is_judged_by_them(spark):
    pages = _host("a", 40)
    # A slot that six of forty pages have, always with the same text.
    pages = [(i, u, h.replace("</p></div><div>", "</p><pre>Sale ends soon</pre></div><div>", 1) if i % 7 == 0 else h) for i, u, h in pages]
    rows = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(text == f"Head {i}\nStory number {i} told" for i, text in rows.items())


def test_few_pages_and_copies_prove_nothing(spark):
    pages = _host("a", 4) + [(50 + i, "http://h.example/0", _host("a", 1)[0][2]) for i in range(20)]
    texts = [r["text"] for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()]
    assert all(t.startswith("Old brand\nBest prices in town\nHead") or t.startswith("Old brand Best") for t in texts)


def _plain_matching(a, b):
    """Simple tree matching by its definition."""
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + _plain_matching(x, y))
    return m[-1][-1] + 1


def test_alignment_against_the_definition():
    deal = random.Random(3)

    def tree(depth):
        children = [tree(depth - 1) for _ in range(deal.randint(0, 4))] if depth else []
        return deal.choice("abc") + ("(" + ",".join(children) + ")" if children else "")

    for _ in range(300):
        one, other = (f"r({tree(2)},{tree(3)},{tree(2)})" for _ in range(2))
        pairs = align(one, other)
        assert len(pairs) == _plain_matching(read_shape(one), read_shape(other)) == len(set(pairs.values()))


def _seconds(work):
    start = time.monotonic()
    work()
    return time.monotonic() - start


def test_many_unlike_siblings():
    one = "r(" + ",".join(f"a{i}" for i in range(5000)) + ")"
    other = "r(" + ",".join(f"b{i}" if i % 2 else f"a{i}" for i in range(5000)) + ")"
    assert _seconds(lambda: align(one, other)) < 5
    assert len(align(one, other)) == 2501
    # More pairs than are compared: found still, in order.
    many = "r(" + ",".join("x(p)" if i % 3 else "y" for i in range(3000)) + ")"
    more = "r(" + ",".join("x(q,p)" if i % 3 else "y" for i in range(3100)) + ")"
    assert _seconds(lambda: align(many, more)) < 5
    assert len(align(many, more)) == 1 + 1000 + 2 * 2000


@pytest.mark.parametrize("piece, words", [('<div title="x>word ', 0), ("<div>word ", 100_000), ("<nav>word ", 0), ("<p class=ad>word ", 0), ("</b word ", None), ("<!x word ", None), ("<svg/>word ", 100_000),
                                          ("word < 5 ", 100_000), ("</ word ", 100_000)])
def test_broken_pages_take_no_longer(piece, words):
    page = piece * 100_000
    text = []
    assert _seconds(lambda: text.append(main_text(page, None, set()))) < 5
    assert words is None or words == 0 or text[0].count("word") == words


def test_remembered_alignments_are_bounded(monkeypatch):
    monkeypatch.setattr(wrappers, "REMEMBERED_NODES", 50)
    wrappers._aligned.clear()
    for i in range(100):
        align(f"r(a,b,c{i})", "r(a,b)")
        assert sum(map(len, wrappers._aligned.values())) <= 50
