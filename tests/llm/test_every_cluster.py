"""A host may have any number of layouts; each has its template."""

import random

from noticework.llm import wrappers
from noticework.llm.wrappers import align, cluster_shapes, extract_main_text, read_shape


def _layout(k, i):
    """Page ``i`` of layout ``k``, whose blocks are its own."""
    own = f'<section class="kind{"abcdefghijklmnopqrstuvwxyz"[k]}">'
    return f"{own}{own}<p>Slogan {k}</p></section>{own}<pre>Story {i} of {k}</pre></section></section>"


def test_the_seventh_layout_has_its_template_too(spark):
    pages = [(100 * k + i, f"http://h.example/{k}/{i}", _layout(k, i)) for k in range(7) for i in range(5 + k)]
    rows = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert rows == {100 * k + i: f"Story {i} of {k}" for k in range(7) for i in range(5 + k)}


def _one_by_one(trees):
    """The clusters by their definition: one seed after the other."""
    found, left = {}, dict(trees)
    turn = 0
    while sum(left.values()) >= wrappers.MIN_PAGES:
        seed = max((n, s) for s, n in left.items())[1]
        own = [s for s in left if len(align(s, seed)) >= wrappers.ALIGNED_SHARE * wrappers._size(read_shape(s))]
        if sum(left[s] for s in own) >= wrappers.MIN_PAGES:
            found |= dict.fromkeys(own, seed)
        for s in own:
            del left[s]
        turn += 1
    return found


def test_rounds_find_the_clusters_of_the_definition(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "MOST_TREES", 8)
    draw = random.Random(3)
    trees = {}
    for _ in range(120):
        parts = [draw.choice("abcdefgh") for _ in range(draw.randint(1, 5))]
        trees["(" + ",".join(f"{p}({draw.choice('xyz')},{draw.choice('xyz')})" for p in parts) + ")"] = draw.randint(1, 4)
    rows = spark.createDataFrame([("h", s, n) for s, n in trees.items()] + [("few", "(a)", 4)], "host string, shape string, n long")
    found = [r for r in cluster_shapes(rows).collect()]
    pages = {}
    for r in found:
        pages[r["host"], r["seed"]] = pages.get((r["host"], r["seed"]), 0) + trees.get(r["shape"], 0)
    got = {r["shape"]: r["seed"] for r in found if r["host"] == "h" and pages["h", r["seed"]] >= wrappers.MIN_PAGES}
    wanted = _one_by_one(trees)
    assert got == wanted and len(set(wanted.values())) > 4
    assert not [r for r in found if r["host"] == "few"]
