"""Long lists of siblings are aligned as well as short ones."""

import random

import numpy as np

from noticework.llm import wrappers
from noticework.llm.wrappers import align, extract_main_text, heaviest_chain, read_shape

from .test_wrapper_decides import _plain_matching


def test_long_lists_that_are_shifted_and_changed():
    # 245 000 pairs of equal labels; the n-th of a label is not the n-th of the other page, and no subtree is equal.
    one = "r(" + ",".join(f"x(c{i}),y" for i in range(350)) + ")"
    other = "r(" + ",".join(["x(z),y"] * 5 + [f"x(c{i},q),y" for i in range(350)]) + ")"
    pairs = align(one, other)
    assert len(pairs) == len(set(pairs.values())) == 1 + 3 * 350


def test_chains_by_rows_against_the_definition(monkeypatch):
    monkeypatch.setattr(wrappers, "MAX_PAIRS", 0)
    wrappers._aligned.clear()
    deal = random.Random(5)

    def tree(depth):
        children = [tree(depth - 1) for _ in range(deal.randint(0, 5))] if depth else []
        return deal.choice("abc") + ("(" + ",".join(children) + ")" if children else "")

    for _ in range(300):
        one, other = (f"r({tree(2)},{tree(3)},{tree(2)})" for _ in range(2))
        pairs = align(one, other)
        assert len(pairs) == _plain_matching(read_shape(one), read_shape(other)) == len(set(pairs.values()))
    wrappers._aligned.clear()


def test_heaviest_chain_rises():
    draw = np.random.default_rng(2)
    weights = draw.integers(0, 6, (5, 7))
    left, right = draw.integers(0, 5, 40), draw.integers(0, 7, 55)
    chain = heaviest_chain(weights, left, right)
    best = np.zeros((41, 56), int)
    for i in range(40):
        for j in range(55):
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + weights[left[i], right[j]])
    assert sum(weights[left[i], right[j]] for i, j in chain) == best[-1, -1]
    assert all(a < b and x < y for (a, x), (b, y) in zip(chain, chain[1:]))
    assert heaviest_chain(weights, left, right[:0]) == heaviest_chain(weights, left[:0], right) == []


def test_a_long_list_of_a_host_keeps_its_template(spark):
    # Page i has 3 i entries of its own before 400 that all pages have, in each of them a list with a class of its own.
    def page(i):
        own = "".join(f'<dt>Own {i} {j}</dt><dd class="own"><p>Word {i} {j}</p></dd>' for j in range(3 * i))
        fixed = "".join(f'<dt>Fixed {j}</dt><dd><pre>Slogan {j}</pre><ul class="u{chr(97 + i)} {chr(97 + j // 26)}{chr(97 + j % 26)}x"><li>Story {i} {j}</li></ul></dd>' for j in range(400))
        return f"<dl>{own}{fixed}</dl>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(6)]
    for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        # Which of the neighbouring first terms is a partner's is left open.
        assert "Slogan" not in r["text"] and r["text"].count("Fixed") <= 1
        assert r["text"].count("Story") == 400 and r["text"].count("Word") == 3 * r["page_id"]
