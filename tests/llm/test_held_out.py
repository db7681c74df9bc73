"""Perplexity bands: no text is scored by a model that counted it, and copies change no verdict."""

import math
import random
from collections import Counter

import pytest

from noticework.llm import quality
from noticework.llm.quality import judge_documents
from tests.llm.test_text_operators import plain_kneser_ney

SCHEMA = "doc_id long, text string, lang string"


def prose(seed, n, words=80):
    rng = random.Random(seed)
    stock = ["".join(rng.choice(["ba", "lo", "mi", "ta", "no", "ser", "kan"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    return [" ".join(rng.choice(stock) for _ in range(words)) for _ in range(n)]


def gibberish(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(words))


def plain_probability(counted, gram):
    """Probability of any n-gram in a model by definition: unseen ones back off."""
    top = Counter()
    for text in counted:
        raw = b"\0" * (len(gram) - 1) + text.encode()
        top.update(raw[i:i + len(gram)] for i in range(len(text.encode())))
    levels = {len(gram): top}
    for k in range(len(gram) - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def off(k, c):
        t = [sum(1 for x in levels[k].values() if x == i) for i in range(1, 5)]
        if not all(t):
            return 0.5
        c = min(c, 3)
        return max(0.0, c - (c + 1) * t[0] / (t[0] + 2 * t[1]) * t[c] / t[c - 1])

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        followers = [c for x, c in levels[k].items() if x[:-1] == g[:-1]]
        if not followers:
            return p(g[1:])
        left = sum(off(k, c) for c in followers)
        if g not in levels[k]:
            return max(left, 0.5) / sum(followers) * p(g[1:])
        return (levels[k][g] - off(k, levels[k][g]) + left * p(g[1:])) / sum(followers)

    return p(gram)


def test_unseen_ngrams_back_off(spark):
    texts = ["abracadabra alakazam", "abra cadabra, simsalabim", "la la land bra"]
    docs = spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string")
    grams = [b"abr", b"brz", b"zzz", b"qab", b"\0\0a", b"laz"]
    asked = spark.createDataFrame([(x, int.from_bytes(g, "big")) for g in grams for x in ("xx", "none")], "lang string, gram long")
    got = {(r["lang"], int(r["gram"]).to_bytes(3, "big")): r["logp"] for r in quality.kneser_ney(quality.count_ngrams(docs, 3), 3, asked).collect()}
    assert len(got) == 2 * len(grams)
    for g in grams:
        assert math.isclose(got["xx", g], math.log10(plain_probability(texts, g)), abs_tol=1e-9)
        assert math.isclose(got["none", g], math.log10(1 / 256), abs_tol=1e-9)
    assert math.isclose(got["xx", b"abr"], plain_kneser_ney(texts, 3)[b"abr"], abs_tol=1e-9)


def test_odd_texts_go_out_by_the_upper_bound(spark):
    good = [(i, t, "xx") for i, t in enumerate(prose(1, 300))]
    odd = [(1000 + i, gibberish(i, n), "xx") for i, n in enumerate((40, 80, 300, 1000, 2000, 2000))]
    for i in range(10):  # another language: each text has words of its own
        rng = random.Random(50 + i)
        parts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)]
        stock = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(200)]
        odd.append((2000 + i, " ".join(rng.choice(stock) for _ in range(150)), "xx"))
    rows = judge_documents(spark.createDataFrame(good + odd, SCHEMA)).collect()
    third = sorted(r["log10_ppl"] for r in rows if r["doc_id"] < 1000)[225]
    for r in rows:
        if r["doc_id"] >= 1000:
            assert not r["base_failed"] and not r["kept"] and r["log10_ppl"] > third, (r["doc_id"], r["log10_ppl"], third)
        elif not r["base_failed"]:
            assert r["kept"]


@pytest.mark.parametrize("copies", [20, 60, 120])
def test_copies_change_no_verdict(spark, copies):
    good = [(i, t, "xx") for i, t in enumerate(prose(2, 200))]
    alone = {r["doc_id"]: (r["log10_ppl"], r["kept"]) for r in judge_documents(spark.createDataFrame(good, SCHEMA)).collect()}
    rows = judge_documents(spark.createDataFrame(good + [(1000 + i, good[7][1], "xx") for i in range(copies)], SCHEMA)).collect()
    assert len(rows) == 200 + copies
    for r in rows:
        score, kept = alone[r["doc_id"] if r["doc_id"] < 1000 else 7]
        assert r["kept"] == kept and math.isclose(r["log10_ppl"], score, abs_tol=1e-6)
    assert alone[7][1]
