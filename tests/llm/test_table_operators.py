"""Sharding, mixing, URL, page, archive and search operators against brute force, with odd rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticework.llm import topk, wrappers
from noticework.llm.mixing import find_exponent, mix
from noticework.llm.revisits import canonical_url, resolve_revisits
from noticework.llm.shards import locate, permute, shard_rows
from noticework.llm.topk import floored, top_k
from noticework.llm.urlfilter import build_cascade, judge_urls, member
from noticework.llm.wrappers import align, extract_main_text, main_text, parse, shape_of
from noticework.session import settled


# ---------------------------------------------------------------- sharding

@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 65, 1000])
def test_permutation(n):
    places = permute(np.arange(n), n, 7)
    assert sorted(places) == list(range(n))
    assert (places == permute(np.arange(n), n, 7)).all()
    if n == 1000:
        assert (places != permute(np.arange(n), n, 8)).mean() > 0.9 and abs(np.corrcoef(np.arange(n), places)[0, 1]) < 0.1


def test_shards_are_even_gapless_and_computable(spark):
    rows = spark.createDataFrame([(None, 1)] * 2 + [(i, i % 3) for i in range(101)] + [(5, 5)] * 40, "doc_id long, row_no long")
    placed = shard_rows(rows, ["doc_id"], 8, 3, row_no="number").collect()
    assert len(placed) == 143 and sorted(r["number"] for r in placed) == list(range(143))
    slots = defaultdict(list)
    for r in placed:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    shard, slot = locate(np.array([r["number"] for r in placed]), 143, 8, 3)
    assert [(r["shard"], r["slot"]) for r in placed] == list(zip(shard, slot, strict=True))
    assert shard_rows(rows.limit(0), ["doc_id"], 8, 3, row_no="number").count() == 0


# ---------------------------------------------------------------- mixing

def documents(spark, per_source, seed=1):
    rng = random.Random(seed)
    rows, i = [], 0
    for source, n in per_source.items():
        for _ in range(n):
            rows.append((i, " ".join("w" for _ in range(rng.randint(1, 30))), source, "x"))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix_pass string")


def test_exponent_meets_its_target(spark):
    tokens = {"a": 1000, "b": 100, "c": 10}
    sources = spark.createDataFrame([(k, v, 1110) for k, v in tokens.items()], "source string, tokens long, all_tokens long")

    def weights(alpha):
        raised = [(v / 1110) ** alpha for v in tokens.values()]
        return [x / sum(raised) for x in raised]

    entropy = -sum(w * math.log(w) for w in weights(0.4))
    assert math.isclose(find_exponent(sources, entropy=entropy), 0.4, abs_tol=1e-6)
    limited = find_exponent(sources, max_repetition=5.0)
    repeats = [w / (v / 1110) for w, v in zip(weights(limited), tokens.values(), strict=True)]
    assert math.isclose(max(repeats) / min(repeats), 5.0, rel_tol=1e-6)
    assert find_exponent(sources, max_repetition=1000.0) == 0.0
    assert find_exponent(sources, entropy=0.0) == 1.0


def test_mix_meets_budgets(spark):
    docs = documents(spark, {"a": 2000, "b": 300, None: 40})
    rows = mix(docs, max_repetition=3.0, seed=4).collect()
    own = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
    assert all(r["mix_tokens"] == own[r["doc_id"]] for r in rows)
    assert {r["doc_id"] for r in rows} == set(own)
    total, taken, weight = Counter(), Counter(), {}
    for r in docs.collect():
        total[r["source"]] += own[r["doc_id"]]
    for r in rows:
        taken[r["source"]] += r["mix_tokens"]
        weight[r["source"]] = r["mix_weight"]
    assert math.isclose(sum(weight.values()), 1.0)
    whole = sum(total.values()) * max(total[s] / sum(total.values()) / weight[s] for s in total)
    for s in total:
        assert weight[s] * whole - 31 <= taken[s] <= weight[s] * whole + 1
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 3
    assert len({(r["doc_id"], r["mix_pass"]) for r in rows}) == len(rows)
    blocks = defaultdict(set)
    for r in rows:
        blocks[(r["source"], r["mix_pass"])].add(r["mix_place"])
    assert all(x == set(range(len(x))) for x in blocks.values())
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs, max_repetition=3.0, seed=4).collect()))


def test_mix_with_a_small_budget_and_odd_rows(spark):
    docs = documents(spark, {"a": 200, "b": 20}).select("doc_id", "text", "source")
    odd = docs.unionByName(spark.createDataFrame([(900, None, None), (901, "", "b"), (5, "w w", "a"), (5, "w w", "a"), (None, "w", "")], docs.schema))
    rows = mix(odd, entropy=0.5, budget=300).collect()
    assert 300 - 3 * 31 <= sum(r["mix_tokens"] for r in rows) <= 300
    assert mix(odd.limit(0), entropy=0.5).count() == 0
    assert {r["doc_id"] for r in mix(odd, max_repetition=1.0).collect()} == {r["doc_id"] for r in odd.collect()}


# ---------------------------------------------------------------- URLs

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
URLS = [None, "", "no scheme", "http://", "http://example.org", "http://example.org/", "https://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://example.org/en/2",
        "ftp://x.com/fr/", "http://com/de/1", "http://notcom/de/1", "http://bad.net?x", "http://w.bad.net/a", "http://notbad.net/a", "x://a..b/", "http://" + "a." * 500 + "org/en/" + "y" * 3000]


def plain_verdict(url, listed):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
        path = rest[len(host):]
        path = next((path[:i] for i, c in enumerate(path) if c in "?#"), path)
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    under = lambda name: host == name or host.endswith("." + name)
    fits = [r for r in RULES if under(r.split("/")[0]) and path.startswith(r[r.index("/"):])]
    rule = max(fits, key=len, default=None)
    return host, path, rule, RULES[rule] if rule else "block" if any(under(x) for x in listed) else "allow"


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, url_host string")
    judged = judge_urls(pages, RULES, ["bad.net"], names=("host", "path", "rule", "verdict"))
    for r in judged.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(r["url"], ["bad.net"])
        assert r["url_host"] == "y"
    assert judge_urls(pages.limit(0), RULES, ["bad.net"]).count() == 0
    assert all(r["verdict"] == "allow" and r["rule"] is None for r in judge_urls(pages, {}).collect())


def test_verdicts_need_no_join(spark):
    plan = judge_urls(spark.createDataFrame([(u,) for u in URLS], "url string"), RULES, ["bad.net"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def test_cascade_is_exact_on_its_universe(spark):
    universe = settled(spark.range(30000).select(F.concat(F.lit("k"), "id").alias("key"), "id"), "u")
    levels = build_cascade(universe, "key", F.col("id") % 50 == 3)
    assert len(levels) > 1
    wrong = universe.filter(member(F.col("key"), levels) != (F.col("id") % 50 == 3))
    assert wrong.count() == 0
    assert sum(x.bits for x in levels) < 600 * 16
    assert build_cascade(universe, "key", F.lit(False)) == []


# ---------------------------------------------------------------- pages

PAGE = ('<html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body><nav><ul><li><a href="/a">A{i}</a></li></ul></nav><div class="ad">Buy {i}</div>'
        '<article><h1>Head {i}</h1><p>One &amp; two {i}\n  three<p><b>Four {i}<br>five</p><p>Always here</p><div class="comments"><p>me too</p></div></article><footer>foot</footer>')


def test_main_text_of_one_page():
    assert main_text(PAGE.replace("{i}", "7"), None, set()) == "Head 7\nOne & two 7 three\nFour 7 five\nAlways here"
    assert main_text(None, None, set()) == main_text("", None, set()) == main_text("<nav>x</nav>", None, set()) == ""
    assert main_text("plain &lt;text&gt; only", None, set()) == "plain <text> only"
    assert main_text("<div><a href=x>all links</a></div><p>Text <a>here</a> is long enough</p>", None, set()) == "Text here is long enough"
    assert main_text("<p>a<!-- <p>no --><b>b</p><script>x", None, set()) == "ab"
    assert main_text("<p>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after", None, set()) == "deep\nafter"
    assert len(main_text("<article>" + "<p>long text " * 50000, None, set()).split("\n")) == 50000


def test_template_texts_go(spark):
    pages = [(i, f"http://one.org/{i}", PAGE.replace("{i}", str(i)), "x") for i in range(12)] + [(20, "http://two.org/1", PAGE.replace("{i}", "1"), "x")]
    pages += [(30 + i, "http://three.org/", PAGE.replace("{i}", "1"), "x") for i in range(9)] + [(50, None, None, None), (51, None, "", None), (None, "http://one.org/x", "<p>odd</p>", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, n_chars string")
    got = {r["page_id"]: r for r in extract_main_text(df).collect()}
    assert len(got) == len(pages)
    assert got[3]["text"] == "Head 3\nOne & two 3 three\nFour 3 five"
    assert got[20]["text"] == got[30]["text"] == "Head 1\nOne & two 1 three\nFour 1 five\nAlways here"
    assert got[50]["text"] == got[51]["text"] == "" and got[None]["text"] == "odd"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert extract_main_text(df.limit(0)).count() == 0


def test_tree_matching():
    shape = lambda page: shape_of(parse(page)[0])
    one, other = shape("<div><p>a</p><ul><li>b</ul><h2>c</h2></div>"), shape("<div><p>a</p><p>x</p><h2>c</h2><table><tr><td>y</table></div>")
    assert one == "(div(p,ul(li),h2))" and other == "(div(p,h2,table(tr(td))))"
    assert align(one, other) == {0: 0, 1: 1, 2: 2, 5: 3}
    assert align(one, one) == {i: i for i in range(6)}
    nodes = wrappers.read_shape(one)
    assert [c.label for c in nodes.children[0].children] == ["p", "ul", "h2"]


# ---------------------------------------------------------------- archives

def test_canonical_urls(spark, value):
    cases = {"HTTP://A.Com:80/x/?utm_source=f&b=2&a=1#t": "a.com/x?a=1&b=2", "https://a.com/": "a.com", "https://a.com?ref=x": "a.com", "x#y": "x", "": ""}
    for url, want in cases.items():
        assert value(canonical_url(F.lit(url))) == want


def test_revisits_by_definition(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        url = rng.choice(["http://a.org/1", "https://A.org/1/", "http://b.org/2", None])
        time = rng.choice([None, *range(60)])
        kind = rng.choice(["response", "revisit", "revisit", "request", None])
        etag = rng.choice([None, '"1"', 'W/"1"', '"2"'])
        rows.append((i, url, time, kind, etag, rng.choice([None, "m1", "m2"]), rng.choice([None, {}, {"date": str(i), "server": "s"}, {"etag": str(i)}]), "x"))
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "record_id long, url string, captured_at long, kind string, etag string, last_modified string, headers map<string,string>, found string")
    got = {r["record_id"]: r for r in resolve_revisits(df).collect()}
    name = {"http://a.org/1": "a.org/1", "https://A.org/1/": "a.org/1", "http://b.org/2": "b.org/2", None: None}
    kept = [r for r in rows if r[3] in ("response", "revisit")]
    assert len(got) == len({r[0] for r in kept})
    for i, url, time, kind, etag, modified, headers, _ in kept:
        r = got[i]
        if kind == "response":
            assert (r["outcome"], r["referred_id"], r["headers"]) == ("full", None, headers or {})
            continue
        before = [x for x in kept if x[3] == "response" and None not in (url, time, x[1], x[2]) and name[x[1]] == name[url] and x[2] < time]
        if not before:
            assert (r["outcome"], r["referred_id"], r["headers"]) == ("orphan", None, headers or {})
            continue
        full = max(before, key=lambda x: (x[2], x[0]))
        plain = lambda t: t.removeprefix("W/")
        if etag and full[4]:
            outcome = "validated" if plain(etag) == plain(full[4]) else "mismatch"
        elif modified and full[5]:
            outcome = "validated" if modified == full[5] else "mismatch"
        else:
            outcome = "unchecked"
        merged = {**(full[6] or {}), **{k: v for k, v in (headers or {}).items() if k in ("date", "etag")}} if outcome != "mismatch" else headers or {}
        assert (r["outcome"], r["referred_id"], r["headers"]) == (outcome, full[0], merged)
    assert resolve_revisits(df.limit(0)).count() == 0


# ---------------------------------------------------------------- search

def plain_top(rows, k):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(i, [math.floor(256.0 * x) for x in v]) for i, v in ok]
    out = Counter()
    for q, a in ok:
        if q % 10 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)[:k]
            for rank, (score, i) in enumerate(scored, 1):
                out[(q, rank, i, -score)] += 1
    return out


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_top_k_by_definition(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6).round(1)]) for i in range(150)]
    rows += [(200, None), (201, [1.0, None]), (210, [float("nan")]), (211, [float("inf")] * 6), (None, [1.0] * 6), (220, []), (230, [2.0, -1.0]), (31, [0.5] * 6), (31, [0.5] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("x"))
    vectors = df.withColumn("vector", floored(F.col("embedding")))
    got = Counter(tuple(r) for r in top_k(vectors.filter("vec_id % 10 = 0"), vectors, 5).select("query_id", "rank", "vec_id", "score").collect())
    assert got == plain_top(rows, 5)


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (10, [2.0])], "vec_id long, vector array<double>")
    assert {tuple(r) for r in top_k(df, df, 5).select("query_id", "rank", "vec_id", "score").collect()} == {(0, 1, 10, 2), (10, 1, 0, 2)}
    assert top_k(df.limit(0), df, 5).count() == 0
    assert top_k(df, df.limit(0), 5).count() == 0


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(8)
    vectors, queries = rng.integers(-50, 50, (40, 5)).astype(float), rng.integers(-50, 50, (6, 5)).astype(float)
    lists = topk.SortedLists(np.arange(40), vectors)
    exact = queries @ vectors.T
    for depth in (1, 3, 10, 40):
        lower, upper = lists.bounds(np.maximum(queries, 0), np.minimum(queries, 0), depth)
        assert (lower <= exact + 1e-9).all() and (exact <= upper + 1e-9).all()
    assert np.allclose(lower, exact) and np.allclose(upper, exact)


def _shares(spark, vectors, k=5):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, vector array<double>")
    queries = df.filter("vec_id % 40 = 0")
    exact = {}
    for q in range(0, len(vectors), 40):
        exact[q] = sorted(((-int(vectors[q] @ v), i) for i, v in enumerate(vectors) if i != q))[:k]
    got = {}
    for r in top_k(queries, df, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert got == exact
    rows = topk.read_shares(queries, df, k).collect()
    return sum(r["entries_read"] for r in rows) / sum(r["entries"] for r in rows)


def test_reading_stops_early_on_skewed_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 128)
    rng = np.random.default_rng(12)
    plain = rng.integers(-200, 200, (1600, 8))
    # Few long vectors among many short ones: blocks of short ones are not met.
    lengths = np.where(rng.random(1600) < 0.1, 40, 1)[:, None]
    assert _shares(spark, plain * lengths) < 0.3
    # A few coordinates hold most of the weight: lists are left early.
    assert _shares(spark, plain // np.array([1, 1, 8, 16, 32, 64, 64, 64])) < 0.75
    assert _shares(spark, plain) <= 1.0


def test_floor_drops_only_what_lies_below_it():
    rng = np.random.default_rng(9)
    vectors, queries = rng.integers(-9, 9, (300, 4)).astype(float), rng.integers(-9, 9, (12, 4)).astype(float)
    lists, exact = topk.SortedLists(np.arange(300), vectors), queries @ vectors.T
    floors = np.sort(exact, axis=1)[:, -5] - np.arange(12) % 3
    at, candidate, scores, read = topk.block_top_k(lists, np.arange(1000, 1012), queries, 5, floors)
    for q in range(12):
        best = sorted(zip(-exact[q], range(300)))[:5]
        assert [(-s, c) for c, s in zip(candidate[at == q].tolist(), scores[at == q].tolist())] == [(s, c) for s, c in best]
    out_of_reach = topk.block_top_k(lists, np.arange(1000, 1012), queries, 5, np.full(12, 1e6))
    assert not len(out_of_reach[0]) and not out_of_reach[3].any() and (read > 0).all()


def test_top_k_of_equal_rows_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    df = spark.createDataFrame([(7, [3.0, 4.0])] * 200 + [(40, [5.0, 0.0]), (41, [0.0, 0.0]), (80, [])], "vec_id long, vector array<double>")
    rows = [tuple(r) for r in top_k(df.filter("vec_id % 40 = 0"), df, 5).orderBy("query_id", "rank").collect()]
    assert rows == [(40, r, 7, 15) for r in range(1, 6)] + [(80, r, 7, 0) for r in range(1, 6)]


def test_list_of_hosts_as_a_table(spark):
    # 100 000 listed hosts, of which the corpus holds some; every third page lies on a subdomain.
    listed = spark.range(100_000).select(F.concat(F.lit("h"), F.col("id") * 7, F.lit(".example.net")).alias("name")).unionByName(
        spark.createDataFrame([(None,), ("h7.example.net",), ("h7.example.net",)], "name string"))
    number = F.pmod(F.xxhash64("id"), F.lit(900_000))
    pages = spark.range(60_000).select("id", number.alias("number"), F.concat(
        F.lit("http://"), F.when(F.col("id") % 3 == 0, "www.").otherwise(""), F.lit("h"), number, F.lit(".example.net/a")).alias("url"))
    judged = judge_urls(pages, {"org/": "block"}, listed)
    wrong = judged.filter((F.col("verdict") == "block") != ((F.col("number") % 7 == 0) & (F.col("number") < 700_000)))
    assert wrong.count() == 0 and judged.count() == 60_000 and judged.filter("verdict = 'block'").count() > 5000
    assert judge_urls(pages.limit(5), {}, listed.limit(0)).filter("verdict = 'block'").count() == 0
    assert "Join" not in judged._jdf.queryExecution().executedPlan().toString()
