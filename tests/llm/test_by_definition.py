"""The quality query and the pipeline's rows on a driver table, each against its definition in plain Python."""

import math
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from pathlib import Path

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from noticework.llm.queries import QUERIES
from tests.llm.test_text_operators import plain_components, plain_dedup, plain_fingerprint, plain_statistics, plain_words, slow_tokenizer

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are not here")


def log_probability_of(texts, order=5):
    """Log10 probability of any n-gram of bytes by modified Kneser-Ney on these texts; unseen ones back off."""
    counts = Counter()
    for text in texts:
        raw = b"\0" * (order - 1) + text
        counts.update(raw[i:i + order] for i in range(len(text)))
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    off, total, taken = {}, Counter(), defaultdict(float)
    for k, level in levels.items():
        t = [sum(1 for n in level.values() if n == i) for i in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if all(t) else None
        off[k] = [0.0, *(max(0.0, i - (i + 1) * y * t[i] / t[i - 1]) if all(t) else 0.5 for i in (1, 2, 3))]
        for g, n in level.items():
            total[g[:-1], k] += n
            taken[g[:-1], k] += off[k][min(n, 3)]

    @lru_cache(maxsize=None)
    def p(g):
        if not g:
            return 1 / 256
        here, n = (g[:-1], len(g)), levels[len(g)].get(g, 0)
        if here not in total:
            return p(g[1:])
        mass = taken[here] if n else max(taken[here], 0.5)
        return (n - off[len(g)][min(n, 3)] + mass * p(g[1:])) / total[here]

    return lambda g: math.log10(p(g))


def half_of(text):
    """The half of its language that a text belongs to, by the hash that Spark gives it; null has the hash of nothing, the seed."""
    return (42 if text is None else xxhash.xxh64_intdigest(text.encode(), seed=42)) % 2


def verdicts(docs):
    """(base_failed, kept, distance from the nearer bound) of each (doc_id, text, lang)."""
    out = {}
    for lang in {x[2] or "" for x in docs}:
        own = [(d, t, plain_statistics(t)) for d, t, x in docs if (x or "") == lang]
        distinct = {t for _, t, _ in own if t}
        logp = [log_probability_of([t.encode() for t in sorted(distinct) if half_of(t) != half]) for half in (0, 1)]
        scores = {}
        for d, t, stats in own:
            raw = b"\0" * 4 + (t or "").encode()
            failed = stats[0] < 10 or 100 * stats[4] > 20 * stats[0]
            scores[d] = failed, -sum(logp[half_of(t)](raw[i:i + 5]) for i in range(len(raw) - 4)) / (len(raw) - 4) if t else None, stats[0]
        once = {t: scores[d][1] for d, t, _ in own if not scores[d][0]}
        bins = sorted(math.floor(1000 * s + 0.5) for s in once.values())
        for d, (failed, score, words) in scores.items():
            if failed:
                out[d] = True, False, 1.0
                continue
            q1, q3 = (bins[max(0, math.ceil(len(bins) * q / 4) - 1)] / 1000 for q in (1, 3))
            reach = 4 * max(q3 - q1, 0.001) * math.sqrt(1 + 300 / words)
            out[d] = False, q1 - reach <= score <= q3 + reach, min(abs(score - q1 + reach), abs(q3 + reach - score))
    return out


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def judged(documents):
    return verdicts([x[:3] for x in documents])


def test_quality_query(spark, documents, judged):
    rows = {r["doc_id"]: r for r in QUERIES["op1_quality"](spark, SF_DIR).collect()}
    assert len(rows) == len(documents)
    for d, text, _, _ in documents:
        r = rows[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_statistics(text)
        failed, kept, margin = judged[d]
        assert r["base_failed"] == failed and (r["kept"] == kept or margin < 0.002)
    assert any(r["kept"] for r in rows.values())


def test_pipeline_rows(spark, documents, judged):
    kept = [(d, t) for d, t, _, _ in documents if judged[d][1]]
    cleaned = {d: t for d, t, _, _ in plain_dedup(kept)}
    groups = plain_components([(d, plain_fingerprint(t)) for d, t in cleaned.items()])
    unique = {d: cleaned[d] for d, first in zip(cleaned, groups, strict=True) if d == first}
    found = defaultdict(list)
    places = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF_DIR).collect():
        found[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(found) == set(unique)
    tokenizer = slow_tokenizer()
    times = {}
    for d, pieces in found.items():
        ids = np.array([*tokenizer.encode(unique[d], add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024
        starts = [*([0] if first else []), *range(first, len(ids), 1024)]
        want = [(k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
        times[d] = len(pieces) // len(want)
        assert Counter(pieces) == Counter(want * times[d])
    for slots in places.values():
        slots.sort()
        assert [o for o, _ in slots] == [sum(n for _, n in slots[:i]) for i in range(len(slots))] and sum(n for _, n in slots) <= 1024
    # The mix: every document at least once, the largest source once, none over the limit.
    source = {d: s for d, _, _, s in documents}
    tokens, taken = Counter(), Counter()
    for d, n in times.items():
        tokens[source[d]] += len(plain_words(unique[d]))
        taken[source[d]] += n * len(plain_words(unique[d]))
    largest = max(tokens, key=tokens.get)
    assert taken[largest] == tokens[largest] and min(times.values()) == 1
    assert all(taken[s] <= 2 * tokens[s] for s in tokens)
