"""The mixing query against weights and budgets worked out in plain Python."""

import math
import re
from collections import defaultdict
from pathlib import Path

import pytest

from noticework.llm.mixing import mix
from noticework.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are not here")


def test_mixing_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs}
    source = {r["doc_id"]: r["source"] for r in docs}
    tokens, members = defaultdict(int), defaultdict(set)
    for d, n in words.items():
        tokens[source[d]] += n
        members[source[d]].add(d)
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items() if n}
    # The smallest exponent that repeats no source over four times as often as another: share ** (a - 1) falls with the share.
    spread = max(share.values()) / min(share.values())
    exponent = 0.0 if spread <= 4 else 1 - math.log(4) / math.log(spread)
    z = sum(x ** exponent for x in share.values())
    whole = total * z * max(share.values()) ** (1 - exponent)
    taken = defaultdict(lambda: defaultdict(set))
    for r in QUERIES["op8_mixing"](spark, SF_DIR).collect():
        s = source[r["doc_id"]]
        assert r["tokens"] == words[r["doc_id"]] and r["weight"] == pytest.approx(share[s] ** exponent / z, rel=1e-6)
        assert r["doc_id"] not in taken[s][r["pass"]]
        taken[s][r["pass"]].add(r["doc_id"])
    assert set(taken) == set(tokens)
    for s, passes in taken.items():
        budget = share[s] ** exponent / z * whole
        complete = math.floor(budget / tokens[s] * (1 + 1e-9) + 1e-9)
        assert all(passes[p] == members[s] for p in range(complete)) and max(passes) <= complete
        rest = sum(words[d] for d in passes.get(complete, ()))
        room = budget - complete * tokens[s]
        # The part of a pass ends before the first document that does not fit.
        assert rest <= room + 1 and (rest > room - max(words.values()) or complete not in passes)


def test_kept_columns_are_those_of_the_whole_mix(spark):
    rows = [(i, ["a", "b", None][i % 7 % 3], " ".join(["word"] * (i % 13)), i) for i in range(400)] + [(9, "a", None, 9), (9, "a", None, 9), (None, "", "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_pass long")
    whole = mix(docs, max_repetition=2.0).select("doc_id", "mix_tokens", "mix_weight", "mix_pass", "mix_place")
    narrow = mix(docs, max_repetition=2.0, keep=["doc_id"])
    assert narrow.columns == whole.columns
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, narrow.collect()))
    assert mix(docs.limit(0), max_repetition=2.0, keep=["doc_id", "source"]).count() == 0
