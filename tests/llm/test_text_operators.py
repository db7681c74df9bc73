"""Quality, packing, line and near dedup against brute force, with odd rows."""

import math
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticework.llm import lines, packing, quality, simhash
from noticework.llm.lines import CuckooChain, CuckooFilter, LineStore, dedup_lines
from noticework.llm.packing import pack
from noticework.llm.quality import judge_documents, text_statistics
from noticework.llm.simhash import components, fingerprint, near_duplicates

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD_TEXTS = [None, "", "\n\n", " \t ", "word", "two words", "Über ß 語 😀 <|endoftext|> 'll", "a b c d e f " * 40, "x" * 5000, "same line here\nsame line here\n  SAME LINE HERE\t",
             "same line here\nother line here", "z\u00a0z\u2003z " * 12, " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(3000)) + " end"]


def odd_documents(spark, extra=True):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[9], rows[9], (None, "same line here", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.withColumns({c: F.lit("taken") for c in ("kept", "n_lines", "n_words", "fingerprint", "component_id", "key", "line_keys", "band_q1", "log_sum")}) if extra else docs


def plain_words(text):
    return [w for w in "".join(" " if c in BLANK else c for c in text or "").split(" ") if w]


def plain_statistics(text):
    words = plain_words(text)
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if plain_words(line):
            repeated += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(covered)


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_text_statistics(text):
    assert text_statistics(None if text is None else text.encode()) == plain_statistics(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#é", max_size=60))
def test_text_statistics_random(text):
    assert text_statistics(text.encode()) == plain_statistics(text)


def plain_kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney by definition, on bytes."""
    top = Counter()
    for text in texts:
        raw = b"\0" * (order - 1) + text.encode()
        top.update(raw[i:i + order] for i in range(len(raw) - order + 1))
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def discount(k, c):
        t = [sum(1 for x in levels[k].values() if x == i) for i in range(1, 5)]
        if not all(t):
            return 0.5
        y = t[0] / (t[0] + 2 * t[1])
        c = min(c, 3)
        return max(0.0, c - (c + 1) * y * t[c] / t[c - 1])

    def probability(gram):
        k = len(gram)
        if k == 0:
            return 1 / 256
        followers = [c for g, c in levels[k].items() if g[:-1] == gram[:-1]]
        left = sum(discount(k, c) for c in followers) / sum(followers)
        return (levels[k][gram] - discount(k, levels[k][gram])) / sum(followers) + left * probability(gram[1:])

    return {g: math.log10(probability(g)) for g in top}


def test_kneser_ney_by_definition(spark):
    texts = ["abracadabra alakazam", "abra cadabra, simsalabim", "la la land bra"]
    docs = spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string")
    got = {int(r["gram"]).to_bytes(3, "big"): r["logp"] for r in quality.kneser_ney(quality.count_ngrams(docs, 3), 3).collect()}
    want = plain_kneser_ney(texts, 3)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[g], want[g], abs_tol=1e-9) for g in want)


def test_perplexity_sums_over_pieces_and_rounds(spark, monkeypatch):
    texts = ["abracadabra alakazam " * 30, "", None, "la la land"]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = quality.settled(quality.kneser_ney(quality.count_ngrams(docs, 3), 3), "m")
    logp = {int(r["gram"]).to_bytes(3, "big"): r["logp"] for r in model.collect()}
    want = {}
    for i, t in enumerate(texts):
        raw = b"\0\0" + (t or "").encode()
        want[i] = -sum(logp[raw[j:j + 3]] for j in range(len(raw) - 2)) / (len(raw) - 2) if t else None
    foreign = spark.createDataFrame([(9, "la zz", "xx"), (10, "la", "yy")], "doc_id long, text string, lang string")
    want |= {9: (7.0 * 2 - sum(logp[g] for g in (b"\0\0l", b"\0la", b"la "))) / 5, 10: 7.0}
    for entries, part, piece in ((4_000_000, 1 << 16, 1 << 18), (20, 8, 7)):
        monkeypatch.setattr(quality, "BROADCAST_ENTRIES", entries)
        monkeypatch.setattr(quality, "PART_ENTRIES", part)
        monkeypatch.setattr(quality, "_PIECE", piece)
        got = {r["doc_id"]: r["log10_ppl"] for r in quality.score_documents(docs.unionByName(foreign), model, 3).collect()}
        assert all(got[i] is None if want[i] is None else math.isclose(got[i], want[i], abs_tol=1e-4) for i in want)


def test_judged_documents(spark):
    docs = odd_documents(spark)
    rows = judge_documents(docs, prefix="p_").collect()
    assert len(rows) == docs.count()
    for r in rows:
        words, chars, symbols, repeated, covered = plain_statistics(r["text"])
        assert (r["p_n_words"], r["p_word_chars"], r["p_n_symbols"], r["p_n_dup_lines"], r["p_n_repeat_words"]) == (words, chars, symbols, repeated, covered)
        assert r["p_base_failed"] == (words < 10 or 100 * covered > 20 * words)
        assert not (r["p_base_failed"] and r["p_kept"]) and r["kept"] == "taken"


def test_band_rejects_another_language(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(["ba", "lo", "mi", "ta", "no"], rng.integers(1, 4))) for _ in range(300)]
    good = [(i, " ".join(rng.choice(words, 60)), "xx") for i in range(300)]
    docs = spark.createDataFrame([*good, (1000, " ".join("".join(chr(c) for c in rng.integers(97, 123, 5)) for _ in range(60)), "xx")], "doc_id long, text string, lang string")
    verdicts = {r["doc_id"]: r["kept"] for r in judge_documents(docs).filter(~F.col("base_failed")).collect()}
    assert not verdicts[1000]
    assert sum(verdicts.values()) == len(verdicts) - 1


# ---------------------------------------------------------------- packing

def slow_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab 'lsé\n\t 1<|endoftext>", max_size=80), st.just("x <|endoftext|>  y")))
def test_ranks_give_the_tokenizers_ids(text):
    encoder = packing._encoder(*packing.byte_bpe_50k())
    assert encoder.encode_to_numpy(text, allowed_special="all").tolist() == slow_encoder().encode(text, add_special_tokens=False).ids


_SLOW = []


def slow_encoder():
    if not _SLOW:
        _SLOW.append(slow_tokenizer())
    return _SLOW[0]


def check_packing(spark, docs, capacity):
    rows = pack(docs, capacity=capacity).collect()
    want = Counter()
    for d in docs.collect():
        ids = [*slow_encoder().encode(d["text"] or "", add_special_tokens=False).ids, 2]
        for k, (start, length) in enumerate(packing.cut(len(ids), capacity)):
            want[(d["doc_id"], k, start, length, zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r["length"] for r in rows)


def test_packing_round_trip(spark):
    sequences, tokens = check_packing(spark, odd_documents(spark), 64)
    assert sequences <= math.ceil(tokens / 64) + 2


def test_packing_nothing(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("length", [1, 9, 10, 11, 20, 25])
def test_only_the_first_piece_is_short(length):
    cut = packing.cut(length, 10)
    assert sum(n for _, n in cut) == length and all(n == 10 for _, n in cut[1:])
    assert [s for s, _ in cut] == [sum(n for _, n in cut[:i]) for i in range(len(cut))]


def fewest_sequences(sizes, capacity):
    """By branching over all assignments."""
    best = [len(sizes)]

    def place(rest, rooms):
        if len(rooms) >= best[0]:
            return
        if not rest:
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= rest[0]:
                place(rest[1:], [*rooms[:i], rooms[i] - rest[0], *rooms[i + 1:]])
        place(rest[1:], [*rooms, capacity - rest[0]])

    place(sorted(sizes, reverse=True), [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_fixed_sets_keep_the_optimum(sizes):
    fixed, rest = packing.reduce_lengths(Counter(sizes), 20)
    left = [s for s, n in rest.items() for _ in range(n)]
    used = Counter(s for pattern, n in fixed for s in pattern for _ in range(n))
    assert used + Counter(left) == Counter(sizes)
    assert all(sum(p) <= 20 for p, _ in fixed)
    assert sum(n for _, n in fixed) + (fewest_sequences(left, 20) if left else 0) == fewest_sequences(sizes, 20)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=0, max_size=60))
def test_best_fit_equals_one_by_one(sizes):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(20 - s)
    groups = packing.best_fit(Counter(sizes), 20)
    assert Counter(s for p, n in groups for s in p for _ in range(n)) == Counter(sizes)
    assert sorted(20 - sum(p) for p, n in groups for _ in range(n)) == sorted(rooms)


# ---------------------------------------------------------------- lines

def plain_line_key(line):
    key = line.strip(BLANK)
    key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)
    return key if len(key) >= 10 else None


def plain_dedup(rows):
    """rows: (doc_id, text); a missing doc_id comes last."""
    big = 1 << 63
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[plain_line_key(line)].add(big if d is None else d)
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if (k := plain_line_key(x)) is None or min(holders[k]) == (big if d is None else d)]
        out.append((d, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return out


def test_line_dedup_by_definition(spark):
    docs = odd_documents(spark)
    rows = dedup_lines(docs).collect()
    want = plain_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in rows) == Counter(want)
    assert all(r["kept"] == "taken" for r in rows)
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_dedup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", 0)
    docs = odd_documents(spark)
    want = plain_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(docs).collect()) == Counter(want)


def store_state(store):
    keys = Counter((bytes(r["key"]), r["refs"], r["first"]) for r in store._read("keys").collect())
    references = Counter((bytes(r["key"]), r["doc"]) for r in store._read("references").collect())
    return keys, references


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_insert_and_delete_are_reversible(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", broadcast_bytes)
    rng = np.random.default_rng(5)
    texts = [f"line number {i} of the pool" for i in range(30)]
    make = lambda ids: spark.createDataFrame([(int(i), "\n".join(rng.choice(texts, 6))) for i in ids], "doc_id long, text string")
    first, second = make(range(20)).cache(), make(range(20, 35)).cache()
    store = LineStore(spark, shards=3).insert(first)
    before = store_state(store)
    cleaned = sorted(map(tuple, store.clean(first).collect()))
    store.insert(second).insert(second)
    both = first.unionByName(second)
    want = plain_dedup([tuple(r) for r in both.collect()])
    assert Counter(map(tuple, store.clean(both).collect())) == Counter(want)
    assert store_state(store) == store_state(LineStore(spark, shards=3).insert(both))
    store.delete(second.select("doc_id"))
    assert store_state(store) == before
    assert sorted(map(tuple, store.clean(first).collect())) == cleaned
    # The filters know every key that is left, and no more than a few others.
    chains = {(r["shard"], r["kind"]): CuckooChain.unpack(bytes(r["filter"])) for r in store._read("filters").collect()}
    for r in store._read("keys").collect():
        h = lines._hashes([bytes(r["key"])])
        assert chains[(r["shard"], "known")].contains(h).all()
        assert chains[(r["shard"], "repeated")].contains(h).all() or r["refs"] < 2


def test_filters_answer_for_unique_lines(spark):
    docs = spark.createDataFrame([(i, f"a line of {i} alone\nthe line of {i // 2} and its neighbour") for i in range(200)], "doc_id long, text string")
    store = LineStore(spark, shards=4).insert(docs)
    flags = store._flag(store._read("keys"), store._read("filters"), "repeated").join(store._read("keys"), ["shard", "key"])
    counts = Counter((r["refs"] > 1, r["maybe"]) for r in flags.collect())
    assert counts[True, True] == 100 and counts[True, False] == 0 and counts[False, False] > 190


@pytest.mark.parametrize("n", [1, 100, 5000])
def test_cuckoo_chain(n):
    rng = np.random.default_rng(n)
    hashes, others = rng.integers(0, 1 << 64, n, np.uint64), rng.integers(0, 1 << 64, 20000, np.uint64)
    chain = CuckooChain()
    for part in np.array_split(hashes, 3):
        chain.add(part)
    chain = CuckooChain.unpack(chain.pack())
    assert chain.contains(hashes).all()
    assert chain.contains(others).mean() < 0.005
    chain.remove(hashes[: n // 2])
    assert chain.contains(hashes[n // 2:]).all()
    chain.remove(hashes[n // 2:])
    assert not chain.contains(others).any() and not chain.stray


def test_full_filter_keeps_what_it_evicts():
    hashes = np.random.default_rng(0).integers(0, 1 << 64, 90, np.uint64)
    chain = CuckooChain([CuckooFilter(16)])
    chain.stray += [(0, int(p), int(b)) for p, b in chain.filters[0].add(hashes)]
    assert chain.stray and chain.contains(hashes).all()
    chain = CuckooChain.unpack(chain.pack())
    chain.remove(hashes)
    assert not chain.stray and not chain.filters[0].slots.any()


# ---------------------------------------------------------------- near duplicates

def plain_fingerprint(text):
    words = plain_words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_fingerprint(text):
    assert fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def plain_components(items):
    parent = {i: i for i in range(len(items))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(items)), 2):
        if (items[i][1] ^ items[j][1]).bit_count() <= 3:
            parent[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            smallest[find(i)] = min(smallest.get(find(i), d), d)
    return [smallest.get(find(i)) for i in range(len(items))]


def test_near_duplicates_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = near_duplicates(docs, fingerprint_name="mark", component="group").collect()
    items = [(r["doc_id"], plain_fingerprint(r["text"])) for r in rows]
    assert [r["mark"] % (1 << 64) for r in rows] == [f for _, f in items]
    assert [r["group"] for r in rows] == plain_components(items)
    assert all(r["fingerprint"] == "taken" for r in rows) and len(rows) == docs.count()
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_connect_all_pairs_within_the_radius(spark):
    rng = np.random.default_rng(3)
    prints = set(int(x) for x in rng.integers(0, 1 << 64, 60, np.uint64))
    dense = int(rng.integers(0, 1 << 64, dtype=np.uint64))
    for _ in range(400):  # a dense group, and chains of single steps
        prints.add(dense ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), False)))
    for start in list(prints)[:30]:
        for _ in range(4):
            start ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), False))
            prints.add(start)
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fingerprint long")
    links = simhash.near_links(df)
    assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 3 for r in links.collect())
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    want = plain_components([(signed(x), x) for x in prints])
    assert [roots.get(signed(x), signed(x)) for x in prints] == want


def test_grid_finds_every_near_pair():
    rng = np.random.default_rng(9)
    one = rng.integers(0, 1 << 64, 3000, np.uint64)
    other = one.copy()
    for row in range(len(other)):
        for b in rng.choice(64, rng.integers(0, 4), False):
            other[row] ^= np.uint64(1) << np.uint64(b)
    assert (simhash.grid_cells(one) == simhash.grid_cells(other)).any(axis=1).all()
    assert simhash._near(one, other, 3).all()


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 150: 100} or got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 150: 100}
