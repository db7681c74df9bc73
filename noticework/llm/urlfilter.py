"""URL verdicts from rules and lists held in Bloom filter cascades, without joins.

A cascade answers exactly for every key of the corpus: its first level encodes the listed keys, the
next one the other keys of the corpus that the first lets through, then the listed keys which that one lets
through, and so on until no error is left.  Levels are bit words inside the expression itself, so
a verdict is a projection.  Their size follows the listed keys, not the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticework.llm.common import fresh
from noticework.session import settled

# Bits of one level at most, 2 MB of words: a level is part of every task's plan.
MAX_LEVEL_BITS = 1 << 24
MAX_LEVELS = 40


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    bits: int
    hashes: int


def _positions(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(100 * number + j)), F.lit(bits).cast("bigint")) for j in range(hashes)]


def _passes(key: Column, number: int, level: Level) -> Column:
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    found = F.lit(True)
    for at in _positions(key, number, level.bits, level.hashes):
        word = F.get(words, F.shiftright(at, 6).cast("int"))
        found = found & (F.call_function("shiftright", word, at.bitwiseAND(F.lit(63).cast("bigint")).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return found


def _fill(keys: DataFrame, key: str, number: int, bits: int, hashes: int) -> Level:
    """One Bloom filter of ``keys``: its words are ORed in Spark, at most bits / 64 of them come to the driver."""
    marks = keys.select(F.explode(F.array(*_positions(F.col(key), number, bits, hashes))).alias("at")).select(
        F.shiftright("at", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(F.lit(63).cast("bigint")).cast("int")).alias("bit"))
    words = [0] * (-(-bits // 64))
    for row in marks.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        words[row["word"]] = row["bits"]
    return Level(tuple(words), bits, hashes)


def marked_keys(universe: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """``universe`` with a flag ``is_listed``: whether the first column of ``listed`` holds the key.

    This is the only join, made once when levels are built; nulls and repeats in the list do nothing.
    """
    keys = listed.select(F.col(listed.columns[0]).alias(key)).filter(F.col(key).isNotNull()).distinct().withColumn("is_listed", F.lit(True))
    return universe.join(keys, key, "left").withColumn("is_listed", F.coalesce("is_listed", F.lit(False)))


def build_cascade(universe: DataFrame, key: str, listed: Column | DataFrame) -> list[Level]:
    """Levels that tell exactly which keys of ``universe`` (a written table of distinct keys) satisfy ``listed``, or stand in that table.

    Raises ValueError if a level would outgrow ``MAX_LEVEL_BITS``.
    """
    marked = settled(marked_keys(universe.select(key), key, listed), "marked") if isinstance(listed, DataFrame) else universe.select(key, listed.alias("is_listed"))
    inside, outside = marked.filter("is_listed"), marked.filter("not is_listed")
    levels: list[Level] = []
    own, other = inside, outside
    size, others = (int(x or 0) for x in marked.agg(F.sum(F.col("is_listed").cast("int")), F.sum((~F.col("is_listed")).cast("int"))).first())
    while size and len(levels) < MAX_LEVELS:
        # Half as many errors as there are keys to encode at first, a quarter of the rest later.
        rate = min(0.25, 0.5 * size / max(others, 1)) if not levels else 0.25
        hashes = max(1, min(20, round(-math.log2(rate))))
        bits = max(64, math.ceil(size * hashes / math.log(2)))
        if bits > MAX_LEVEL_BITS:
            raise ValueError(f"a level of {bits} bits is too large for a plan; split the list")
        level = _fill(own, key, len(levels), bits, hashes)
        levels.append(level)
        own, other = other.filter(_passes(F.col(key), len(levels) - 1, level)), own
        others, size = size, own.count()
    if size:
        raise RuntimeError("the cascade did not end")
    return levels


def member(key: Column, levels: Sequence[Level]) -> Column:
    """Whether a key of the universe is listed."""
    answer = F.lit(len(levels) % 2 == 1)
    for number in reversed(range(len(levels))):
        # A key that a level rejects is not of the kind that the level encodes: levels 0, 2, ... encode listed keys.
        answer = F.when(_passes(key, number, levels[number]), answer).otherwise(F.lit(number % 2 == 1))
    return answer


# ---------------------------------------------------------------- URLs

def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    start = F.instr(whole, "://")
    rest = F.when(start > 0, F.substring(whole, start + 3, F.length(whole))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, letters, letters.lower()), path


def _suffixes(host: Column, labels: int) -> Column:
    """The host and its parent domains, of at most ``labels`` labels."""
    parts = F.split(host, r"\.")
    last = F.least(F.size(parts), F.lit(labels))
    return F.transform(F.sequence(F.lit(1), last), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))


def rule_keys(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """All keys a rule that fits this host and path could have, longest first, given the rules' shapes."""
    lengths = sorted({len(r) - r.index("/") for r in rules}, reverse=True)
    labels = max((r.split("/")[0].count(".") + 1 for r in rules), default=1)
    suffixes = _suffixes(host, labels)

    def with_prefix(prefix: Column) -> Column:
        return F.transform(suffixes, lambda suffix: F.concat(suffix, prefix))

    none = F.array().cast("array<string>")
    per_length = [F.when(F.length(path) >= n, with_prefix(F.substring(path, 1, n))).otherwise(none) for n in lengths]
    keys = F.concat(*per_length) if per_length else none
    return F.array_sort(keys, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def judge_urls(pages: DataFrame, rules: Mapping[str, str], listed: Sequence[str] | DataFrame = (), url: str = "url",
               names: Sequence[str] = ("host", "path", "rule", "verdict")) -> DataFrame:
    """``pages`` with host, path, the longest rule that fits (or null) and the verdict.

    ``rules`` maps ``host/path`` to ``allow`` or ``block``.  A rule fits its host and every subdomain if
    the path starts with the rule's.  Without a rule the method decides: block if ``listed`` holds the
    host or one of its parent domains, else allow; a long list comes as a table, hosts in its first column.  Null and relative urls have empty host and path
    and are allowed unless a rule says otherwise.  Columns of ``pages`` named like the results are replaced.
    """
    host_name, path_name, rule_name, verdict_name = names
    host, path = host_and_path(F.col(url))
    h, p = fresh(pages, "url_host"), fresh(pages, "url_path")
    split = pages.withColumns({h: host, p: path})
    if isinstance(listed, DataFrame):
        labels = int(listed.agg(F.max(F.size(F.split(listed.columns[0], r"\.")))).first()[0] or 1)
    else:
        labels = max((x.count(".") + 1 for x in listed), default=1)
    rule_candidates, host_candidates = rule_keys(F.col(h), F.col(p), list(rules)), _suffixes(F.col(h), labels)
    universe = settled(split.select(h, F.left(p, F.lit(max((len(r) - r.index("/") for r in rules), default=0))).alias(p)).distinct()
                       .select(F.explode(F.concat(rule_candidates, host_candidates)).alias("key")).distinct(), "keys")
    sets = {"allow": [r for r, v in rules.items() if v == "allow"], "block": [r for r, v in rules.items() if v == "block"]}
    levels = {name: build_cascade(universe, "key", F.col("key").isin(keys) if keys else F.lit(False)) for name, keys in sets.items()}
    levels["listed"] = build_cascade(universe, "key", listed if isinstance(listed, DataFrame) else F.col("key").isin(*listed) if listed else F.lit(False))
    best = F.get(F.filter(rule_candidates, lambda k: member(k, levels["allow"]) | member(k, levels["block"])), F.lit(0))
    r = fresh(pages, "url_rule")
    verdict = (F.when(F.col(r).isNotNull(), F.when(member(F.col(r), levels["allow"]), "allow").otherwise("block"))
               .when(F.exists(host_candidates, lambda k: member(k, levels["listed"])), "block").otherwise("allow"))
    replaced = {n.lower() for n in names}
    return split.withColumn(r, best).select(
        *(c for c in pages.columns if c.lower() not in replaced), F.col(h).alias(host_name), F.col(p).alias(path_name), F.col(r).alias(rule_name), verdict.alias(verdict_name))
