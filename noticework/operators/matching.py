"""Entity resolution: winners against a company register, by name, number and near name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from noticework.functions.meeting import probing
from noticework.functions.similarity import jaro_winkler, overlap_factor
from noticework.functions.text import NAME_FLOOR, company_name, digits, first_word, usable_register_number
from noticework.functions.values import AWARD_CAP, share
from noticework.operators.ordering import best_rows
from noticework.operators.skew import salted_join
from noticework.session import settled, spread_by

# Similarity a near name has to reach; awards and value that ``match_fuzzy`` can be told to ask for.
NEAR_NAME = 0.95
FUZZY_MIN_AWARDS = 3
FUZZY_MIN_VALUE = 5e6

METHODS = ("exact", "id", "fuzzy")
MATCH_COLUMNS = ["winner", "iso3", "awards", "value_capped", "parent", "sub_name", "sim", "how"]


def winner_names(awards: DataFrame, value: str, cap: float = AWARD_CAP) -> DataFrame:
    """One row per (winner, iso3): awards, capped value, one register number, normalised name.

    Names are grouped as written first, so the normalisation runs once per spelling.
    """
    grouped = awards.filter(F.col("winner").isNotNull()).groupBy("winner", "iso3").agg(
        F.min("winner_id").alias("winner_id"), F.count(F.lit(1)).alias("awards"),
        F.sum(F.least(F.col(value), F.lit(cap))).alias("value_capped"))
    return grouped.withColumn("name_norm", company_name(F.col("winner"))).filter(F.length("name_norm") >= NAME_FLOOR)


def unambiguous_names(register: DataFrame, keys: Sequence[str], owner: str) -> DataFrame:
    """Register rows whose key belongs to a single owner."""
    single = register.groupBy(*keys).agg(F.min(owner).alias("__low"), F.max(owner).alias("__high"))
    single = single.filter(F.col("__low") == F.col("__high")).select(*keys)
    return register.join(single, list(keys), "left_semi")


def register_names(register: DataFrame) -> DataFrame:
    """Distinct register entries with normalised, unambiguous names and the number after the slash."""
    number = digits(F.regexp_extract("oc", "/(.*)$", 1))
    entries = register.select("parent", "iso3", "sub_name", company_name(F.col("sub_name")).alias("name_norm"),
                              number.alias("oc_digits")).distinct().filter(F.length("name_norm") >= NAME_FLOOR)
    return unambiguous_names(entries, ["iso3", "name_norm"], "parent")


def _register_by(register: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First register entry per key, so that the join never multiplies winners."""
    entry = F.min(F.struct("sub_name", "parent")).alias("__entry")
    return register.groupBy(*keys).agg(entry).select(*keys, "__entry.sub_name", "__entry.parent")


def match_exact(winners: DataFrame, register: DataFrame) -> DataFrame:
    entries = _register_by(register, ["iso3", "name_norm"])
    return winners.join(entries, ["iso3", "name_norm"]).withColumns({"sim": F.lit(1.0), "how": F.lit("exact")}).select(*MATCH_COLUMNS)


def match_id(winners: DataFrame, register: DataFrame) -> DataFrame:
    numbered = winners.withColumn("reg_no", usable_register_number(F.col("winner_id"), F.col("iso3"))).filter("reg_no is not null")
    known = register.withColumn("reg_no", usable_register_number(F.col("oc_digits"), F.col("iso3"))).filter("reg_no is not null")
    entries = _register_by(known, ["iso3", "reg_no"])
    return numbered.join(entries, ["iso3", "reg_no"]).withColumns({"sim": F.lit(1.0), "how": F.lit("id")}).select(*MATCH_COLUMNS)


# Characters of a normalised name, and how many occurrences of each are told apart.  A name is
# a bit set per occurrence level (bit i of level k: character i occurs at least k times), so
# shared characters are counted with a few machine instructions.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 "
_LEVELS = 4

# As SQL text: one expression instead of hundreds of column objects.
_BIT_OF_CHAR = f"shiftleft(1L, instr('{_ALPHABET}', c) - 1)"
_STEPS = [f"'l1', s.l1 | {_BIT_OF_CHAR}"]
_STEPS += [f"'l{k}', s.l{k} | (s.l{k - 1} & {_BIT_OF_CHAR})" for k in range(2, _LEVELS + 1)]
_STEPS += [f"'over', s.over + if(s.l{_LEVELS} & {_BIT_OF_CHAR} <> 0, 1L, 0L)"]
_PROFILE = f"""
aggregate(filter(split(substring(name_norm, length(word) + 1), ''), c -> c <> ''),
          named_struct({", ".join(f"'l{k}', 0L" for k in range(1, _LEVELS + 1))}, 'over', 0L),
          (s, c) -> named_struct({", ".join(_STEPS)}))"""


# Meeting points that a name needs in a large block, about; where fewer pairs than that exist, all pairs of the block meet.
_USUAL_PROBES = 100
# Blocks of this many names a side meet on single characters; every size 2.5 times as large adds one to the combination.
_SINGLES, _STEP = 250, 2.5
# Occurrences of a character whose frequencies are told apart when characters are ordered from rare to frequent.
_RANKED_OCCURRENCES = 8

_LEVEL_COLUMNS = [f"l{k}" for k in range(1, _LEVELS + 1)]


def _profiled(names: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Names of shared blocks with an id, their length and characters as occurrence levels (``l1``..); ``over`` counts the rest."""
    shaped = names.join(blocks, list(keys)).withColumns({"len": F.length("name_norm"), "p": F.expr(_PROFILE)})
    # The first word is shared by definition, so all of it counts.
    rest = (F.length("word") + F.col("p.over")).cast("int")
    return settled(shaped.select(*keys, "name_norm", "direct", "size", "len", *[f"p.l{k}" for k in range(1, _LEVELS + 1)], rest.alias("over"),
                                 F.monotonically_increasing_id().alias("id")), "profiles")


def _shared_enough(factor: float) -> Column:
    """Whether two names share as many characters as the threshold asks for at least."""
    common = F.least("over", "other_over")
    for level in _LEVEL_COLUMNS:
        common = common + F.bit_count(F.col(level).bitwiseAND(F.col(f"other_{level}")))
    return common >= F.lit(factor) * F.col("len") * F.col("other_len") / (F.col("len") + F.col("other_len")) - 1e-9


def _other(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).alias(f"other_{c}") for c in columns]


def _character_ranks(*sides: DataFrame) -> dict[tuple[str, int], int]:
    """Place of each (character, occurrence) after the first word, rarest first; at most alphabet times ``_RANKED_OCCURRENCES`` rows."""
    total = None
    for names in sides:
        chars = names.select(F.explode(F.filter(F.split(F.expr("substring(name_norm, length(word) + 1)"), ""), lambda c: c != "")).alias("c"), "id")
        counted = (chars.groupBy("id", "c").count().select("c", F.explode(F.sequence(F.lit(1), F.least("count", F.lit(_RANKED_OCCURRENCES)).cast("int"))).alias("k"))
                   .groupBy("c", "k").count())
        total = counted if total is None else total.unionByName(counted)
    rows = total.groupBy("c", "k").agg(F.sum("count").alias("n")).orderBy("n", "c", "k").collect()
    return {(r["c"], r["k"]): i for i, r in enumerate(rows)}


def _probes(profiles: DataFrame, factor: float, keys: Sequence[str], flipped: bool, ranks: dict[tuple[str, int], int], carried: Sequence[str]) -> DataFrame:
    """One row per meeting point of a name.  Different points with an equal hash only add pairs, which later checks drop."""
    source = profiles.select(*carried, "name_norm", F.length("word").alias("__word"), F.xxhash64(*keys).alias("__block"), "size")
    schema = StructType([StructField("meet", LongType()), *(source.schema[c] for c in carried)])

    return source.mapInArrow(probing(schema.fieldNames(), factor, flipped, ranks), schema)


def met_pairs(a: DataFrame, b: DataFrame, factor: float, keys: Sequence[str]) -> DataFrame:
    """Pairs of profiled names of large blocks that meet on a combination of rare characters, with what the bound needs."""
    carried = ["id", "len", *_LEVEL_COLUMNS, "over"]
    ranks = _character_ranks(a, b)
    ours, theirs = (spread_by(_probes(side, factor, keys, flipped, ranks, carried), "meet") for side, flipped in ((a, False), (b, True)))
    return salted_join(ours, theirs.select("meet", *_other(carried)), ["meet"])


def similar_names(left: DataFrame, right: DataFrame, threshold: float = NEAR_NAME, block: str = "iso3") -> DataFrame:
    """All pairs of different names with an equal block and first word that reach the threshold.

    In a small block all names meet.  In a large one they meet on combinations of their rarest characters: the more names a block has,
    the more characters a combination has, so that the pairs that meet grow more slowly than all pairs (see ``meeting.combination_sizes``).
    Hot meeting points are salted, and the shared-character bound drops the rest before the similarity
    is computed.  No bound can drop a pair that reaches the threshold.  Of large blocks only numbers are shuffled;
    names come back for the pairs that are left.
    """
    factor = overlap_factor(threshold)
    keys = [block, "word"]
    a, b = (spread_by(names.select(block, "name_norm"), block, "name_norm").distinct().withColumn("word", first_word(F.col("name_norm"))) for names in (left, right))
    # Names whose block exists on one side only can meet nobody.
    sizes = (a.groupBy(*keys).agg(F.count(F.lit(1)).alias("lefts")).join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("rights")), keys))
    few = F.col("lefts") * F.col("rights") <= _USUAL_PROBES * (F.col("lefts") + F.col("rights"))
    size = 1 + F.greatest(F.log(_STEP, F.sqrt(F.col("lefts") * F.col("rights").cast("double")) / _SINGLES), F.lit(0.0))
    blocks = settled(sizes.select(*keys, few.alias("direct"), size.alias("size")), "blocks")
    a, b = _profiled(a, blocks, keys), _profiled(b, blocks, keys)
    carried = ["name_norm", "len", *_LEVEL_COLUMNS, "over"]
    small = salted_join(a.filter("direct").select(*keys, *carried), b.filter("direct").select(*keys, *_other(carried)), keys)
    named = small.filter(_shared_enough(factor)).select(block, "name_norm", "other_name_norm")
    if not blocks.filter(~F.col("direct")).isEmpty():
        large_a, large_b = a.filter(~F.col("direct")), b.filter(~F.col("direct"))
        # A pair may meet on several combinations.
        close = met_pairs(large_a, large_b, factor, keys).filter(_shared_enough(factor)).select("id", "other_id").distinct()
        named = named.unionByName(
            close.join(large_a.select("id", block, "name_norm"), "id")
            .join(large_b.select(F.col("id").alias("other_id"), F.col("name_norm").alias("other_name_norm")), "other_id").select(block, "name_norm", "other_name_norm"))
    named = named.filter(F.col("name_norm") != F.col("other_name_norm"))
    return named.withColumn("sim", jaro_winkler("name_norm", "other_name_norm")).filter(F.col("sim") >= threshold)


def match_fuzzy(winners: DataFrame, register: DataFrame, threshold: float = NEAR_NAME,
                min_awards: int | None = None, min_value: float | None = None) -> DataFrame:
    """Best near name per winner; with ``min_awards`` or ``min_value`` only of those that reach one of them."""
    floors = [F.col(c) >= least for c, least in (("awards", min_awards), ("value_capped", min_value)) if least is not None]
    worth = winners.filter(reduce(or_, floors)) if floors else winners
    entries = _register_by(register, ["iso3", "name_norm"]).withColumnRenamed("name_norm", "other_name_norm")
    pairs = similar_names(worth, register, threshold)
    named = pairs.join(entries, ["iso3", "other_name_norm"])
    best = best_rows(named, ["iso3", "name_norm"], [F.col("sim").desc(), F.col("sub_name"), F.col("parent")])
    return (worth.join(best.select("iso3", "name_norm", "parent", "sub_name", "sim"), ["iso3", "name_norm"])
            .withColumn("how", F.lit("fuzzy")).select(*MATCH_COLUMNS))


def method_rank(how: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in METHODS]), how)


def merge_matches(*matches: DataFrame) -> DataFrame:
    """One match per winner: exact before register number before near name."""
    every = matches[0]
    for more in matches[1:]:
        every = every.unionByName(more)
    return best_rows(every, ["winner", "iso3"], [method_rank(F.col("how")), F.col("sim").desc(), F.col("sub_name"), F.col("parent")])


def match_all(winners: DataFrame, register: DataFrame, threshold: float = NEAR_NAME) -> DataFrame:
    """All three methods; give it settled inputs, as each method reads them again.

    A near name never displaces an exact name or a number, so only the remaining winners are searched.
    """
    sure = settled(merge_matches(match_exact(winners, register), match_id(winners, register)), "sure")
    rest = winners.join(sure.select("winner", "iso3"), ["winner", "iso3"], "left_anti")
    return sure.unionByName(match_fuzzy(rest, register, threshold))


def match_report(matches: DataFrame, winners: DataFrame) -> DataFrame:
    """Matched winners by method, with their shares of all awards and of all capped value."""
    totals = winners.agg(F.struct(F.sum("awards").alias("awards"), F.sum("value_capped").alias("value")).alias("t")).scalar()
    by_method = matches.groupBy("how").agg(F.count(F.lit(1)).alias("winners"), F.sum("awards").alias("awards"),
                                           F.sum("value_capped").alias("value_capped"), F.min("sim").alias("min_sim"))
    return by_method.withColumns({"share_of_awards": share(F.col("awards"), totals["awards"]),
                                  "share_of_value": share(F.col("value_capped"), totals["value"])})


def match_precision(matches: DataFrame, winners: DataFrame, register: DataFrame) -> DataFrame:
    """Name matches where both sides carry a register number: how often the numbers agree.

    A match counts once, against the register entry that it names; an entry with several numbers agrees by any of them.
    """
    ours = winners.select("winner", "iso3", usable_register_number(F.col("winner_id"), F.col("iso3")).alias("own_no"))
    theirs = register.select("iso3", "sub_name", "parent", usable_register_number(F.col("oc_digits"), F.col("iso3")).alias("reg_no"))
    checked = (matches.filter(F.col("how").isin("exact", "fuzzy")).join(ours.filter("own_no is not null"), ["winner", "iso3"])
               .join(theirs.filter("reg_no is not null"), ["iso3", "sub_name", "parent"]))
    judged = checked.groupBy("winner", "iso3", "how").agg(F.bool_or(F.col("own_no") == F.col("reg_no")).alias("agrees"))
    return judged.groupBy("how").agg(F.count(F.lit(1)).alias("checkable"), F.avg(F.col("agrees").cast("int")).alias("ids_agree"))


def matched_share(winners: DataFrame, matches: DataFrame, by: str = "iso3") -> DataFrame:
    """Share of awards and of value that found a parent, per country."""
    flagged = winners.join(matches.select("winner", "iso3", F.lit(True).alias("hit")), ["winner", "iso3"], "left")
    hit = F.coalesce(F.col("hit"), F.lit(False))
    return flagged.groupBy(by).agg(
        F.sum("awards").alias("awards"),
        share(F.sum(F.when(hit, F.col("awards")).otherwise(0)), F.sum("awards")).alias("awards_matched"),
        share(F.sum(F.when(hit, F.col("value_capped")).otherwise(0.0)), F.sum("value_capped")).alias("value_matched"))


def parents(matches: DataFrame, headquarters: DataFrame) -> DataFrame:
    """Winner names, awards and value per parent, with its headquarters."""
    located = headquarters.groupBy("parent").agg(F.min("hq_iso3").alias("hq_iso3"))
    totals = matches.groupBy("parent").agg(F.count(F.lit(1)).alias("winner_names"), F.sum("awards").alias("awards"), F.sum("value_capped").alias("value_capped"))
    return totals.join(located, "parent", "left")


def split_value(notices: DataFrame, value: Column, awards: str = "awards") -> Column:
    """A notice total split equally over its awards."""
    return value / F.greatest(F.col(awards), F.lit(1))
