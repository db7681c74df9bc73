"""Labels from several runs: consensus, agreement, secondary tags, human validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticework.functions.values import share
from noticework.operators.ordering import best_rows
from noticework.operators.shares import with_grand_shares

# Right-closed agreement bands.
BANDS = ((0.5, "contested (<=50%)"), (0.75, "majority (50-75%)"), (0.999, "strong (75-99%)"), (1.0, "unanimous"))

# Names of the one factor in which two runs differ.
REPEAT, ORDER, LANGUAGE = "Exact repeat (noise floor)", "Batch order", "Label language"
WORDING, SIZE, FAMILY, SEVERAL = "Prompt wording", "Model size (same family)", "Model family", "Several factors"
BASE_VARIANT = "en"
VARIANTS = {"rep": REPEAT, "shuf": ORDER, "fr": LANGUAGE}


def binned(value: Column, upper_bounds: Sequence[tuple[float, str]]) -> Column:
    """Right-closed bins: the first bound that is not exceeded names the bin."""
    ladder: Column | None = None
    for bound, label in upper_bounds:
        fits = value <= bound
        ladder = F.when(fits, label) if ladder is None else ladder.when(fits, label)
    return ladder


def clean_division(label: Column, divisions: Sequence[str], deferred: Sequence[str] = ("buyer-dependent", "BD")) -> Column:
    """Two-digit division of a label, 'BD' for buyer-dependent codes, '??' for anything else."""
    division = F.left(label, F.lit(2))
    return F.when(label.isin(*deferred), "BD").when(division.isin(*divisions), division).otherwise("??")


def one_label_per_run(runs: DataFrame, run: str = "run", code: str = "code", label: str = "label") -> DataFrame:
    """Exactly one label per run and code; repeated rows (parallel writers) give the smallest."""
    return runs.groupBy(run, code).agg(F.min(label).alias(label))


def consensus(runs: DataFrame, code: str = "code", label: str = "label") -> DataFrame:
    """Plurality label per code, agreement, vote string and band; ties go to the first label in order.

    Votes are counted before they meet per code, so a code holds one row per distinct label.
    """
    votes = runs.groupBy(code, label).agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), F.col(label).alias("label"))))
    per_code = votes.groupBy(code).agg(F.sum("n").alias("n_runs"), F.count(F.lit(1)).alias("n_distinct"), ordered.alias("tally"))
    agree = share(-F.col("tally")[0]["minus_n"], F.col("n_runs"))
    text = F.array_join(F.transform("tally", lambda v: F.concat(v["label"], F.lit(":"), (-v["minus_n"]).cast("string"))), " ")
    return per_code.select(code, "n_runs", F.col("tally")[0]["label"].alias("consensus"), agree.alias("agree"),
                           "n_distinct", text.alias("votes"), binned(agree, BANDS).alias("band"))


def band_report(consensus_with_use: DataFrame, by: str = "band", weight: str = "notices") -> DataFrame:
    """Codes and use per band (or label), with shares of all codes and of all use."""
    counted = consensus_with_use.groupBy(by).agg(F.count(F.lit(1)).alias("codes"), F.sum(weight).alias(weight))
    return with_grand_shares(counted, {"codes": "share_of_codes", weight: f"share_of_{weight}"})


def pairwise_agreement(runs: DataFrame, names: Sequence[str], run: str = "run", code: str = "code", label: str = "label") -> DataFrame:
    """Agreement of every pair of runs over the codes both labelled.

    One wide row per code and two sums per pair: no pair of rows is ever formed.  A run missing
    from ``names`` is an error.
    """
    ordered = sorted(names)
    unlisted = F.raise_error(F.concat(F.lit("run not listed: "), F.coalesce(F.col(run), F.lit("NULL"))))
    runs = runs.withColumn(run, F.when(F.col(run).isin(*ordered), F.col(run)).otherwise(unlisted))
    sheet = runs.groupBy(code).pivot(run, ordered).agg(F.min(label))
    cells = []
    for a, b in combinations(ordered, 2):
        both = F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()
        same = F.col(f"`{a}`") == F.col(f"`{b}`")
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both).alias("common"), F.count_if(same).alias("equal")))
    pairs = sheet.agg(F.array(*cells).alias("pairs")).select(F.explode("pairs").alias("p")).select("p.*")
    return pairs.select("a", "b", "common", share(F.col("equal"), F.col("common")).alias("agreement"))


def differing_factor(a: Column, b: Column) -> Column:
    """Which single factor separates two runs named ``provider_model_wording_variant``."""
    left, right = F.split(a, "_"), F.split(b, "_")
    provider, model, wording, variant = (left[i] != right[i] for i in range(4))
    unusual = F.array_remove(F.array_distinct(F.array(left[3], right[3])), BASE_VARIANT)
    by_variant: Column | None = None
    for name, factor in VARIANTS.items():
        hit = unusual[0] == name
        by_variant = F.when(hit, factor) if by_variant is None else by_variant.when(hit, factor)
    by_variant = F.when(F.size(unusual) == 1, by_variant.otherwise(SEVERAL)).otherwise(SEVERAL)
    return (
        F.when(~provider & ~model & ~wording & variant, by_variant)
        .when(~provider & ~model & wording & ~variant, WORDING)
        .when(~provider & model & ~wording & ~variant, SIZE)
        .when(provider & model & ~wording & ~variant, FAMILY)
        .otherwise(SEVERAL)
    )


def factor_agreement(pairs: DataFrame) -> DataFrame:
    """Number of pairs, mean, lowest and highest agreement per differing factor."""
    return pairs.withColumn("factor", differing_factor(F.col("a"), F.col("b"))).groupBy("factor").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("agreement").alias("mean_agreement"),
        F.min("agreement").alias("min_agreement"), F.max("agreement").alias("max_agreement"))


def secondary_tags(runs: DataFrame, floor: int, code: str = "code", label: str = "secondary") -> DataFrame:
    """Most voted non-blank secondary label per code, kept when it reaches the vote floor."""
    named = runs.filter(F.length(F.trim(F.col(label))) > 0).withColumn(label, F.left(F.trim(F.col(label)), F.lit(4)))
    votes = named.groupBy(code, label).agg(F.count(F.lit(1)).alias("votes"))
    return best_rows(votes, [code], [F.col("votes").desc(), F.col(label)]).filter(F.col("votes") >= floor)


def validation(judged: DataFrame, human: str = "human", machine: str = "machine", best_case: tuple[str, ...] = ("01",)) -> DataFrame:
    """Agreement flags: as measured, and with every catch-all machine label resolved."""
    agree = F.col(human) == F.col(machine)
    fixable = F.col(machine).isin(*best_case) & ~F.col(human).isin(*best_case)
    return judged.withColumns({"agree": agree, "agree_best_case": agree | fixable})


def agreement_by(judged: DataFrame, by: str) -> DataFrame:
    return judged.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("agree").cast("int")).alias("agreement"),
        F.avg(F.col("agree_best_case").cast("int")).alias("agreement_best_case"))


def weighted_headline(by_band: DataFrame, weights: Mapping[str, float], band: str = "band") -> DataFrame:
    """Agreement weighted by each band's share of use (one row)."""
    weight: Column | None = None
    for name, value in weights.items():
        hit = F.col(band) == name
        weight = F.when(hit, F.lit(value)) if weight is None else weight.when(hit, F.lit(value))
    weighted = by_band.withColumn("w", weight)
    return weighted.agg(*[F.try_divide(F.sum(F.col(c) * F.col("w")), F.sum("w")).alias(c) for c in ("agreement", "agreement_best_case")])


def confusion(judged: DataFrame, k: int, human: str = "human", machine: str = "machine") -> DataFrame:
    """Most frequent disagreements."""
    counted = judged.filter(~F.col("agree")).groupBy(human, machine).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), human, machine).limit(k)


def _flat(value: Column) -> Column:
    """One text per JSON value: lists and objects become their parts joined with '; '."""
    parts = F.try_variant_get(value, "$", "array<string>")
    fields = F.map_values(F.try_variant_get(value, "$", "map<string,string>"))
    joined = F.coalesce(F.array_join(parts, "; "), F.array_join(fields, "; "), F.try_variant_get(value, "$", "string"))
    return F.nullif(joined, F.lit(""))


def normalise_answers(raw: DataFrame, answer: str, fields: Sequence[str], code: str = "cpv",
                      code_pattern: str = "^[0-9]{8}$", asked: str | None = None) -> DataFrame:
    """Rows out of free-form JSON answers: ``{"items": [...]}``, a bare list, or an object keyed by code.

    Code fences are stripped, extra keys dropped, missing fields NULL; with ``asked`` (an
    array column) codes that were not asked for are dropped.
    """
    body = F.regexp_replace(F.trim(F.col(answer)), "^```json|^```|```$", "")
    parsed = raw.withColumn("__v", F.try_parse_json(body))
    keyed = F.coalesce(F.try_variant_get("__v", "$.items", "map<string,variant>"), F.try_variant_get("__v", "$", "map<string,variant>"))
    all_codes = F.forall(F.map_keys(keyed), lambda k: k.rlike(code_pattern))
    listed = F.coalesce(F.try_variant_get("__v", "$.items", "array<variant>"), F.try_variant_get("__v", "$", "array<variant>"))
    no_key = F.lit(None).cast("string")
    from_list = F.transform(listed, lambda item: F.struct(no_key.alias("key"), item.alias("item")))
    from_object = F.when(all_codes, F.transform(F.map_entries(keyed), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("item"))))
    rows = parsed.withColumn("__row", F.explode_outer(F.coalesce(from_list, from_object)))
    value = F.col("__row")["item"]
    rows = rows.withColumn("__fields", F.try_variant_get(value, "$", "map<string,variant>")).filter(F.col("__fields").isNotNull())
    picked = {name: _flat(F.try_element_at(F.col("__fields"), F.lit(name))) for name in fields}
    picked[code] = F.coalesce(F.col("__row")["key"], picked.get(code, _flat(F.try_element_at(F.col("__fields"), F.lit(code)))))
    rows = rows.withColumns(picked).drop("__v", "__row", "__fields")
    if asked is not None:
        rows = rows.filter(F.array_contains(F.col(asked), F.col(code)))
    return rows
