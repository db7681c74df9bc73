"""Labelling of product codes: batches to send, answers to keep, consensus, samples, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticework.functions import codes
from noticework.operators import labels
from noticework.operators.lookups import with_parent_labels
from noticework.operators.ordering import number_shuffled, number_sorted, pack_batches, stratified_sample

# Fields of one answered code, quotas of the validation sample, the bands' shares of use.
ANSWER_FIELDS = ("cpv", "cofog_primary", "cofog_secondary", "secondary_condition", "justification", "confidence")
SAMPLE_QUOTAS = {"unanimous": 60, "strong (75-99%)": 50, "majority (50-75%)": 50}
SAMPLE_DEFAULT = 40
SAMPLE_LANGUAGES = ("fra", "eng", "deu", "spa", "ita")
BAND_WEIGHTS = {"unanimous": 0.656, "strong (75-99%)": 0.186, "majority (50-75%)": 0.136, "contested (<=50%)": 0.023}
BATCH_SIZE = 40


def used_codes(cn: DataFrame, can: DataFrame) -> DataFrame:
    """How often each product code is used."""
    return cn.select("cpv").unionByName(can.select("cpv")).groupBy("cpv").agg(F.count(F.lit(1)).alias("notices"))


def batches_to_send(used: DataFrame, code_labels: DataFrame, done: DataFrame, language: str = "en", seed: int = 0) -> DataFrame:
    """Codes without an answer yet, in batches with one line per code (sorted, or shuffled by a seed)."""
    named = code_labels.select("cpv", F.col(f"label_{language}").alias("label"))
    todo = with_parent_labels(used.join(named, "cpv"), named, "cpv", "label", {"division": 2, "grp": 3}).join(done.select("cpv"), "cpv", "left_anti")
    numbered = number_shuffled(todo, "cpv", seed) if seed else number_sorted(todo, ["cpv"])
    def part(name, prefix=""):
        return F.concat(F.lit(prefix), F.coalesce(name, F.lit("NA")))
    line = F.concat_ws(" | ", F.col("cpv"), part("label"), part("division", "division: "), part("grp", "group: "))
    return pack_batches(numbered, BATCH_SIZE, line)


def answered_codes(raw_answers: DataFrame) -> DataFrame:
    """Answers of one batch each (``answer`` text, ``codes`` asked for) as one row per code."""
    return labels.normalise_answers(raw_answers, "answer", ANSWER_FIELDS, asked="codes").drop("answer", "codes")


def code_consensus(label_runs: DataFrame, used: DataFrame, code_labels: DataFrame) -> DataFrame:
    """Consensus division per product code, with its use and English label."""
    division = labels.clean_division(F.col("cofog_primary"), codes.FUNCTIONS)
    runs = labels.one_label_per_run(label_runs.select("run", "cpv", division.alias("label")), code="cpv")
    voted = labels.consensus(runs, code="cpv")
    return voted.join(used, "cpv", "left").join(code_labels.select("cpv", "label_en"), "cpv", "left")


def validation_sample(api: DataFrame, consensus: DataFrame, code_labels: DataFrame, seed: int = 42,
                      readable_length: tuple[int, int] = (80, 4000), languages: Sequence[str] = SAMPLE_LANGUAGES) -> tuple[DataFrame, DataFrame]:
    """A blind sample for the labellers and the key with the machine labels, by agreement band.

    Drawn from notices in ``languages`` whose description is long enough to judge and short enough to read.
    """
    readable = api.filter(F.length("description").between(*readable_length) & F.col("lang").isin(*languages))
    pool = readable.join(consensus.select("cpv", "band", "consensus", "agree", "votes"), "cpv").join(code_labels.select("cpv", "label_en"), "cpv")
    drawn = stratified_sample(pool, "band", SAMPLE_QUOTAS, SAMPLE_DEFAULT, "pub_number", seed).drop("position")
    numbered = number_shuffled(drawn, "pub_number", f"{seed}-order", name="sample_id")
    shown = ["sample_id", "pub_number", "type", "country", "lang", "cpv", "label_en", "buyer_name", "title", "description"]
    return numbered.select(*shown), numbered.select("sample_id", "pub_number", "cpv", "band", "consensus", "agree", "votes")


def judged_sample(human: DataFrame, key: DataFrame, notice_all: DataFrame) -> DataFrame:
    """Human labels against the machine's function (the buyer's activity decides deferred codes)."""
    activity = notice_all.groupBy("pub_number").agg(F.min("activity").alias("activity"))
    joined = human.filter(F.length(F.trim("human_div")) > 0).join(key.select("sample_id", "band", "consensus"), "sample_id").join(activity, "pub_number", "left")
    deferred = F.col("consensus") == "BD"
    machine = F.when(deferred, codes.owner_function(F.col("activity"))).otherwise(F.col("consensus"))
    source = F.when(deferred, "buyer activity").otherwise("product code")
    return labels.validation(joined.withColumns({"machine": machine, "source": source}), human="human_div")


def validation_report(judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Agreement by band, by source, and the weighted headline."""
    by_band = labels.agreement_by(judged, "band")
    return by_band, labels.agreement_by(judged, "source"), labels.weighted_headline(by_band, BAND_WEIGHTS)


def run_agreement(label_runs: DataFrame, run_names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Agreement of every pair of runs, and by the one factor that differs."""
    division = labels.clean_division(F.col("cofog_primary"), codes.FUNCTIONS)
    runs = labels.one_label_per_run(label_runs.select("run", "cpv", division.alias("label")), code="cpv")
    pairs = labels.pairwise_agreement(runs, run_names, code="cpv")
    return pairs, labels.factor_agreement(pairs)
