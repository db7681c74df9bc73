"""Runs, votes, samples, batches, answers, human validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticework.catalogue.registry import query, table
from noticework.functions.codes import by_table
from noticework.operators import labels
from noticework.operators.lookups import with_parent_labels
from noticework.operators.ordering import number_shuffled, number_sorted, pack_batches as pack, stratified_sample as sample
from noticework.operators.shares import with_grand_shares
from noticework.session import dealt_out

# A line's number names the run that labelled its part; the return flag is the label.
RUN_NAMES = {1: "fa_small_v1_en", 2: "fa_small_v1_rep", 3: "fa_small_v1_shuf", 4: "fa_small_v1_fr", 5: "fa_small_v2_en", 6: "fa_large_v1_en", 7: "fb_flash_v1_en"}

_RUNS_SQL = "CASE l_linenumber " + " ".join(f"WHEN {n} THEN '{name}'" for n, name in RUN_NAMES.items()) + " END"
_LABELS_SQL = f"""
WITH x AS (SELECT {_RUNS_SQL} AS run, l_partkey AS code, min(l_returnflag) AS label FROM lineitem GROUP BY 1, 2)"""
_CONSENSUS_SQL = _LABELS_SQL + """,
v AS (SELECT code, label, count(*) AS n FROM x GROUP BY 1, 2),
c AS (SELECT code, CAST(sum(n) AS BIGINT) AS n_runs, count(*) AS n_distinct, arg_min(label, (-n, label)) AS consensus, max(n) / sum(n) AS agree,
             string_agg(label || ':' || n, ' ' ORDER BY n DESC, label) AS votes FROM v GROUP BY 1),
cons AS (SELECT code, n_runs, consensus, agree, n_distinct, votes, CASE WHEN agree <= 0.5 THEN 'contested (<=50%)' WHEN agree <= 0.75 THEN 'majority (50-75%)'
                WHEN agree <= 0.999 THEN 'strong (75-99%)' ELSE 'unanimous' END AS band FROM c)"""
_PAIRS_SQL = _LABELS_SQL + """,
pw AS (SELECT p.run AS a, q.run AS b, count(*) AS common, avg((p.label = q.label)::INT) AS agreement FROM x p JOIN x q ON p.code = q.code AND p.run < q.run GROUP BY 1, 2)"""


def label_runs(spark, sf_dir):
    run = by_table(F.col("l_linenumber").cast("string"), {str(n): name for n, name in RUN_NAMES.items()})
    lines = table(spark, sf_dir, "lineitem").select(run.alias("run"), F.col("l_partkey").alias("code"), F.col("l_returnflag").alias("label"))
    return labels.one_label_per_run(lines)


@query("consensus_vote", _CONSENSUS_SQL + " SELECT * FROM cons")
def consensus_vote(spark, sf_dir):
    return labels.consensus(label_runs(spark, sf_dir))


@query("band_report", _CONSENSUS_SQL + """,
u AS (SELECT cons.*, CAST(notices AS BIGINT) AS notices FROM cons JOIN (SELECT l_partkey, count(*) AS notices FROM lineitem GROUP BY 1) ON l_partkey = code)
SELECT band, count(*) AS codes, CAST(sum(notices) AS BIGINT) AS notices, count(*) / (SELECT count(*) FROM u) AS share_of_codes,
       sum(notices) / (SELECT sum(notices) FROM u) AS share_of_notices FROM u GROUP BY 1""")
def band_report(spark, sf_dir):
    use = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("code")).agg(F.count(F.lit(1)).alias("notices"))
    return labels.band_report(labels.consensus(label_runs(spark, sf_dir)).join(use, "code"))


@query("contested_codes", _CONSENSUS_SQL + """,
u AS (SELECT cons.*, CAST(notices AS BIGINT) AS notices FROM cons JOIN (SELECT l_partkey, count(*) AS notices FROM lineitem GROUP BY 1) ON l_partkey = code)
SELECT code, notices, votes FROM u WHERE agree <= 0.5 ORDER BY notices DESC, code LIMIT 15""")
def contested_codes(spark, sf_dir):
    use = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("code")).agg(F.count(F.lit(1)).alias("notices"))
    used = labels.consensus(label_runs(spark, sf_dir)).join(use, "code").filter(F.col("agree") <= 0.5)
    return used.select("code", "notices", "votes").orderBy(F.col("notices").desc(), "code").limit(15)


@query("pairwise_agreement", _PAIRS_SQL + " SELECT * FROM pw")
def pairwise_agreement(spark, sf_dir):
    return labels.pairwise_agreement(label_runs(spark, sf_dir), list(RUN_NAMES.values()))


@query("factor_agreement", _PAIRS_SQL + """,
f AS (SELECT *, string_split(a, '_') AS l, string_split(b, '_') AS r FROM pw),
k AS (SELECT agreement, CASE
        WHEN l[1] = r[1] AND l[2] = r[2] AND l[3] = r[3] THEN CASE WHEN l[4] <> 'en' AND r[4] <> 'en' THEN 'Several factors'
             WHEN 'rep' IN (l[4], r[4]) THEN 'Exact repeat (noise floor)' WHEN 'shuf' IN (l[4], r[4]) THEN 'Batch order' WHEN 'fr' IN (l[4], r[4]) THEN 'Label language' ELSE 'Several factors' END
        WHEN l[4] = r[4] AND l[1] = r[1] AND l[2] = r[2] THEN 'Prompt wording' WHEN l[4] = r[4] AND l[1] = r[1] AND l[3] = r[3] THEN 'Model size (same family)'
        WHEN l[4] = r[4] AND l[3] = r[3] AND l[1] <> r[1] AND l[2] <> r[2] THEN 'Model family' ELSE 'Several factors' END AS factor FROM f)
SELECT factor, count(*) AS pairs, round(avg(agreement), 9) AS mean_agreement, min(agreement) AS min_agreement, max(agreement) AS max_agreement FROM k GROUP BY 1""")
def factor_agreement(spark, sf_dir):
    pairs = labels.pairwise_agreement(label_runs(spark, sf_dir), list(RUN_NAMES.values()))
    return labels.factor_agreement(pairs).withColumn("mean_agreement", F.round("mean_agreement", 9))


QUOTAS = {"en": 60, "fr": 50, "de": 50}


@query("stratified_sample", """
SELECT doc_id, lang, source, position FROM (SELECT doc_id, lang, source, CAST(row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) AS INT) AS position
  FROM documents WHERE length(text) >= 80)
WHERE position <= CASE lang WHEN 'en' THEN 60 WHEN 'fr' THEN 50 WHEN 'de' THEN 50 ELSE 40 END""")
def stratified_sample(spark, sf_dir):
    pool = table(spark, sf_dir, "documents").filter(F.length("text") >= 80).select("doc_id", "lang", "source")
    return sample(pool, "lang", QUOTAS, 40, "doc_id", seed=42)


@query("sequential_ids", """
SELECT user_id, event_type, n, row_number() OVER (ORDER BY md5(user_id || '-' || event_type || '|7'), user_id || '-' || event_type) AS sample_id
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)""")
def sequential_ids(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    keyed = pairs.withColumn("id", F.concat_ws("-", "user_id", "event_type"))
    return number_shuffled(keyed, "id", seed=7, name="sample_id").drop("id")


_BATCH_SQL = """
SELECT batch_id, count(*) AS codes, string_agg(line, chr(10) ORDER BY no) AS payload
FROM (SELECT {no} AS no, CAST(ceil({no} / 40.0) AS BIGINT) AS batch_id, p_partkey || ' | ' || p_name || ' | division: ' || p_type AS line FROM part)
GROUP BY 1"""


def _batch_line():
    return F.concat_ws(" | ", F.col("p_partkey"), F.col("p_name"), F.concat(F.lit("division: "), F.col("p_type")))


@query("pack_batches", _BATCH_SQL.format(no="row_number() OVER (ORDER BY p_partkey)"))
def pack_batches(spark, sf_dir):
    codes = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return pack(number_sorted(codes, ["p_partkey"]), 40, _batch_line())


@query("pack_batches_shuffled", _BATCH_SQL.format(no="row_number() OVER (ORDER BY md5(p_partkey || '|3'), p_partkey)"))
def pack_batches_shuffled(spark, sf_dir):
    codes = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return pack(number_shuffled(codes, "p_partkey", seed=3), 40, _batch_line())


@query("hierarchy_labels", """
WITH c AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code, p_name AS label FROM part)
SELECT c.code, c.label, d.label AS division, g.label AS grp FROM c
LEFT JOIN c d ON d.code = left(c.code, 5) || '000' LEFT JOIN c g ON g.code = left(c.code, 7) || '0'""")
def hierarchy_labels(spark, sf_dir):
    codes = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("code"), F.col("p_name").alias("label"))
    return with_parent_labels(codes, codes, "code", "label", {"division": 5, "grp": 7})


@query("normalise_answers", """
SELECT o_orderkey, CAST(10000000 + o_orderkey AS VARCHAR) AS cpv, o_orderpriority AS primary_label,
       CASE o_orderstatus WHEN 'F' THEN 'x; y' WHEN 'O' THEN 'z' END AS secondary FROM orders
UNION ALL
SELECT o_orderkey, CAST(20000000 + o_custkey AS VARCHAR), o_orderstatus, NULL FROM orders""")
def normalise_answers(spark, sf_dir):
    status = F.col("o_orderstatus")
    first = (F.lit(10000000) + F.col("o_orderkey")).cast("string")
    second = (F.lit(20000000) + F.col("o_custkey")).cast("string")
    listed = F.to_json(F.array(F.lit("x"), F.lit("y")))
    a = F.concat(F.lit('"primary_label": "'), F.col("o_orderpriority"), F.lit('", "extra": {"n": 1}, "secondary": '),
                 F.when(status == "F", listed).when(status == "O", '"z"').otherwise("null"))
    b = F.concat(F.lit('"primary_label": "'), status, F.lit('"'))
    row_a = F.concat(F.lit('{"cpv": "'), first, F.lit('", '), a, F.lit("}"))
    row_b = F.concat(F.lit('{"cpv": "'), second, F.lit('", '), b, F.lit("}"))
    keyed = F.concat(F.lit('{"'), first, F.lit('": {'), a, F.lit('}, "'), second, F.lit('": {'), b, F.lit("}}"))
    bare = F.concat(F.lit("[ "), row_a, F.lit(", "), row_b, F.lit(', {"cpv": "99999999"}, "text" ]'))
    wrapped = F.concat(F.lit('```json\n{"items": ['), row_a, F.lit(", "), row_b, F.lit("]}\n```"))
    answers = dealt_out(table(spark, sf_dir, "orders")).select(
        "o_orderkey", F.array(first, second).alias("asked"),
        F.when(status == "F", wrapped).when(status == "O", bare).otherwise(keyed).alias("answer"))
    rows = labels.normalise_answers(answers, "answer", ["cpv", "primary_label", "secondary"], asked="asked")
    return rows.select("o_orderkey", "cpv", "primary_label", "secondary")


WEIGHTS = {"en": 0.656, "fr": 0.186, "de": 0.136, "es": 0.023}
_JUDGED_SQL = """
WITH j AS (SELECT doc_id, lang, source, CASE quality WHEN 1 THEN '04' ELSE '01' END AS human, CASE WHEN n_chars > 800 THEN '04' ELSE '01' END AS machine
           FROM labels JOIN documents USING (doc_id)),
k AS (SELECT *, human = machine AS agree, human = machine OR (machine = '01' AND human <> '01') AS best FROM j)"""


def judged(spark, sf_dir):
    human = F.when(F.col("quality") == 1, "04").otherwise("01")
    machine = F.when(F.col("n_chars") > 800, "04").otherwise("01")
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    df = table(spark, sf_dir, "labels").join(documents, "doc_id").withColumns({"human": human, "machine": machine})
    return labels.validation(df)


@query("validate_labels", _JUDGED_SQL + """
SELECT lang, count(*) AS n, avg(agree::INT) AS agreement, avg(best::INT) AS agreement_best_case FROM k GROUP BY 1""")
def validate_labels(spark, sf_dir):
    return labels.agreement_by(judged(spark, sf_dir), "lang")


@query("validation_headline", _JUDGED_SQL + f""",
w(lang, w) AS (VALUES {', '.join(str(x) for x in WEIGHTS.items())}),
b AS (SELECT lang, avg(agree::INT) AS agreement, avg(best::INT) AS best FROM k GROUP BY 1)
SELECT round(sum(agreement * w) / sum(w), 9) AS agreement, round(sum(best * w) / sum(w), 9) AS agreement_best_case FROM b JOIN w USING (lang)""")
def validation_headline(spark, sf_dir):
    headline = labels.weighted_headline(labels.agreement_by(judged(spark, sf_dir), "lang"), WEIGHTS, band="lang")
    return headline.select(*[F.round(c, 9).alias(c) for c in headline.columns])


@query("confusion_top", _JUDGED_SQL + """
SELECT human, machine, count(*) AS n FROM k WHERE NOT agree GROUP BY 1, 2 ORDER BY n DESC, human, machine LIMIT 10""")
def confusion_top(spark, sf_dir):
    return labels.confusion(judged(spark, sf_dir), 10)


@query("grand_total_share", """
SELECT role, conv_len AS turns, count(*) AS conversations, count(*) / sum(count(*)) OVER () AS share
FROM (SELECT conv_id, role, count(*) AS conv_len FROM conversations GROUP BY 1, 2) GROUP BY 1, 2""")
def grand_total_share(spark, sf_dir):
    per = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("turns"))
    counted = per.groupBy("role", "turns").agg(F.count(F.lit(1)).alias("conversations"))
    return with_grand_shares(counted, {"conversations": "share"})
