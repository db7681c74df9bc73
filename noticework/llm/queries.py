"""One query per operator of this folder, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticework.llm import chat
from noticework.llm.audit import failing_sets, interaction_audit
from noticework.llm.common import table
from noticework.llm.infill import fill_in_middle, restored
from noticework.llm.lines import dedup_lines
from noticework.llm.mixing import mix
from noticework.llm.packing import pack
from noticework.llm.quality import judge_documents
from noticework.llm.revisits import resolve_revisits
from noticework.llm.shards import shard_rows
from noticework.llm.simhash import near_duplicates
from noticework.llm.topk import floored, top_k
from noticework.llm.urlfilter import judge_urls
from noticework.llm.wrappers import extract_main_text

QueryFunction = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    def register(function: QueryFunction) -> QueryFunction:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return function
    return register


@query("op1_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query("op2_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@query("op6_simhash")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query("op7_sharding")
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = shard_rows(rows, ["doc_id", "size", "text_crc32"], shards=8, seed=20240229)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op5_line_dedup", f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
numbered AS (SELECT doc_id, unnest(all_lines) AS line, unnest(range(len(all_lines))) AS line_no FROM parts),
keyed AS (SELECT *, translate(trim(line, {_BLANK_SQL}), '{_UPPER}', '{_LOWER}') AS line_key FROM numbered),
holders AS (SELECT line_key, min(doc_id) AS first_doc FROM keyed WHERE length(line_key) >= 10 GROUP BY line_key HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT k.*, h.first_doc IS NOT NULL AND h.first_doc <> k.doc_id AS gone FROM keyed k LEFT JOIN holders h USING (line_key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


# Rules and listed hosts of the url query (fixed values).
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
LISTED_HOSTS = [f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]

_RULES_SQL = ", ".join(f"('{r.split('/')[0]}', '{r[r.index('/'):]}', '{v}')" for r, v in URL_RULES.items())
_LISTED_SQL = ", ".join(f"('{x}')" for x in LISTED_HOSTS)


@query("op9_url_filter", f"""
WITH rests AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
rules(rule_host, rule_path, action) AS (VALUES {_RULES_SQL}), listed(name) AS (VALUES {_LISTED_SQL}),
fits AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
         FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
hits AS (SELECT DISTINCT page_id FROM split JOIN listed ON host = name OR ends_with(host, '.' || name))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.action, CASE WHEN h.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM split s LEFT JOIN fits f USING (page_id) LEFT JOIN hits h USING (page_id)
""")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED_HOSTS))).alias("host"))
    judged = judge_urls(table(spark, sf_dir, "pages"), URL_RULES, listed)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op10_top_k", """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
           FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= 5
""")
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", floored(F.col("embedding")).alias("vector"))
    return top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, k=5)


@query("op3_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def captures(pages: DataFrame) -> DataFrame:
    """Archive records made from pages: each one is captured in full twice and asked for again twice, under spellings of its whole address.

    Every fifth page is asked for before its first capture.  Every fourth page changes between its captures, and every third is asked
    for with the tag of the first.  Null addresses stay null.
    """
    page, at_turn = F.col("page_id"), F.col("turn")
    bare, fragment = F.regexp_replace("url", "(?s)#.*$", ""), F.regexp_extract("url", "(?s)(#.*)$", 1)
    front = F.regexp_extract(bare, "(?s)^([^/?]*://[^/?]*)", 1)
    back = F.substr(bare, F.length(front) + 1)
    sign = F.when(F.contains(bare, F.lit("?")), "&").otherwise("?")
    even = page % 2 == 0
    spelled = (F.when(at_turn == 0, F.when(even, F.concat(bare, sign, F.lit("b=2&a=1"), fragment)).otherwise(F.col("url")))
               .when(at_turn == 1, F.concat(F.upper(front), back, F.when(even, F.concat(sign, F.lit("a=1&b=2"))).otherwise(""), F.lit("#again")))
               .when(at_turn == 2, F.concat(bare, sign, F.when(even, "a=1&utm_campaign=x&b=2").otherwise("gclid=7")))
               .otherwise(F.concat(front, F.when(front == "", "").otherwise(":443"), back, sign, F.when(even, "ref=home&b=2&a=1").otherwise("ref=home"))))
    # The state of the page that a record speaks of.
    changed = (page % 4 == 0) & ((at_turn == 2) | (at_turn == 3) & (page % 3 != 0))
    state = F.concat(F.coalesce(F.col("html"), F.lit("")), F.when(changed, "changed").otherwise(""))
    tag = F.when(page % 5 != 0, F.concat(F.lit('"'), F.md5(state.cast("binary")), F.lit('"')))
    modified = F.when(page % 3 != 0, F.concat(F.lit("day "), page % 400 + changed.cast("int")))
    after = F.when(at_turn == 0, 0).when(at_turn == 1, F.when(page % 5 == 1, -100).otherwise(200)).when(at_turn == 2, 400).otherwise(600 + 1000 * (page % 7))
    turns = pages.select(page, "url", "html", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("turn"))
    later = at_turn % 2 == 1
    rows = turns.select((4 * page + at_turn).cast("bigint").alias("record_id"), spelled.alias("url"), (1000 * page + after).cast("bigint").alias("captured_at"),
                        F.when(later, "revisit").otherwise("response").alias("kind"), tag.alias("etag"), modified.alias("last_modified"), (page % 100).alias("age"))
    common = [F.lit("date"), F.col("captured_at").cast("string"), F.lit("etag"), F.coalesce("etag", F.lit("none")), F.lit("content-type"), F.when(F.col("kind") == "revisit", "none").otherwise("text/html")]
    headers = F.when(F.col("kind") == "revisit", F.create_map(*common)).otherwise(F.create_map(*common, F.lit("cache-control"), F.concat(F.lit("max-age="), "age")))
    return rows.select("record_id", "url", "captured_at", "kind", "etag", "last_modified", headers.alias("headers"))


@query("op4_revisits", """
WITH parts AS (
  SELECT page_id, url, html, turn, regexp_replace(url, '(?s)#.*$', '') AS bare, regexp_extract(url, '(?s)(#.*)$', 1) AS fragment
  FROM pages, (SELECT unnest(range(4)) AS turn)),
split AS (SELECT *, regexp_extract(bare, '(?s)^([^/?]*://[^/?]*)', 1) AS front, CASE WHEN contains(bare, '?') THEN '&' ELSE '?' END AS sign,
                 page_id % 4 = 0 AND (turn = 2 OR turn = 3 AND page_id % 3 <> 0) AS changed FROM parts),
spelled AS (
  SELECT *, substr(bare, length(front) + 1) AS back,
         CASE turn WHEN 0 THEN CASE WHEN page_id % 2 = 0 THEN bare || sign || 'b=2&a=1' || fragment ELSE url END
                   WHEN 1 THEN upper(front) || substr(bare, length(front) + 1) || CASE WHEN page_id % 2 = 0 THEN sign || 'a=1&b=2' ELSE '' END || '#again'
                   WHEN 2 THEN bare || sign || CASE WHEN page_id % 2 = 0 THEN 'a=1&utm_campaign=x&b=2' ELSE 'gclid=7' END
                   ELSE front || CASE WHEN front = '' THEN '' ELSE ':443' END || substr(bare, length(front) + 1) || sign
                        || CASE WHEN page_id % 2 = 0 THEN 'ref=home&b=2&a=1' ELSE 'ref=home' END END AS address FROM split),
rests AS (SELECT *, regexp_replace(regexp_replace(address, '(?s)#.*$', ''), '(?s)^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM spelled),
queried AS (
  SELECT *, regexp_replace(lower(regexp_extract(rest, '(?s)^([^/?]*)', 1)), ':(80|443)$', '') || regexp_replace(regexp_extract(rest, '(?s)^[^/?]*([^?]*)', 1), '/+$', '') AS place,
         list_sort(list_filter(string_split(regexp_extract(rest, '(?s)^[^?]*[?](.*)$', 1), '&'),
                               lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND split_part(p, '=', 1) NOT IN ('ref', 'gclid', 'fbclid'))) AS kept FROM rests),
records AS (
  SELECT 4 * page_id + turn AS record_id, CASE WHEN address IS NOT NULL THEN place || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical_url,
         1000 * page_id + CASE turn WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN page_id % 5 = 1 THEN -100 ELSE 200 END WHEN 2 THEN 400 ELSE 600 + 1000 * (page_id % 7) END AS captured_at,
         turn % 2 = 1 AS again, CASE WHEN page_id % 5 <> 0 THEN '"' || md5(coalesce(html, '') || CASE WHEN changed THEN 'changed' ELSE '' END) || '"' END AS etag,
         CASE WHEN page_id % 3 <> 0 THEN 'day ' || (page_id % 400 + changed::INT) END AS last_modified, 'cache-control=max-age=' || (page_id % 100) AS cache FROM queried),
met AS (
  SELECT v.*, r.record_id AS referred_id, r.cache AS r_cache,
         CASE WHEN r.record_id IS NULL THEN 'orphan'
              WHEN v.etag IS NOT NULL AND r.etag IS NOT NULL THEN CASE WHEN v.etag = r.etag THEN 'validated' ELSE 'mismatch' END
              WHEN v.last_modified IS NOT NULL AND r.last_modified IS NOT NULL THEN CASE WHEN v.last_modified = r.last_modified THEN 'validated' ELSE 'mismatch' END
              ELSE 'unchecked' END AS outcome
  FROM (SELECT * FROM records WHERE again) v ASOF LEFT JOIN (SELECT * FROM records WHERE NOT again) r ON v.canonical_url = r.canonical_url AND v.captured_at > r.captured_at)
SELECT record_id, canonical_url, captured_at, 'revisit' AS kind, referred_id, outcome,
       CASE WHEN outcome IN ('validated', 'unchecked') THEN r_cache || ';content-type=text/html' ELSE 'content-type=none' END
       || ';date=' || captured_at || ';etag=' || coalesce(etag, 'none') AS merged_headers
FROM met
UNION ALL
SELECT record_id, canonical_url, captured_at, 'response', NULL, 'full',
       cache || ';content-type=text/html;date=' || captured_at || ';etag=' || coalesce(etag, 'none') FROM records WHERE NOT again
""")
def revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve_revisits(captures(table(spark, sf_dir, "pages")))
    listed = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return resolved.withColumn("merged_headers", F.array_join(listed, ";")).drop("headers")


@query("op8_mixing")
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), max_repetition=4.0, seed=8, prefix="", keep=["doc_id", "source"])
    return mixed.select("doc_id", "source", "tokens", "weight", "pass", "place")


# The conversation that speaks the template's own marks (fixed value).
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"
_ESCAPED_SQL = "regexp_replace({0}, '<(\\\\*)\\|', '<\\1\\\\|', 'g')"
_MARK_CHARS = sum(map(len, chat.MARKS))


@query("op11_chat_format", f"""
WITH spoken AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '{CONTROL_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS extra(t, r))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESCAPED_SQL.format('role')}) + length({_ESCAPED_SQL.format('text')}) + {_MARK_CHARS}) AS BIGINT) AS formatted_chars
FROM spoken GROUP BY conv_id
""")
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.format_conversations(rows).withColumns({
        "turns": chat.turns_of(F.col("formatted")), "learnt": F.array_join(F.transform("loss_texts", chat.unescaped), "")})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                       F.length("learnt").cast("bigint").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))


@query("op12_filter_audit", """
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
judged AS (
  SELECT part, doc_id, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE) AS e FROM words),
said AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
rows AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
         if(a, 'A', '') || if(b, 'B', '') || if(c, 'C', '') || if(d, 'D', '') || if(e, 'E', '') AS fails FROM judged LEFT JOIN said USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM rows GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS letter, substr(filter_order, 1, k - 1) AS earlier
          FROM orders, range(1, 6) AS r(k)),
met AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails = letter AS sole, contains(fails, letter) AS hit,
         fails <> '' AND regexp_matches(fails, '[' || earlier || '0]') AS gone FROM cells, steps),
counted AS (
  SELECT part, filter_order, step, letter, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (WHERE sole), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM met GROUP BY ALL)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM counted
""")
def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction_audit(failing_sets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def _draw_sql(place: int) -> str:
    return f"CAST('0x' || substr(hash, {8 * place - 7}, 8) AS BIGINT)"


@query("op13_fill_in_middle", f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM documents),
drawn AS (
  SELECT *, {_draw_sql(1)} % (n + 1) AS a, {_draw_sql(2)} % (n + 1) AS b,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR {_draw_sql(3)} % 100 >= 90 THEN 'plain' WHEN {_draw_sql(4)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM base),
parts AS (
  SELECT *, least(a, b) AS p, greatest(a, b) - least(a, b) AS m, left(text, least(a, b)) AS head,
         substr(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS inner_text, substr(text, greatest(a, b) + 1) AS tail FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || inner_text
                        ELSE '<S>' || tail || '<P>' || head || '<M>' || inner_text END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
""")
def infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = {name: F.sha2(c.cast("binary"), 256).alias(name) for name, c in (
        ("output_sha256", F.col("output")), ("restored_sha256", restored(F.col("output"), F.col("form"))))}
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), *digest.values())
