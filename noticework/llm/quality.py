"""Document quality: word and line statistics, and language-wise perplexity bands.

The language model is a modified Kneser-Ney model over the bytes of whole texts, one per language.
Spark counts the n-grams of the highest order; counts of lower orders are continuation counts, so
they follow from the distinct n-grams one order up.  Interpolation, discounts and back-off masses
are joins on n-gram keys.  Texts are scored by the model of texts they are not among.  What scoring needs is one interpolated
log probability per n-gram of the scored texts, kept in sorted hash arrays with an index over the leading bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, FloatType, LongType, StringType, StructField, StructType

from noticework.llm.common import as_bytes, fresh, in_small_batches, with_arrow
from noticework.session import settled

ORDER = 5
# Entries (12 bytes each) that one broadcast may hold; a larger model is scored in several rounds.
BROADCAST_ENTRIES = 4_000_000
# Entries in a hash range that one task sorts, about.
PART_ENTRIES = 1 << 16
# Log10 probability of an n-gram the model has never seen.
UNSEEN = -7.0
# Bands reach this many quartile ranges below the first and above the third quartile.
LOWER_REACH, UPPER_REACH = 4.0, 4.0
# The mean over few words scatters more: both reaches are multiplied by sqrt(1 + SHORT_WORDS / words).
SHORT_WORDS = 300

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"

_BLOCK = 1 << 20
_PIECE = 1 << 18
_MERGE_AT = 1 << 20
_SALTS = 64
_BIN = 1000  # bands are read off a histogram of this many bins per unit of log10 perplexity


# ---------------------------------------------------------------- n-grams of texts

def _blocks(texts: list[bytes | None], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Packed n-grams of blocks of text pieces, with the row and the number of n-grams of each piece.

    There is one n-gram per byte: the byte and the ``order - 1`` bytes before it, zeros before the
    start.  Long texts are cut into pieces that overlap by that much.
    """
    pad = order - 1
    parts: list[bytes] = []
    rows: list[int] = []
    sizes: list[int] = []
    total = 0

    def pack() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
        n = len(raw) - pad
        grams = np.zeros(n, np.uint64)
        for j in range(order):
            grams <<= np.uint64(8)
            grams |= raw[j:j + n]
        lengths = np.array(sizes)
        starts = np.cumsum(lengths + pad)[:-1]
        whole = np.ones(n, bool)
        for k in range(1, pad + 1):
            whole[starts - k] = False
        return grams[whole], np.array(rows), lengths

    for row, text in enumerate(texts):
        if not text:
            continue
        for start in range(0, len(text), _PIECE):
            before = text[start - pad:start] if start else b"\0" * pad
            body = text[start:start + _PIECE]
            parts += (before, body)
            rows.append(row)
            sizes.append(len(body))
            total += len(body)
            if total >= _BLOCK:
                yield pack()
                parts, rows, sizes, total = [], [], [], 0
    if rows:
        yield pack()


def _rows_by_language(languages: pa.Array) -> dict[str, list[int]]:
    groups: dict[str, list[int]] = {}
    for row, language in enumerate(languages.to_pylist()):
        groups.setdefault(language or "", []).append(row)
    return groups


def count_ngrams(docs: DataFrame, order: int = ORDER, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (lang, gram, n): how often each n-gram of bytes occurs in each language's texts.

    Every task counts its own texts first and sends each distinct n-gram once.
    """
    schema = StructType([StructField("lang", StringType()), StructField("gram", LongType()), StructField("n", LongType())])

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if len(parts) == 1:
            return parts[0]
        grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order_of = np.argsort(grams, kind="stable")
        grams, counts = grams[order_of], counts[order_of]
        first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        return grams[first], np.add.reduceat(counts, first)

    def batch_of(language: str, parts: list) -> pa.RecordBatch:
        grams, counts = merged(parts)
        return pa.RecordBatch.from_arrays(
            [pa.array([language] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for language, rows in _rows_by_language(batch.column(1)).items():
                parts = held.setdefault(language, [])
                for grams, _, _ in _blocks([texts[r] for r in rows], order):
                    parts.append(np.unique(grams, return_counts=True))
                    if sum(len(g) for g, _ in parts) > _MERGE_AT:
                        parts[:] = [merged(parts)]
                        if len(parts[0][0]) > _MERGE_AT // 2:
                            yield batch_of(language, parts)
                            parts.clear()
        for language, parts in held.items():
            if parts:
                yield batch_of(language, parts)

    return in_small_batches(docs.select(text, lang)).mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- modified Kneser-Ney

def kneser_ney(counts: DataFrame, order: int = ORDER, asked: DataFrame | None = None) -> DataFrame:
    """Rows (lang, gram, logp): interpolated modified Kneser-Ney log10 probabilities of the highest order.

    They are given for the n-grams ``asked`` for, rows (lang, gram), or else for those of ``counts``.  An n-gram that was not
    counted gets the back-off mass of its context, and all of the next lower order if its context was not counted either.  The mass
    is that of half a count at least, so that no n-gram is impossible; a context whose discounts are nought then sums to a little over one.
    ``counts`` is written down first.  The lowest order interpolates with 1/256.  Discounts of a
    language and order come from its numbers of n-grams seen once to four times; where one of these
    numbers is zero, half a count is taken off instead.
    """
    def lowest(k: int) -> F.Column:
        return F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")

    levels = {order: settled(counts.select("lang", "gram", "n"), "ngrams")}
    for k in range(order - 1, 0, -1):
        levels[k] = settled(levels[k + 1].groupBy("lang", lowest(k)).agg(F.count(F.lit(1)).alias("n")), "ngrams")
    if asked is not None:
        questions = {order: asked.select("lang", "gram")}
        for k in range(order - 1, 0, -1):
            questions[k] = settled(questions[k + 1].select("lang", lowest(k)).distinct(), "asked")
    lower = None
    for k in range(1, order + 1):
        grams = levels[k]
        times = [F.count(F.when(F.col("n") == i, 1)).cast("double") for i in (1, 2, 3, 4)]
        seen = grams.groupBy("lang").agg(*(t.alias(f"t{i}") for i, t in enumerate(times, 1)))
        share = F.try_divide("t1", F.col("t1") + 2 * F.col("t2"))
        usable = (F.col("t1") > 0) & (F.col("t2") > 0) & (F.col("t3") > 0) & (F.col("t4") > 0)
        discounts = seen.select("lang", *(
            F.when(usable, F.greatest(F.lit(0.0), i - (i + 1) * share * F.try_divide(f"t{i + 1}", f"t{i}"))).otherwise(0.5).alias(f"d{i}")
            for i in (1, 2, 3)))
        context = F.shiftright("gram", 8).alias("context")
        # One language may hold most n-grams: its discounts are repeated once per salt.
        spread = discounts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        masses = grams.groupBy("lang", context).agg(
            F.sum("n").alias("total"), *(F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2)),
            F.count(F.when(F.col("n") >= 3, 1)).alias("n3")).withColumn(
            "salt", F.pmod(F.xxhash64("context"), F.lit(_SALTS)).cast("int")).join(spread, ["lang", "salt"]).drop("salt")
        rows = grams if asked is None else questions[k].join(grams, ["lang", "gram"], "left")
        joined = rows.withColumn("context", context).join(masses, ["lang", "context"], "left")
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = F.coalesce((F.col("n") - taken) / F.col("total"), F.lit(0.0))
        left = F.coalesce((F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total"), F.lit(1.0))
        left = F.when(F.col("n").isNull(), F.greatest(left, F.coalesce(0.5 / F.col("total"), F.lit(1.0)))).otherwise(left)
        if lower is None:
            lower = joined.select("lang", "gram", (own + left / 256.0).alias("p"))
        else:
            below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            lower = joined.select("lang", "gram", lowest(k - 1).alias("suffix"), own.alias("own"), left.alias("left")).join(
                below, ["lang", "suffix"]).select("lang", "gram", (F.col("own") + F.col("left") * F.col("below")).alias("p"))
        if k < order:  # each order is a job of its own: one plan over all of them costs the driver a lot of memory
            lower = settled(lower, "order")
    return lower.select("lang", "gram", F.log10("p").alias("logp"))


# ---------------------------------------------------------------- sorted hash arrays

def _mix(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble, so that sorted keys are spread evenly."""
    x = values.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _seed(language: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(language.encode()))


@dataclass
class SortedHashes:
    """Sorted 64-bit keys, their values, and where each run of equal leading bits starts."""

    keys: np.ndarray
    values: np.ndarray
    index: np.ndarray
    shift: int
    longest: int

    @staticmethod
    def of_sorted(keys: np.ndarray, values: np.ndarray) -> SortedHashes:
        bits = max(1, int(len(keys)).bit_length())
        shift = 64 - bits
        index = np.searchsorted(keys >> np.uint64(shift), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        return SortedHashes(keys, values, index, shift, int(np.diff(index).max(initial=0)))

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, not-a-number for those that are not here."""
        found = np.full(len(keys), np.nan, np.float32)
        if not len(self.keys):
            return found
        at = self.index[keys >> np.uint64(self.shift)]
        last = len(self.keys) - 1
        open_rows = None
        for step in range(self.longest):
            if open_rows is None:
                place = np.minimum(at, last)
                hit = self.keys[place] == keys
                np.copyto(found, self.values[place], where=hit)
                open_rows = np.flatnonzero(~hit)
            else:
                place = np.minimum(at[open_rows] + step, last)
                hit = self.keys[place] == keys[open_rows]
                found[open_rows[hit]] = self.values[place[hit]]
                open_rows = open_rows[~hit]
            if not len(open_rows):
                break
        return found


def hash_ranges(model: DataFrame, entries: int) -> tuple[DataFrame, int]:
    """Rows (part, keys, values) of a model with ``entries`` n-grams, and the number of parts.

    Part ``i`` holds the sorted keys whose leading bits are ``i``, so parts in rising order are sorted as a whole.  Keys are
    scrambled, which keeps parts alike in size, about ``PART_ENTRIES``, whatever the languages.
    """
    bits = max(0, -(-entries // PART_ENTRIES) - 1).bit_length()
    keyed = StructType([StructField("part", LongType()), StructField("key", LongType()), StructField("logp", FloatType())])
    ranges = StructType([StructField("part", LongType()), StructField("keys", BinaryType()), StructField("logps", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(1).to_numpy().astype(np.uint64)
            keys = np.empty(len(grams), np.uint64)
            for language, rows in _rows_by_language(batch.column(0)).items():
                keys[rows] = _mix(grams[rows] ^ _seed(language))
            parts = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(keys.view(np.int64)), batch.column(2)], names=keyed.fieldNames())

    def ordered(part: pa.Table) -> pa.Table:
        keys = part.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        values = part.column("logp").to_numpy()
        return pa.table([pa.array([part.column("part")[0].as_py()]), pa.array([keys[order].tobytes()], pa.binary()),
                         pa.array([values[order].tobytes()], pa.binary())], names=ranges.fieldNames())

    rows = model.select("lang", "gram", F.col("logp").cast("float").alias("logp")).mapInArrow(run, keyed)
    return rows.groupBy("part").applyInArrow(ordered, ranges), 1 << bits


def _of_parts(ranges: DataFrame, first: int, last: int) -> SortedHashes:
    """The hash arrays of parts ``first`` to ``last - 1``: one round's share of the model."""
    rows = sorted(ranges.filter(F.col("part").between(first, last - 1)).collect())
    return SortedHashes.of_sorted(np.frombuffer(b"".join(r["keys"] for r in rows), np.uint64), np.frombuffer(b"".join(r["logps"] for r in rows), np.float32))


def _log_sums(texts: pa.Array, languages: pa.Array, order: int, hashes: SortedHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the log probabilities that these arrays hold, and the numbers of n-grams that they hold none for."""
    sums, missing = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    raw = as_bytes(texts)
    for language, rows in _rows_by_language(languages).items():
        seed = _seed(language)
        for grams, piece_rows, lengths in _blocks([raw[r] for r in rows], order):
            values = hashes.look_up(_mix(grams ^ seed))
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            held, own = ~np.isnan(values), np.asarray(rows)[piece_rows]
            np.add.at(sums, own, np.add.reduceat(np.where(held, values, 0.0).astype(np.float64), starts))
            np.add.at(missing, own, np.add.reduceat((~held).astype(np.int64), starts))
    return sums, missing


# ---------------------------------------------------------------- word and line statistics

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_START = (np.arange(256) & 0xC0) != 0x80
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def text_statistics(text: bytes | None) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated windows) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    chars = int(np.count_nonzero(_IS_START[raw] & ~_IS_BLANK[raw]))
    symbols = int(np.count_nonzero(_IS_SYMBOL[raw]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated_words(words)


def _repeated_words(words: list[bytes]) -> int:
    windows = len(words) - WINDOW + 1
    if windows < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    keys = np.zeros(windows, np.uint64)
    for j in range(WINDOW):
        keys += hashes[j:j + windows] * _WEIGHTS[j]
    ordered = np.sort(keys)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.isin(keys, ordered[1:][same])
    covered = np.zeros(len(words), bool)
    for j in range(WINDOW):
        covered[j:j + windows] |= twice
    return int(np.count_nonzero(covered))


# ---------------------------------------------------------------- the operator

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def score_documents(docs: DataFrame, model: DataFrame, order: int = ORDER, text: str = "text", lang: str = "lang",
                    keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``docs`` with text statistics and ``log10_ppl``, the log10 perplexity per byte (null for empty texts).

    ``model`` has to be a written table.  It goes to the tasks in rounds of about ``BROADCAST_ENTRIES`` entries, sorted by Spark
    in hash ranges beforehand; each n-gram lies in one round, so the sums of the rounds add up, and one that no
    round holds counts ``UNSEEN``.  Each round is written down and its arrays are given back, so that
    neither the driver nor a task ever holds more than one of them.  ``prefix`` is put before the names of the new columns.
    """
    spark = docs.sparkSession
    entries = model.count()
    ranges, parts = hash_ranges(model, entries)
    ranges = settled(ranges, "ranges")
    rounds = min(parts, max(1, -(-entries // BROADCAST_ENTRIES)))
    total, absent, size = fresh(docs, "log_sum"), fresh(docs, "log_missing"), prefix + "n_bytes"
    kept = list(docs.columns if keep is None else keep)
    made = [*(prefix + c for c in STATISTICS), size]
    texts = list(dict.fromkeys([*kept, text, lang]))
    scored = docs
    for i in range(rounds):
        hashes = spark.sparkContext.broadcast(_of_parts(ranges, i * parts // rounds, (i + 1) * parts // rounds))
        first, last = i == 0, i == rounds - 1
        carried = [*(kept if last else texts), *([] if first else made)]
        outputs = StructType([*([StructField(c, LongType()) for c in made] if first else []), StructField(total, DoubleType()), StructField(absent, LongType())])
        scored = settled(with_arrow(scored, [text, lang, *([] if first else [total, absent])], outputs, _round(hashes, order), carried), "round")
        hashes.destroy()
    # Every n-gram lies in one round, so all other rounds miss it.
    unseen = UNSEEN * (F.col(absent) - F.lit(rounds - 1) * F.col(size))
    perplexity = -F.try_divide(F.col(total) + unseen, F.col(size))
    return scored.select(*kept, *(F.col(prefix + c) for c in STATISTICS), perplexity.alias(prefix + "log10_ppl"))


def _statistics_columns(texts: pa.Array) -> list[pa.Array]:
    rows = np.empty((len(texts), len(STATISTICS) + 1), np.int64)
    for i, value in enumerate(texts.cast(pa.binary())):
        text = value.as_py()
        rows[i] = *text_statistics(text), len(text or b"")
    return [pa.array(rows[:, j]) for j in range(rows.shape[1])]


def _round(hashes: Broadcast, order: int):
    """One round of scoring; the first one also takes the text statistics."""
    def compute(texts: pa.Array, languages: pa.Array, before: pa.Array | None = None, missed: pa.Array | None = None) -> list[pa.Array]:
        sums, missing = _log_sums(texts, languages, order, hashes.value)
        if before is None:
            return [*_statistics_columns(texts), pa.array(sums), pa.array(missing)]
        return [pa.array(sums + before.to_numpy(zero_copy_only=False)), pa.array(missing + missed.to_numpy(zero_copy_only=False))]
    return compute


def base_failed(prefix: str = "") -> F.Column:
    words, repeated = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


def perplexity_bands(scored: DataFrame, lang: str = "lang", prefix: str = "", copies: str | None = None) -> DataFrame:
    """Rows (lang, q1, q3): quartiles of log10 perplexity of each language's documents.

    They are exact on a histogram with ``_BIN`` bins per unit, over all documents that pass the base rules.  Documents alike
    in column ``copies``, if it is named, and in their statistics count once.
    """
    usable = scored.filter(~base_failed(prefix) & F.col(prefix + "log10_ppl").isNotNull()).select(
        F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.round(F.col(prefix + "log10_ppl") * _BIN).cast("long").alias("bin"),
        *([] if copies is None else [F.col(copies).alias("copies"), *(F.col(prefix + c).alias(c) for c in STATISTICS)]))
    bins = (usable if copies is None else usable.distinct()).groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("lang").orderBy("bin")
    ranked = bins.withColumn("upto", F.sum("n").over(along)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    quartile = [F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bin"))) / _BIN for q in (1, 3)]
    return ranked.groupBy("lang").agg(quartile[0].alias("q1"), quartile[1].alias("q3"))


def inside_band(perplexity: F.Column, words: F.Column, first: F.Column, third: F.Column) -> F.Column:
    """Whether a log10 perplexity lies between the lower and the upper bound of its language."""
    spread = F.greatest(third - first, F.lit(1.0 / _BIN)) * F.sqrt(1 + SHORT_WORDS / F.greatest(words, F.lit(1)))
    return F.coalesce(perplexity.between(first - LOWER_REACH * spread, third + UPPER_REACH * spread), F.lit(False))


def judge_documents(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER,
                    keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``keep`` (default all) columns of ``docs`` with statistics, ``log10_ppl``, ``base_failed`` and ``kept``.

    A document is kept if it passes the base rules and its perplexity lies inside its language's
    band.  Each language's texts are dealt to two halves by their hash, and each half is scored by the model of the other, so
    no text predicts itself or a copy of itself.  Copies count once in the models and in the bands.
    Null or empty texts fail the base rules; a null language is a language of its own;
    repeated rows are judged alike.  Scores are written down once, because bands and verdicts both read them.
    """
    columns = list(docs.columns if keep is None else keep)
    label, mark, counted, asks = (fresh(docs, x) for x in ("judged_lang", "text_hash", "counted_as", "scored_as"))
    labelled = docs.withColumns({label: F.coalesce(F.col(lang), F.lit("")), mark: F.xxhash64(text)}).withColumns({
        counted: F.concat(F.pmod(F.col(mark), F.lit(2)).cast("string"), label), asks: F.concat(F.pmod(F.col(mark) + 1, F.lit(2)).cast("string"), label)})
    counts = settled(count_ngrams(distinct_texts(labelled, text, counted, mark), order, text, counted), "counts")
    other_half = F.concat(F.translate(F.substring("lang", 1, 1), "01", "10"), F.expr("substring(lang, 2)")).alias("lang")
    model = settled(kneser_ney(counts, order, counts.select(other_half, "gram")), "model")
    scored = score_documents(labelled, model, order, text, asks, [*columns, label, mark], prefix)
    bands = perplexity_bands(scored, label, prefix, mark).withColumnRenamed("lang", label)
    failed = base_failed(prefix)
    first, third = fresh(scored, "band_q1"), fresh(scored, "band_q3")
    inside = inside_band(F.col(prefix + "log10_ppl"), F.col(prefix + "n_words"), F.col(first), F.col(third))
    return (scored.join(bands.withColumnsRenamed({"q1": first, "q3": third}), label, "left")
            .select(*columns, *(prefix + c for c in STATISTICS), failed.alias(prefix + "base_failed"),
                    (~failed & inside).alias(prefix + "kept"), prefix + "log10_ppl"))


def distinct_texts(docs: DataFrame, text: str, lang: str, mark: str) -> DataFrame:
    """Columns (text, lang) of ``docs``, each text once per language.  ``mark`` holds a hash of the text.

    Only texts whose hash stands in several rows are compared, and only they are shuffled.
    """
    several = settled(docs.groupBy(lang, mark).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(lang, mark), "copied")
    if several.count() <= BROADCAST_ENTRIES:
        several = F.broadcast(several)
    rows = docs.select(text, lang, mark)
    once = rows.join(several, [lang, mark], "left_anti")
    copied = rows.join(several, [lang, mark], "left_semi").dropDuplicates([lang, text])
    return once.select(text, lang).unionByName(copied.select(text, lang))
