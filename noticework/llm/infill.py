"""Fill-in-the-middle samples cut by one regular expression per row.

``regexp_count`` gives a text's number of units.  Two numbers drawn from the row's key cut it, and the row's own
pattern repeats the unit as often as each part asks: possessive counts neither back-track nor recurse, so one
match captures prefix, middle and suffix of a text of any length, and its replacement writes them in their new order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticework.llm.common import fresh

CODE_POINT = "."
# The marks of the parts, and the orders in which a sample holds them.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
WRITTEN = {PSM: "<P>$1<S>$3<M>$2", SPM: "<S>$3<P>$1<M>$2"}
READ = {PSM: (r"(?s)\A<P>(.*?)<S>(.*?)<M>(.*)", "$1$3$2"), SPM: (r"(?s)\A<S>(.*?)<P>(.*?)<M>(.*)", "$2$3$1")}

# Units counted as one match, so that the count of a long text holds few matches at a time.
_BLOCK = 1000


def unit_count(text: Column, unit: str = CODE_POINT) -> Column:
    """Units of a text, matched from left to right: whole blocks first, then what they leave."""
    rest = F.regexp_replace(text, F.lit(rf"(?s)\A(?:{unit}{{{_BLOCK}}}+)*+"), F.lit(""))
    return (F.regexp_count(text, F.lit(f"(?s){unit}{{{_BLOCK}}}+")) * _BLOCK + F.regexp_count(rest, F.lit(f"(?s){unit}"))).cast("bigint")


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of seed and key; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = CODE_POINT, seed: int = 1,
                   infill_percent: int = 90, spm_percent: int = 20, prefix: str = "") -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``prefix_units``, ``middle_units`` and ``output``.

    ``unit`` is a regular expression, one atom, whose matches tile the text.  ``infill_percent`` of the texts are cut,
    ``spm_percent`` of those put the suffix first; empty and null texts, and texts that hold a mark, stay plain: their
    output is the text, their units of prefix and middle are null.  Everything follows from key and text, so repeated
    rows agree and a lost task is redone alike.  ``prefix`` is put before the names of the new columns; a column of ``docs``
    that is called so all the same gives way, others stay.
    """
    known, first, second = fresh(docs, "infill_text"), fresh(docs, "infill_a"), fresh(docs, "infill_b")
    n, form, before, inner = (prefix + c for c in ("n", "form", "prefix_units", "middle_units"))
    h1, h2, h3, h4 = draws(F.col(key), seed)
    marked = F.col(known).contains(PREFIX) | F.col(known).contains(SUFFIX) | F.col(known).contains(MIDDLE)
    stays = (F.col(known) == "") | marked | (h3 % 100 >= infill_percent)
    counted = docs.withColumn(known, F.coalesce(F.col(text), F.lit(""))).withColumn(n, unit_count(F.col(known), unit))
    drawn = counted.withColumns({first: h1 % (F.col(n) + 1), second: h2 % (F.col(n) + 1),
                                 form: F.when(stays, PLAIN).when(h4 % 100 < spm_percent, SPM).otherwise(PSM)})
    cut = F.col(form) != PLAIN
    placed = drawn.withColumns({before: F.when(cut, F.least(first, second)),
                                inner: F.when(cut, F.greatest(first, second) - F.least(first, second))})
    pattern = F.concat(F.lit(rf"(?s)\A({unit}{{"), F.col(before), F.lit(f"}}+)({unit}{{"), F.col(inner), F.lit("}+)(.*)"))
    written = F.regexp_replace(F.col(known), pattern, F.when(F.col(form) == SPM, WRITTEN[SPM]).otherwise(WRITTEN[PSM]))
    return placed.withColumn(prefix + "output", F.when(cut, written).otherwise(F.col(known))).drop(known, first, second)


def restored(output: Column, form: Column) -> Column:
    """The text that a sample was made of.  A text without marks leaves one of each, so the parts are told apart."""
    read = {f: F.regexp_replace(output, F.lit(pattern), F.lit(order)) for f, (pattern, order) in READ.items()}
    return F.when(form == PSM, read[PSM]).when(form == SPM, read[SPM]).otherwise(output)
