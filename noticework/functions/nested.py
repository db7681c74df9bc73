"""JSON fields whose shape varies: scalar or list, language-keyed objects, aligned lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIST_OF_TEXT = "array<string>"
LANGUAGE_OBJECT = "map<string,string>"


def _enclosed(json_text: Column, opening: str, closing: str) -> Column:
    """Both brackets are needed: the parser would take ``[2024] Works`` for a list."""
    return F.startswith(F.ltrim(json_text), F.lit(opening)) & F.endswith(F.rtrim(json_text), F.lit(closing))


def is_json(text: Column) -> Column:
    """Whether the text is one valid JSON value; NULL stays NULL."""
    return F.when(text.isNotNull(), F.try_parse_json(text).isNotNull())


def items(json_text: Column) -> Column:
    """JSON list to an array of text; a scalar or broken JSON gives NULL."""
    return F.when(_enclosed(json_text, "[", "]"), F.from_json(json_text, LIST_OF_TEXT))


def first_item(listed: Column, json_text: Column) -> Column:
    """First element of a list already parsed by ``items``, or the scalar itself.

    An empty list has no value; text that only looks like a list is a scalar.
    """
    return F.coalesce(F.try_element_at(listed, F.lit(1)), F.when(listed.isNull(), json_text))


def first_or_scalar(json_text: Column) -> Column:
    return first_item(items(json_text), json_text)


def language_texts(json_text: Column) -> Column:
    """Language-keyed object as a map in document order; values stay raw JSON."""
    return F.when(_enclosed(json_text, "{", "}"), F.from_json(json_text, LANGUAGE_OBJECT))


def first_language(texts: Column) -> Column:
    return F.try_element_at(F.map_keys(texts), F.lit(1))


def in_first_language(texts: Column) -> Column:
    """Raw JSON held under the first language of the map."""
    return F.try_element_at(F.map_values(texts), F.lit(1))


def any_equal(values: Column, wanted: str) -> Column:
    """Whether any element is the wanted one: unknown elements are ignored, without a known one the answer is unknown."""
    return F.when(F.array_max(values).isNotNull(), F.coalesce(F.array_contains(values, wanted), F.lit(False)))


def any_other_than(values: Column, excluded: str) -> Column:
    """Whether any element differs, unknown ones ignored: the smallest or the largest does."""
    return (F.array_min(values) != excluded) | (F.array_max(values) != excluded)


def total(values: Column) -> Column:
    """Sum of the numbers in a list of text; NULL when none of them is a number."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda acc, x: F.coalesce(F.coalesce(acc, F.lit(0.0)) + x.try_cast("double"), acc))


def distinct_known(values: Column) -> Column:
    """Distinct non-null elements in order of first appearance."""
    return F.array_distinct(F.array_compact(values))


def aligned(values: Column, position: Column, expected: Column) -> Column:
    """Element at a 1-based position, only when the list has exactly the expected length."""
    return F.when(F.size(values) == expected, F.try_element_at(values, position))


def single_or_aligned(values: Column, position: Column, expected: Column) -> Column:
    """The one distinct element when there is only one, else the aligned element."""
    lone = distinct_known(values)
    return F.when(F.size(lone) == 1, lone[0]).otherwise(aligned(values, position, expected))
