"""Tokens, trigrams, positions and snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters, marks, digits and underscores, or one other visible character.
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]"


def tokens(text: Column) -> Column:
    """Tokens of the lower-cased text in order; null gives an empty list."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def trigrams(token: Column) -> Column:
    """Distinct trigrams of the token padded with one $ on either side; none for an empty token."""
    padded = F.concat(F.lit("$"), token, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(token), F.lit(1))), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(F.length(token) > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def term_runs(title: Column, body: Column) -> Column:
    """array<struct<term, pos_title, pos_body>> of two token lists: each distinct term with its positions in either field,
    found by sorting inside the row, so that an index build shuffles no tokens."""
    mark = lambda arr, field: F.transform(arr, lambda t, i: F.struct(t.alias("term"), F.lit(field).alias("field"), i.alias("pos")))
    return F.concat(mark(title, 0), mark(body, 1))


def runs_of(sorted_col: str, starts_col: str) -> Column:
    """See term_runs: groups the sorted occurrences in sorted_col at the offsets in starts_col."""
    s, st = F.col(sorted_col), F.col(starts_col)

    def group(a: Column, k: Column) -> Column:
        part = F.slice(s, a + 1, F.coalesce(F.get(st, k + 1), F.size(s)) - a)
        pos = lambda field: F.transform(F.filter(part, lambda x: x["field"] == field), lambda x: x["pos"])
        return F.struct(F.get(s, a)["term"].alias("term"), pos(0).alias("pos_title"), pos(1).alias("pos_body"))

    return F.transform(st, group)


def starts_of(sorted_col: str) -> Column:
    s = F.col(sorted_col)
    all_ = F.sequence(F.lit(0), F.size(s) - 1)
    return F.when(F.size(s) > 0, F.filter(all_, lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"])))


def snippet(body: Column, length: int) -> Column:
    """The first `length` bytes of the text; a character cut in two becomes U+FFFD."""
    return F.make_valid_utf8(F.substring(body.cast("binary"), 1, length).cast("string"))
