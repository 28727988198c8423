"""Visually identical text with different characters (problem 10)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import all_pairs, cut, sent, spread

# Letters that look like Latin ones, each followed by the Latin letter.
CYRILLIC = "АAВBЕEЅSІIЈJКKМMНHОOРPСCТTУYХXаaеeоoрpсcуyхxѕsіiјjһhԁdԛqԝwѵvԌGԚQԜWҮYӀIӏl"
GREEK = "ΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧXαaιiοoνvρpυuϲcϳjϹCͿJ"
ARMENIAN_LATIN = "օoսuհhցgոnզqՕOՍUɑaɡgɩi"
CHEROKEE = "ᎠDᎡRᎢTᎥiᎪAᎫJᎬEᎳWᎷMᎻHᏀGᏃZᏏbᏒRᏔWᏕSᏙVᏚSᏞLᏟCᏢPᏦKᏴB"
LISU = "ꓐBꓑPꓓDꓔTꓖGꓗKꓙJꓚCꓜZꓝFꓟMꓠNꓡLꓢSꓣRꓦVꓧHꓪWꓫXꓬYꓮAꓰEꓲIꓳOꓴU"
# Hyphens that look like the ASCII one.
HYPHENS = "\u02d7\u2010\u2011\u2012\u2043\u2212\ufe58\ufe63\uff0d"
# A gap that is no white space.
BLANKS = "\u2800"
# The ranges of default-ignorable characters, and of others that show nothing.
IGNORABLE = (
    (0x0080, 0x0084), (0x0086, 0x009F), (0xFFF9, 0xFFFB),
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
#: Compatibility characters of these kinds don't look like what they stand for, so they stay.
DISTINCT_KINDS = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>")
_HIDDEN = "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in IGNORABLE)
#: A line end stays one if a character that shows nothing stands inside it.
LINE_ENDS = re.compile(f"\r(?:[{_HIDDEN}]*\n)?|[\x0b\x0c\x85\u2028\u2029]")
CONTROLS = re.compile("[\x00-\x09\x0b-\x1f\x7f\x85\u2028\u2029]")
ASCII_CONTROLS = {c: None for c in (*range(32), 127) if c not in (9, 10)} | {9: " "}
SEGMENT = re.compile("[!-~]?[^\x00-\x7f][^ \n]*")
_PRIVATE = 0x100000


@cache
def _tables(fold: bool) -> tuple[dict[int, str | None], dict[int, str]]:
    """What characters become before normalisation, and what to put back after it."""
    to: dict[int, str | None] = {}
    for lo, hi in IGNORABLE:
        to.update(dict.fromkeys(range(lo, hi + 1)))
    for s in (CYRILLIC, GREEK, ARMENIAN_LATIN, CHEROKEE, LISU):
        to.update({ord(a): b for a, b in zip(s[::2], s[1::2])})
    to.update(dict.fromkeys(map(ord, HYPHENS), "-") | dict.fromkeys(map(ord, BLANKS), " "))
    back: dict[int, str] = {}
    for c in range(0x80, 0x20000):
        ch = chr(c)
        if unicodedata.category(ch) == "Zs":
            to[c] = " "
        elif not fold and unicodedata.decomposition(ch).startswith(DISTINCT_KINDS):
            stand_in = _PRIVATE + len(back)
            to[c], back[stand_in] = chr(stand_in), ch
    return to, back


def _whole(text: str, fold_case: bool) -> str:
    to, back = _tables(fold_case)
    s = unicodedata.normalize("NFKC", unicodedata.normalize("NFD", text).translate(to))
    if fold_case:
        s = unicodedata.normalize("NFKC", s.casefold())
    # what only normalisation brought to light
    s = unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(to))
    return s.translate(back) if back else s


_segments: dict[str, str] = {}


def _segment(m: re.Match) -> str:
    """A piece of text from the letter before its first character beyond ASCII to the next blank: what composes lies within
    it. Short pieces come again and again, so each distinct one is treated once."""
    x = m[0]
    s = _segments.get(x)
    if s is None:
        s = _whole(x, False)
        if len(x) <= 40:
            if len(_segments) >= 500_000:
                _segments.clear()
            _segments[x] = s
    return s


def canonical_form(text: str, fold_case: bool = False) -> str:
    """One form for texts that look the same: canonically decomposed, look-alike letters and hyphens replaced, line ends,
    white space and default-ignorable characters mapped or removed, then compatibility-composed (NFKC).

    Case stays unless fold_case, which adds full case folding and lets raised digits, fractions and circled characters
    become plain ones, for looser comparisons."""
    if CONTROLS.search(text):
        text = LINE_ENDS.sub("\n", text).translate(ASCII_CONTROLS)
    if fold_case:
        return text.casefold() if text.isascii() else _whole(text, True)
    return text if text.isascii() else SEGMENT.sub(_segment, text)


def canonical(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold_case: bool = False) -> DataFrame:
    """(id, form): the canonical form of every text, one row for each row of the input.

    A null text has a null form, an empty one an empty form. Equal texts of a batch are treated once. No shuffle;
    repeated rows stay, other columns are ignored, an empty table gives an empty result; texts are read whole."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            code, values = pd.factorize(pdf[text_col])
            forms = [canonical_form(x, fold_case) for x in values]
            yield pd.DataFrame({id_col: pdf[id_col], "form": [forms[i] if i >= 0 else None for i in code]})

    return spread(df.select(id_col, text_col)).mapInPandas(run, f"`{id_col}` {kind}, form string")


def same_looking_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold_case: bool = False) -> DataFrame:
    """(id_a, id_b), a < b: records whose texts differ but have one form. Null and blank texts have no partner.

    Only digests (128 bits) of form and text are shuffled, once each row; equal texts form a class, and the links between
    the classes of a form become pairs of records, all of them, made in blocks (see common.all_pairs)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        digest = lambda s: hashlib.blake2b(s.encode(), digest_size=16).hexdigest()
        for pdf in it:
            pdf = pdf[pdf[text_col].notna()]
            code, values = pd.factorize(pdf[text_col])
            forms = [canonical_form(x, fold_case) for x in values]
            of = [digest(f) if f.strip() else None for f in forms]
            cls = [digest(x) for x in values]
            out = pd.DataFrame({"id": pdf[id_col], "class": [cls[i] for i in code], "form": [of[i] for i in code]})
            yield out[out.form.notna()]

    d = cut(spread(df.where(F.col(id_col).isNotNull()).select(id_col, text_col)).mapInPandas(run, f"id {kind}, class string, form string"))
    # forms of one text alone, nearly all, go no further
    several = sent(cut(d.groupBy("form").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("form")))
    c = cut(d.join(several, "form", "left_semi").distinct())
    classes = c.select("form", "class").distinct()
    links = classes.select("form", F.col("class").alias("class_a")).join(classes.select("form", F.col("class").alias("class_b")), "form").where("class_a < class_b").select("class_a", "class_b")
    return all_pairs(links, c.select("class", "id"))
