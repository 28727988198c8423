import base64
import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm import canonical as ca
from rankloom.llm import encoding as en
from rankloom.llm import packing as pk

VOCABULARY = Path(en.TOKENIZERS) / "byte_bpe_50k.tiktoken"
here = pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary files")


@pytest.fixture(scope="module")
def bpe():
    return en.ByteBpe(str(VOCABULARY))


def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, VOCABULARY.open("rb"))}
    return tiktoken.Encoding("own", pat_str=en.SPLIT, mergeable_ranks=ranks, special_tokens={})


@here
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40) | st.text("ab 'st\n\t0 é", max_size=40), max_size=5))
def test_same_ids_as_another_encoder(texts):
    b = en.tokenizer(str(VOCABULARY))
    ref = _ref.setdefault("e", None) or _ref.__setitem__("e", reference()) or _ref["e"]
    assert list(b.encode_batch(texts)) == [ref.encode_ordinary(t) for t in texts]


_ref: dict = {}


@here
def test_round_trip_and_edges(spark, bpe):
    long = "naïve <|endoftext|> 12345 " * 5000
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, long), (4, long), (None, "aaaaaaa")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = en.encode(df).collect()
    assert len(got) == 6
    by = {r["doc_id"]: r["ids"] for r in got}
    assert by[1] == [] and by[2] == [] and len(by[3]) > 0
    assert b"".join(bpe.token[i] for i in by[4]).decode() == long
    counts = {r["doc_id"]: r["n_tokens"] for r in en.token_counts(df).collect()}
    assert counts == {k: len(v) for k, v in by.items()}
    assert en.encode(df.limit(0)).count() == 0


def test_first_fit_is_first_fit():
    rng = random.Random(1)
    for _ in range(30):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(60))]
        room, want = [], []
        for s in sizes:
            i = next((i for i, r in enumerate(room) if r >= s), len(room))
            if i == len(room):
                room.append(30)
            room[i] -= s
            want.append(i)
        assert pk.first_fit(sizes, 30) == want


@pytest.mark.parametrize("group_items", [10_000, 50])
def test_pack(spark, group_items):
    rng = random.Random(2)
    items = [(i, rng.choice([1, 5, 30, 99, 100, 101, 250, 0])) for i in range(400)] + [(900, None), (901, -1)]
    df = spark.createDataFrame(items, "doc_id bigint, n_tokens bigint").withColumn("container", F.lit("clash"))
    got = pk.pack(df, 100, group_items=group_items).collect()
    of, used = {}, {}
    for r in got:
        of.setdefault(r["doc_id"], []).append((r["token_start"], r["token_end"]))
        used.setdefault(r["container"], []).append((r["place"], r["token_end"] - r["token_start"]))
    for i, n in items:
        if not n or n < 0:
            assert i not in of
            continue
        parts = sorted(of[i])
        assert parts[0][0] == 0 and parts[-1][1] == n and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert len(parts) == -(-n // 100) and all(b - a == 100 for a, b in parts[:-1])
    for rows in used.values():
        assert sum(n for _, n in rows) <= 100 and sorted(p for p, _ in rows) == list(range(len(rows)))
    total = sum(n for _, n in items if n and n > 0)
    assert len(used) <= 1.05 * total / 100 + 2 * (402 // group_items + 1)
    assert pk.pack(df.limit(0), 100).count() == 0


@here
def test_pack_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "word " * 5000)], "doc_id bigint, text string")
    got = pk.pack_texts(df).collect()
    assert {r["doc_id"] for r in got} == {3, 4} and sum(r["token_end"] - r["token_start"] for r in got if r["doc_id"] == 4) >= 5000


SAME = [
    ("ｆｕｌｌ　ｗｉｄｔｈ１２", "full width12"), ("été", "été"), ("ﬁ ﬂ", "fi fl"), ("pаypаl", "paypal"), ("a b c　d\te", "a b c d e"), ("zero​width﻿­", "zerowidth"),
    ("non‑breaking", "non-breaking"), ("K", "K"), ("line\r\nend\rx", "line\nend\nx"), ("ϲοѕһ", "cosh"), ("ё ё", "ё ё"), ("が", "が"), ("Ι e​́", "I é"),
    ("a\r\u200b\nb", "a\nb"), ("a\u0081b\ufff9", "ab"), ("a\u2800b", "a b"), ("1\u20122", "1-2"), ("υ ӏ ո", "u l n"), ("ᎠꓐꓟᏚ", "DBMS"),
]
DIFFERENT = [("a", "A"), ("é", "e"), ("x²", "x2"), ("½", "1/2"), ("a  b", "a b"), ("a\n\nb", "a\nb"), ("①", "1"), ("1", "l"), ("a b", "ab")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert ca.canonical_form(a) == ca.canonical_form(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert ca.canonical_form(a) != ca.canonical_form(b)


def test_folded():
    assert ca.canonical_form("Straße ²", True) == ca.canonical_form("STRASSE 2", True) == "strasse 2"


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Co", "Cn"]), max_size=30))
def test_stable_and_piecewise(s):
    once = ca.canonical_form(s)
    assert ca.canonical_form(once) == once


def test_large_groups_give_all_pairs(spark):
    df = spark.range(210).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 110, "same").otherwise("ｓame").alias("text"))
    p = ca.same_looking_pairs(df).collect()
    assert len({tuple(r) for r in p}) == len(p) == 110 * 100 and all(a < 110 <= b for a, b in p)


def test_pairs_and_forms(spark, rows):
    recs = [(1, "full"), (2, "ｆull"), (3, "full"), (4, None), (5, ""), (6, "​ "), (7, " "), (8, "Full"), (2, "ｆull"), (9, "x" * 100_000 + "ｙ"), (10, "x" * 100_000 + "y"), (None, "fuｌl")]
    df = spark.createDataFrame(recs, "doc_id bigint, text string").withColumn("class", F.lit(0)).withColumn("form", F.lit(0))
    assert rows(ca.same_looking_pairs(df)) == [(1, 2), (2, 3), (9, 10)] or rows(ca.same_looking_pairs(df)) == [(1, 2), (9, 10), (2, 3)]
    forms = {r["doc_id"]: r["form"] for r in ca.canonical(df).collect()}
    assert forms[1] == forms[2] == "full" and forms[4] is None and forms[5] == "" and ca.canonical(df).count() == len(recs)
    assert ca.same_looking_pairs(df.limit(0)).count() == 0
