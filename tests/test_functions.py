"""Columns and text helpers on hand-made rows."""

import datetime
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from almanac.functions import casts, text as X
from almanac.functions.fuzzy import NameIndex, partial_ratio
from almanac.functions.splitting import split_text
from almanac.functions.vectors import cosine_distance


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_numbers_that_cannot_be_read_are_null(spark):
    values = ["1.5", " 2 ", "-3e2", ".5", "n/a", "", None, "1d", "0x10", "1,5"]
    assert column(spark, values, casts.to_number) == [1.5, 2.0, -300.0, 0.5, None, None, None, None, None, None]


def test_years_are_cut_to_whole(spark):
    assert column(spark, ["2020.0", "2020.9", "x", "1e99"], casts.year_from_float) == [2020, 2020, None, None]


def test_iso3_takes_three_upper_case_letters(spark):
    values = ["PRT", "prt", "PR", "PRTX", "P1T", "ÁÉÍ", "PRT\n", None]
    assert column(spark, values, casts.is_iso3) == [True, False, False, False, False, True, False, None]


def test_dates_in_three_layouts(spark):
    values = ["15/03/2001", "2001-03-15", "5-3-2001", "2001/03/15", "31/02/2001", None]
    d = datetime.date
    want = [d(2001, 3, 15), d(2001, 3, 15), d(2001, 3, 5), None, None, None]
    assert column(spark, values, casts.parse_date_flexible) == want


def test_values_are_shown_with_blanks_between_thousands(spark):
    values = [1234567.0, 1234.5, 0.005, -2.0, None]
    assert column(spark, values, X.format_value, "double") == ["1 234 567", "1 234.50", "0.01", "-2", ""]


def test_comments_go_but_urls_stay(spark):
    raw = 'a: 1 // note\nb: "http://x.org/y" // end\n// all'
    assert column(spark, [raw], X.strip_jsonc) == ['a: 1 \nb: "http://x.org/y" \n']


def test_fences(spark):
    values = ["x ```SQL\nselect 1\n``` y", "```\na\n```", "  select 2 \n"]
    assert column(spark, values, X.strip_fence) == ["select 1", "a", "select 2"]


def test_names_are_one_line(spark):
    assert column(spark, [" a\nb\r\nc "], X.normalise_name) == ["a b c"]


def test_cosine_of_nothing_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0], [0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, None]


# --- splitting -----------------------------------------------------------------------------


def test_splitting_by_hand():
    assert split_text("aaa bbb ccc ddd", 10, 3) == ["aaa bbb", "ccc ddd"]
    assert split_text("aaa bbb ccc ddd", 10, 5) == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert split_text("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]
    assert split_text("one\n\ntwo", 500, 50) == ["one\n\ntwo"]
    assert split_text(" \n ", 500, 50) == [] and split_text("", 500, 50) == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_chunks_cover_the_text_in_order(shape, size, overlap):
    # every letter is a different one, so a chunk has one place in the text
    text = "".join(chr(0x4E00 + i) if ch in "ab" else ch for i, ch in enumerate(shape))
    covered = 0
    for c in split_text(text, size, overlap):
        assert 0 < len(c) <= size and c == c.strip()
        at = text.find(c)
        assert at >= 0 and text[covered:at].strip() == "" and at >= covered - overlap
        covered = at + len(c)
    assert text[covered:].strip() == ""


# --- similarity -----------------------------------------------------------------------------


def test_similarity_by_hand():
    assert partial_ratio("abc", "xxabcxx") == 100.0
    assert partial_ratio("abcd", "abxd") == 75.0
    assert partial_ratio("", "a") == 0.0
    assert partial_ratio("abc", "xyz") == 0.0


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.text(alphabet="abcd e", max_size=20), min_size=1, max_size=6),
    st.lists(st.text(alphabet="abcd e", max_size=70), min_size=1, max_size=6),
    st.sampled_from([30.0, 50.0, 72.0, 90.0, 100.0]),
)
def test_name_index_equals_the_definition(names, texts, threshold):
    best, place = NameIndex(names, threshold).best(texts)
    for t, s, p in zip(texts, best, place):
        want = max(((partial_ratio(n, t), -i) for i, n in enumerate(names) if n and t), default=(0.0, 0))
        assert (s, -p) == (pytest.approx(want[0]), want[1]) if want[0] >= threshold else (s, p) == (0, -1)


def test_pairs_that_share_too_little_are_not_scored():
    index = NameIndex(["press freedom", "rule of law", "zz top and more"], 72.0)
    best, place = index.best(["press freedom in 2001", "zzzz" * 50, "qqq"])
    assert list(place) == [0, -1, -1] and index.scored <= 3


def test_long_names_and_texts_are_scored_too():
    rng = random.Random(1)
    name = "".join(rng.choice("abcdefg ") for _ in range(90))
    worn = "say " + name[:40] + name[45:] + " now"
    best, _ = NameIndex([name], 72.0).best([worn, name[5:80], "x" * 100_000 + worn, worn + "y" * 19_000])
    assert best[0] == pytest.approx(partial_ratio(name, worn)) and best[1] == 100.0 and best[2] == best[3] == best[0]
