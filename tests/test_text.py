import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from glossmeter.functions import numbers as N, text as T

SAMPLES = ["ề", "ề", "é", "é", "각", "각", "🙂", "👩‍🚀", "Ω", "한국어", "हिन्दी", "क़", "abc", "",
           "がぎ", "がき", "Русский", "Русский", "漢字", "豈", "Ạ̊", "ﬁ", "ﬀ", "̀", "ʹ", "q̣̇", "`"]


def _map(spark, expr, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r[1] for r in sorted(df.select("i", expr(F.col("text"))).collect())]


def test_nfc_matches_the_standard_library(spark):
    assert _map(spark, T.nfc, [*SAMPLES, None]) == [*(unicodedata.normalize("NFC", s) for s in SAMPLES), None]


def test_safe_ranges_hold_only_code_points_nfc_never_touches():
    seconds = set()
    for cp in range(0x110000):
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(int(parts[1], 16))
    seconds |= set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))      # Hangul vowels and finals
    for lo, hi in T.NFC_SAFE_RANGES:
        for cp in range(lo, hi + 1):
            c = chr(cp)
            assert unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) and cp not in seconds, hex(cp)


def test_plain_text_is_not_sent_to_python(spark):
    df = spark.createDataFrame([("plain",), ("décomposé".encode().decode(),), ("漢字",)], "text string")
    suspect = F.col("text").rlike(T._BEYOND_LATIN) & ~F.col("text").rlike(T._ALL_SAFE)
    assert [r[0] for r in df.select(suspect).collect()] == [False, False, False]


def test_counts_are_code_points_bytes_and_words(spark):
    assert _map(spark, T.char_count, SAMPLES) == [len(s) for s in SAMPLES]
    assert _map(spark, T.byte_count, SAMPLES) == [len(s.encode()) for s in SAMPLES]
    assert _map(spark, T.word_count, ["a b_1 é-ü", "", "..", "Привет мир 42"]) == [4, 0, 0, 3]


def test_code_points_round_trip(spark):
    assert _map(spark, T.code_points, SAMPLES) == [[ord(c) for c in s] for s in SAMPLES]
    assert _map(spark, lambda t: T.from_code_points(T.code_points(t)), SAMPLES) == SAMPLES


LINE_CASES = ["a\nb\n", "a\r\nb\r\n", "a\rb", "\n", "", "a\n\nb", "a\n\n", " \nx", "x y\nz", "\r", "a\r\r\nb"]


def _python_lines(text, keep):
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return lines if keep or lines[-1] else lines[:-1]


@pytest.mark.parametrize("keep", [False, True])
def test_split_lines(spark, keep):
    assert _map(spark, lambda t: T.split_lines(t, keep), LINE_CASES) == [_python_lines(s, keep) for s in LINE_CASES]


def test_blank_and_strip_follow_python(spark):
    values = ["", " ", " ", "　\t", "\x1c\x1f", "​", "x", " x ", " a b\x85", "﻿", "\n \r"]
    assert _map(spark, T.is_blank, values) == [not v.strip() for v in values]
    assert _map(spark, T.strip_space, values) == [v.strip() for v in values]


def test_subsequence_removal_takes_whole_tokens_only(spark):
    cases = [([5, 248059, 1, 7], [5, 7]), ([248059, 12], [248059, 12]), ([1248059, 1], [1248059, 1]), ([], []),
             ([248059, 1, 248059, 1], []), ([248059, 248059, 1, 1], [248059, 1]), ([1, 248059], [1, 248059])]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, ids array<bigint>")
    got = [r[1] for r in sorted(df.select("i", T.remove_subsequence(F.col("ids"), [248059, 1])).collect())]
    assert got == [c[1] for c in cases]


def test_unknown_count_truncates_and_is_never_negative(spark):
    cases = [(10, 100, 95), (3, 10, 12), (7, 9, 4), (5, 0, 0), (10**13, 10**14, 10**14 - 3)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n bigint, len bigint, known bigint")
    got = [r[1] for r in sorted(df.select("i", T.unknown_count(F.col("n"), F.col("len"), F.col("known"))).collect())]
    assert got == [max(0, n * (a - b) // a if a >= b else 0) if a else None for n, a, b in cases]


def test_rounding_is_half_even_on_the_scaled_value(spark):
    import numpy as np
    values = [2.5, 0.00125, 1.00005, 0.125, -2.5, 1 / 3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[1] for r in sorted(df.select("i", N.round_even(F.col("v"), 4)).collect())]
    assert got == [float(np.round(v, 4)) for v in values]


def test_locale_forms(spark):
    df = spark.createDataFrame([(1234.56, 5.0, "2026-10-09")], "v double, whole double, d string")
    row = df.select(N.locale_number(F.col("v"), 2, "en"), N.locale_number(F.col("v"), 2, "vi"),
                    N.locale_money(F.col("whole"), "en"), N.locale_money(F.col("v"), "vi"),
                    N.locale_date(F.col("d"), "en"), N.locale_date(F.col("d"), "vi"),
                    N.locale_compact(F.col("v"), "vi"), N.locale_compact(F.col("whole"), "en"),
                    N.fixed(F.lit(None).cast("double"), 2)).first()
    assert tuple(row) == ("1,234.56", "1.234,56", "$5", "1.234,56 USD", "2026-10-09", "9/10/2026", "1.235", "5.00", None)


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(max_size=30), min_size=1, max_size=30))
def test_any_text_normalises_like_python(spark, texts):
    assert _map(spark, T.nfc, texts) == [unicodedata.normalize("NFC", s) for s in texts]
