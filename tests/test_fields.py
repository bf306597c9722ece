"""Scalar functions on literal edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bookfeel import schemas
from bookfeel.functions import fields as fx
from bookfeel.functions import text as tx
from bookfeel.operators import filters, metadata


def values(spark, rows, expression, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("c"))).collect()]


def words(n):
    return " ".join(["w"] * n)


def test_word_count_matches_python(spark):
    texts = ["", "  ", "a b", " a\tb\nc ", "a b", "a\x1cb\x85c", " x ", words(51)]
    assert values(spark, texts, tx.word_count) == [len(t.split()) for t in texts]


def test_has_text_is_unicode_aware(spark):
    texts = ["", " \t", "  ", "\x1c", " x ", None]
    assert values(spark, texts, tx.has_text) == [False, False, False, False, True, None]


@pytest.mark.parametrize("limit", [0, 1, 50])
def test_longer_than_is_word_count(spark, limit):
    texts = ["", " ", words(1), " a b ", words(50), words(51), " " + words(51) + " ", words(50) + "\n", words(3000)]
    assert values(spark, texts, lambda c: tx.longer_than(c, limit)) == [len(t.split()) > limit for t in texts]


def test_dump_dates(spark):
    rows = ["Sun Jul 30 07:44:10 -0700 2017", "Mon Jan 5 00:00:00 +0000 2015", "Mon Jan 05 00:00:00 +0000 2015", "", "x", None]
    got = values(spark, rows, lambda c: F.unix_seconds(fx.dump_date(c)))

    def at(*a):
        return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp())

    none = at(1970, 7, 1, 7)
    assert got == [at(2017, 7, 30, 14, 44, 10), at(2015, 1, 5), at(2015, 1, 5), none, none, none]


def test_read_hours(spark):
    rows = [
        ("2015-01-01 00:00:00", "2015-01-02 06:30:00", 30.5),
        ("2015-01-01 00:00:00", "2015-01-01 00:00:00", 0.0),
        ("2015-01-02 00:00:00", "2015-01-01 00:00:00", None),
        ("1970-07-01 07:00:00", "2015-01-01 00:00:00", None),
        ("2015-01-01 00:00:00", "1970-12-31 23:59:59", None),
        ("1969-12-31 23:00:00", "1971-01-01 00:00:00", 8761.0),
    ]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    hours = fx.read_hours(F.to_timestamp("a"), F.to_timestamp("b"))
    assert [r[0] for r in df.select(hours).collect()] == [r[2] for r in rows]


def test_year_1970_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.range(1).select(fx.read_hours(
            F.timestamp_seconds(F.lit(365 * 86400 - 1)), F.timestamp_seconds(F.lit(365 * 86400))))
        assert df.first()[0] is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_count_bins(spark):
    counts = [-1, 0, 5, 6, 10, 11, 1000, 1001, 100000, 100001, None]
    want = [None, "1-5", "1-5", "6-10", "6-10", "11-50", "501-1000", "1001+", "1001+", None, None]
    assert values(spark, counts, fx.count_bin, "long") == want
    assert values(spark, counts, fx.bin_colour, "long")[0] == "#cccccc"


def test_display_forms(spark):
    assert values(spark, ["10.05", "10.0", "", None], fx.numeric_display) == ["105", "10", "", ""]
    assert values(spark, ["['1999']", " 2001 ", None], fx.clean_year) == ["1999", "2001", ""]
    assert values(spark, [-5, 1, 0], fx.century_label, "int") == ["5th c. BCE", "1th c. CE", "0th c. CE"]
    assert values(spark, [3.0], fx.era_anchor, "double") == ["era-3"]
    assert values(spark, [" Y", "yes", "T", "1", "n", None], fx.flag_to_int) == [1, 1, 1, 1, 0, 0]
    assert values(spark, ["[1.5, 2]", "[1]", "x", None], lambda c: F.size(fx.parse_latlng(c))) == [2, 1, None, None]


def test_shelves_and_series(spark):
    df = spark.createDataFrame(
        [([("3", "a"), ("4", "b")], ["s"]), ([], []), (None, [])],
        "shelves array<struct<count: string, name: string>>, series array<string>")
    got = df.select(fx.shelves_total(F.col("shelves")), fx.series_flag(F.col("series"))).collect()
    assert [tuple(r) for r in got] == [(7, "Y"), (0, "N"), (0, "N")]


def test_normalised_text(spark):
    texts = ["  The Children WERE reading 3 books!  ", "Cafés, l'été", "I cannot go", "cannothing scannot"]
    assert values(spark, texts, tx.normalize_text) == [
        "the child be read book", "cafés lété", "i can not go", "cannothing scannot"]
    assert values(spark, texts, tx.normalize_text_full) == ["child read book", "cafes lete", "go", "cannothing scannot"]
    # A repeated word stays repeated.
    assert values(spark, ["dog dog the dog"], tx.normalize_text_full) == ["dog dog dog"]


def test_json_block(spark):
    rows = ['{"a": 1}', '```json\n{"a": 1}\n```', 'Well: {"a": {"b": 2}} bye', "nothing {here", "", None]
    assert values(spark, rows, tx.json_block) == ['{"a": 1}', '{"a": 1}', '{"a": {"b": 2}}', None, None, None]


def test_parse_literal_and_flatten(spark):
    text = ["[{'count': '2', 'name': \"it's\"}]", "[]"]
    assert values(spark, text, lambda c: F.to_json(tx.parse_literal(c, schemas.SHELVES))) == [
        '[{"count":"2","name":"it\'s"}]', "[]"]
    df = spark.createDataFrame([(1, ((5, ["x", "y"]), "z"))], "id int, r struct<a: struct<b: int, c: array<string>>, d: string>")
    flat = metadata.flatten_record(df, "r")
    assert flat.columns == ["id", "a.b", "a.c", "d"] and tuple(flat.first()) == (1, 5, "x, y", "z")


def test_joined_categories_keep_missing_ones(spark):
    df = spark.createDataFrame([("a", None), ("b", "c")], "x string, y string")
    got = df.select(tx.joined_categories([F.col("x"), F.col("y")], " | ")).collect()
    assert [r[0] for r in got] == ["a | nan", "b | c"]


def test_language_filters(spark):
    df = spark.createDataFrame([(c,) for c in ("eng", "en-US", "EN", "", None, "fre", "nl")], "language_code string")
    assert [r[0] for r in filters.filter_language(df).collect()] == ["eng", "en-US"]
    assert {tuple(r) for r in filters.split_languages(df).collect()} == {
        ("eng", "ENG"), ("en-US", "ENG"), ("fre", "FRA"), ("nl", "DUT")}
