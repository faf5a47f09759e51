"""Hand cases for column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from terrashelf.functions import jsonobj, packid, text, timegrid
from terrashelf.operators import jsonstats, packs
from tests.conftest import rows


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_flags(spark):
    raw = [None, "", "EMPTY", "null", "No", "0", "maybe", " no", "FALSE", "not"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(text.clean_flag(F.col("x"))).collect()]
    assert got == [None, None, None, None, False, False, True, True, False, False]
    assert one(spark, text.clean_flag(F.lit(""), default=True)) is True


def test_vat_key(spark):
    assert one(spark, text.vat_key(F.lit("CNPJ:12.345/0001-9"))) == "cnpj:1234500019"
    assert one(spark, text.vat_key(F.lit("a,b.c;d/e-f+g*h~i"))) == "abcdefghi"


@pytest.mark.parametrize("given, expected", [
    ("sao.paulo", "SaoPaulo"), ("sao.jose-do.rio", "SaoJose-DoRio"), ("SAO", "Sao"), ("são.joão d'oeste", "SãoJoão D'Oeste"),
    ("", ""), ("a..b", "AB"),
])
def test_camel_label(spark, given, expected):
    assert one(spark, text.camel_label(F.lit(given))) == expected


def test_split_uri(spark):
    uri = F.lit("/intake/checkFiles-step1/maria/0")
    assert one(spark, text.split_uri(uri, ["intake", "checkfiles-step1"])) == ["maria", "0"]
    assert one(spark, text.split_uri(uri, ["x"])) is None
    assert one(spark, text.split_uri(F.lit(""))) == [""]
    assert one(spark, text.split_uri(F.lit("/A"), ["a"])) == []
    assert one(spark, text.split_uri(F.lit("/a"), ["a", "b"])) is None


@pytest.mark.parametrize("at, minutes, expected", [
    ("10:02:30", 5, "10:00"), ("10:07:30", 5, "10:10"), ("10:58:00", 5, "11:00"), ("10:59:00", 7, "10:56"), ("23:59:59", 15, "00:00"),
])
def test_nearest_slot(spark, at, minutes, expected):
    ts = F.lit(f"2022-01-05 {at}").cast("timestamp_ntz")
    assert one(spark, timegrid.nearest_slot(ts, minutes)).strftime("%H:%M") == expected
    assert one(spark, timegrid.nearest_slot_text(ts, minutes, "HH:mm")) == expected


def test_slot_moves_to_next_day(spark):
    ts = F.lit("2022-01-31 23:58:00").cast("timestamp_ntz")
    assert one(spark, timegrid.nearest_slot(ts, 5)) == dt.datetime(2022, 2, 1)


def test_pack_ids(spark):
    real = lambda c: one(spark, c.cast("string"))
    assert real(packid.from_parts(F.lit(76), F.lit(None).cast("int"))) == "76.001"
    assert real(packid.from_parts(F.lit(76), F.lit(-3))) == "76.001"
    assert real(packid.from_text(F.lit("10_2"))) == "10.200"
    ten = packid.from_text(F.lit("10_2"))
    assert one(spark, F.struct(packid.pack_of(ten), packid.version_of(ten)).cast("struct<a:int,b:int>")) == (10, 200)
    assert one(spark, packid.is_valid(F.lit("76.001").cast("decimal(13,3)"))) is True
    assert one(spark, packid.is_valid(F.lit("76.000").cast("decimal(13,3)"))) is False
    spilled = packid.from_parts(F.lit(5), F.lit(1000))
    assert real(spilled) == "6.000" and one(spark, packid.is_valid(spilled)) is False
    assert one(spark, packid.is_valid(F.lit(None).cast("decimal(13,3)"))) is False


def test_pack_ids_keep_neighbouring_versions_apart(spark):
    """Single precision takes 20000.003 and 20000.004 for one value; decimals do not."""
    a, b = F.lit("20000.003").cast(packid.PACK_ID), F.lit("20000.004").cast(packid.PACK_ID)
    assert one(spark, a == b) is False


def test_pack_texts(spark):
    value = F.lit("7.012").cast(packid.PACK_ID)
    assert one(spark, packid.to_text(value)) == "007.012"
    assert one(spark, packid.to_text(value, "_")) == "007_012"
    assert one(spark, packid.pack_text(value)) == "007"
    assert one(spark, packid.to_text(F.lit("12345.100").cast(packid.PACK_ID))) == "12345.100"


def test_pack_round_trip(spark):
    df = spark.range(1, 3000).select(F.col("id").alias("p"), (F.col("id") % 999 + 1).cast("int").alias("v"))
    back = df.withColumn("r", packid.from_parts(F.col("p"), F.col("v")))
    bad = back.where((packid.pack_of(F.col("r")) != F.col("p")) | (packid.version_of(F.col("r")) != F.col("v")) | ~packid.is_valid(F.col("r")))
    assert bad.count() == 0
    assert back.where(packid.from_text(packid.to_text(F.col("r"), "_")) != F.col("r")).count() == 0


def test_next_pack_by_meaning(spark):
    """The plain call gives the current maximum, the other one the next version."""
    df = spark.createDataFrame([("a", "3.001"), ("a", "3.007"), ("b", "1.002")], "k string, pack_id string")
    got = rows(packs.highest(df, ["k"]).select("k", F.col("max_pack_id").cast("string"), F.col("next_pack_id").cast("string")))
    assert got == [("a", "3.007", "3.008"), ("b", "1.002", "1.003")]


@pytest.mark.parametrize("given, expected", [
    ('{"a":1,"b":null}', '{"a":1}'),
    ('{"a":null}', "{}"),
    ('{"a":{"b":null,"c":[null,{"d":null,"e":1}]}}', '{"a":{"c":[null,{"e":1}]}}'),
    ("[null,1]", "[null,1]"),
    ('{"a":{"b":null},"n":12345678901234567.25,"e":1E400,"i":123456789012345678901234567890}',
     '{"a":{},"n":12345678901234567.25,"e":1E400,"i":123456789012345678901234567890}'),
    ('{"a":": null"}', '{"a":": null"}'),
    ("nonsense", None),
    (None, None),
])
def test_strip_nulls(spark, given, expected):
    df = spark.createDataFrame([(given,)], "x string")
    assert df.select(jsonobj.strip_nulls(F.col("x"))).first()[0] == expected


def test_dropped_names(spark):
    given = ['{"a":null,"b":1}', '{"a":{"b":null,"c":[{"d":null}]},"e":null}', "[null]", "x", None]
    df = spark.createDataFrame([(g,) for g in given], "j string")
    assert rows(jsonstats.dropped_keys(df, "j")) == [("a", 1), ("a.b", 1), ("a.c.d", 1), ("e", 1)]


def test_strip_nulls_empty(spark):
    assert one(spark, jsonobj.strip_nulls(F.lit('{"a":null}'), keep_empty=False)) is None


def test_members(spark):
    assert one(spark, F.to_json(jsonobj.members(F.lit('{"a":1,"b":2,"a":3}')))) == '{"b":2,"a":3}'
    merged = jsonobj.merged(jsonobj.members(F.lit('{"a":1,"b":2}')), jsonobj.members(F.lit('{"b":3}')))
    assert one(spark, F.to_json(merged)) == '{"a":1,"b":3}'
    assert one(spark, jsonobj.without(F.lit('{"a":1,"b":2}'), ["b"])) == '{"a":1}'
    assert one(spark, jsonobj.picked(F.lit('{"a":1}'), "a", "z")) == '{"z":1}'
    assert one(spark, jsonobj.picked(F.lit('{"a":1}'), "q")) == '{"q":null}'
    assert one(spark, jsonobj.values_in_order(F.lit('{"a":1,"b":"x"}'), ["b", "c", "a"])) == ['"x"', None, "1"]
    assert one(spark, jsonobj.array_texts(F.lit("[]"))) == []
    assert one(spark, jsonobj.array_texts(F.lit(None).cast("string"))) is None


def test_key_profile(spark):
    df = spark.createDataFrame([('{"a":1,"bb":null}',), ('{"a":2}',), ("[1]",), (None,)], "j string")
    assert rows(jsonstats.key_profile(df, "j")) == [("a", 2, 0, 1), ("bb", 1, 1, 2)]
    assert rows(jsonstats.object_sizes(df, "j")) == [(1, 1, 1), (2, 2, 1), (None, None, 2)]
