from datetime import datetime

from pyspark.sql import functions as F

from tallyweave.functions import scalars as sc


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_text(spark):
    assert one(spark, sc.slug, " Great  White ") == "_great__white_"
    assert one(spark, sc.basename, "a/b/c.png") == "c.png"
    assert one(spark, sc.basename, "c.png") == "c.png"
    assert one(spark, sc.basename, "a/") == ""
    assert one(spark, sc.format_label, "great_white  fOXES") == "Great White  FOXES"
    row = spark.createDataFrame([("My Set", 7, "x.png")], "n string, i long, f string")
    assert row.select(sc.image_path("n", "i", "f")).first()[0] == "datasets/my_set-7/x.png"


def test_duration(spark):
    cases = {0.0: "00:00:00", 59.999: "00:00:59", 3661.5: "01:01:01", 360000.0: "100:00:00", 3599999.0: "999:59:59"}
    for seconds, text in cases.items():
        assert one(spark, sc.format_duration, seconds, "double") == text
    stamps = spark.createDataFrame(
        [(datetime(2024, 1, 1, 0, 0, 0, 999), datetime(2024, 1, 1, 0, 1, 0, 2500))], "a timestamp_ntz, b timestamp_ntz"
    )
    assert stamps.select(sc.session_duration("a", "b")).first()[0] == 60.002


def test_percent_rounds_the_binary_value(spark):
    # 1.005 and 8.345 lie below the tie in binary, 0.125 and 2.675000000000001 on or above it
    cases = {1.005: "1.00%", 8.345: "8.35%", 0.125: "0.13%", 2.675: "2.67%", 99.995: "100.00%", 100.0: "100.00%", 0.004: "0.00%"}
    for value, text in cases.items():
        from decimal import ROUND_HALF_UP, Decimal

        exact = Decimal(value).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert text == f"{exact}%"
        assert one(spark, sc.pct, value, "double") == text


def test_percent_matches_exact_rounding_everywhere(spark):
    from decimal import ROUND_HALF_UP, Decimal

    values = [(i * 0.005,) for i in range(20001)] + [(100.0 * i / 7919,) for i in range(7919)]
    got = spark.createDataFrame(values, "v double").select("v", sc.pct("v").alias("t")).collect()
    for r in got:
        assert r.t == f"{Decimal(r.v).quantize(Decimal('0.01'), ROUND_HALF_UP)}%"


def test_percent_falsy(spark):
    falsy = lambda c: sc.pct(c, falsy_pending=True)
    for value in (0.0, float("nan"), None):
        assert one(spark, falsy, value, "double") == "Calculating..."
    assert one(spark, sc.pct, 0.0, "double") == "0.00%"
    assert one(spark, sc.pct, float("nan"), "double") == "NaN%"
    assert one(spark, sc.pct, None, "double") == "Calculating..."


def test_arrays(spark):
    names = spark.createDataFrame([(["a", "b c"],)], "n array<string>")
    text = names.select(sc.join_class_names("n").alias("t"))
    assert text.first()[0] == "a, b c"
    assert text.select(sc.split_class_names("t")).first()[0] == ["a", "b c"]
    assert one(spark, lambda c: sc.one_hot(c, 4), 2, "int") == [0, 0, 1, 0]
    kinds = spark.createDataFrame([(True, True), (False, True), (False, False)], "b boolean, t boolean")
    assert [r[0] for r in kinds.select(sc.dataset_kind("b", "t")).collect()] == ["Base", "Testing", "Training"]
