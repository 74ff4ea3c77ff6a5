import math

import pytest
from pyspark.sql import functions as F

from perexpo.functions import bins, cleaning, daytime, geometry, names


def test_clean_int(values):
    decimals = ["5.0", "1,008.0", "-3.", ".5", "1e3"]
    assert values(cleaning.clean_int, decimals) == [5, 1008, -3, None, None]
    data = ["5", "1,008", "1,234,567", None, "abc", "12.7"]
    assert values(cleaning.clean_int, data) == [5, 1008, 1234567, None, None, 12]
    lenient = values(lambda c: cleaning.clean_int(c, lenient=True), data)
    assert lenient == [5, 1008, 1234567, None, 0, 12]


def test_prefix_int(values):
    data = ["09", "9:", " 9", "+9", "-3x", "(null)", "", None]
    assert values(cleaning.prefix_int, data) == [9, 9, 9, 9, -3, 0, 0, None]
    strict = values(lambda c: cleaning.prefix_int(c, strict=True), data)
    assert strict == [9, 9, 9, 9, -3, None, None, None]


def test_attribute_text(values):
    data = ["250,000+", "2,500-", "-", "41,250", None, "1d"]
    assert values(cleaning.attribute_value, data) == [250000.0, None, None, 41250.0, None, None]
    assert values(cleaning.is_topcoded, data) == [True, False, False, False, False, False]


def test_strip_literal_is_not_a_pattern(values):
    assert values(lambda c: cleaning.strip_literal(c, "1.0"), ["1.0x1.0", "1a0x"]) == ["x", "1a0x"]


def test_stored_type(values):
    assert values(cleaning.stored_type, ["7", "7.5", "1,008", None, ""]) == [
        "integer", "real", "text", "null", "text",
    ]


def test_label_needs_all_parts(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "x string, y string")
    assert [r[0] for r in df.select(cleaning.label("x", "y")).collect()] == ["a - b", None]


def test_base_name(values):
    data = ["A St (1)", "A (x) (y)", "No parenthesis", "  lead (1)", None]
    assert values(names.base_name, data) == ["A ST", "A", "", "LEAD", None]


def test_expand_street(values):
    data = ["42 ST", "42 ST-X", "1 ST-2 ST", "ST", "WEST", "A STX-B"]
    assert values(names.expand_street, data) == [
        "42 STREET", "42 STREET-X", "1 ST-2 STREET", "ST", "WEST", "A STX-B",
    ]


def test_expand_avenue(values):
    data = ["X AV/53 ST", "X AV-Y", "X AV", "AV", "1 AV-2 AV"]
    assert values(names.expand_avenue, data) == [
        "X AVENUE/53 ST", "X AVENUE-Y", "X AVENUE", "AV", "1 AV-2 AVENUE",
    ]


def test_expand_abbrev(values):
    data = ["ST. X AVE.", "42 ST.-Y", "STS./Z", "Q PKWY.", "Q BLVD.", "A ST. B ST.", None]
    assert values(names.expand_abbrev, data) == [
        "ST. X AVENUE", "42 STREET-Y", "STS./Z", "Q PKWY", "Q BLVD", "A STREET B STREET", None,
    ]


def test_site_key(spark):
    df = spark.createDataFrame([("5 Av/53 St (E,F)",), ("42 St-Bryant Pk (B)",)], "n string")
    keyed = names.with_site_key(df, "n", "k").collect()
    assert [r.k for r in keyed] == ["5 AVENUE/53 STREET", "42 STREET-BRYANT PK"]


def test_is_admin_ignores_case(values):
    data = ["DISTRICT 4 OFFICE", "district 4 office", "DISTRICT OFFICE", None]
    assert values(names.is_admin, data) == [True, True, False, None]


def test_hour24(values):
    data = ["09:05:00", "9:05:00", "(null)", None, "23:59:59"]
    assert values(daytime.hour24, data) == [9, 9, 0, None, 23]
    assert values(lambda c: daytime.hour24(c, strict=True), data) == [9, 9, None, None, 23]


def test_hour12(values):
    clock = ["12:00:00 AM", "01:00:00 AM", "11:00:00 AM", "12:00:00 PM", "11:00:00 PM", "00:00:00 AM", "13:00:00 PM"]
    data = [f"01/31/2025 {c}" for c in clock] + ["garbage", None]
    assert values(daytime.hour12, data) == [0, 1, 11, 12, 23, None, None, None, None]


def test_period(values):
    hours = [5, 6, 11, 12, 16, 17, 21, 22, 23, 0, None, -1]
    late, day = "Late Night", ["Morning", "Afternoon", "Evening"]
    assert values(daytime.period, hours, "int") == [
        late, day[0], day[0], day[1], day[1], day[2], day[2], late, late, late, None, None,
    ]


def test_bins_closed_sides(values):
    right = values(lambda c: bins.bin_by(c, bins.DISTANCE_BINS_SHORT), [0.05, 0.0500001, 0.5, 0.51, None], "double")
    assert right == ["0-0.05", "0.05-0.10", "0.25-0.50", "Over 0.50", None]
    left = values(lambda c: bins.bin_by(c, bins.INCOME_BINS, bins.MISSING), [49999.0, 50000.0, 150000.0, None], "double")
    assert left == ["Under $50k", "$50k-$75k", "$150k+", "Missing"]
    order = values(lambda c: bins.bin_ordinal(c, bins.EXPOSURE_BINS), [99_999, 100_000, 5_000_000, None], "bigint")
    assert order == [0, 1, 4, None]


def test_bins_checked():
    with pytest.raises(ValueError):
        bins.Bins((1,), ("a",), "left")
    with pytest.raises(ValueError):
        bins.Bins((1,), ("a", "b"), "up")


def test_flag_unknown_is_no(values):
    assert values(lambda c: bins.flag(F.col(c) >= 1, "y", "n"), [1, 0, None], "int") == ["y", "n", "n"]


def test_scaled(values):
    data = [40.123456, 40.1234549, -73.987654, -73.9876549, None]
    assert values(geometry.scaled, data, "double") == [4012346, 4012345, -7398765, -7398765, None]


def test_haversine(spark):
    row = spark.range(1).select(
        geometry.haversine_miles(F.lit(40.0), F.lit(-74.0), F.lit(41.0), F.lit(-74.0)).alias("north"),
        geometry.haversine_miles(F.lit(40.0), F.lit(-74.0), F.lit(40.0), F.lit(-74.0)).alias("same"),
    ).first()
    assert row.north == pytest.approx(3959 * math.pi / 180)
    assert row.same == 0.0
