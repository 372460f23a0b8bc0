"""Column functions on single values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinloom.functions import dates, military, names, places


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("raw", "qualifier", "year", "iso", "end"),
    [
        ("ABT 1798", "about", 1798, None, None), ("BET 1900 AND 1905", "range", 1900, None, 1905),
        ("FROM 1861", "range", 1861, None, None), ("TO 1865", "range", None, None, 1865), ("1745/46", "exact", 1746, None, None),
        ("1699/00", "exact", 1700, None, None), ("44 B.C.", "exact", -44, None, None), ("5 FEB 950", "exact", 950, "0950-02-05", None),
        ("100 B.C.", "exact", -100, None, None), ("31 FEB 1900", "exact", 1900, "1900-02-31", None), ("12", "unknown", None, None, None),
        ("@#DJULIAN@ 1 JAN 1700", "exact", 1700, None, None), ("BET 1900", "exact", 1900, None, None), ("abt. 3 mar 1801", "about", 1801, None, None),
        ("", "unknown", None, None, None), ("40 1812", "exact", 1812, None, None), ("long ago", "unknown", None, None, None),
    ],
)
def test_dates(spark, raw, qualifier, year, iso, end):
    d = one(spark, raw, dates.parse_date)
    assert (d.raw, d.qualifier, d.year, d.iso, d.range_end.year if d.range_end else None) == (raw, qualifier, year, iso, end)


def test_names_and_places(spark):
    n = one(spark, "  Mary  Ann / O'Hara /  Jr ", lambda c: names.parse_name(c, F.lit(True)))
    assert (n.given, n.surname, n.full) == ("Mary Ann", "O'Hara", "Mary Ann O'Hara Jr")
    assert one(spark, "Jo /Smith", lambda c: names.parse_name(c, F.lit(True))).full == "Jo Smith"
    p = one(spark, " Boston ,, Suffolk County ", places.parse_place)
    assert (p.parts, p.normalized) == (["Boston", "Suffolk County"], "boston, suffolk county")
    assert one(spark, "Louisville,,Kentucky", places.society_place) == "Louisville//KY"
    assert one(spark, "Boone County, WV", places.society_place) == "/Boone/WV"
    ladder = one(spark, "Fleming Co., KY, Kentucky, USA", lambda c: places.query_ladder(places.split_place(c), c))
    assert ladder == [
        "Fleming County, Kentucky, United States", "Kentucky, United States", "United States", "Fleming Co., KY, Kentucky, USA"
    ]
    s = one(spark, "Pvt., Co. B, 7th Virginia Infantry, CSA", lambda c: military.standard_service(c, F.lit(1863)))
    assert tuple(s) == ("Civil War", "Confederate", "Private", "7th Virginia Infantry")
