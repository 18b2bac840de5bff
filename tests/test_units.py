import pytest

from jobloom.operators.units import parse_pay, segment, unify_pay

UNITS = [("USD", "currency", 1.0), ("EUR", "currency", 1.08), ("INR", "currency", 0.012), ("GBP", "currency", 1.27), ("ZAR", "currency", 0.054), ("hour", "period", 2080.0), ("month", "period", 12.0), ("year", "period", 1.0)]
CASES = {
    "$129k-$161k/yr": (129000, 161000, "USD", "year"), "74 to 90 lakhs per annum": (7.4e6, 9e6, "INR", "year"), "34-40 LPA": (3.4e6, 4e6, "INR", "year"), "€63.000—€71.000 brutos al año": (63000, 71000, "EUR", "year"),
    "18,50 EUR por hora, 25 days holiday": (18.5, 18.5, "EUR", "hour"), "740 - 1.1k euros a la semana plus equity": (740, 1100, "EUR", "week"), "36-42K": (36000, 42000, "USD", "year"),
    "760kINR-1.1M INR p.m. + 10% bonus": (760000, 1.1e6, "INR", "month"), "R 880 000+ per year OTE": (880000, 880000, "ZAR", "year"), "between £56,000 and £81,000 a year": (56000, 81000, "GBP", "year"),
    "USD 45+ hourly": (45, 45, "USD", "hour"), "N2.45m to N3.1m p.m.": (2.45e6, 3.1e6, "NGN", "month"), "$4.2k+ a month": (4200, 4200, "USD", "month"), "100000": (1e5, 1e5, "USD", "year"),
}


@pytest.mark.parametrize("text", CASES)
def test_pay(text):
    low, high, currency, period = parse_pay(text)
    assert (round(low, 6), round(high, 6), currency, period) == CASES[text]


@pytest.mark.parametrize("text", [None, "", "  ", "0", "Grade 7", "25 days leave + pension", "TVöD E13", "401(k) match up to 4%", "Top 10 employer", "Level 3, 37.5 hours per week", "Competitive", "$$$", "Bonus 10%"])
def test_no_pay(text):
    assert parse_pay(text) is None


def test_dimension_decides_between_readings():
    kinds = lambda t: [(k, v) for k, _, v in segment(t, True, False)[1] if k in ("prefix", "root", "bare")]
    assert kinds("m naira") == [("prefix", "m"), ("root", "NGN")]
    assert kinds(" p.m.") == [("root", "month")]
    assert kinds("kusd/h") == [("prefix", "k"), ("root", "USD"), ("root", "hour")]


def test_table(spark):
    units = spark.createDataFrame(UNITS, "unit_name string, unit_kind string, factor double")
    rows = [("a", "$50 per hour", 1), ("b", None, 2), ("c", " ", 3), ("d", "EUR 1k a month", 4), ("d2", "EUR 1k a month", 4), ("e", "x" * 100_000 + " 5", 5), ("f", "£5 a week", 6)]
    df = spark.createDataFrame(rows, "id string, salary_range string, usd_year_min long")  # a column that clashes
    got = {r.id: (r.usd_year_min, r.usd_year_max) for r in unify_pay(df, units).collect()}
    assert got == {"a": (104000, 104000), "d": (12960, 12960), "d2": (12960, 12960)}  # no factor for weeks: no row
    assert unify_pay(df.limit(0), units).count() == 0
