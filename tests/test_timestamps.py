import datetime as dt

import pytest

from jobloom.operators.timestamps import normalise_instants, parse_instant

E = lambda *a: int(dt.datetime(*a, tzinfo=dt.UTC).timestamp())
CASES = [
    ("2025-04-30", "Africa/Lagos", True, E(2025, 4, 29, 23)), ("03/04/2025", "Europe/London", True, E(2025, 4, 2, 23)), ("03/04/2025", "America/New_York", False, E(2025, 3, 4, 5)),
    ("Wed, 14 Feb 2024 07:51:41 GMT", "UTC", False, E(2024, 2, 14, 7, 51, 41)), ("2023-11-05T01:30:00", "America/New_York", False, E(2023, 11, 5, 5, 30)), ("2025-03-30 02:30", "Europe/Berlin", True, E(2025, 3, 30, 1, 30)),
    ("1er mars 2024", "Europe/Paris", True, E(2024, 2, 29, 23)), ("Publié le 2 août 2025 à 19h24", "Europe/Paris", True, E(2025, 8, 2, 17, 24)), ("20250603T163350Z", "Asia/Tokyo", False, E(2025, 6, 3, 16, 33, 50)),
    ("November 3, 2024 1:51 AM CST", "America/Chicago", False, E(2024, 11, 3, 7, 51)), ("2023-12-31 02:37 America/New_York", "America/New_York", False, E(2023, 12, 31, 7, 37)), ("1763347310789712", "UTC", False, 1763347310),
    ("1730352989.802", "UTC", False, 1730352989), ("20251007", "UTC", False, E(2025, 10, 7)), ("2024-01-08T20:05:23+01:00[Europe/Madrid]", "Europe/Madrid", True, E(2024, 1, 8, 19, 5, 23)),
]


@pytest.mark.parametrize("text,zone,day_first,want", CASES)
def test_instants(text, zone, day_first, want):
    assert parse_instant(text, zone, day_first) == ("at", want)


@pytest.mark.parametrize("text,seconds", [("3 days ago", 259200), ("Posted 1 hour ago", 3600), ("3w ago", 1814400), ("vor 17 Tagen", 1468800), ("il y a 1 heure", 3600), ("hace 3 horas", 10800), ("a day ago", 86400)])
def test_ages(text, seconds):
    assert parse_instant(text, "UTC", False) == ("age", seconds)


@pytest.mark.parametrize("text", [None, "", "ASAP", "30+ days ago", "31/02/2025", "just posted", "-", "2025-13-01", "12345", "x" * 500])
def test_no_instant(text):
    assert parse_instant(text, "Europe/London", True) is None


def test_join_and_store(spark, tmp_path):
    when = dt.datetime(2025, 1, 10, 12)
    rows = [("a", "2025-01-02", "s", when, 1), ("b", "2 days ago", "s", when, 1), ("c", None, "s", when, 1), ("d", "2025-01-02", None, when, 1), ("e", "2 days ago", "s", None, 1), ("f", "2025-01-02", "s", when, 1), ("g", "2025-01-02T00:00:00Z", "unknown", when, 1)]
    jobs = spark.createDataFrame(rows, "id string, posted_date string, source_site string, crawled_at timestamp, tz_name int")
    sites = spark.createDataFrame([("s", "Europe/Berlin", True)], "source_site string, tz_name string, day_first boolean")
    want = {"a": E(2025, 1, 1, 23), "b": E(2025, 1, 8, 12), "f": E(2025, 1, 1, 23), "g": E(2025, 1, 2)}
    store = f"file://{tmp_path}/dictionary"
    for _ in range(2):  # the second run finds everything in the store
        assert {r.id: r.epoch_s for r in normalise_instants(jobs, sites, store=store).collect()} == want
    assert {r.id: r.epoch_s for r in normalise_instants(jobs, sites).collect()} == want
    assert normalise_instants(jobs.limit(0), sites).count() == 0
