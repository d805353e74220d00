import pytest

from strataform.operators.timestamps import em_weights, normalise, readings
from strataform.plans.problems import p7_found

CASES = [
    ("2024-01-02T03:04:05+00:00", None, None, "canonical", 1704164645000000),
    (" 2024-01-02T03:04:05+00:00", None, None, "read", 1704164645000000),
    ("2024-01-02T03:04:05Z", "Asia/Tokyo", None, "read", 1704164645000000),
    ("2024-01-02 03:04:05,123456789 -0330", None, None, "read", 1704177245123456),
    ("2024-01-02T03:04:05.9", "Asia/Tokyo", None, "read", 1704132245900000),
    ("2024-11-03 01:27:46", "America/New_York", None, "read", 1730611666000000),  # twice: the earlier
    ("2025-03-09T02:27:14", "America/Chicago", None, "read", 1741508834000000),  # skipped: moved on
    ("2024-03-02T00:47:24[America/New_York]", "Asia/Tokyo", None, "read", 1709358444000000),
    ("2022-11-07T08:18:03+00:00[Europe/Lisbon]", None, None, "read", 1667809083000000),
    ("2024-11-03 01:27:46 EST", None, None, "read", 1730615266000000),
    ("Tue, 07 Mar 2023 11:16:52 +0530", None, None, "read", 1678168012000000),
    ("5 Jan 2023 12:06:50 +03:00", None, None, "read", 1672909610000000),
    ("03.03.2023 20:48:21", "Europe/Madrid", None, "read", 1677872901000000),
    ("12/4/2024 09:52:16", "Europe/Madrid", "en-GB", "read", 1712908336000000),
    ("12/4/2024 9:52 PM", "Europe/Madrid", "en-US", "read", 1733345520000000),
    ("20220622T140914Z", None, None, "read", 1655906954000000),
    ("1755050901", None, None, "read", 1755050901000000),
    ("1647577949731", None, None, "read", 1647577949731000),
    ("1745673929396929", None, None, "read", 1745673929396929),
    ("2024-01-02", "Asia/Tokyo", None, "unread", None),
    ("2024-01-02T03:04:05", None, None, "no_zone", None),
    ("2024-01-02T03:04:05", "Mars/Base", None, "no_zone", None),
    ("2024-02-30T03:04:05Z", None, None, "invalid", None),
    ("a month ago", "Asia/Tokyo", None, "unread", None),
    ("", None, None, "unread", None),
    (None, None, None, "null", None),
    ("9" * 100_000, None, None, "unread", None),
]


@pytest.mark.parametrize("case", CASES)
def test_readings(case):
    value, tz, locale, state, at = case
    got = readings(value, tz, locale)
    assert got[0] == state and (got[1][0][1] if got[1] else None) == at


def test_mixture_settles_or_stays_open(spark):
    clear = [("t", f"a{k}", "A", f"{k}/{20}/2024 10:00:00", "UTC", None) for k in range(1, 10)]
    open_ = [("t", "a", "A", "3/4/2024 10:00:00", "UTC", None), ("t", "b", "B", "3/4/2024 10:00:00", "UTC", None), ("t", "c", None, "5/5/2024 10:00:00", "UTC", None)]
    df = spark.createDataFrame(clear + open_ + open_, "table_name string, row_key string, source string, value string, time_zone string, locale string")
    got = {r.row_key: (r.state, r.instant_us) for r in normalise(df).collect()}
    assert got["a"] == ("read", 1709546400000000)  # month first, as the rest of source A
    assert got["b"] == ("ambiguous", None)
    assert got["c"][0] == "read"
    assert normalise(df.limit(0)).count() == 0
    w = em_weights({("mdy",): 9, ("dmy", "mdy"): 3})
    assert w["mdy"] > 0.9


def test_whole_tables(spark, data):
    got = p7_found(spark, data)
    assert got.count() == got.select("table_name", "row_key").distinct().count() > 100


def test_locale_is_a_prior_of_the_mixture(spark):
    """A locale decides against any mixture; a value that reads only against it is contradicted; none of it without priors."""
    cols = "table_name string, row_key string, source string, value string, time_zone string, locale string"
    crowd = [("t", f"a{k}", "A", f"{k % 9 + 1}/{20}/2024 10:00:00", "UTC", None) for k in range(200)]
    rows = crowd + [("t", "gb", "A", "3/4/2024 10:00:00", "UTC", "en-GB"), ("t", "us", "A", "3/4/2024 10:00:00", "UTC", "en-US"), ("t", "bare", "A", "3/4/2024 10:00:00", "UTC", None), ("t", "bad", "A", "3/20/2024 10:00:00", "UTC", "de")]
    got = {r.row_key: (r.state, r.instant_us) for r in normalise(spark.createDataFrame(rows, cols)).collect()}
    april, march = 1712138400000000, 1709546400000000
    assert got["gb"] == ("read", april) and got["us"] == got["bare"] == ("read", march) and got["bad"] == ("contradicted", None)
    assert em_weights({(("mdy", 1.0), ("dmy", 1e-30)): 5, (("dmy", 1.0),): 5})["mdy"] > 0.4
    assert [n for n, _, _ in readings("3/4/2024 10:00:00", "UTC", "en-GB")[1]] == ["dmy", "mdy"]
