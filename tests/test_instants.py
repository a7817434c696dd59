from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions.instants import with_readings
from tallyloom.operators.instants import fit_source, resolve_instants

FEEDS = "source_name string, zone_name string, date_order string"
IN = "record_uid string, source_name string, txn_ts string, received_at timestamp_ntz"


def us(*a, tz=UTC):
    d = datetime(*a, tzinfo=tz).astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)
    return d // timedelta(microseconds=1)


def read(spark, text, zone="Europe/Berlin", order="dmy"):
    df = spark.createDataFrame([(text,)], "t string")
    r = with_readings(df, F.col("t"), F.lit(zone).cast("string"), F.lit(order).cast("string"), "_t").first()
    return r["_t_us1"]


BERLIN = ZoneInfo("Europe/Berlin")
CASES = [
    ("2026-10-01T00:00:00Z", us(2026, 10, 1)),
    ("2026-10-01t00:35:02z", us(2026, 10, 1, 0, 35, 2)),
    ("  2026-10-01T03:41:39.370Z ", us(2026, 10, 1, 3, 41, 39, 370000)),
    ("2026-10-01 10:00:01,250", us(2026, 10, 1, 10, 0, 1, 250000, tz=BERLIN)),
    ("01/02/2026", us(2026, 2, 1, tz=BERLIN)),
    ("01.02.26 05:06", us(2026, 2, 1, 5, 6, tz=BERLIN)),
    ("Wed, 30 Sep 2026 21:17:03 -0400", us(2026, 10, 1, 1, 17, 3)),
    ("Oct 1, 2026 12:00:43 AM GMT+05:30", us(2026, 9, 30, 18, 30, 43)),
    ("01-Oct-2026 03:22:26 CEST", us(2026, 10, 1, 1, 22, 26)),
    ("20261001T004944Z", us(2026, 10, 1, 0, 49, 44)),
    ("20261001030659", us(2026, 10, 1, 3, 6, 59, tz=BERLIN)),
    ("1790818942", 1790818942000000),
    ("1790818942959", 1790818942959000),
    ("1790818942959123", 1790818942959123),
    ("2026-10-01 10:00 +05", us(2026, 10, 1, 5, 0)),
    ("2026-10-25 02:30:00", us(2026, 10, 25, 0, 30)),  # occurs twice: the first, summer time
    ("2026-03-29 02:30:00", us(2026, 3, 29, 1, 30)),  # never occurs: the offset before the change
    ("2026-10-01T27:00:00Z", None),
    ("31/02/2026 04:25:00", None),
    ("2026-13-40 20:57:00", None),
    ("0000-00-00 00:00:00", None),
    ("pending", None),
    ("n/a", None),
    ("", None),
    ("2026-10-01 10:00:00 QQQ", None),
    ("9" * 40, None),
    ("x" * 100_000, None),
]


def test_spellings(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(len(CASES), None)], "i int, t string")
    got = {r["i"]: r["_t_us1"] for r in with_readings(df, F.col("t"), F.lit("Europe/Berlin"), F.lit("dmy"), "_t").collect()}
    assert [got[i] for i in range(len(CASES))] == [w for _, w in CASES]
    assert got[len(CASES)] is None


def test_same_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert read(spark, "2026-10-25 02:30:00") == us(2026, 10, 25, 0, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@settings(max_examples=12, deadline=None)
@given(st.lists(st.datetimes(datetime(2001, 1, 1), datetime(2060, 1, 1)), min_size=20, max_size=20), st.sampled_from(["Asia/Kolkata", "America/New_York", "Australia/Sydney"]))
def test_local_times_round_trip(spark, times, zone):
    df = spark.createDataFrame([(i, t.strftime("%d.%m.%Y %H:%M:%S.%f")) for i, t in enumerate(times)], "i int, t string")
    got = {r["i"]: r["_t_us1"] for r in with_readings(df, F.col("t"), F.lit(zone), F.lit("dmy"), "_t").collect()}
    for i, t in enumerate(times):
        assert got[i] == us(*t.timetuple()[:6], t.microsecond, tz=ZoneInfo(zone))


def test_undeclared_order_is_inferred(spark):
    """A source without a declared order writes month first; delays of minutes tell, also for days up to 12."""
    rows = []
    for i in range(200):
        t = datetime(2026, 1, 1) + timedelta(days=i * 1.5, minutes=i)
        rows.append((f"r{i}", "s", t.strftime("%m/%d/%Y %H:%M:%S"), t + timedelta(minutes=3)))
    rows += [("both", "s", "03/04/2026 10:00:00", None), ("twelve", "s", "05/05/2026 10:00:00", None), ("null", "s", None, None), ("blank", "s", " ", None), ("bad", "s", "soon", None), ("none", None, "2026-01-01", None)]
    feeds = spark.createDataFrame([("s", "UTC", None)], FEEDS)
    df = spark.createDataFrame(rows, IN).withColumn("_extra", F.lit(1)).withColumn("instant_us", F.lit("clash"))
    got = {r["record_uid"]: r for r in resolve_instants(df, "txn_ts", "source_name", "received_at", feeds).collect()}
    assert len(got) == len(rows)
    assert all(got[f"r{i}"]["instant_us"] == us(*(datetime(2026, 1, 1) + timedelta(days=i * 1.5, minutes=i)).timetuple()[:6]) for i in range(200))
    assert got["r0"]["instant_format"] in ("dmy", "mdy") and got["r40"]["instant_format"] == "mdy"
    assert got["both"]["instant_us"] == us(2026, 3, 4, 10) and got["both"]["instant_format"] == "mdy"
    assert got["twelve"]["instant_state"] == "resolved"
    assert [got[k]["instant_state"] for k in ("null", "blank", "bad", "none")] == ["missing", "missing", "unreadable", "unreadable"]
    assert got["r1"]["_extra"] == 1


def test_unresolved_ambiguity_is_marked(spark):
    feeds = spark.createDataFrame([("s", "UTC", None)], FEEDS)
    df = spark.createDataFrame([("a", "s", "03/04/2026", None), ("a", "s", "03/04/2026", None)], IN)
    got = resolve_instants(df, "txn_ts", "source_name", "received_at", feeds).collect()
    assert [(r["instant_state"], r["instant_us"]) for r in got] == [("ambiguous", None)] * 2


def test_empty(spark):
    feeds = spark.createDataFrame([], FEEDS)
    assert resolve_instants(spark.createDataFrame([], IN), "txn_ts", "source_name", "received_at", feeds).count() == 0


def test_fit_prefers_the_commoner_format():
    out = fit_source(pd.DataFrame({"signature": ["dmy:5", "dmy:5/mdy:22", "mdy:20"], "n": [90, 10, 1]}))
    assert out.set_index("signature").loc["dmy:5/mdy:22", "choice"] == 1
    assert out.posterior.iloc[0] == pytest.approx(1, abs=0.01)


def test_declared_order_is_a_prior(spark):
    """The declared order settles what it can read; what only another order reads is no time, however well that fits."""
    feeds = spark.createDataFrame([("s", "UTC", "DMY"), ("y", "UTC", "ymd")], FEEDS)
    t = datetime(2026, 3, 4, 10)
    rows = [(f"m{i}", "s", (t + timedelta(days=i)).strftime("%d/%m/%Y"), t + timedelta(days=i)) for i in range(9)]
    feeds = feeds.unionByName(spark.createDataFrame([("m", "UTC", "mdy")], FEEDS))
    rows += [("same", "m", "10/10/2026", datetime(2026, 10, 10)), ("ysame", "y", "10/10/10", None)]
    rows += [("us", "s", "03/04/2026", datetime(2026, 3, 4)), ("no", "s", "03/25/2026", datetime(2026, 3, 25)), ("rare", "s", "20260304T000000Z", None), ("y1", "y", "26/03/04", t), ("y2", "y", "03/04/2026", t)]
    got = {r["record_uid"]: r for r in resolve_instants(spark.createDataFrame(rows, IN), "txn_ts", "source_name", "received_at", feeds).collect()}
    assert all(got[f"m{i}"]["instant_format"] == "dmy" for i in range(9))
    assert got["us"]["instant_us"] == us(2026, 4, 3)
    assert (got["no"]["instant_state"], got["no"]["instant_us"]) == ("unreadable", None)
    assert got["rare"]["instant_us"] == us(2026, 3, 4) and got["y1"]["instant_us"] == us(2026, 3, 4) and got["y2"]["instant_state"] == "unreadable"
    assert (got["same"]["instant_us"], got["same"]["instant_format"]) == (us(2026, 10, 10), "mdy") and got["ysame"]["instant_format"] == "ymd"
