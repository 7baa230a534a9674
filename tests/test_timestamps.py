import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from rotativa.operators.timestamps import normalise, offset_intervals

ZONE = "America/Tijuana"


@pytest.fixture(scope="module")
def clocks(spark):
    return spark.createDataFrame([("T", ZONE, "DMY"), ("M", "Europe/Madrid", "MDY"), ("X", "No/Zone", "DMY"), ("N", None, None)], "medio_id string, zona_horaria string, orden_fecha string")


def run(spark, clocks, pairs):
    df = spark.createDataFrame([(str(i), m, v, None, "x") for i, (m, v) in enumerate(pairs)], "noticia_id string, medio_id string, fecha_publicacion string, fecha_captura string, zone string")
    got = {int(r["noticia_id"]): (r["instante_utc"], r["estado"]) for r in normalise(df, clocks).collect()}
    return [got.get(i) for i in range(len(pairs))]


def test_notations(spark, clocks):
    same = "2026-03-13T16:41:00.000000Z"
    values = [
        "2026-03-13T16:41:00Z", "2026-03-13T10:41:00-06:00", "2026-03-13 09:41:00", "1773420060", "1773420060000", "1773420060000000", "13 de marzo de 2026, 09:41 h", "13/03/2026 09:41", "20260313T164100Z",
        "Fri, 13 Mar 2026 16:41:00 GMT", "20260313094100", "Viernes 13 de marzo de 2026 a las 9:41 a.m.", "13/03/26 9:41 a. m.", "March 13, 2026 9:41 AM", "2026-03-13 10:41:00 CST", " 2026-03-13T09:41:00-07:00[America/Tijuana] ",
    ]
    assert run(spark, clocks, [("T", v) for v in values]) == [(same, "unico")] * len(values)


def test_not_times(spark, clocks):
    values = ["2026-03-13", "19/01/2026", "ayer", "31/02/2026 10:00", "2026-13-05T10:00:00Z", "0000-00-00 00:00:00", "2026-01-01 25:00", "N/D", "x" * 100_000]
    assert run(spark, clocks, [("T", v) for v in values]) == [(None, "no_es_fecha")] * len(values)
    assert run(spark, clocks, [("T", None), ("T", "  "), (None, "2026-01-01 10:00"), ("X", "2026-01-01 10:00"), ("N", "01/02/2026 10:00 PM")]) == [None, None, (None, "sin_zona"), (None, "sin_zona"), (None, "sin_zona")]


def test_ambiguous_skipped_and_order(spark, clocks):
    got = run(spark, clocks, [("T", "2025-11-02 01:30:00"), ("T", "2026-03-08 02:30:00"), ("T", "05/04/2026 10:00"), ("M", "05/04/2026 10:00"), ("M", "25/04/2026 10:00")])
    assert got[0] == ("2025-11-02T08:30:00.000000Z", "ambiguo")
    assert got[1] == (None, "inexistente")
    assert got[2][0] == "2026-04-05T17:00:00.000000Z"
    assert got[3][0] == "2026-05-04T08:00:00.000000Z"
    assert got[4] == (None, "no_es_fecha")


def test_against_zoneinfo(spark, clocks):
    rnd = random.Random(3)
    pairs, want = [], []
    for _ in range(400):
        t = datetime(1975, 1, 1, tzinfo=UTC) + timedelta(seconds=rnd.randrange(2_500_000_000), microseconds=rnd.randrange(10**6))
        m, z = rnd.choice((("T", ZONE), ("M", "Europe/Madrid")))
        local = t.astimezone(ZoneInfo(z))
        if local.fold:
            continue
        pairs.append((m, local.strftime("%Y-%m-%dT%H:%M:%S.%f")))
        want.append(t.strftime("%Y-%m-%dT%H:%M:%S.%fZ"))
    assert [g[0] for g in run(spark, clocks, pairs)] == want


def test_session_zone_and_empty(spark, clocks):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert run(spark, clocks, [("T", "2026-03-13 09:41:00")]) == [("2026-03-13T16:41:00.000000Z", "unico")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.createDataFrame([], "noticia_id string, medio_id string, fecha_publicacion string, fecha_captura string")
    assert normalise(df, clocks).count() == 0


def test_intervals_cover():
    x = offset_intervals(ZONE)
    assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(x, x[1:]))


def test_far_years(spark, clocks):
    got = run(spark, clocks, [("T", f"{y}-{m}-15 12:30:00") for y in (1000, 1849, 1965, 2105, 2400, 9999) for m in ("01", "07")])
    for (y, m), (text, state) in zip([(y, m) for y in (1000, 1849, 1965, 2105, 2400, 9999) for m in (1, 7)], got):
        # zoneinfo knows rules without an end for every year
        off = ZoneInfo(ZONE).utcoffset(datetime(y, m, 15, 12, 30))
        want = datetime(y, m, 15, 12, 30) - off
        assert state == "unico" and text == want.strftime(f"{want.year:04d}-%m-%dT%H:%M:%S.000000Z"), (y, m, text)
    # the changes themselves: first Sunday of November and second of March, in 2105
    assert run(spark, clocks, [("T", "2105-11-01 01:30:00"), ("T", "2105-03-08 02:30:00")]) == [("2105-11-01T08:30:00.000000Z", "ambiguo"), (None, "inexistente")]
