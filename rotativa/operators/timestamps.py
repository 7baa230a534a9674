"""Mixed timestamp notations and time zones (problem 6).

A string is read into local date and time fields and, where it has one, an
offset.  Values without zone become instants by an as-of join: the local time
against the intervals in which a zone keeps one offset.  Two matching intervals
mean an ambiguous time, of which the first pass is taken; none means a time the
clocks skipped; one gives the offset.

Everything is built-in expressions.  The intervals are exploded by month, so
that the join is an equality of zone and month with at most a few intervals a
row to look at, and their number has a bound: zones of the tz database times
months of the years covered.  Earlier times are in a zone's first interval; a
later year takes the place of a covered one with the same calendar, as rules
without an end go by month and weekday.
"""

from __future__ import annotations

from datetime import UTC, datetime
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names, abbreviated zone names and their offsets in minutes.
MONTHS = (
    ("enero", "january", "ene", "jan"), ("febrero", "february", "feb", "feb"), ("marzo", "march", "mar", "mar"), ("abril", "april", "abr", "apr"),
    ("mayo", "may", "may", "may"), ("junio", "june", "jun", "jun"), ("julio", "july", "jul", "jul"), ("agosto", "august", "ago", "aug"),
    ("septiembre", "september", "sep", "sep", "setiembre", "sept"), ("octubre", "october", "oct", "oct"), ("noviembre", "november", "nov", "nov"), ("diciembre", "december", "dic", "dec"),
)
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "BST": 60,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "COT": -300, "PET": -300, "CLT": -240, "CLST": -180, "ART": -180, "BRT": -180, "UYT": -180, "VET": -240,
}

#: Years whose intervals are listed: before the first change of any zone, to 28 years of rules without an end.
YEARS = (1850, 2065)
_DAY = 86_400
#: Beginning of all first intervals, in seconds.
_EVER = -(1 << 40)


@lru_cache(maxsize=None)
def offset_intervals(zone: str, years: tuple[int, int] = YEARS) -> tuple[tuple[int, int, int], ...]:
    """(utc start, utc end, offset) in seconds: the intervals in which a zone keeps one offset."""
    z = ZoneInfo(zone)
    at = lambda t: int(datetime.fromtimestamp(t, UTC).astimezone(z).utcoffset().total_seconds())
    lo = int(datetime(years[0], 1, 1, tzinfo=UTC).timestamp()) - 2 * _DAY
    hi = int(datetime(years[1], 12, 31, tzinfo=UTC).timestamp()) + 3 * _DAY
    out, start, off, step = [], lo, at(lo), 5 * _DAY
    t = lo
    while t < hi:
        nxt = min(t + step, hi)
        o = at(nxt)
        if o != off:
            a, b = t, nxt
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if at(m) == off else (a, m)
            out.append((start, b, off))
            start, off = b, at(b)
            if off != o:  # two changes within one step
                t = b
                continue
        t = nxt
    out.append((start, hi, off))
    return ((_EVER, *out[0][1:]), *out[1:])


def zone_months(spark: SparkSession, zones: list[str]) -> DataFrame:
    """(zone, month, near): per zone and local month the intervals with local bounds that touch it."""
    known = available_timezones()
    rows = [(z, a if a == _EVER else a + off, b + off, off) for z in zones if z in known for a, b, off in offset_intervals(z)]
    spans = spark.createDataFrame(rows, "zone string, lo long, hi long, off int")
    # month numbers are cut from UTC dates whatever the session's zone is
    last = F.lit((YEARS[1] - YEARS[0] + 1) * 12 - 1)
    first = F.when(F.col("lo") == _EVER, 0).otherwise(F.greatest(_month(_date(F.col("lo"))), F.lit(0)))
    months = F.sequence(first, F.least(_month(_date(F.col("hi"))), last))
    spread = spans.where(first <= last).select("zone", F.explode(months).alias("month"), F.struct("lo", "hi", "off").alias("near"))
    return spread.groupBy("zone", "month").agg(F.array_sort(F.collect_list("near")).alias("near"))


def _month(date: Column) -> Column:
    return (F.year(date) - YEARS[0]) * 12 + F.month(date) - 1


def _first_day(year: Column) -> Column:
    """Days from the epoch to the first of January."""
    y = year - 1
    return y * 365 + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400) - 719_162


def _covered(seconds: Column) -> Column:
    """Local seconds at the same place of a covered year with the same calendar."""
    year = F.year(_date(seconds))
    start = _first_day(year)
    kind = F.pmod(start, F.lit(7)) * 2 + F.when((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 1).otherwise(0)
    day = lambda y: (datetime(y, 1, 1, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)).days
    like = {day(y) % 7 * 2 + (day(y + 1) - day(y) - 365): day(y) for y in range(YEARS[1] - 27, YEARS[1] + 1)}
    table = F.create_map(*(F.lit(x) for k, v in sorted(like.items()) for x in (k, v)))
    return F.when(year > YEARS[1], seconds + (F.element_at(table, kind.cast("int")) - start) * _DAY).otherwise(seconds).cast("long")


def _date(seconds: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / _DAY).cast("int"))


def parsed(value: Column, order: Column) -> Column:
    """Struct of a timestamp string's parts and of the notation they were found in.

    ``kind`` is null for dates without a time and for other strings.
    ``order`` (DMY or MDY) rules all-numeric day and month.
    """
    s = F.trim(F.regexp_replace(value, "[\\s  ]+", " "))
    # one notation for the parts; each pattern leaves nothing out
    clock = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
    half = r"(?: ?([AaPp])\.? ?[Mm]\.?)?"
    zone = r"(?: ?(Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{3,5}))?(?:\[[\w/+-]+\])?"
    iso = rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:T|t|,? ){clock}{half}{zone}$"
    compact = r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?(Z|[+-]\d{2}:?\d{2})?$"
    numeric = rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}|\d{{2}}),?(?: a las)? {clock}{half}(?: ?(?:h|hrs?|horas)\.?)?{zone}$"
    spanish = rf"^(?:\p{{L}}+,? )?(\d{{1,2}})(?:º|°)? (?:de )?(\p{{L}}+)\.? (?:de |del )?(\d{{4}}),?(?: -)?(?: a las?)? {clock}{half}(?: ?(?:h|hrs?|horas)\.?)?{zone}$"
    english = rf"^(?:\p{{L}}+,? )?(\p{{L}}+)\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}),?(?: at)? {clock}{half}{zone}$"
    epoch = r"^(\d{10}|\d{13}|\d{16}|\d{19})$"
    names = ("y", "h", "mi", "s", "f", "ap", "z", "a", "b")
    found = {
        "epoch": (epoch, ()), "iso": (iso, (1, 4, 5, 6, 7, 8, 9, 2, 3)), "compact": (compact, (1, 4, 5, 6, 7, None, 8, 2, 3)), "numeric": (numeric, (3, 4, 5, 6, 7, 8, 9, 1, 2)),
        "spanish": (spanish, (3, 4, 5, 6, 7, 8, 9, 2, 1)), "english": (english, (3, 4, 5, 6, 7, 8, 9, 1, 2)),
    }
    # the parts in one order, taken out by the one notation that fits
    pieces = None
    for kind, (pattern, groups) in found.items():
        text = F.concat(F.lit(f"{kind}\x01"), F.regexp_replace(s, pattern, "\x01".join("" if g is None else f"${g}" for g in groups)))
        pieces = F.when(s.rlike(pattern), text) if pieces is None else pieces.when(s.rlike(pattern), text)

    def parts(x: Column) -> Column:
        at = lambda i: F.nullif(F.get(x, F.lit(i)), F.lit(""))
        return F.struct(at(0).alias("kind"), *(at(i).alias(n) for i, n in enumerate(names, 1)), F.when(at(0) == "epoch", s).alias("e"), order.alias("order"))

    # bound by a lambda, so that nothing is evaluated again for each part
    return F.transform(F.array(F.split(F.coalesce(pieces, F.lit("")), "\x01")), parts)[0]


def _month_number(name: Column) -> Column:
    low = F.lower(name)
    table = F.create_map(*(F.lit(x) for i, names in enumerate(MONTHS, 1) for n in dict.fromkeys(names) for x in (n, i)))
    return F.try_element_at(table, low)


def resolved(p: Column) -> Column:
    """Struct (micros, local) from the parts, of an instant or of a local time; null where they make none."""
    i = lambda c: c.cast("int")
    mdy = F.upper(F.trim(p["order"])) == "MDY"
    month = (
        F.when(p["kind"].isin("spanish", "english"), _month_number(p["a"]))
        .when(p["kind"] == "numeric", F.when(mdy, i(p["a"])).otherwise(i(p["b"])))
        .otherwise(i(p["a"]))
    )
    day = F.when(p["kind"] == "numeric", F.when(mdy, i(p["b"])).otherwise(i(p["a"]))).otherwise(i(p["b"]))
    year = i(p["y"]) + F.when(F.length(p["y"]) == 2, 2000).otherwise(0)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    length = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    hour12 = p["ap"].isNotNull()
    h = i(p["h"])
    hour = F.when(hour12, h % 12 + F.when(F.lower(p["ap"]) == "p", 12).otherwise(0)).otherwise(h)
    hour_ok = F.when(hour12 & (h <= 12), h >= 0).when(hour12 & (F.lower(p["ap"]) == "p"), h <= 23).when(hour12, F.lit(False)).otherwise(h <= 23)
    hour = F.when(hour12 & (h > 12), h).otherwise(hour)
    minute, second = i(p["mi"]), F.coalesce(i(p["s"]), F.lit(0))
    micro = F.coalesce(F.rpad(F.substring(p["f"], 1, 6), 6, "0").cast("int"), F.lit(0))
    valid = month.between(1, 12) & (day >= 1) & (day <= length) & hour_ok & (minute <= 59) & (second <= 59) & (year >= 1000)
    # days since the epoch of a proleptic Gregorian date, in whole numbers
    y = F.when(month <= 2, year - 1).otherwise(year)
    m = (month + 9) % 12
    days = y * 365 + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400) + F.floor((m * 306 + 5) / 10) + day - 1 - 719_468
    local = ((days.cast("long") * 24 + hour) * 60 + minute) * 60 + second
    table = F.create_map(*(F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v)))
    z = F.upper(p["z"])
    sign = F.when(F.substring(z, 1, 1) == "-", -1).otherwise(1)
    numeric = z.rlike("^[+-]")
    hh, mm = F.substring(z, 2, 2).cast("int"), F.coalesce(F.nullif(F.regexp_extract(z, r"^[+-]\d{2}:?(\d{2})$", 1), F.lit("")).cast("int"), F.lit(0))
    offset = F.when(numeric, F.when((hh <= 18) & (mm <= 59), sign * (hh * 60 + mm))).otherwise(F.try_element_at(table, z))
    e = p["e"]
    ticks = e.cast("decimal(20,0)")
    micros = F.when(F.length(e) == 10, ticks * 1_000_000).when(F.length(e) == 13, ticks * 1000).when(F.length(e) == 16, ticks).otherwise(F.floor(ticks / 1000)).cast("long")
    zone_ok = p["z"].isNull() | offset.isNotNull()
    return (
        F.when(p["kind"] == "epoch", F.struct(micros.alias("micros"), F.lit(False).alias("local")))
        .when(
            p["kind"].isNotNull() & valid & zone_ok,
            F.struct(((local - F.coalesce(offset, F.lit(0)) * 60) * 1_000_000 + micro).alias("micros"), p["z"].isNull().alias("local")),
        )
    )


def as_text(micros: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss.SSSSSSZ of an instant, whatever the session's zone."""
    sec = ((micros - F.pmod(micros, F.lit(1_000_000))) / 1_000_000).cast("long")
    rest = F.pmod(sec, F.lit(_DAY))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(
        _date(sec).cast("string"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest % 3600 / 60)), F.lit(":"), two(rest % 60), F.lit("."),
        F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("Z"),
    )


def normalise(
    df: DataFrame, clocks: DataFrame, fields: tuple[str, ...] = ("fecha_publicacion", "fecha_captura"), key: str = "noticia_id", source: str = "medio_id",
    zone: str = "zona_horaria", order: str = "orden_fecha",
) -> DataFrame:
    """(key, campo, valor, instante_utc, estado) for every non-blank value.

    ``estado`` is ``unico``, ``ambiguo`` (the first pass is taken),
    ``inexistente`` (the clocks skipped it), ``sin_zona`` (a local time of a
    source without a known zone) or ``no_es_fecha``; ``instante_utc`` is null in the last three.
    Blank and null values give no rows; equal rows count once.  Without a
    source's clock, all-numeric dates are read day first.
    """
    spark = df.sparkSession
    # of unchecked strings only those that name a zone come to the driver
    zones = [r[0] for r in clocks.select(F.trim(F.col(zone)).alias("z")).where(F.col("z").isin(sorted(available_timezones()))).distinct().collect()]
    months = zone_months(spark, zones)
    clock = clocks.select(F.col(f"`{source}`").alias("__m"), F.trim(F.col(f"`{zone}`")).alias("zone"), F.col(f"`{order}`").alias("order")).dropDuplicates(["__m"])
    values = df.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{source}`").alias("m"), F.explode(F.array(*(F.struct(F.lit(f).alias("campo"), F.col(f"`{f}`").cast("string").alias("valor")) for f in fields))).alias("v"))
    values = values.select("k", "m", "v.campo", "v.valor").where("k IS NOT NULL AND trim(valor) != ''")
    values = values.join(clock, F.col("m") == F.col("__m"), "left").withColumn("p", parsed(F.col("valor"), F.coalesce("order", F.lit("DMY"))))
    values = values.withColumn("r", resolved(F.col("p")))
    seconds = ((F.col("r.micros") - F.pmod("r.micros", F.lit(1_000_000))) / 1_000_000).cast("long")
    values = values.withColumn("at", F.when(F.col("r.local"), _covered(seconds)))
    month = F.greatest(_month(_date(F.col("at"))), F.lit(0))
    # the zones are those of the tz database, their months a fixed span: a bounded side
    near = values.withColumn("month", month).join(F.broadcast(months), ["zone", "month"], "left")
    match = F.filter("near", lambda x: (F.col("at") >= x["lo"]) & (F.col("at") < x["hi"]))
    near = near.withColumn("hit", match)
    first = F.array_max(F.transform("hit", lambda x: x["off"]))
    micros = F.when(F.col("r").isNull(), None).when(~F.col("r.local"), F.col("r.micros")).when(F.size("hit") > 0, F.col("r.micros") - first.cast("long") * 1_000_000)
    state = (
        F.when(F.col("r").isNull(), "no_es_fecha").when(~F.col("r.local"), "unico").when(F.col("near").isNull(), "sin_zona").when(F.size("hit") == 0, "inexistente")
        .when(F.size("hit") > 1, "ambiguo").otherwise("unico")
    )
    return near.select(F.col("k").alias(key), "campo", "valor", as_text(micros).alias("instante_utc"), state.alias("estado")).distinct()
