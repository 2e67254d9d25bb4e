"""Days in Japan, the phases of a year's end, and numbers and dates in notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

ZONE = "Asia/Tokyo"
#: Thresholds of the titles and their names, and the days' weights by phase.
TITLES = [(10, "人生最高の余暇"), (8, "けんじゃ"), (5, "ゆうしゃ"), (3, "ぼうけんしゃ"), (1, "みならい"), (0, "たびびと")]
WEIGHTS = {"prep": 1, "dec": 2, "final": 7}


def jst_day(ts: Column) -> Column:
    """The date in Japan of an instant held as UTC."""
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def phase(day: Column, year: Column) -> Column:
    md = F.date_format(day, "MM-dd")
    return F.when(F.year(day) > year, "over").when(md < "12-01", "prep").when(md < "12-28", "dec").otherwise("final")


def weight(phase_col: Column) -> Column:
    """How much a day of a phase counts; 1 for any other (a weight of zero counts as none given)."""
    out = F
    for name, n in WEIGHTS.items():
        out = out.when(phase_col == name, n)
    return out.otherwise(1)


def days_left(day: Column, year: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(F.make_date(year, F.lit(12), F.lit(31)), day) + 1)


def weighted_days(day: Column, year: Column, guard: int = 400) -> Column:
    """Sum of the weights from the day to the year's last, at most ``guard`` days."""
    last = F.make_date(year, F.lit(12), F.lit(31))
    days = F.slice(F.sequence(day, last), 1, guard)
    total = F.aggregate(F.transform(days, lambda d: weight(phase(d, year))), F.lit(0), lambda a, w: a + w)
    return F.when(day > last, F.lit(0)).otherwise(total)


def clock_suspect(saved: Column, now: Column, last_day: Column) -> Column:
    """Saved more than ten minutes ahead of now, or a day that lies before the last one seen."""
    millis = lambda t: F.unix_millis(t.cast("timestamp"))
    ahead = F.coalesce(millis(saved) - millis(now) > 600_000, F.lit(False))
    return ahead | F.coalesce(jst_day(now) < last_day, F.lit(False))


def title_for(n: Column) -> Column:
    out = F
    for least, name in TITLES:
        out = out.when(n >= least, name)
    return out.otherwise(TITLES[-1][1])


def number_in(c: Column) -> Column:
    """The first signed decimal after commas are taken out; null for none."""
    return F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def date_in(c: Column, today: Column) -> Column:
    """A date of year-month-day or month-day; a month-day before today is next year's; null if there is no such day."""
    s = F.regexp_replace(F.regexp_replace(tx.fold_digits(tx.strip(c)), "[年月]", "/"), "日", "")
    full, short = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})$", r"^([0-9]{1,2})[-/]([0-9]{1,2})$"
    make = lambda y, m, d: F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")))
    get = lambda p, i: F.regexp_extract(s, p, i).try_cast("int")
    month, day = get(short, 1), get(short, 2)
    as_text = F.format_string("%04d-%02d-%02d", F.year(today), month, day)
    year = F.year(today) + (as_text < F.date_format(today, "yyyy-MM-dd")).cast("int")
    return F.when(s.rlike(full), make(get(full, 1), get(full, 2), get(full, 3))).when(s.rlike(short), make(year, month, day))
