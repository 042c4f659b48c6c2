"""Trading calendars from rules: holidays by weekday of a month, by Easter and by date with their observed days, early closes, and closes in UTC.

A calendar is a set of columns over years: rules give a year's holidays and early closes as arrays of dates, the weekdays that are left are sessions, and
the local close becomes UTC by the exchange's time zone, summer time included.  Holidays that no rule gives (those of the moon's calendars) are handed
in as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SATURDAY, SUNDAY = 6, 0  # weekdays from Sunday on

Rule = Callable[[Column], Column]


def weekday(day: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(day) - 1


def on(month: int, day: int) -> Rule:
    return lambda year: F.make_date(year, F.lit(month), F.lit(day))


def nth(month: int, of: int, n: int) -> Rule:
    """The n-th such weekday of a month; n of -1 is the last one."""

    def rule(year: Column) -> Column:
        if n > 0:
            first = on(month, 1)(year)
            return F.date_add(first, F.pmod(F.lit(of) - weekday(first), F.lit(7)) + 7 * (n - 1))
        last = F.last_day(on(month, 1)(year))
        return F.date_sub(last, F.pmod(weekday(last) - F.lit(of), F.lit(7)))

    return rule


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, by the golden number, the epact and the Sunday that follows the full moon."""
    part = lambda a, b: F.floor(a / b).cast("int")
    golden, century = year % 19, part(year, 100)
    epact = F.pmod(century - part(century, 4) - part(8 * century + 13, 25) + 19 * golden + 15, F.lit(30))
    moon = epact - part(epact, 28) * (1 - part(epact, 28) * part(F.lit(29), epact + 1) * part(21 - golden, 11))
    sunday = F.pmod(year + part(year, 4) + moon + 2 - century + part(century, 4), F.lit(7))
    return F.date_add(on(3, 28)(year), moon - sunday)


def good_friday(year: Column) -> Column:
    return F.date_sub(easter(year), 2)


def nearest(rule: Rule) -> Rule:
    """A Saturday's holiday is kept on Friday, a Sunday's on Monday."""

    def observed(year: Column) -> Column:
        day = rule(year)
        return F.date_add(day, F.when(weekday(day) == SATURDAY, -1).when(weekday(day) == SUNDAY, 1).otherwise(0))

    return observed


def monday_after(rule: Rule) -> Rule:
    """A Sunday's holiday is kept on Monday; a Saturday's is not made up for."""

    def observed(year: Column) -> Column:
        day = rule(year)
        return F.date_add(day, F.when(weekday(day) == SUNDAY, 1).otherwise(0))

    return observed


def since(first: int, rule: Rule) -> Rule:
    return lambda year: F.when(year >= first, rule(year))


def day_after(rule: Rule) -> Rule:
    return lambda year: F.date_add(rule(year), 1)


@dataclass(frozen=True)
class Exchange:
    """Rules of an exchange: local closing times as minutes of the day, its time zone, holidays, and days that close early if they are sessions."""

    name: str
    zone: str
    close: int
    holidays: Sequence[Rule]
    early_close: int | None = None
    early: Sequence[Rule] = ()


#: The calendars of the two exchanges: their holidays by law and rule, fixed values.
US = Exchange(
    "US",
    "America/New_York",
    16 * 60,
    (monday_after(on(1, 1)), since(1998, nth(1, 1, 3)), nth(2, 1, 3), good_friday, nth(5, 1, -1), since(2022, nearest(on(6, 19))), nearest(on(7, 4)), nth(9, 1, 1), nth(11, 4, 4), nearest(on(12, 25))),
    13 * 60,
    (on(7, 3), day_after(nth(11, 4, 4)), on(12, 24)),
)
SGX = Exchange("SGX", "Asia/Singapore", 17 * 60, (monday_after(on(1, 1)), good_friday, monday_after(on(5, 1)), monday_after(on(8, 9)), monday_after(on(12, 25))))


def year_sessions(years: DataFrame, exchange: Exchange, closed: DataFrame | None = None) -> DataFrame:
    """(exchange, session, early, close_utc) for a column `year` of distinct years; closed (exchange, day) has further holidays.

    A null year has no sessions.  pos is not given: number sessions over the span that is asked for."""
    year = F.col("year")
    days = F.sequence(on(1, 1)(year), on(12, 31)(year))
    shut = F.array_compact(F.array(*[rule(year) for rule in exchange.holidays]))
    short = F.array_compact(F.array(*[rule(year) for rule in exchange.early])) if exchange.early else F.array().cast("array<date>")
    # a holiday of the next year may be kept on the last days of this one
    rows = years.where("year is not null").select(F.explode(days).alias("session"), shut.alias("shut"), short.alias("short"))
    open_ = rows.where(weekday(F.col("session")).between(1, 5) & ~F.array_contains("shut", F.col("session")))
    if closed is not None:
        more = closed.where(F.col("exchange") == exchange.name).select(F.col("day").alias("__day")).distinct()
        open_ = open_.join(more, F.col("session") == F.col("__day"), "left_anti")
    early = F.array_contains("short", F.col("session"))
    minutes = F.when(early, exchange.early_close or exchange.close).otherwise(exchange.close)
    local = F.col("session").cast("timestamp_ntz") + F.make_dt_interval(mins=minutes)
    utc = F.to_utc_timestamp(local.cast("timestamp"), exchange.zone).cast("timestamp_ntz")
    return open_.select(F.lit(exchange.name).alias("exchange"), "session", early.alias("early"), utc.alias("close_utc"))


def sessions(years: DataFrame, closed: DataFrame | None = None, exchanges: Sequence[Exchange] = (US, SGX)) -> DataFrame:
    """The sessions of several exchanges."""
    parts = [year_sessions(years, e, closed) for e in exchanges]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
