"""Dates as strings: shapes, order evidence, two-digit years. Results are ISO strings.

A structure of year, month and day is checked by casting the formatted text, which gives null for days that no
calendar has; ANSI mode stays on.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.text import bounded, strip

#: One separator, the same twice: / . or -
SHAPE = r"^(\d{1,4})([/.\-])(\d{1,2})\2(\d{1,4})$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH_NAMES = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?"


def valid_ymd(y: Column, m: Column, d: Column) -> Column:
    """The ISO date, or null."""
    text = F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int"))
    return F.when((y >= 1) & (y <= 9999) & m.between(1, 12) & d.between(1, 31), F.date_format(text.try_cast("date"), "yyyy-MM-dd"))


def split_numeric(c: Column) -> Column:
    """A struct of kind (ymd: the year comes first, xxy: last), a, b, c as ints; null if the text is of neither shape."""
    t = strip(bounded(c))
    part = [F.regexp_extract(t, SHAPE, g) for g in (1, 3, 4)]
    first, last = F.length(part[0]), F.length(part[2])
    year_first = (first == 4) & (last <= 2)
    year_last = (first <= 2) & last.isin(2, 4)
    kind = F.when(year_first, "ymd").when(year_last, "xxy")
    numbers = [p.try_cast("int") for p in part]
    return F.when(t.rlike(SHAPE) & kind.isNotNull(), F.struct(kind.alias("kind"), numbers[0].alias("a"), numbers[1].alias("b"), numbers[2].alias("c"), F.length(part[2]).alias("year_digits")))


def _once(value: Column, use) -> Column:
    """use(value) with value computed once, however often use mentions it; ladders stay small enough to compile."""
    return F.transform(F.array(value), use)[0]


def _parts(c: Column) -> Column:
    return F.struct(split_numeric(c).alias("s"), written(c).alias("w"))


def written(c: Column) -> Column:
    """ISO of an ISO date, an ISO datetime at midnight, or a date with a month's name; else null."""
    t = F.lower(strip(bounded(c)))
    iso = r"^(\d{4})-(\d{2})-(\d{2})(?:[t ]00:00(?::00(?:\.0+)?)?(?:z|\+00:00)?)?$"
    day_first = rf"^(\d{{1,2}})[\s\-]+{_MONTH_NAMES}[\s\-,]+(\d{{4}})$"
    month_first = rf"^{_MONTH_NAMES}[\s\-]+(\d{{1,2}})(?:,\s*|\s+)(\d{{4}})$"
    n = lambda p, g: F.regexp_extract(t, p, g).try_cast("int")
    month = lambda p, g: F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(t, p, g)).cast("int")
    return (
        F.when(t.rlike(iso), valid_ymd(n(iso, 1), n(iso, 2), n(iso, 3)))
        .when(t.rlike(day_first), valid_ymd(n(day_first, 3), month(day_first, 2), n(day_first, 1)))
        .when(t.rlike(month_first), valid_ymd(n(month_first, 3), month(month_first, 1), n(month_first, 2)))
    )


def interpret(c: Column, order: str | None = None) -> Column:
    """A struct status (valid, ambiguous, invalid), iso, candidates. Without an order a numeric date counts only if it
    has one reading; two-digit years have none here."""

    def readings(p: Column) -> Column:
        s = p["s"]
        ymd = F.when(s["kind"] == "ymd", valid_ymd(s["a"], s["b"], s["c"]))
        four = (s["kind"] == "xxy") & (s["year_digits"] == 4)
        mdy = F.when(four, valid_ymd(s["c"], s["a"], s["b"]))
        dmy = F.when(four, valid_ymd(s["c"], s["b"], s["a"]))
        wanted = {"MDY": [mdy], "DMY": [dmy]}.get(order, [mdy, dmy])
        return F.array_sort(F.array_distinct(F.array_compact(F.array(p["w"], ymd, *wanted))))

    def result(options: Column) -> Column:
        status = F.when(F.size(options) == 1, "valid").when(F.size(options) > 1, "ambiguous").otherwise("invalid")
        return F.struct(status.alias("status"), F.when(F.size(options) == 1, options[0]).alias("iso"), options.alias("candidates"))

    return _once(_once(_parts(c), readings), result)


def order_evidence(c: Column) -> Column:
    """What a value says about the order of its column: decisive_mdy, decisive_dmy, ambiguous, order_invariant, ymd,
    written, invalid; null for blanks. With a two-digit year only month and day ranges count."""

    def evidence(p: Column) -> Column:
        s = p["s"]
        two = s["year_digits"] == 2
        month_day = lambda m, d: F.when(two, m.between(1, 12) & d.between(1, 31)).otherwise(valid_ymd(s["c"], m, d).isNotNull())
        both = F.struct(month_day(s["a"], s["b"]).alias("mdy"), month_day(s["b"], s["a"]).alias("dmy"), (s["a"] == s["b"]).alias("same"))
        numeric = _once(both, lambda e: F.when(e["mdy"] & e["dmy"], F.when(e["same"], "order_invariant").otherwise("ambiguous")).when(e["mdy"], "decisive_mdy").when(e["dmy"], "decisive_dmy").otherwise("invalid"))
        return (
            F.when(p["w"].isNotNull(), F.when(strip(c).rlike(r"^\d{4}-"), "ymd").otherwise("written"))
            .when(s["kind"] == "ymd", F.when(valid_ymd(s["a"], s["b"], s["c"]).isNotNull(), "ymd").otherwise("invalid"))
            .when(s["kind"] == "xxy", numeric).otherwise("invalid")
        )

    return F.when(c.isNotNull() & (strip(c) != ""), _once(_parts(c), evidence))


def permitted(iso: Column, rules: Mapping, reference_date: str) -> Column:
    """Whether a date keeps a field's temporal rules: not_future, allow_future, min_year, max_age_years, min_age_years.
    Ages count in years. Rules are values, or columns where they differ by row (null: none). The reference date is given, so that a later run finds the same."""
    year, now = F.substring(iso, 1, 4).cast("int"), int(reference_date[:4])
    ok = F.lit(True)
    past = rules.get("not_future") if rules.get("not_future") is not None else rules.get("allow_future") is False
    if isinstance(past, Column):
        ok &= ~F.coalesce(past, F.lit(False)) | (iso <= reference_date)
    elif past:
        ok &= iso <= reference_date
    for name, holds in (("min_year", lambda v: year >= v), ("max_age_years", lambda v: now - year <= v), ("min_age_years", lambda v: now - year >= v)):
        bound = rules.get(name)
        if isinstance(bound, Column):
            ok &= bound.isNull() | holds(bound)
        elif bound:
            ok &= holds(bound)
    return ok


def apply_order(c: Column, order: Column | str, rules: Mapping, reference_date: str, pivot: int | Column | None = None) -> Column:
    """A struct status (valid, ambiguous_century, ambiguous, invalid), iso, candidates for a value of a column whose
    order (MDY, DMY, YMD) is known. A two-digit year takes the century that the pivot (0 to 99: years up to it are
    20xx) or the field's rules leave."""
    if isinstance(pivot, int) and not 0 <= pivot <= 99:
        raise ValueError("a century pivot is a two-digit year")
    order = F.lit(order) if isinstance(order, str) else order

    def readings(p: Column) -> Column:
        s = p["s"]
        m, d = F.when(order == "MDY", s["a"]).otherwise(s["b"]), F.when(order == "MDY", s["b"]).otherwise(s["a"])
        either = (s["kind"] == "xxy") & order.isin("MDY", "DMY")
        known = F.coalesce(p["w"], F.when(s["kind"] == "ymd", valid_ymd(s["a"], s["b"], s["c"])), F.when(either & (s["year_digits"] == 4), valid_ymd(s["c"], m, d)))
        late, early = valid_ymd(s["c"] + 2000, m, d), valid_ymd(s["c"] + 1900, m, d)
        if pivot is not None:
            centuries = F.array_compact(F.array(F.when(s["c"] <= pivot, late).otherwise(early)))
        else:
            centuries = F.filter(F.array(early, late), lambda x: x.isNotNull() & permitted(x, rules, reference_date))
        return F.when(known.isNotNull(), F.array(known)).when(either & (s["year_digits"] == 2), centuries).otherwise(F.array().cast("array<string>"))

    def result(options: Column) -> Column:
        status = F.when(F.size(options) == 1, "valid").when(F.size(options) == 2, "ambiguous_century").otherwise("invalid")
        return F.struct(status.alias("status"), F.when(F.size(options) == 1, options[0]).alias("iso"), options.alias("candidates"))

    return _once(_once(_parts(c), readings), result)
