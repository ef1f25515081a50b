"""Local (Indonesian) and ISO dates, validity ranges and lifecycle, as column expressions.

A range goes through an ordered list of shapes; the first one that yields a
date wins. Text inside brackets or after a colon is tried before the whole
text, so each input becomes a short list of candidate texts and the shapes are
written once, inside a ``transform`` over that list.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import AsOf, col, instant, let

# Month names and abbreviations.
MONTHS = {
    "januari": 1, "jan": 1, "january": 1,
    "februari": 2, "feb": 2, "febuari": 2, "february": 2, "pebruari": 2,
    "maret": 3, "mar": 3, "march": 3,
    "april": 4, "apr": 4,
    "mei": 5, "may": 5,
    "juni": 6, "jun": 6, "june": 6,
    "juli": 7, "jul": 7, "july": 7,
    "agustus": 8, "ags": 8, "agt": 8, "agu": 8, "aug": 8, "august": 8,
    "september": 9, "sep": 9, "sept": 9,
    "oktober": 10, "okt": 10, "oct": 10, "october": 10,
    "november": 11, "nov": 11, "nopember": 11, "nop": 11,
    "desember": 12, "des": 12, "dec": 12, "december": 12,
}
# The words in front of a validity period, as one pattern.
BANNER_WORDS = (r"periode\s*promosi|periode\s*promo|periode|promo\s*jsm|berlaku|valid|katalog\s*super\s*hemat|promo\s*koran|promo\s*mingguan|"
                r"edisi\s*ke-?\d+|minggu\s*ke-?\d+|minggu\s*\d+|week\s*\d+|promo\s*\d+\s*(?:minggu|pekan)|periode\s*\d+\s*(?:minggu|pekan)")
BANNER_KEYS = ["banner_date", "validity_period", "valid_period", "period", "periode", "flyer_period", "flyer_date",
               "header_date", "catalog_period", "dates", "date_banner", "promo_period"]

_MONTH = "(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + ")"
_DAY, _GAP, _YEAR = r"(\d{1,2})", r"[\s\-_]+", r"(?:[\s\-_]+'?(\d{2,4}))?"
_TEXT_DATE = rf"(?i)^{_DAY}{_GAP}{_MONTH}{_YEAR}$"
_DMY = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](?:'?(\d{2,4}))?$"
_YMD = r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$"
_UNTIL = r"(?i)^(?:s/?d\.?|sampai|hingga|maks\.?)\s+"
_UNTIL_OR_ON = r"(?i)^(?:s/?d\.?|sampai|hingga|maks\.?|tgl\.?|tanggal)\s+"
#: All dates begin with a digit, if need be after a word as above.
_BEGINS = r"(?i)^\s*(?:(?:s/?d\.?|sampai|hingga|maks\.?|tgl\.?|tanggal)\s+)?\d"
_BANNER = rf"(?i)^(?:{BANNER_WORDS})\s*[:\-–—]?\s*"
_CROSS = rf"(?i){_DAY}{_GAP}{_MONTH}{_YEAR}\s*-\s*{_DAY}{_GAP}{_MONTH}{_YEAR}"
_SAME = rf"(?i){_DAY}\s*-\s*{_DAY}{_GAP}{_MONTH}{_YEAR}"
_LENGTH = r"(?i)(\d+)\s*(minggu|pekan|hari)"
_FROM = rf"(?i)(?:mulai|sejak)(?:\s+tanggal)?\s+{_DAY}{_GAP}{_MONTH}{_YEAR}"


def _groups(text: Column, pattern: str, count: int) -> Column:
    """Array of the capture groups of the first match; null when the pattern does not occur."""
    return F.when(text.rlike(pattern), F.array(*[F.regexp_extract(text, pattern, i) for i in range(1, count + 1)]))


def _month(name: Column) -> Column:
    # one constant string instead of a node per month keeps the plan small
    table = F.str_to_map(F.lit(",".join(f"{month}:{number}" for month, number in MONTHS.items())), F.lit(","), F.lit(":"))
    return F.try_element_at(table, F.lower(name)).try_cast("int")


def _full_year(text: Column) -> Column:
    year = text.try_cast("int")
    return F.when(year < 100, year + 2000).otherwise(year)


def _date(year: Column, month: Column, day: Column) -> Column:
    """Calendar date, or null when the parts name no real day."""
    return F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.try_cast("int")).try_cast("date")


def _year_of(default_year: int | Column) -> Column:
    return default_year if isinstance(default_year, Column) else F.lit(int(default_year))


def _tidy(text: Column) -> Column:
    squeezed = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")
    return F.when(text.rlike(r"^\s|\s$|\s\s|[^\S ]"), squeezed).otherwise(text)  # one look; most texts are tidy


def _single(raw: Column, default_year: Column) -> Column:
    def parse(text: Column) -> Column:
        worded = let(_groups(text, _TEXT_DATE, 3),
                     lambda g: F.when(g.isNotNull(), _date(F.coalesce(_full_year(g[2]), default_year), _month(g[1]), g[0])))
        numeric = let(_groups(text, _DMY, 3),
                      lambda g: F.when(g.isNotNull(), _date(F.coalesce(_full_year(g[2]), default_year), g[1].try_cast("int"), g[0])))
        ymd = let(_groups(text, _YMD, 3),
                  lambda g: F.when(g.isNotNull(), _date(g[0].try_cast("int"), g[1].try_cast("int"), g[2])))
        iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10).try_cast("date"))
        return F.coalesce(iso, worded, numeric, ymd)

    return F.when(raw.rlike(_BEGINS), let(F.trim(F.regexp_replace(_tidy(raw), _UNTIL_OR_ON, "")), parse))


def parse_local_date(text: Column | str, default_year: int | Column) -> Column:
    """'12 Mei 2026', '12/05/2026', '2026-05-12', 's/d 12 Mei' -> date; null when unreadable."""
    return F.when(col(text).rlike(r"\d"), _single(col(text), _year_of(default_year)))


def _period(starts: Column, ends: Column) -> Column:
    return F.struct(starts.cast("date").alias("starts"), ends.cast("date").alias("ends"))


def _by_duration(text: Column, default_year: Column) -> Column:
    def build(length: Column) -> Column:
        def ends(start_parts: Column) -> Column:
            start = _date(F.coalesce(_full_year(start_parts[2]), default_year), _month(start_parts[1]), start_parts[0])
            n = length[0].try_cast("int")
            span = F.when(F.lower(length[1]) == "hari", n - 1).otherwise(n * 7 - 1)
            return F.when(start.isNotNull() & span.isNotNull(), _period(start, F.date_add(start, F.greatest(span, F.lit(0)))))
        return F.when(length.isNotNull(), let(_groups(text, _FROM, 3), lambda g: F.when(g.isNotNull(), ends(g))))
    return let(_groups(text, _LENGTH, 2), build)


def _by_two_months(text: Column, default_year: Column) -> Column:
    def build(g: Column) -> Column:
        m1, m2 = _month(g[1]), _month(g[4])
        y1, y2 = _full_year(g[2]), _full_year(g[5])
        wraps = F.when(m1 > m2, 1).otherwise(0)
        first = F.coalesce(y1, F.when(y2.isNotNull(), y2 - wraps), default_year)
        second = F.coalesce(y2, F.coalesce(y1, default_year) + wraps)
        starts, ends = _date(first, m1, g[0]), _date(second, m2, g[3])
        return F.when(g.isNotNull() & starts.isNotNull() & ends.isNotNull(), _period(starts, ends))
    return let(_groups(text, _CROSS, 6), build)


def _by_one_month(text: Column, default_year: Column) -> Column:
    def build(g: Column) -> Column:
        year, month = F.coalesce(_full_year(g[3]), default_year), _month(g[2])
        starts, ends = _date(year, month, g[0]), _date(year, month, g[1])
        return F.when(g.isNotNull() & starts.isNotNull() & ends.isNotNull(), _period(starts, ends))
    return let(_groups(text, _SAME, 4), build)


def _by_two_dates(text: Column, default_year: Column) -> Column:
    def build(parts: Column) -> Column:
        return let(F.transform(parts, lambda p: _single(p, default_year)),
                   lambda d: F.when((F.size(d) == 2) & d[1].isNotNull(), _period(d[0], d[1])))
    return F.when(text.contains(" - "), let(F.split(text, " - ", 2), build))


def _one_text(raw: Column, default_year: Column) -> Column:
    delimited = F.regexp_replace(raw, r"(?i)\s+(?:s/?d\.?|sd|s\.d\.|sampai|hingga|to)\s+", " - ")
    delimited = F.regexp_replace(delimited, r"\s*[–—]\s*", " - ")

    def shapes(text: Column) -> Column:
        single = let(_single(raw, default_year), lambda d: F.when(d.isNotNull(), _period(d, d)))
        return F.coalesce(_by_two_months(text, default_year), _by_one_month(text, default_year),
                          _by_two_dates(text, default_year), single)

    until = let(_single(raw, default_year), lambda d: F.when(d.isNotNull(), _period(F.lit(None), d)))
    return F.coalesce(
        _by_duration(raw, default_year),
        F.when(raw.rlike(_UNTIL), until).otherwise(let(delimited, shapes)),
    )


def _strip_banner(raw: Column) -> Column:
    whole = let(_tidy(raw), lambda t: F.when(t.startswith("(") & t.endswith(")"),
                                             F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t))
    return F.trim(F.regexp_replace(whole, _BANNER, ""))


def _inner(text: Column) -> Column:
    return F.when(text.rlike(r"[(:]\s*[^)]+"), F.trim(F.regexp_extract(text, r"[(:]\s*([^)]+)\s*\)?", 1)))


def parse_local_range(text: Column | str, default_year: int | Column) -> Column:
    """Struct(starts, ends) of a validity wording; null when no date can be read."""
    year = _year_of(default_year)

    def candidates(outer: Column) -> Column:
        def with_inner(inner: Column) -> Column:
            deepest = let(inner, lambda t: F.when(t.isNotNull(), _strip_banner(_inner(t))))
            return F.array_compact(F.array(deepest, inner, outer))
        return let(F.when(outer.isNotNull(), _strip_banner(_inner(outer))), with_inner)

    def read(raw: Column) -> Column:
        tried = F.transform(let(_strip_banner(raw), candidates), lambda t: _one_text(t, year))
        return F.try_element_at(F.array_compact(tried), F.lit(1))

    # every date has a digit, so other texts (and nulls) skip the grammar
    return F.when(col(text).rlike(r"\d"), let(col(text), read))


def banner_validity(values: list[Column], top_start: Column, top_end: Column, default_year: int | Column) -> Column:
    """First banner value that parses, else the top-level start/end pair."""
    holds_range = top_start.rlike(r" - | s/d | sd | sampai ")
    # one transform over all wordings, so the grammar enters the plan once
    parsed = parse_local_ranges([F.when(holds_range, top_start), *values], default_year)

    def choose(periods: Column) -> Column:
        named = F.try_element_at(F.array_compact(F.slice(periods, 2, max(1, len(values)))), F.lit(1)) if values else F.lit(None)
        ranged = periods[0]
        starts = F.when(holds_range, ranged["starts"]).otherwise(parse_local_date(top_start, default_year))
        ends = F.coalesce(ranged["ends"], parse_local_date(top_end, default_year))
        pair = F.when(starts.isNotNull() | ends.isNotNull(), _period(starts, ends))
        return F.coalesce(named, pair)

    return let(parsed, choose)


def parse_local_ranges(texts: list[Column], default_year: int | Column) -> Column:
    """Array with the period of each text (null where unreadable)."""
    return F.transform(F.array(*texts), lambda text: parse_local_range(text, default_year))


def day_start(day: Column | str) -> Column:
    return col(day).cast("timestamp_ntz")


def day_end(day: Column | str) -> Column:
    """Last microsecond of a date-only end."""
    return (F.date_add(col(day), 1).cast("timestamp_ntz") - F.expr("INTERVAL '0.000001' SECOND"))


def lifecycle(starts: Column | str, ends: Column | str, as_of: AsOf) -> Column:
    s, e, now = col(starts), col(ends), instant(as_of)
    return (F.when(s.isNull() & e.isNull(), "UNKNOWN").when(now < s, "UPCOMING")
            .when(now > e, "EXPIRED").otherwise("ACTIVE"))


def periods_compatible(start_a, end_a, start_b, end_b) -> Column:
    """Inclusive overlap of [start, end or start]; compatible when either start is unknown."""
    sa, ea = col(start_a).cast("date"), col(end_a).cast("date")
    sb, eb = col(start_b).cast("date"), col(end_b).cast("date")
    overlap = F.greatest(sa, sb) <= F.least(F.coalesce(ea, sa), F.coalesce(eb, sb))
    return sa.isNull() | sb.isNull() | overlap


def days_left(ends: Column | str, as_of: AsOf) -> Column:
    return F.greatest(F.lit(0), F.datediff(col(ends).cast("date"), instant(as_of).cast("date")))
