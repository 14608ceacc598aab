"""Scalar expressions as Columns: dates, numbers, classes, windows. All stay in the JVM."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, localcontext

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.schemas import ANNULLED_STATUS, AWARDED_STATUS, IN_PROGRESS_STATUS, NO_AWARD_STATUS, REGIME_DATE

ISO, DMY = r"^\d{4}-\d{2}-\d{2}", r"^\d{2}[-/]\d{2}[-/]\d{4}"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_date(c: str | Column) -> Column:
    """ISO text of a date given as ISO or day-first text, else null. Impossible days pass, as text does."""
    c = F.trim(_col(c))
    return F.coalesce(F.when(c.rlike(ISO), F.substring(c, 1, 10)), F.when(c.rlike(DMY), F.concat_ws("-", F.substring(c, 7, 4), F.substring(c, 4, 2), F.substring(c, 1, 2))))


def compact_date(c: str | Column) -> Column:
    """ISO text of a date as above or as DDMMYYYY with a day up to 31 and a month up to 12."""
    raw = F.trim(_col(c))
    day, month = F.substring(raw, 1, 2), F.substring(raw, 3, 2)
    fits = raw.rlike(r"^\d{8}$") & day.between("01", "31") & month.between("01", "12")
    return F.coalesce(iso_date(c), F.when(fits, F.concat_ws("-", F.substring(raw, 5, 4), month, day)))


def as_day(c: str | Column) -> Column:
    """The day of ISO text; null for days that don't exist."""
    return F.try_to_date(_col(c), "yyyy-MM-dd")


def days_between(start: str | Column, end: str | Column) -> Column:
    """Whole days from one ISO text to another."""
    return F.datediff(as_day(end), as_day(start))


def number(c: str | Column) -> Column:
    """A double from text with a point or one comma, else null."""
    text = F.regexp_replace(F.trim(_col(c)), "^([^,]*),", "$1.")
    return F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def canonical_number(c: str | Column) -> Column:
    """A number's text without sign of zero, leading or trailing zeros; null for other text. No floats."""
    text = F.regexp_replace(F.regexp_replace(_col(c), r"^\s+|\s+$", ""), "^([^,]*),", "$1.")
    body = F.regexp_replace(text, "^[+-]", "")
    whole = F.regexp_replace(F.regexp_extract(body, r"^(\d*)", 1), "^0+", "")
    part = F.regexp_replace(F.regexp_extract(body, r"\.(\d*)$", 1), "0+$", "")
    whole = F.when(whole == "", "0").otherwise(whole)
    zero = (whole == "0") & (part == "")
    sign = F.when(text.startswith("-") & ~zero, "-").otherwise("")
    return F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), F.concat(sign, whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise("")))


def leading_int(c: str | Column) -> Column:
    """The whole number that a text starts with, else 0."""
    return F.coalesce(F.regexp_extract(_col(c), r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def filled(c: str | Column) -> Column:
    """Neither null nor only spaces."""
    return F.coalesce(F.trim(_col(c)) != "", F.lit(False))


def status_class(c: str | Column) -> Column:
    """awarded, noAward, annulled, inProgress or unclassified: exact texts first, then what they contain."""
    s = F.trim(F.coalesce(_col(c), F.lit("")))
    low = F.lower(s)
    return (
        F.when(s.isin(*AWARDED_STATUS), "awarded")
        .when(s.isin(*NO_AWARD_STATUS), "noAward")
        .when(s.isin(*ANNULLED_STATUS), "annulled")
        .when(s.isin(*IN_PROGRESS_STATUS), "inProgress")
        .when(low.contains("desierto") | low.contains("infructuoso"), "noAward")
        .otherwise("unclassified")
    )


def low_value(c: str | Column) -> Column:
    """Whether an exception is direct contracting of small value."""
    return F.coalesce(_col(c), F.lit("")).rlike(r"(?i)escasa\s+cuant")


def exception_family(c: str | Column) -> Column:
    """low-value-threshold or substantive."""
    return F.when(low_value(c), "low-value-threshold").otherwise("substantive")


def before_regime(c: str | Column) -> Column:
    """Whether a date is before the change of law."""
    return iso_date(c) < REGIME_DATE


def dispersion(c: str | Column) -> Column:
    """tight, moderate, wide or extreme, by interquartile ratio."""
    r = _col(c)
    return F.when(r <= 1.5, "tight").when(r <= 3, "moderate").when(r <= 10, "wide").when(r.isNotNull(), "extreme")


def decade(c: str | Column) -> Column:
    """Power of ten of a positive number."""
    return F.floor(F.log10(_col(c))).cast("int")


def ratio(n: str | Column, d: str | Column) -> Column:
    """n / d, null unless d is positive."""
    n, d = _col(n), _col(d)
    return F.when(d > 0, n.cast("double") / d)


def movement(before: str | Column, after: str | Column) -> Column:
    """filled, cleared, text, reprint or numeric: how a field's value moved."""
    b, a = _col(before), _col(after)
    nb, na = canonical_number(b), canonical_number(a)
    return (
        F.when(~filled(b) & filled(a), "filled")
        .when(filled(b) & ~filled(a), "cleared")
        .when(nb.isNull() | na.isNull(), "text")
        .when(nb == na, "reprint")
        .otherwise("numeric")
    )


def direction(before: str | Column, after: str | Column) -> Column:
    """up or down for canonical numbers that differ: exact, by sign, length and digits, without floats."""
    nb, na = canonical_number(before), canonical_number(after)

    def less(x: Column, y: Column) -> Column:
        xi, yi = F.regexp_extract(x, r"^(\d+)", 1), F.regexp_extract(y, r"^(\d+)", 1)
        xf, yf = F.regexp_extract(x, r"\.(\d+)", 1), F.regexp_extract(y, r"\.(\d+)", 1)
        return (F.length(xi) < F.length(yi)) | ((F.length(xi) == F.length(yi)) & ((xi < yi) | ((xi == yi) & (xf < yf))))

    minus_b, minus_a = nb.startswith("-"), na.startswith("-")
    b, a = F.ltrim(nb, F.lit("-")), F.ltrim(na, F.lit("-"))
    up = F.when(minus_b & ~minus_a, True).when(~minus_b & minus_a, False).when(minus_b, less(a, b)).otherwise(less(b, a))
    return F.when(nb.isNotNull() & na.isNotNull() & (nb != na), F.when(up, "up").otherwise("down"))


def _differences(before: pd.Series, after: pd.Series) -> pd.Series:
    def one(b: str | None, a: str | None) -> str | None:
        if b is None or a is None:
            return None
        with localcontext() as exact:
            exact.prec = len(a) + len(b) + 2
            d = Decimal(a) - Decimal(b)
            text = format(d.normalize() if d else Decimal(0), "f")
        return f"+{text}" if d > 0 else text

    return pd.Series([one(b, a) for b, a in zip(before, after, strict=True)], dtype=object)


def delta(before: str | Column, after: str | Column) -> Column:
    """after - before as signed decimal text, exact for numbers of any length; null unless both are numbers."""
    return F.pandas_udf(_differences, "string")(canonical_number(before), canonical_number(after))


def periods(first: str | Column, last: str | Column, yearly: bool = False) -> Column:
    """All months (yyyyMM) or years (yyyy) between two, both included; empty if the last is before the first."""
    a, b = _col(first), _col(last)
    tail, form = ("0101", "yyyy") if yearly else ("01", "yyyyMM")
    start, end = F.try_to_date(F.concat(a, F.lit(tail)), "yyyyMMdd"), F.try_to_date(F.concat(b, F.lit(tail)), "yyyyMMdd")
    step = F.expr("interval 1 year") if yearly else F.expr("interval 1 month")
    return F.when(start.isNull() | end.isNull(), None).when(start > end, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(start, F.greatest(start, end), step), lambda d: F.date_format(d, form)))


def current_period(now: str | Column, yearly: bool = False) -> Column:
    """The month or year that an instant lies in."""
    return F.date_format(_col(now), "yyyy" if yearly else "yyyyMM")


def compact_stamp(http_date: str | Column) -> Column:
    """An HTTP date (Thu, 01 Jan 2026 12:00:00 GMT) as yyyyMMddTHHmmssZ; null if it isn't one."""
    text = F.regexp_extract(_col(http_date), r"^\s*[A-Za-z]{3},\s+(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT\s*$", 1)
    at = F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit("d MMM yyyy HH:mm:ss"))
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def http_date(stamp: str | Column) -> Column:
    """yyyyMMddTHHmmssZ as an HTTP date."""
    return F.concat(F.date_format(stamp_time(stamp), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


@dataclass(frozen=True)
class Window:
    """Inclusive dates of publication, source month and institution; None means any."""

    from_: str | None = None
    to: str | None = None
    month: str | None = None
    institution: str | None = None

    def filters(self) -> bool:
        """Whether anything is restricted."""
        return any((self.from_, self.to, self.month, self.institution))

    def dates(self, c: str | Column) -> Column:
        """The condition on a date column; null dates fall out once a bound is set."""
        day, out = iso_date(c), F.lit(True)
        if self.from_:
            out = out & (day >= self.from_)
        if self.to:
            out = out & (day <= self.to)
        return F.coalesce(out, F.lit(False))

    def tender(self, prefix: str = "") -> Column:
        """The condition on a tender's columns."""
        out = self.dates(f"{prefix}fecha_publicacion")
        if self.month:
            out = out & (F.col(f"{prefix}source_month") == self.month)
        if self.institution:
            out = out & (F.col(f"{prefix}cedula_institucion") == self.institution)
        return F.coalesce(out, F.lit(False))


ALL = Window()


def stamp_time(c: str | Column) -> Column:
    """The instant of a compact stamp yyyyMMddTHHmmssZ, in UTC."""
    return F.try_to_timestamp(_col(c), F.lit("yyyyMMdd'T'HHmmss'Z'"))


def closes_at(period: str | Column, grace_days: int = 2, yearly: bool = False) -> Column:
    """The instant at which a month or year, with its days of grace, is over."""
    p = _col(period)
    first = F.try_to_date(F.concat(p, F.lit("0101" if yearly else "01")), "yyyyMMdd")
    return F.date_add(F.add_months(first, 12 if yearly else 1), grace_days).cast("timestamp")


def after_close(period: str | Column, stamp: str | Column, grace_days: int = 2, yearly: bool = False) -> Column:
    """Whether a copy was written after its period had closed."""
    return F.coalesce(stamp_time(stamp) > closes_at(period, grace_days, yearly), F.lit(False))


# Code lists of the open contracting data standard.
def ocds_method(c: str | Column) -> Column:
    """open, limited or selective."""
    s = F.upper(F.trim(F.coalesce(_col(c), F.lit(""))))
    return F.when(s.startswith("LICITACI") | s.contains("REMATE"), "open").when(s.contains("EXCEPCI"), "limited").when(s.contains("ESPECIAL"), "selective")


def ocds_category(c: str | Column) -> Column:
    """works, goods or services."""
    s = F.upper(F.trim(F.coalesce(_col(c), F.lit(""))))
    return F.when(s.contains("OBRA"), "works").when(s.contains("BIENES"), "goods").when(s.contains("SERVICIO"), "services")


def ocds_status(c: str | Column) -> Column:
    """unsuccessful, cancelled, complete or active; null for none."""
    s = F.lower(F.trim(F.coalesce(_col(c), F.lit(""))))
    return (
        F.when(s == "", None)
        .when(s.contains("infructuoso") | s.contains("desierto"), "unsuccessful")
        .when(s.contains("anulad") | s.contains("cancelad"), "cancelled")
        .when(s.contains("contrato") | s.contains("firme") | s.contains("adjudicad"), "complete")
        .otherwise("active")
    )


def ocds_currency(c: str | Column, default: str = "CRC") -> Column:
    """Three letters, else the default."""
    s = F.upper(F.trim(F.coalesce(_col(c), F.lit(""))))
    return F.when(s.rlike("^[A-Z]{3}$"), s).otherwise(default)


def ocds_time(c: str | Column) -> Column:
    """A day as a date-time."""
    s = F.trim(_col(c))
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(s, F.lit("T00:00:00Z")))
