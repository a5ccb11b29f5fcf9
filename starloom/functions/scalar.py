"""Scalar functions over Columns; missing values are NULL throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value.
MISSING = ("", "nan", "none", "null")


def number(c: Column) -> Column:
    """Text or number as double; what doesn't parse, NaN and infinities are NULL."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def whole(c: Column) -> Column:
    """Text or number as a whole number, cut towards zero."""
    return number(c).cast("long")


def known(c: Column) -> Column:
    """A text, or NULL where it is one of MISSING."""
    return F.when(~F.lower(F.trim(c)).isin(*MISSING), c)


def missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def sanitized(df, *columns: str):
    """NaN and infinities of double columns become NULL, in arrays too; all double columns where none are named."""
    out = {}
    for field in df.schema:
        if columns and field.name not in columns:
            continue
        kind = field.dataType.simpleString()
        if kind in ("double", "float"):
            out[field.name] = number(F.col(field.name)).cast(kind)
        elif kind in ("array<double>", "array<float>"):
            out[field.name] = F.transform(field.name, number).cast(kind)
    return df.withColumns(out)


def true(c: Column) -> Column:
    """A condition with NULL as false."""
    return F.coalesce(c, F.lit(False))


def log10(c: Column) -> Column:
    return F.when(c > 0, F.log10(c))


def clipped(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def one_blank(c: Column) -> Column:
    """Runs of blanks as one, ends trimmed, upper case."""
    return F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))


def no_blank(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s+", ""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit(""))))


def contains_any(c: Column, texts: Sequence[str]) -> Column:
    """Whether any of the texts is in it, whatever their case."""
    found = F.lit(False)
    for t in texts:
        found = found | F.contains(F.lower(c), F.lit(t.lower()))
    return found


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match, NULL without one."""
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def source_id(c: Column, digits: str = "15,20") -> Column:
    """The long number that names a source within a text."""
    return group(c, rf"(\d{{{digits}}})").try_cast("long")


def catalogue_key(c: Column) -> Column:
    """HD or HIP name as prefix and digits without blank."""
    pattern = r"(?i)^(HD|HIP)\s+(\d+)"
    return F.when(c.rlike(pattern), F.concat(F.upper(group(c, pattern)), group(c, pattern, 2)))


def spectral_letter(c: Column) -> Column:
    return group(F.trim(c), "^([OBAFGKM])")


def luminosity_numeral(c: Column, legacy: bool = True) -> Column:
    """I, II, III, IV or V of a spectral type.

    legacy: the first numeral that starts at a word boundary, so none right after a digit, and one of
    three letters counts as I. Otherwise the first numeral after the subtype.
    """
    if legacy:
        found = group(c, r"\b(I{1,3}V?|IV|V)\b")
        return F.when(F.length(found) > 2, F.lit("I")).otherwise(found)
    return group(c, r"(?:^|[^IVa-z])(III|II|IV|I|V)")


def numbers_in(c: Column) -> Column:
    """All numbers in a text."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(-?\d+\.?\d*)"), F.lit(1)), lambda x: x.try_cast("double"))


def fixed(c: Column, form: str = "%.2f") -> Column:
    """A number in a fixed form, N/A without one."""
    return F.coalesce(F.when(c.isNotNull(), F.format_string(form, c)), F.lit("N/A"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def masked_mean(values: Column, keep) -> Column:
    """Mean of the array's values that ``keep`` admits."""
    own = F.filter(values, keep)
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.size(own))


def masked_deviation(values: Column, keep) -> Column:
    """Population standard deviation of the array's values that ``keep`` admits."""
    own, mean = F.filter(values, keep), masked_mean(values, keep)
    return F.when(F.size(own) > 0, F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(own)))


def in_windows(x: Column, windows: Sequence[tuple[float, float]]) -> Column:
    found = F.lit(False)
    for low, high in windows:
        found = found | x.between(low, high)
    return found


def trapezoid(xs: Column, ys: Column) -> Column:
    """Integral over the points (xs, ys)."""
    n = F.size(xs)
    steps = F.zip_with(F.zip_with(F.slice(xs, F.lit(2), n - 1), F.slice(xs, F.lit(1), n - 1), lambda a, b: a - b), F.zip_with(F.slice(ys, F.lit(2), n - 1), F.slice(ys, F.lit(1), n - 1), lambda a, b: (a + b) / 2), lambda w, h: w * h)
    return F.when(n > 1, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def json_body(c: Column) -> Column:
    """From the first { to the last } of a text."""
    return group(c, r"(?s)(\{.*\})")


def present(*parts: Column) -> Column:
    """The parts that aren't NULL, as an array."""
    return F.array_compact(F.array(*parts))
