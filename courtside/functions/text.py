"""Column -> Column helpers for text and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtside.functions.numeric import as_column

# Fixed value: how a missing piece shows in a label.
MISSING = "NA"

# Short names of time zones and their offsets from UTC.
ZONE_OFFSETS = {
    "UTC": "+00:00", "GMT": "+00:00", "BST": "+01:00", "CET": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00",
    "AST": "-04:00", "ADT": "-03:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00",
    "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00", "AKST": "-09:00", "AKDT": "-08:00", "HST": "-10:00", "JST": "+09:00",
    "KST": "+09:00", "AEST": "+10:00", "AEDT": "+11:00", "NZST": "+12:00", "NZDT": "+13:00",
}
CLOCK = "yyyy-MM-dd HH:mm:ss"


def label(*parts: Column | str, sep: str = " ") -> Column:
    """Join columns into one text; a missing piece shows as ``NA``.

    ``concat`` alone would lose the whole label and ``concat_ws`` would drop the piece.
    Doubles show as :func:`number_text`. Strings name columns; wrap constants in ``F.lit``.
    """
    pieces = [F.coalesce(_shown(as_column(p)), F.lit(MISSING)) for p in parts]
    return F.concat_ws(sep, *pieces)


def _shown(x: Column) -> Column:
    # the type is known when the query is planned, which leaves one of the two
    text = x.cast("string")
    return F.when(F.typeof(x).isin("double", "float"), number_text(text.try_cast("double"))).otherwise(text)


def number_text(x: Column | str) -> Column:
    """A double as text: up to 15 significant digits without trailing zeros, plain or with an exponent, whichever is shorter.

    2.0 is ``2``, 0.1 + 0.2 is ``0.3``, 123456 is ``123456``, 100000 is ``1e+05`` and 0.00001 is ``1e-05``: an exponent is
    used where the plain form would be longer.
    """
    x = as_column(x)
    shown = F.format_string("%.14e", F.abs(x))
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(shown, "e", 1), r"\.", ""), "(?<=.)0+$", "")
    power = F.substring_index(shown, "e", -1).try_cast("int")
    n = F.length(digits)
    zeros = lambda k: F.repeat(F.lit("0"), k)
    decimals = F.greatest(n - 1 - power, F.lit(0))
    plain_width = F.greatest(power, F.lit(0)) + 1 + F.when(decimals > 0, decimals + 1).otherwise(0)
    short_width = n + F.when(n > 1, 1).otherwise(0) + F.when(F.abs(power) >= 100, 5).otherwise(4)
    plain = (
        F.when(power < 0, F.concat(F.lit("0."), zeros(-1 - power), digits))
        .when(power >= n - 1, F.concat(digits, zeros(power - n + 1)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n)))
    )
    mantissa = F.when(n > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(digits)
    exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    text = F.when(plain_width <= short_width, plain).otherwise(F.concat(mantissa, exponent))
    signed = F.concat(F.when(x < 0, "-").otherwise(""), text)
    infinite = F.when(x == float("inf"), "Inf").when(x == float("-inf"), "-Inf")
    return F.when(x.isNull(), None).when(F.isnan(x), "NaN").otherwise(F.coalesce(infinite, signed))


def decimals(x: Column | str, digits: int) -> Column:
    """A number as text, rounded half-even to ``digits`` and without trailing zeros."""
    rounded = F.bround(as_column(x), digits) + F.lit(0.0)
    text = F.regexp_replace(F.format_string(f"%.{digits}f", rounded), r"(\.\d*?)0+$", "$1")
    text = F.regexp_replace(text, r"\.$", "")
    return F.when(as_column(x).isNotNull(), text)  # format_string writes a null out as text


def matches(x: Column | str, pattern: str) -> Column:
    """Regular-expression match anywhere in the text."""
    return as_column(x).rlike(pattern)


def clock_time(x: Column | str) -> Column:
    """``2024-01-27 09:20:00 EST`` to a timestamp; the zone in the text counts.

    A short name is a fixed offset: ``EST`` is five hours behind UTC in summer too. Offsets (``-05:00``) and names of
    regions (``America/New_York``) are read as well. Text without a zone is in the session's zone; other text is null.
    """
    text = F.trim(as_column(x))
    offsets = F.create_map(*[F.lit(piece) for pair in ZONE_OFFSETS.items() for piece in pair])
    offset = F.try_element_at(offsets, F.regexp_extract(text, r" ([A-Z]+)$", 1))
    fixed = F.concat(F.regexp_replace(text, "[A-Z]+$", ""), offset)
    return F.coalesce(
        F.try_to_timestamp(fixed, F.lit(f"{CLOCK} XXX")),
        F.try_to_timestamp(text, F.lit(f"{CLOCK} XXX")),
        F.try_to_timestamp(text, F.lit(f"{CLOCK} VV")),
        F.try_to_timestamp(text, F.lit(CLOCK)),
    )
