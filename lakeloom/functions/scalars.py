"""Scalar column functions. All of them stay inside generated JVM code."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed by a whitespace strip.
WHITESPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Replacements that make a step id usable as a file name.
NAME_REPLACEMENTS = {"/": "__", ":": "--", "[": "_", "]": "", "=": "_", ",": "_", " ": "_"}

MONEY = "decimal(18,4)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """Exact decimal form of a currency amount, so sums do not depend on order."""
    return _col(c).cast(MONEY)


def fixed_units(c: Column | str, digits: int = 4) -> Column:
    """A double as a whole number of ``10**-digits``, exact for values with that many decimals.

    Much cheaper than a cast from double to decimal, which goes through text.
    """
    return F.rint(_col(c) * 10**digits).cast("bigint")


def exact_sum(c: Column | str) -> Column:
    """Sum of doubles as decimal(38,10), rounded once, at the end; it does not depend on the order of rows.

    Each value is split into its floor and the rest in units of 2^-52, which add
    up as integers: nothing finer than that is lost of a value, however many there
    are. Values from 2^62 on enter with the digits of their text. Null values are
    passed over. The sum is null if a value is not finite or
    is 10^28 or more, and an error beyond 28 digits.
    """
    x = _col(c)
    odd = F.isnan(x) | (F.abs(x) >= 1e28)
    large = F.abs(x) >= float(2**62)
    floor = F.floor(F.when(odd | large, 0.0).otherwise(x))
    whole = F.when(odd, None).when(large, x.cast("decimal(38,0)")).otherwise(floor.cast("decimal(38,0)"))
    rest = F.when(odd | large, 0.0).otherwise((x - floor) * float(2**52)).cast("bigint").cast("decimal(18,0)")
    total = F.sum(whole).cast("decimal(38,10)") + (F.sum(rest) / F.lit(Decimal(2**52))).cast("decimal(38,10)")
    return F.when(F.coalesce(F.max(odd), F.lit(False)), None).otherwise(total.cast("decimal(38,10)"))


def round_money(c: Column | str, digits: int = 2) -> Column:
    return F.round(_col(c), digits)


def strip_lower(c: Column | str) -> Column:
    stripped = F.regexp_replace(_col(c), f"^{WHITESPACE}+", "")
    return F.lower(F.regexp_replace(stripped, f"{WHITESPACE}+$", ""))


def format_prefix(prefix: str, c: Column | str) -> Column:
    return F.concat(F.lit(f"{prefix}: "), _col(c).cast("string"))


def month_of(c: Column | str) -> Column:
    """``yyyy-MM`` of a date, timestamp or ISO text."""
    return F.substring(_col(c).cast("string"), 1, 7)


def zero_pad(c: Column | str, width: int, prefix: str = "") -> Column:
    return F.format_string(f"{prefix}%0{width}d", _col(c))


def percent_format(c: Column | str) -> Column:
    """Two-decimal percentage text, e.g. ``0.1234`` becomes ``12.34%``."""
    return F.concat(F.round(_col(c).cast("decimal(18,8)") * 100, 2).cast("string"), F.lit("%"))


def md5_8(c: Column | str) -> Column:
    return F.substring(F.md5(_col(c).cast("string")), 1, 8)


def sha256_hex(c: Column | str, length: int = 64) -> Column:
    digest = F.sha2(_col(c).cast("string"), 256)
    return digest if length == 64 else F.substring(digest, 1, length)


def sha256_iterated(c: Column | str, rounds: int = 500) -> Column:
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        _col(c).cast("string"),
        lambda acc, _: F.sha2(acc, 256),
    )


def hex_to_int(c: Column | str) -> Column:
    """Unsigned value of up to 15 hexadecimal digits."""
    return F.conv(_col(c), 16, 10).cast("bigint")


def unit_score(c: Column | str) -> Column:
    """Text hashed onto [0, 1)."""
    return hex_to_int(md5_8(c)) / F.lit(2**32)


def parse_int(c: Column | str, skip: int = 0) -> Column:
    """Integer after ``skip`` leading characters; null when the text is no integer."""
    return F.substring(_col(c), skip + 1, 2**31 - 1).try_cast("bigint")


def safe_name(c: Column | str) -> Column:
    out = _col(c)
    for old, new in NAME_REPLACEMENTS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, r"[^\p{L}\p{N}_.\-]", "_")


def fill_default(c: Column | str, default) -> Column:
    return F.coalesce(_col(c), F.lit(default))


def merge_maps(*maps: Column) -> Column:
    """Right-most entry wins, like a chain of dictionary updates."""

    def update(first: Column, later: Column) -> Column:
        return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(later, k)), later)

    return reduce(update, maps)


def zip_map(names: Column, values: Column) -> Column:
    return F.map_from_arrays(names, values)


def sorted_concat(*arrays: Column) -> Column:
    return F.sort_array(F.concat(*arrays))


def epoch_micros(c: Column | str) -> Column:
    """Microseconds since 1970 on the timestamp's own clock, whatever the session zone."""
    ts = _col(c)
    seconds = (
        F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
    )
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
