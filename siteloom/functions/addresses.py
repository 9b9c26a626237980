"""IP addresses as bit strings, so that a prefix test is a string prefix test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
_V6 = r"^(?=.*:)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?(?:::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)?$"


def unmapped(address: Column) -> Column:
    """The IPv4 address in an IPv4-mapped IPv6 one; others as they are."""
    return F.regexp_replace(F.trim(address), r"(?i)^::ffff:(?=\d+\.\d+\.\d+\.\d+$)", "")


def _pad(col: Column, base: int, bits: int) -> Column:
    return F.lpad(F.conv(col, base, 2), bits, "0")


def hextets(address: Column) -> Column:
    """The eight hextets of an IPv6 address, null if it is none."""
    half = lambda i: F.filter(F.split(F.coalesce(F.get(F.split(address, "::"), F.lit(i)), F.lit("")), ":"), lambda x: x != "")
    left, right = half(0), half(1)
    missing = F.lit(8) - F.size(left) - F.size(right)
    whole = F.when(
        address.contains("::") & (missing > 0), F.concat(left, F.array_repeat(F.lit("0"), missing), right),
    ).when(~address.contains("::") & (missing == 0), left)
    return F.when(address.rlike(_V6), whole)


def ip_bits(address: Column) -> Column:
    """32 or 128 characters 0/1; null for what is no address."""
    plain = unmapped(address)
    v4 = F.array_join(F.transform(F.split(plain, r"\."), lambda x: _pad(x, 10, 8)), "")
    v6 = F.array_join(F.transform(hextets(plain), lambda x: _pad(x, 16, 16)), "")
    return F.when(plain.rlike(_V4), v4).when(plain.contains(":"), v6)


def anonymize_ip(address: Column) -> Column:
    """IPv4 with the last part 0; IPv6 with three hextets kept; else ''."""
    kept = F.transform(F.slice(hextets(address), 1, 3), lambda x: F.lpad(F.lower(x), 4, "0"))
    mapped = address.rlike(r"(?i)^::ffff:\d+\.\d+\.\d+\.\d+$")
    v6 = F.when(mapped, F.lit("0000:0000:0000:0:0:0:0:0")).otherwise(F.concat(F.array_join(kept, ":"), F.lit(":0:0:0:0:0")))
    return F.coalesce(F.when(address.rlike(_V4), F.regexp_replace(address, r"\d+$", "0")).when(mapped | address.contains(":"), v6), F.lit(""))
