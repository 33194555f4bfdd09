"""Network addresses as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
CIDR = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}/(3[0-2]|[12]?\d)$"


def ip_to_long(ip: Column) -> Column:
    """Dotted IPv4 text as an unsigned 32-bit number; NULL when it is not IPv4."""
    parts = F.split(ip, "[.]")
    value = F.aggregate(
        parts, F.lit(0).cast("long"), lambda total, part: total * 256 + part.try_cast("long")
    )
    return F.when(ip.rlike(IPV4), value)


def long_to_ip(value: Column) -> Column:
    octets = [F.pmod(F.shiftright(value, shift), F.lit(256)).cast("string") for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def cidr_network(cidr: Column) -> Column:
    """Network of an IPv4 CIDR with the host bits cleared, as ``address/length``."""
    address = ip_to_long(F.substring_index(cidr, "/", 1))
    length = F.substring_index(cidr, "/", -1).try_cast("int")
    # Integer powers of two from a shift keep the mask exact.
    size = F.call_function("shiftleft", F.lit(1).cast("long"), 32 - length)
    network = address - F.pmod(address, size)
    return F.when(
        cidr.rlike(CIDR), F.concat(long_to_ip(network), F.lit("/"), length.cast("string"))
    )


def ipv6_hex(ip: Column) -> Column:
    """IPv6 text as 32 hex digits (128 bits do not fit a decimal); NULL when malformed."""
    text = F.lower(ip)
    has_gap = F.instr(text, "::") > 0

    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda g: g != "")

    left = groups(F.when(has_gap, F.substring_index(text, "::", 1)).otherwise(text))
    right = groups(F.when(has_gap, F.substring_index(text, "::", -1)).otherwise(F.lit("")))
    filled = 8 - F.size(left) - F.size(right)
    zeros = F.array_repeat(F.lit("0"), F.greatest(filled, F.lit(0)).cast("int"))
    whole = F.when(has_gap, F.concat(left, zeros, right)).otherwise(left)
    digits = F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")
    shape = (
        text.rlike("^[0-9a-f:]+$")
        & ~text.rlike(":::")
        & ~text.rlike("::.*::")
        & ~text.rlike("^:[^:]")
        & ~text.rlike("[^:]:$")
        & ~text.rlike("[0-9a-f]{5}")
    )
    fits = F.when(has_gap, filled >= 1).otherwise(F.size(left) == 8)
    return F.when(shape & fits, digits)


def ipv6_halves(ip: Column) -> Column:
    """High and low 64 bits of an IPv6 address as signed longs."""
    digits = ipv6_hex(ip)

    def half(start: int) -> Column:
        # conv() gives the unsigned value as text; decimal(20) wraps into the signed range.
        unsigned = F.conv(F.substring(digits, start, 16), 16, 10).cast("decimal(20,0)")
        wrap = F.lit("18446744073709551616").cast("decimal(20,0)")
        limit = F.lit("9223372036854775807").cast("decimal(20,0)")
        return F.when(unsigned > limit, unsigned - wrap).otherwise(unsigned).cast("long")

    return F.when(
        digits.isNotNull(), F.struct(half(1).alias("high"), half(17).alias("low"))
    )
