"""IP addresses of both families as numbers, and what kind of network they belong to, as columns.

An address is a struct of its family (4 or 6) and two longs, the upper and the lower half of its 128 bits; version 4 fills the lower
32. Text forms are those that the standard allows: four decimal octets without leading zeros; up to eight groups of hex digits, one run of zero groups left out
by ``::``, the last two perhaps as four octets, perhaps a zone after ``%``, which is dropped. All else is null.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDRESS = "struct<family: int, high: bigint, low: bigint>"

#: The special-purpose address registries, and the blocks of version 6 that are not assigned. The longest block that holds an address decides.
SPECIAL = {
    "private": [
        "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
        "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
        "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
    ],
    "public": ["192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"],
    "reserved": ["::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9"],
}


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def halves(number: int) -> tuple[int, int]:
    return signed(number >> 64), signed(number & (1 << 64) - 1)


def masks(family: int, length: int) -> tuple[int, int]:
    """What to keep of both halves for a prefix of ``length`` bits."""
    bits = 32 if family == 4 else 128
    return halves(((1 << length) - 1) << (bits - length))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def octets(text: Column) -> Column:
    """The number of a dotted quad; null if it is none."""
    value = [F.split_part(text, F.lit("."), F.lit(i)).try_cast("long") for i in range(1, 5)]
    good = text.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$") & (F.greatest(*value) <= 255)
    return F.when(good, ((value[0] * 256 + value[1]) * 256 + value[2]) * 256 + value[3])


def six_groups(text: Column) -> Column:
    """The text of version 6 without its zone; an ending of four octets becomes two groups."""
    plain = F.regexp_replace(text, r"%[^%]+$", "")
    tail = F.substring_index(plain, ":", -1)
    as_groups = lambda n: F.concat_ws(":", F.lower(F.hex(F.shiftright(n, 16))), F.lower(F.hex(n.bitwiseAND(65535))))
    swapped = lambda n: F.coalesce(F.concat(plain.substr(F.lit(1), F.length(plain) - F.length(tail)), F.when(n.isNotNull(), as_groups(n))), F.lit(""))
    return F.when(tail.contains("."), let(octets(tail), swapped)).otherwise(plain)


def filled(sides: Column) -> Column:
    """Eight groups from what stands on both sides of ``::`` (or on the one side there is); null if they don't fit."""
    groups = lambda i: F.when(F.length(F.get(sides, F.lit(i))) > 0, F.split(F.get(sides, F.lit(i)), ":")).otherwise(F.array().cast("array<string>"))
    zeros = lambda both: 8 - F.size(both["l"]) - F.size(both["r"])
    fits = lambda both: F.when(F.size(sides) == 1, zeros(both) == 0).otherwise((F.size(sides) == 2) & (zeros(both) >= 1))
    return let(F.struct(groups(0).alias("l"), groups(1).alias("r")), lambda both: F.when(fits(both), F.concat(both["l"], F.array_repeat(F.lit("0"), zeros(both)), both["r"])))


def address(text: Column) -> Column:
    """(family, high, low) of an address text; null if it is none."""
    half = lambda groups, at: F.aggregate(F.slice(groups, at, 4), F.lit(0).cast("long"), lambda a, g: F.shiftleft(a, 16).bitwiseOR(F.conv(g, 16, 10).cast("long")))
    made = lambda groups: F.when(F.forall(groups, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$")), F.struct(F.lit(6).alias("family"), half(groups, 1).alias("high"), half(groups, 5).alias("low")))
    six = let(let(F.split(six_groups(text), "::"), filled), made)
    four = octets(text)
    return F.when(text.contains(":"), six).when(four.isNotNull(), F.struct(F.lit(4).alias("family"), F.lit(0).cast("long").alias("high"), four.alias("low")))


def network(cidr: Column) -> Column:
    """(family, length, high, low) of ``address/length`` (or one address), host bits cleared; null if it is none."""
    return let(F.struct(address(F.substring_index(cidr, "/", 1)).alias("own"), F.when(cidr.contains("/"), F.substring_index(cidr, "/", -1)).alias("given"), cidr.alias("cidr")), lambda x: masked(x["own"], x["given"], x["cidr"]))


def masked(own: Column, given: Column, cidr: Column) -> Column:
    most = F.when(own["family"] == 4, 32).otherwise(128)
    length = F.when(~cidr.contains("/"), most).when(given.rlike("^[0-9]{1,3}$"), given.try_cast("int"))
    high_bits, low_bits = F.when(own["family"] == 4, 0).otherwise(F.least(length, F.lit(64))), F.when(own["family"] == 4, length + 32).otherwise(F.greatest(length - 64, F.lit(0)))
    mask = lambda bits: F.when(bits <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - bits).cast("int")))
    made = F.struct(own["family"].alias("family"), length.alias("length"), own["high"].bitwiseAND(mask(high_bits)).alias("high"), own["low"].bitwiseAND(mask(low_bits)).alias("low"))
    return F.when(own.isNotNull() & length.between(0, most), made)


def within(own: Column, cidr: str) -> Column:
    """Whether an address struct belongs to a stated network."""
    net = ipaddress.ip_network(cidr)
    (high, low), (high_mask, low_mask) = halves(int(net.network_address)), masks(net.version, net.prefixlen)
    return (own["family"] == net.version) & (own["high"].bitwiseAND(F.lit(high_mask)) == high) & (own["low"].bitwiseAND(F.lit(low_mask)) == low)


def category(text: Column) -> Column:
    """private, reserved, public, or none where the text is no address; loopback counts as private."""
    known = sorted(((ipaddress.ip_network(c).prefixlen, kind, c) for kind, blocks in SPECIAL.items() for c in blocks), reverse=True)

    def kind_of(own: Column) -> Column:
        found = F.when(own.isNull(), "none")
        for _, kind, cidr in known:
            found = found.when(within(own, cidr), kind)
        return found.otherwise("public")

    def mapped_or_not(own: Column) -> Column:
        """An address of version 4 within version 6 is private if that is, else reserved."""
        mapped = F.coalesce((own["family"] == 6) & (own["high"] == 0) & (F.shiftrightunsigned(own["low"], 32) == 0xFFFF), F.lit(False))
        inner = F.when(mapped, F.struct(F.lit(4).alias("family"), F.lit(0).cast("long").alias("high"), own["low"].bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))).otherwise(own)
        return let(F.struct(let(inner, kind_of).alias("kind"), mapped.alias("mapped")), lambda x: F.when(x["mapped"] & (x["kind"] != "private"), "reserved").otherwise(x["kind"]))

    # most hosts are names, and a name is told by its letters
    return F.when(text.contains(":") | text.rlike("^[0-9.]+$"), let(address(text), mapped_or_not)).otherwise("none")
