"""Addresses held as BINARY: 4 bytes (IPv4), 16 bytes (IPv6), 6 bytes (MAC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetlake.functions.binary import piece

INTERNAL, EXTERNAL = "internal", "external"


def ip_version(address: Column) -> Column:
    """4 or 6 by the number of bytes; NULL for any other length."""
    return F.when(F.length(address) == 4, 4).when(F.length(address) == 16, 6)


def node_label(address: Column) -> Column:
    return F.concat(F.lit("IPv"), ip_version(address).cast("string"))


def ipv4_from_long(value: Column) -> Column:
    """4-byte address of an unsigned 32-bit number."""
    return F.unhex(F.lpad(F.hex(value), 8, "0"))


def ipv4_from_text(text: Column) -> Column:
    """4-byte address of dotted text; NULL where it is not a valid IPv4 address."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    valid = text.rlike("^" + r"\.".join([octet] * 4) + "$")
    parts = F.split(text, r"\.")
    octets = [F.lpad(F.hex(F.try_element_at(parts, F.lit(i)).try_cast("long")), 2, "0") for i in (1, 2, 3, 4)]
    return F.when(valid, F.unhex(F.concat(*octets)))


def ipv4_text(address: Column) -> Column:
    """``a.b.c.d``; NULL unless the address has 4 bytes."""
    octets = [F.conv(F.hex(piece(address, i, 1)), 16, 10) for i in range(4)]
    return F.when(F.length(address) == 4, F.concat_ws(".", *octets))


def mac_text(address: Column) -> Column:
    """``AA:BB:CC:DD:EE:FF``; NULL unless the address has 6 bytes."""
    octets = [F.hex(piece(address, i, 1)) for i in range(6)]
    return F.when(F.length(address) == 6, F.concat_ws(":", *octets))


def _compressed(full: Column) -> Column:
    """Longest run of two or more zero groups (the leftmost of equals) as ``::``.

    ``full`` has a colon on both sides, so whole groups can be found as text.
    """
    text = F.substring(full, F.lit(2), F.length(full) - 2)
    for run in range(2, 9):
        zeros = ":" + "0:" * run
        at = F.instr(full, zeros)
        head = F.substring(full, F.lit(2), at - 2)
        tail = F.substring(full, at + F.lit(len(zeros)), F.length(full) - at - F.lit(len(zeros)))
        text = F.when(at > 0, F.concat(head, F.lit("::"), tail)).otherwise(text)
    return text


def ipv6_text(address: Column) -> Column:
    """Canonical text: lower case, no leading zeros, longest zero run as ``::``.

    An IPv4-mapped address ends in dotted notation. NULL unless 16 bytes.
    """
    grouped = F.regexp_replace(F.lower(F.hex(address)), "(.{4})", "$1:")
    full = F.concat(F.lit(":"), F.regexp_replace(grouped, "(^|:)0{1,3}(?=[0-9a-f])", "$1"))
    # The lambda binds the text once; written out, it would be repeated 30 times.
    text = F.element_at(F.transform(F.array(full), _compressed), 1)
    mapped = F.hex(piece(address, 0, 12)) == "00000000000000000000FFFF"
    return F.when(
        F.length(address) == 16,
        F.when(mapped, F.concat(F.lit("::ffff:"), ipv4_text(piece(address, 12, 4)))).otherwise(text),
    )


def ip_text(address: Column) -> Column:
    return F.when(F.length(address) == 4, ipv4_text(address)).otherwise(ipv6_text(address))


# Internal address ranges as (first bytes, first bytes behind the range); a prefix
# sorts before everything it begins (fixed values).
# IPv4: 10/8, 172.16/12, 192.168/16, 127/8, 169.254/16. IPv6: fe80::/10, fc00::/7,
# ff00::/8; the loopback address is compared whole.
INTERNAL_V4 = [("0A", "0B"), ("AC10", "AC20"), ("C0A8", "C0A9"), ("7F", "80"), ("A9FE", "A9FF")]
INTERNAL_V6 = [("FE80", "FEC0"), ("FC", "FE"), ("FF", None)]
LOOPBACK_V6 = "0" * 31 + "1"


def _in_ranges(address: Column, ranges: list[tuple[str, str | None]]) -> Column:
    hit = F.lit(False)
    for low, high in ranges:
        inside = address >= F.lit(bytes.fromhex(low))
        if high:
            inside = inside & (address < F.lit(bytes.fromhex(high)))
        hit = hit | inside
    return hit


def is_internal(address: Column) -> Column:
    """Private, loopback or link-local (IPv4); loopback, link-local, unique-local
    or multicast (IPv6)."""
    v6 = (address == F.lit(bytes.fromhex(LOOPBACK_V6))) | _in_ranges(address, INTERNAL_V6)
    return F.when(F.length(address) == 4, _in_ranges(address, INTERNAL_V4)).otherwise(v6)


def address_scope(address: Column) -> Column:
    return F.when(is_internal(address), INTERNAL).otherwise(EXTERNAL)


def address_before(left: Column, right: Column) -> Column:
    """Numeric order of addresses: IPv4 before IPv6, then unsigned byte order."""
    shorter = F.length(left) < F.length(right)
    return shorter | ((F.length(left) == F.length(right)) & (left < right))


