"""Whole DNS messages: every question and every record, read in Arrow batches.

Names can point back into the message, so a walk of one has no bound that a
column expression could state. The walk is a function of one message.
"""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

RECORD = StructType().add("section", "string").add("name", "string").add("type", "integer").add("class", "integer")
RECORD = RECORD.add("ttl", "long").add("value", "string").add("data", "binary")
WALKED = StructType().add("fault", "string").add("records", ArrayType(RECORD))
ARROW = pa.struct({f.name: f.type for f in to_arrow_schema(WALKED)})

HEADER, NAME_BYTES = 12, 255
SECTIONS = ("answer", "authority", "additional")
# Record types (fixed values) with an address, and those whose data is a name behind so many bytes:
# A and AAAA; NS, CNAME, PTR, DNAME, MX, SRV.
ADDRESS_BYTES = {1: 4, 28: 16}
NAME_BEHIND = {2: 0, 5: 0, 12: 0, 39: 0, 15: 2, 33: 6}


class Fault(Exception):
    """The message cannot be read on; the text says why."""


def _name(message: bytes, at: int, known: dict) -> tuple[str, int]:
    """The name at ``at`` and the offset behind it.

    A pointer leads to an earlier byte, and no byte is met twice. ``known`` keeps
    text, wire size and end of each place that begins the rest of a name, so a
    message is walked in time of its size, however its names share their ends.
    """
    path, met, place = [], set(), at
    while place not in known:
        if place in met:
            raise Fault("name loops")
        met.add(place)
        if place >= len(message):
            raise Fault("name beyond the end")
        size = message[place]
        if size == 0:
            known[place] = ("", 1, place + 1)
        elif size >= 192:
            if place + 2 > len(message):
                raise Fault("name beyond the end")
            target = (size & 63) << 8 | message[place + 1]
            if target >= place:
                raise Fault("pointer forward")
            path.append((place, None))
            place = target
        elif size > 63:
            raise Fault("label type")
        else:
            label = message[place + 1 : place + 1 + size]
            if len(label) < size:
                raise Fault("name beyond the end")
            path.append((place, label))
            place += 1 + size
    for begin, label in reversed(path):
        text, wire, end = known[place]
        if label is None:
            end = begin + 2
        else:
            shown = label.decode("utf-8", "replace")
            text, wire = f"{shown}.{text}" if wire > 1 else shown, wire + 1 + len(label)
        if wire > NAME_BYTES:
            raise Fault("name too long")
        known[begin] = (text, wire, end)
        place = begin
    text, _, end = known[at]
    return text, end


def _number(message: bytes, at: int, width: int) -> int:
    return int.from_bytes(message[at : at + width], "big")


def _value(message: bytes, kind: int, begin: int, end: int, known: dict) -> str | None:
    """Address or name in the data of a record; nothing for other types."""
    if kind in ADDRESS_BYTES:
        if end - begin != ADDRESS_BYTES[kind]:
            raise Fault("address size")
        return str(ipaddress.ip_address(message[begin:end]))
    if kind not in NAME_BEHIND:
        return None
    if begin + NAME_BEHIND[kind] >= end:
        raise Fault("name beyond its record")
    text, behind = _name(message, begin + NAME_BEHIND[kind], known)
    if behind != end:
        raise Fault("name beyond its record")
    return text


def read_message(message: bytes) -> dict:
    """``records`` up to the first fault, and that ``fault``, NULL in a sound message.

    Bytes behind the last record are no fault.
    """
    records, known = [], {}
    try:
        if len(message) < HEADER:
            raise Fault("short header")
        at = HEADER
        for _ in range(_number(message, 4, 2)):
            at = _name(message, at, known)[1] + 4
            if at > len(message):
                raise Fault("question beyond the end")
        for section, place in zip(SECTIONS, (6, 8, 10)):
            for _ in range(_number(message, place, 2)):
                name, at = _name(message, at, known)
                begin = at + 10
                if begin > len(message):
                    raise Fault("record beyond the end")
                kind, end = _number(message, at, 2), begin + _number(message, at + 8, 2)
                if end > len(message):
                    raise Fault("record beyond the end")
                records.append(
                    {
                        "section": section,
                        "name": name,
                        "type": kind,
                        "class": _number(message, at + 2, 2),
                        "ttl": _number(message, at + 4, 4),
                        "value": _value(message, kind, begin, end, known),
                        "data": message[begin:end],
                    }
                )
                at = end
    except Fault as fault:
        return {"fault": str(fault), "records": records}
    return {"fault": None, "records": records}


@F.arrow_udf(WALKED)
def walk_messages(messages: pa.Array) -> pa.Array:
    """``read_message`` of each message; NULL of NULL."""
    return pa.array([None if m is None else read_message(m) for m in messages.to_pylist()], ARROW)
