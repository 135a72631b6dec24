"""Directional and normalised flow keys as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlake.functions.net import address_before, ip_text


def is_forward(src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column) -> Column:
    """True where the source endpoint is strictly the smaller one.

    A packet between equal endpoints counts as backward.
    """
    return address_before(src_ip, dst_ip) | ((src_ip == dst_ip) & (src_port < dst_port))


def flow_key_text(src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column, protocol: Column) -> Column:
    """``src:port -> dst:port (protocol)``, in the direction given."""
    return F.format_string("%s:%d -> %s:%d (%s)", ip_text(src_ip), src_port, ip_text(dst_ip), dst_port, protocol)


def with_normalised_key(packets: DataFrame) -> DataFrame:
    """Adds ``is_fwd`` and the endpoints ordered so both directions agree."""
    forward = packets.withColumn(
        "is_fwd", is_forward(F.col("src_ip"), F.col("dst_ip"), F.col("src_port"), F.col("dst_port"))
    )

    def pick(when_forward: str, otherwise: str) -> Column:
        return F.when(F.col("is_fwd"), F.col(when_forward)).otherwise(F.col(otherwise))

    return forward.withColumns(
        {
            "ip_lo": pick("src_ip", "dst_ip"),
            "ip_hi": pick("dst_ip", "src_ip"),
            "port_lo": pick("src_port", "dst_port"),
            "port_hi": pick("dst_port", "src_port"),
        }
    )
