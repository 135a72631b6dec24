"""Frame decoding as columns of one DataFrame, without Python in the row path."""

from packetlake.operators.decode.packets import decode_packets, decode_summary, packet_table, split_errors

__all__ = ["decode_packets", "decode_summary", "packet_table", "split_errors"]
