"""packetlake: network-traffic analytics as Spark DataFrame and Structured Streaming jobs."""

from packetlake.session import build_session

__all__ = ["build_session"]
