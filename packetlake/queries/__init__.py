"""Registered queries over the test tables, each with its SQL counterpart where SQL can say it."""

from packetlake.queries.base import REGISTRY

__all__ = ["REGISTRY", "load"]


def load():
    """The full registry: name -> (callable, SQL or None)."""
    from packetlake.queries import decoding, files, flows, graph, labelled, streams, tokens  # noqa: F401

    return REGISTRY
