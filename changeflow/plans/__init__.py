"""Registered queries: each a function of (session, data folder), most with an equivalent SQL text."""

from __future__ import annotations

from . import barriers, boundary, capture, dead, documents, envelopes, failover, schemas, signal, snapshots, state, streams, transform
from .registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "barriers", "boundary", "capture", "dead", "documents", "envelopes", "failover", "schemas", "signal", "snapshots", "state", "streams", "transform",
]
