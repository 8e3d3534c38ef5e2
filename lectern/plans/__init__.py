"""Registered queries, by theme."""

from . import analysis, chats, citing, ingesting, judged, reporting, scoring, searching, texts
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analysis", "chats", "citing", "ingesting", "judged", "reporting", "scoring", "searching", "texts"]
