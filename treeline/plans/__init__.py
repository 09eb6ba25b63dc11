"""Registered queries beside their SQL."""

from . import analysis, graphs, members, pages, paths, relations, scopes, streams, texts
from .catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analysis", "graphs", "members", "pages", "paths", "relations", "scopes", "streams", "texts"]
