"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("chat", "embeddup", "langid", "lm", "media", "neardup", "packing", "pii", "sentencepieces", "spelling", "trie", "warc", "winnowing")

QUERIES = {}
ORACLE_SQL = {}
for _name in _MODULES:
    _module = import_module(f"{__name__}.{_name}")
    QUERIES.update({k: f for k, f in vars(_module).items() if k.startswith("op") and k[2:3].isdigit()})
    ORACLE_SQL.update(getattr(_module, "ORACLE_SQL", {}))
