"""The engine's own queries and their SQL, by name."""

from __future__ import annotations

from . import corpora, rules, scans, sequences, serving, sets, stores, tracking

QUERIES = {**sequences.QUERIES, **sets.QUERIES, **rules.QUERIES, **serving.QUERIES, **tracking.QUERIES, **stores.QUERIES, **corpora.QUERIES, **scans.QUERIES}
ORACLE_SQL = {**sequences.SQL, **sets.SQL, **rules.SQL, **serving.SQL, **tracking.SQL, **stores.SQL, **corpora.SQL, **scans.SQL}
