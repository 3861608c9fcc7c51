"""Every runnable query of the engine, with an independent SQL statement where one exists."""

from __future__ import annotations

from corpusmill.plans import (
    queries_corpus,
    queries_retrieval,
    queries_service,
    queries_text,
)

_MODULES = [queries_retrieval, queries_corpus, queries_service, queries_text]

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
