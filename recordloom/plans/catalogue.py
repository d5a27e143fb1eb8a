"""Every query of the core library by name, with its SQL."""

from recordloom.plans import learning, matching, spans, statistics, texts

_MODULES = (matching, statistics, texts, spans, learning)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
