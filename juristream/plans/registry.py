"""All registered queries of the engine's own operators, and their SQL twins."""

from juristream.plans import acceptance, amendments, analytics, checks, graphs, law, monitoring, retrieval, scalars, stewardship, tables, temporal, texts

MODULES = (temporal, law, acceptance, checks, amendments, graphs, tables, stewardship, analytics, texts, scalars, retrieval, monitoring)
QUERIES: dict = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES: dict = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
