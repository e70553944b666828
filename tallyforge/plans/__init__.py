"""Registered queries over the driver's tables, with their DuckDB counterparts."""

from tallyforge.plans import decisions, folders, kept, matching, rulebook, scalars, sourcing, texts, upkeep

MODULES = (texts, scalars, sourcing, matching, decisions, upkeep, folders, rulebook, kept)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
flagship = matching.exact_match_top1
