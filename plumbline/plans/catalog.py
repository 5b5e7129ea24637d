"""All queries of the library, and the SQL that says the same."""

from __future__ import annotations

from . import cutting, landings, reports, rules, texts, tracing

QUERIES = rules.QUERIES | reports.QUERIES | texts.QUERIES | landings.QUERIES | tracing.QUERIES | cutting.QUERIES
ORACLES = rules.ORACLES | reports.ORACLES | texts.ORACLES | landings.ORACLES | tracing.ORACLES | cutting.ORACLES
