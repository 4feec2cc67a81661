"""Every query of the library and its SQL twin, gathered from the query modules."""

from __future__ import annotations

from lineweave.plans import aligner_queries, data_queries, line_queries, metric_queries, misc_queries, source_queries, stat_queries

QUERIES: dict = {}
ORACLES: dict = {}
for module in (line_queries, stat_queries, metric_queries, misc_queries, data_queries, source_queries, aligner_queries):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
