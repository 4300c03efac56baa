"""All queries of the urban engine over the driver's tables, with their SQL oracles."""

from __future__ import annotations

from . import area_queries, audit_queries, equity_queries, field_queries, form_queries, network_queries, planning_queries, street_queries, transit_queries

FLAGSHIP = "access_equity"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (area_queries, audit_queries, equity_queries, field_queries, form_queries, network_queries, planning_queries, street_queries, transit_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
