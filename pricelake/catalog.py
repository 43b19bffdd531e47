"""All catalog queries: callables of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from .plans import compare, comparing, converge, events, ingest, linkage, market, matching, more, offers, operations, pages, quality, scoring, search

QUERIES = offers.QUERIES | scoring.QUERIES | search.QUERIES | linkage.QUERIES | matching.QUERIES | quality.QUERIES | compare.QUERIES | comparing.QUERIES | converge.QUERIES | ingest.QUERIES | operations.QUERIES | pages.QUERIES | more.QUERIES | market.QUERIES | events.QUERIES
SQL = offers.SQL | scoring.SQL | search.SQL | linkage.SQL | matching.SQL | quality.SQL | compare.SQL | comparing.SQL | converge.SQL | ingest.SQL | operations.SQL | pages.SQL | more.SQL | market.SQL | events.SQL
