"""All queries that need no training-data operator, and their SQL."""

from __future__ import annotations

from tidemill.plans import events, series, star
from tidemill.streaming import funnel, joins, upsert, windows

QUERIES = {**star.QUERIES, **events.QUERIES, **series.QUERIES, **windows.QUERIES, **joins.QUERIES, **funnel.QUERIES, **upsert.QUERIES}
ORACLE_SQL = {**star.ORACLE_SQL, **events.ORACLE_SQL, **series.ORACLE_SQL, **windows.ORACLE_SQL, **joins.ORACLE_SQL, **funnel.ORACLE_SQL, **upsert.ORACLE_SQL}
