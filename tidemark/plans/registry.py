"""All registered queries of the library proper and their DuckDB counterparts."""

from __future__ import annotations

from . import feeds, live, policy, web

QUERIES: dict = {**web.QUERIES, **feeds.QUERIES, **policy.QUERIES, **live.QUERIES}
ORACLES: dict[str, str] = {**web.ORACLES, **feeds.ORACLES, **policy.ORACLES, **live.ORACLES}
