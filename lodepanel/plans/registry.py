"""All queries of the panel engine by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, campaigns, families, panel, studies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _queries, _oracles in (panel.all_queries(), (analytics.QUERIES, analytics.ORACLES), (families.QUERIES, families.ORACLES), (studies.QUERIES, studies.ORACLES), (campaigns.QUERIES, campaigns.ORACLES)):
    QUERIES |= _queries
    ORACLES |= _oracles
