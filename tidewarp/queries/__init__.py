"""Named queries over the provided tables, with SQL for those that SQL can express."""

from . import model_queries, series_queries

QUERIES = {**series_queries.QUERIES, **model_queries.QUERIES}
ORACLES = {**series_queries.ORACLES, **model_queries.ORACLES}
