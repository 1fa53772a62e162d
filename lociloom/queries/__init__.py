"""The catalogue of the library's own queries with their SQL."""

from __future__ import annotations

from lociloom.queries import highorder, keyed, matrix, pairs

QUERIES = {**keyed.QUERIES, **pairs.QUERIES, **matrix.QUERIES, **highorder.QUERIES}
ORACLES = {**keyed.ORACLES, **pairs.ORACLES, **matrix.ORACLES, **highorder.ORACLES}
