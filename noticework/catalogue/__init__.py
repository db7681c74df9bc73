"""Queries on the driver tables, one per operator, each with its SQL counterpart.

The tables stand in for the notice data: an order is a notice, its lines are lots or
awards, customers are buyers, suppliers are winners, nations are countries, part brands and
types are product codes, events are an append log.
"""

from noticework.catalogue.registry import ORACLES, QUERIES

from noticework.catalogue import breakdowns, entities, fields, history, indicators, labelling, matching, quality, refresh, storage, streams  # noqa: F401,E402  (register)

__all__ = ["ORACLES", "QUERIES"]
