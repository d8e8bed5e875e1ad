"""All registered queries: name -> fn(Tables) -> DataFrame."""

from __future__ import annotations

from carelake.plans import alerts, dashboards, filtered, governance, marts, models, positions, quality, semantic


def all_queries() -> dict:
    reg = {}
    reg.update(marts.QUERIES)
    reg.update(dashboards.QUERIES)
    reg.update(models.QUERIES)
    reg.update(governance.QUERIES)
    reg.update(quality.QUERIES)
    reg.update(alerts.QUERIES)
    reg.update(semantic.QUERIES)
    reg.update(filtered.QUERIES)
    reg.update(positions.QUERIES)
    return reg
