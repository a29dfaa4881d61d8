"""All registered queries of the core and their SQL."""

from __future__ import annotations

from saltmarsh.plans import registry, scale
from saltmarsh.plans.scale_sql import SQL

FLAGSHIP = registry.FLAGSHIP
QUERIES = registry.QUERIES | {name: getattr(scale, name) for name in scale.NAMES}
ORACLES = registry.ORACLES | SQL
