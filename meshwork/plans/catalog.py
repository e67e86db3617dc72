"""All queries over the library's own operators, with the SQL that checks them."""

from __future__ import annotations

from .contract_queries import BOOK as CONTRACTS
from .registering import Query
from .registry_queries import BOOK as REGISTRY
from .scale_queries import BOOK as SCALE
from .scene_queries import BOOK as SCENE
from .stream_queries import BOOK as STREAM


def queries() -> dict[str, Query]:
    return SCENE.queries | REGISTRY.queries | CONTRACTS.queries | SCALE.queries | STREAM.queries


def oracle_sql() -> dict[str, str]:
    return SCENE.sql | REGISTRY.sql | CONTRACTS.sql | SCALE.sql | STREAM.sql
