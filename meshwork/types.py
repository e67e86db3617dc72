"""Schemas, dimension rows, limits and view parameters of the scene and registry model."""

from __future__ import annotations

import math
from dataclasses import dataclass

ALL_BITS = -1  # unsigned 64-bit masks are kept as the bit pattern of a BIGINT

ACCEPTED = 1  # the review bit of what has been accepted

NODE_SCHEMA = "id bigint, position array<float>, radius float, color array<float>, kind int, flags int"
EDGE_SCHEMA = "id bigint, source bigint, target bigint, width float, color array<float>, kind int, flags int"
SNAPSHOT_SCHEMA = f"revision bigint, first bigint, nodes array<struct<{NODE_SCHEMA}>>, edges array<struct<{EDGE_SCHEMA}>>"
ENTRY_SCHEMA = "id bigint, parent bigint, kind string, name string"
ENTITY_SCHEMA = (
    "id bigint, label string, kind string, custom_kind string, origin_document bigint, "
    "sources struct<ner:boolean,user_tagged:boolean>, ner_mention_count bigint"
)
MENTION_SCHEMA = (
    "entity_id bigint, document bigint, document_revision bigint, content_hash string, start bigint, end bigint, "
    "surface string, prefix string, suffix string, active boolean"
)
MANIFEST_SCHEMA = (
    "generation bigint, kind string, registry_revision bigint, document_id bigint, node_count bigint, edge_count bigint, "
    "entity_count bigint, archive_bytes bigint, index_bytes bigint, archive_hash string, index_hash string"
)

# Kinds of the toolbar in order, with their label and family.
ENTITY_KINDS = [
    ("character", "Character", "character"),
    ("location", "Location", "location"),
    ("npc", "NPC", "character"),
    ("faction", "Faction", "organization"),
    ("event", "Event", "event"),
    ("concept", "Concept", "concept"),
    ("custom", "Custom", "other"),
]
# Families with their slot in family masks and two colours.
FAMILIES = [
    ("character", 0, 0x4F7CFF, 0xB45CFF),
    ("location", 1, 0x21D17D, 0x52E8B8),
    ("organization", 2, 0x52C8FF, 0x5B8CFF),
    ("item", 3, 0xFFBF47, 0xFF7A59),
    ("concept", 4, 0x36D9C2, 0x5EE7FF),
    ("event", 5, 0xFF7A45, 0xFFCF45),
    ("structure", 6, 0xE44C8F, 0xA971FF),
    ("other", 7, 0xB6C4BF, 0x6F9187),
]
MANIFOLDS = ["hybrid", "hopf", "caps", "transit", "siegel"]
REVIEW_BITS = {"accepted": 1, "proposed": 2, "rejected": 4}

# Limits that become data-quality rules.
LIMITS = {
    "archive_bytes": 512 << 20,
    "page_bytes": 128 << 20,
    "pages": 128,
    "references": 2_000_000,
    "hot_bytes": 32 << 20,
    "anchors": 100_000,
    "entries": 16_384,
    "name_bytes": 96,
    "document_bytes": 16 << 20,
    "entities": 100_000,
    "mentions": 1_000_000,
    "surface_bytes": 512,
    "custom_kind_bytes": 64,
    "context_chars": 32,
    "command_queue": 64,
    "event_log": 256,
    "event_ring": 32,
    "sample_ring": 256,
}


@dataclass(frozen=True)
class View:
    """The query of the read path: which families, scopes, relations and review states to show."""

    families: int = ALL_BITS
    scopes: int = ALL_BITS
    relations: int = ALL_BITS
    reviews: int = 7
    manifold: str = "hybrid"
    generation: int | None = None
    cohort_hash: str | None = None
    index_hash: str | None = None

    @property
    def is_unfiltered(self) -> bool:
        return self.families == self.scopes == self.relations == ALL_BITS and self.reviews == 7

    def style_error(self, revision: int, node_scale: float) -> str | None:
        """Why a style may not replace the view's style; None when it may."""
        return None if revision != 0 and math.isfinite(node_scale) and node_scale > 0 else "InvalidStyle"

    def authority_error(self, generation: int | None, cohort_hash: str | None, index_hash: str | None) -> str | None:
        """Why this view may not be applied to the resident scene; None when it may."""
        if not self.is_unfiltered and index_hash is None:
            return "ProductIndexRequiredForFilteredView"
        if (self.generation, self.cohort_hash, self.index_hash) != (generation, cohort_hash, index_hash):
            return "StaleGraphViewAuthority"
        return None
