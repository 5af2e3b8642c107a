"""Queries of the subpackage's operators; SQL where DuckDB can say the same over whole tables."""

from __future__ import annotations

from quarrion.llm.addresses import same_location
from quarrion.llm.components import listing_groups
from quarrion.llm.entities import SURE, matched
from quarrion.llm.leaks import leaked
from quarrion.llm.products import offered_versions
from quarrion.llm.residue import residue
from quarrion.llm.tokens import round_trip, token_ids
from quarrion.session import table

SOURCES = ("tx_directory", "state_registry", "dealerships")


def _entities(s, d):
    return matched({n: table(s, d, n) for n in SOURCES}, table(s, d, "osm_sample"), table(s, d, "zip_coords")).where(f"confidence >= {SURE}")


QUERIES = {
    "p1_found": lambda s, d: _entities(s, d).select("key_a", "key_b"),
    "p1_confidence": lambda s, d: _entities(s, d).select("key_a", "key_b", "confidence"),
    "p3_found": lambda s, d: listing_groups(table(s, d, "listings"), table(s, d, "listing_pairs")),
    "p8_ids": lambda s, d: token_ids(table(s, d, "documents")),
    "p8_round_trip": lambda s, d: round_trip(table(s, d, "documents")),
    "p10_found": lambda s, d: residue(table(s, d, "documents")).select("doc_id").distinct(),
    "p10_reasons": lambda s, d: residue(table(s, d, "documents")),
    "p9_found": lambda s, d: leaked(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "item_id"),
    "p9_shares": lambda s, d: leaked(table(s, d, "documents"), table(s, d, "eval_items")),
    "p5_found": lambda s, d: offered_versions(table(s, d, "listings"), table(s, d, "vehicle_versions")),
    "p7_found": lambda s, d: same_location({n: table(s, d, n) for n in SOURCES}, table(s, d, "zip_coords")),
}

SQL = {
    "p3_found": r"""
WITH RECURSIVE decided AS (
  SELECT least(id_a, id_b) AS a, greatest(id_a, id_b) AS b, is_match,
         row_number() OVER (PARTITION BY least(id_a, id_b), greatest(id_a, id_b) ORDER BY decided_at DESC, pair_id DESC) AS n
  FROM listing_pairs WHERE id_a <> id_b),
keys AS (SELECT id, 'g' || duplicate_group_id AS key FROM listings WHERE duplicate_group_id IS NOT NULL
         UNION ALL SELECT id, 'v' || upper(regexp_replace(vin, '[\s\-]', '', 'g')) FROM listings WHERE length(regexp_replace(vin, '[\s\-]', '', 'g')) = 17),
star AS (SELECT id AS a, min(id) OVER (PARTITION BY key) AS b FROM keys),
e AS (SELECT a, b FROM decided WHERE n = 1 AND is_match = 1 UNION SELECT a, b FROM star WHERE a <> b),
edges AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS id, a AS r FROM edges UNION SELECT edges.b, reach.r FROM reach JOIN edges ON edges.a = reach.id WHERE reach.r < edges.b)
SELECT id, min(r) AS group_id FROM reach GROUP BY id
""",
}
