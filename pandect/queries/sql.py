"""Pieces of SQL that several oracles share."""

from __future__ import annotations

#: Blanks of all scripts, inside of a character class of the oracle's engine.
B = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
P = r"^.*?([a-z]+)[^a-z0-9]+([0-9]{4})[^a-z0-9]+([0-9]+)[^a-z0-9]*$"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[{B}]+|[{B}]+$', '', 'g')"


def key_sql(x: str) -> str:
    """SQL for the normal form of a law reference."""
    return rf"CASE WHEN regexp_matches(lower({x}), '{P}') THEN regexp_replace(lower({x}), '{P}', 'UK_\1_\2_\3') ELSE nullif({strip_sql(x)}, '') END"


NL = "nl AS (SELECT * EXCLUDE (record_change_log) FROM uk_lrt WHERE updated_at IS NOT NULL AND name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY updated_at DESC, synced_at) = 1)"
NU = f"nu AS (SELECT * REPLACE ({key_sql('law_name')} AS law_name) FROM lat WHERE updated_at IS NOT NULL AND section_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY updated_at DESC, synced_at) = 1)"
NA = f"na AS (SELECT * REPLACE ({key_sql('law_name')} AS law_name) FROM amendment_annotations WHERE updated_at IS NOT NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, synced_at) = 1)"
