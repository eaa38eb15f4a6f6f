"""CRC-32 as a DuckDB expression, for the SQL of queries that use Spark's ``crc32``."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text expression: each byte goes in, then eight shifts, here ``-1``, follow."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda x: [ord(x), -1, -1, -1, -1, -1, -1, -1, -1]))"
    fed = "CASE WHEN x >= 0 THEN xor(c, x::BIGINT) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce({steps}, lambda c, x: {fed}, 4294967295::BIGINT), 4294967295)"
