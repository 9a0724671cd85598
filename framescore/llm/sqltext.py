"""SQL fragments that several oracles share."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII text expression in DuckDB, worked out bit by bit."""
    return f"""xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::INT, 1))::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
    ))"""
