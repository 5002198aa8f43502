"""Pieces of DuckDB SQL that several operators' SQL shares."""

from __future__ import annotations


class CRC32:
    """The checksum as SQL: select from TABLE as `crc` (one row, column `steps`) and use of(expression)."""

    #: Eight shifts for each value of a byte, with the reflected polynomial.
    TABLE = "SELECT list_transform(range(256), lambda n: list_reduce([n, 1, 1, 1, 1, 1, 1, 1, 1], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS steps"

    @staticmethod
    def of(text: str) -> str:
        """Of a text's UTF-8 bytes, as an unsigned BIGINT."""
        # DuckDB writes a blob's bytes as pairs of hexadecimal digits.
        octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
        return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda a, b: xor(a >> 8, crc.steps[(xor(a, b) & 255) + 1])), 4294967295)"
