"""SQL text that several document queries share."""

from __future__ import annotations

#: CTEs ending in ``crc_table(t)``: the 256 remainders of the reflected CRC-32 polynomial.
CRC_TABLE = """
crc_steps as (
  select i, i::bigint as v, 0 as k from (select unnest(range(256)) as i)
  union all
  select i, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, k + 1 from crc_steps where k < 8),
crc_table as (select list(v order by i) as t from crc_steps where k = 8)"""


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text expression; ``t`` of ``crc_table`` must be in scope."""
    places = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    folded = f"list_reduce([4294967295::bigint] || {places}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))"
    return f"xor({folded}, 4294967295)"
