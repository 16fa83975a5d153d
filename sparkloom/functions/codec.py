"""Gap and variable-length integer coding of posting lists.

A value of -112 to 127 is one byte.  Any other is a marker byte followed by the
magnitude in big-endian order: -112 - n marks n bytes of a positive value, and
-120 - n marks n bytes of the complement of a negative one.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_int(value: int) -> bytes:
    if -112 <= value <= 127:
        return bytes([value & 0xFF])
    rest = ~value if value < 0 else value
    size = max(1, (rest.bit_length() + 7) // 8)
    marker = (-120 if value < 0 else -112) - size
    return bytes([marker & 0xFF]) + rest.to_bytes(size, "big")


def decode_ints(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        head = data[at] - 256 if data[at] > 127 else data[at]
        at += 1
        if head >= -112:
            out.append(head)
            continue
        negative = head < -120
        size = -(head + 120) if negative else -(head + 112)
        rest = int.from_bytes(data[at : at + size], "big")
        at += size
        out.append(~rest if negative else rest)
    return out


def encode_postings(ids: Iterable[int], counts: Iterable[int]) -> bytes:
    """(gap, count) pairs of ascending ids."""
    out, before = bytearray(), 0
    for i, c in zip(ids, counts, strict=True):
        out += encode_int(i - before) + encode_int(c)
        before = i
    return bytes(out)


def decode_postings(data: bytes) -> tuple[list[int], list[int]]:
    flat = decode_ints(data)
    ids, total = [], 0
    for gap in flat[::2]:
        total += gap
        ids.append(total)
    return ids, flat[1::2]


def _hex(x: str) -> str:
    """SQL: the bytes of the integer x, in hexadecimal digits."""
    rest = f"IF({x} < 0, ~{x}, {x})"
    size = f"(length(hex({rest})) + 1) div 2"
    marker = f"right(hex(IF({x} < 0, -120L, -112L) - {size}), 2)"
    return f"CASE WHEN {x} BETWEEN -112 AND 127 THEN right(concat('0', hex({x})), 2) ELSE concat({marker}, lpad(hex({rest}), cast(2 * ({size}) as int), '0')) END"


def encoded(ids: str, counts: str, before: str = "0L") -> Column:
    """``encode_postings`` of two array columns of longs, as an expression; ``before`` is the id before the first.

    The arrays are bound before the loop: as columns they would be made again for each of their elements.
    """
    gap = _let("v - IF(i = 0, s.b, s.ids[i - 1])", _hex("x"))
    pairs = f"unhex(array_join(transform(s.ids, (v, i) -> concat({gap}, {_let('cast(s.counts[i] as bigint)', _hex('x'))})), ''))"
    return F.expr(_let(f"struct({ids} AS ids, {counts} AS counts, {before} AS b)", pairs, "s"))


def _let(value: str, body: str, name: str = "x") -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


@F.pandas_udf(T.ArrayType(T.LongType()))
def decoded_ids(data: pd.Series) -> pd.Series:
    return pd.Series([decode_postings(bytes(x))[0] for x in data])
