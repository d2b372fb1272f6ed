"""Point records and node counts as bytes, built as hexadecimal text so that Spark stays in one expression.

A number is written seven bits a byte, low bits first, with the high bit set on all but the last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES = 9


def _byte(v: Column) -> Column:
    return F.lpad(F.hex(v), 2, "0")


def varint_hex(v: Column) -> Column:
    """Hex of a number from 0 to 2**63 - 1; null below zero, where the format would lose bits."""
    n = v.cast("long")
    out = None
    for size in range(MOST_BYTES, 0, -1):
        parts = [
            _byte(F.shiftright(n, 7 * k).bitwiseAND(F.lit(127)) + F.lit(128 if k < size - 1 else 0)) for k in range(size)
        ]
        whole = F.concat(*parts)
        out = whole if out is None else F.when(n < F.lit(1 << (7 * size)), whole).otherwise(out)
    return F.when(n >= 0, out)


def varint(v: Column) -> Column:
    return F.unhex(varint_hex(v))


def quantise(c: Column, offset: Column, scale: float) -> Column:
    """(c - offset) / scale, cut toward zero."""
    q = (c - offset) / F.lit(scale)
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("long")


def record_hex(qx: Column, qy: Column, qz: Column, r: Column, g: Column, b: Column) -> Column:
    """Three varints and three colour bytes."""
    return F.concat(*[varint_hex(q) for q in (qx, qy, qz)], *[_byte(c.bitwiseAND(F.lit(255))) for c in (r, g, b)])


def normal_hex(c: Column, scale: float) -> Column:
    """A component of a normal as a varint of whole numbers of scale. The format has no sign, so a negative number v is
    written as 2 * -v - 1 and others as 2 * v."""
    v = quantise(c, F.lit(0.0), scale)
    return varint_hex(F.when(v < 0, -2 * v - 1).otherwise(2 * v))


def to_little_endian(v: Column, size: int) -> Column:
    """Hex of the low size bytes (1 to 8) of a whole number, the lowest first; negative numbers in two's complement."""
    n = v.cast("long")
    return F.concat(*[_byte(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))) for k in range(size)])


def from_little_endian(data: Column, size: int, signed: bool = True) -> Column:
    """The whole number in the first size bytes of hex; unsigned numbers of eight bytes do not fit and are signed."""
    out = None
    for k in range(size):
        byte = F.conv(F.substring(data, 2 * k + 1, 2), 16, 10).cast("long")
        out = F.shiftleft(byte, 8 * k) if out is None else out.bitwiseOR(F.shiftleft(byte, 8 * k))
    if signed and size < 8:
        out = F.when(out >= F.lit(1 << (8 * size - 1)), out - F.lit(1 << (8 * size))).otherwise(out)
    return out


def double_from_little_endian(data: Column) -> Column:
    """The number in the first eight bytes of hex in IEEE 754; null where it is not finite."""
    bits = from_little_endian(data, 8)
    power = F.shiftright(bits, 52).bitwiseAND(F.lit(2047)).cast("int")
    whole = bits.bitwiseAND(F.lit((1 << 52) - 1))
    lead = F.when(power > 0, whole.bitwiseOR(F.lit(1 << 52))).otherwise(whole).cast("double")
    step = F.greatest(power, F.lit(1)) - 1075
    half = F.floor(step / 2).cast("int")  # two factors, since one alone may leave the range
    size = lead * F.pow(F.lit(2.0), half.cast("double")) * F.pow(F.lit(2.0), (step - half).cast("double"))
    return F.when(power < 2047, F.when(bits < 0, -size).otherwise(size))


def count_code(n: Column) -> Column:
    """A count in one byte: leading digits rounded half up, and the power of ten in the high bits."""
    digits = F.length(n.cast("string"))
    power = F.when(n > 0, digits - 1).otherwise(0)
    lead = F.floor(n / F.pow(F.lit(10.0), power.cast("double")) + F.lit(0.5))
    return (lead.cast("int").bitwiseOR(F.shiftleft(power, 4))).cast("int")


def decode_records(data: bytes, offset: tuple[float, float, float], scale: float, normals: bool = False) -> list[tuple]:
    """(x, y, z, r, g, b) of a node's payload, and the three components of the normal where records have them."""
    out, at = [], 0

    def three() -> list[int]:
        nonlocal at
        found = []
        for _ in range(3):
            v, shift = 0, 0
            while True:
                byte = data[at]
                at += 1
                v |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    break
            found.append(v)
        return found

    while at < len(data):
        place = [o + v * scale for o, v in zip(offset, three(), strict=True)]
        colour = data[at : at + 3]
        at += 3
        normal = [scale * (-(v + 1) // 2 if v % 2 else v // 2) for v in three()] if normals else []
        out.append((*place, *colour, *normal))
    return out
