"""Keys and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def morton(x: Column, y: Column, z: Column, level: int) -> Column:
    """The octree key of whole cell numbers below 2**level: their bits interleaved, x lowest."""
    key = F.lit(0).cast("long")
    for i in range(level):
        for j, c in enumerate((x, y, z)):
            bit = F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1).cast("long"))
            key = key.bitwiseOR(F.shiftleft(bit, 3 * i + j))
    return key


def bytes_of(number: Column) -> Column:
    """A 32-bit number as four bytes, highest first."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0"))


def sha1_state(state: Column, index: Column) -> Column:
    """The 20 bytes of SHA-1(state, index as four bytes): a splittable random generator."""
    return F.unhex(F.sha1(F.concat(state, bytes_of(index))))


def state_value(state: Column) -> Column:
    """The last four bytes without their sign, over 2**31: in [0, 1)."""
    return F.conv(F.hex(F.substring(state, 17, 4)), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF).cast("long")) / F.lit(2147483648.0)


def hash_unit(*columns: Column) -> Column:
    """A number in (0, 1) by hash."""
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def tokens(text: Column) -> Column:
    """Runs of characters between white space."""
    return F.filter(F.split(text, "\\s+"), lambda t: t != "")
