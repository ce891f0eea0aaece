"""Bit sets over 64-bit hashes: a small filter on every executor for keys that a table holds."""
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 28


def bits_of(keys: DataFrame, most=MOST_BITS) -> np.ndarray:
    """The bit set of the long column `key`, some 32 bits a key but at most `most`: 32 MB, which is all that the driver receives.

    With more keys it lets more through, but never loses one."""
    bits, wanted = 1 << 18, 32 * keys.count()
    while bits < min(wanted, most):
        bits *= 2
    place = F.col("key").bitwiseAND(F.lit(bits - 1)) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in maps:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Keys (unsigned) whose bit is set."""
    at = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
