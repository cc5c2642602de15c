"""Blocked Bloom filter over 64-bit hashes: blocks of eight 32-bit words with one bit in each.

The filter is built by Spark as a table of blocks and has at most `MAX_BLOCKS` of them, so its size is
bounded; more keys make it fuller, not larger. It never misses a key; what follows must be exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

MAX_BLOCKS = 1 << 20  # 32 MB
KEYS_PER_BLOCK = 20  # 12.8 bits a key
# The odd multipliers of the split block filter of the Parquet format, one for each word of a block.
SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]


def bloom_blocks(keys: DataFrame, hash_col: str, blocks: int) -> DataFrame:
    """(block, w0..w7); bits are united before the shuffle."""
    h = F.col(hash_col)
    words = [  # 31 bits of the hash times a salt stay below 2^63
        F.expr(f"shiftleft(1L, cast(shiftrightunsigned((`{hash_col}` & 2147483647L) * {s}L & 4294967295L, 27) as int))").alias(f"w{i}")
        for i, s in enumerate(SALTS)
    ]
    rows = keys.select(F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(blocks - 1).cast("long")).alias("block"), *words)
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(len(SALTS))])


def bloom_table(keys: DataFrame, hash_col: str, count: int, max_blocks: int = MAX_BLOCKS) -> np.ndarray:
    """The filter as an array (blocks x 8): a power of two of blocks, `max_blocks` at most."""
    blocks = 1
    while blocks < max_blocks and blocks * KEYS_PER_BLOCK < count:
        blocks *= 2
    rows = bloom_blocks(keys, hash_col, blocks).toArrow()
    table = np.zeros((blocks, len(SALTS)), np.uint32)
    at = rows["block"].to_numpy()
    for i in range(len(SALTS)):
        table[at, i] = rows[f"w{i}"].to_numpy().astype(np.uint32)
    return table


def may_contain(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False only for hashes that are not in the filter."""
    h = np.asarray(hashes).astype(np.int64, copy=False).view(np.uint64)
    rows = table[((h >> np.uint64(32)) & np.uint64(len(table) - 1)).astype(np.int64)]
    low = (h & np.uint64(0x7FFFFFFF)).astype(np.uint32)
    bits = np.uint32(1) << ((low[:, None] * np.array(SALTS, np.uint32)) >> np.uint32(27))
    return ((rows & bits) == bits).all(axis=1)
