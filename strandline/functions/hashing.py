"""Repeatable draws.

A draw is a pure function of (seed, row key, position), so it does not depend on
partitioning, retries or the engine, and any SQL dialect with md5 can repeat it.
"""

import math
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

HASH_RANGE = 2.0**32


def hash_hex(*parts) -> Column:
    """First 32 bits of the md5 of the parts joined by ':', as 8 hex digits.

    Their order as text is their order as numbers, so draws compare without a conversion.
    """
    return F.substring(whole_hash(*parts), 1, 8)


def whole_hash(*parts) -> Column:
    """All 32 hex digits: different parts don't tie."""
    return F.md5(F.concat_ws(":", *[_column(p).cast("string") for p in parts]))


def hash32(*parts) -> Column:
    """The same bits as a long."""
    return F.conv(hash_hex(*parts), 16, 10).cast("long")


def draw(*parts) -> Column:
    """Uniform double in [0, 1) decided by the parts."""
    return hash32(*parts) / F.lit(HASH_RANGE)


def hex_bar(share: float) -> Column:
    """What ``hash_hex`` stays below with probability ``share``, exactly as draw() < share."""
    bar = math.ceil(share * HASH_RANGE)
    return F.lit(f"{bar:08x}" if bar < HASH_RANGE else "g")


def hit(share: float, *parts) -> Column:
    """True with probability ``share``."""
    return hash_hex(*parts) < hex_bar(share)


def hits(share: float, n: Column, *parts) -> Column:
    """For each i below ``n`` ``hit(share, *parts, i)``, as an array; null without ``n``. Many draws a row cost less in Python."""
    bar = math.ceil(share * HASH_RANGE)

    @F.arrow_udf("array<boolean>")
    def drawn(prefixes: pa.Array, sizes: pa.Array) -> pa.Array:
        counts = sizes.fill_null(0).to_numpy().astype(np.int64).clip(0)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        numbers = [b"%d" % i for i in range(int(counts.max(initial=0)))]
        found = bytearray(4 * int(offsets[-1]))
        for prefix, start, count in zip(prefixes.to_pylist(), offsets.tolist(), counts.tolist()):
            before = prefix.encode()
            found[4 * start : 4 * (start + count)] = b"".join([md5(before + i).digest()[:4] for i in numbers[:count]])
        low = np.frombuffer(found, ">u4").astype(np.int64) < bar
        lists = pa.array(offsets.astype(np.int32))
        return pa.ListArray.from_arrays(lists, pa.array(low, pa.bool_()), mask=sizes.is_null() if sizes.null_count else None)

    return drawn(F.concat_ws(":", *[_column(p).cast("string") for p in [*parts, ""]]), n)


def _column(part):
    return part if isinstance(part, Column) else F.lit(part)
