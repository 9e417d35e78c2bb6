"""Bloom filters of 64-bit hashes, with three places each.

A filter has 16 bits a hash, 4 MB at least and MOST_BITS (128 MB) at most: beyond that more of the other hashes pass, and
none of its own is lost. Its bytes are put together in blocks on the executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: The filter's places, as powers of two; places for each hash; places put together in one block.
LEAST_BITS, MOST_BITS, PER_HASH, BLOCK = 25, 30, 16, 16
#: Multipliers of a hash's places.
_PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(hashes * np.uint64(m)) >> np.uint64(64 - bits) for m in _PLACES]


def build(known: DataFrame) -> np.ndarray:
    """The filter's bytes. known: a written table with one column of longs."""
    bits = min(MOST_BITS, max(LEAST_BITS, (PER_HASH * known.count()).bit_length()))

    def scan(batches):
        for b in batches:
            s = np.unique(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            p = np.unique(np.concatenate(places(s, bits)))
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(BLOCK)).astype(np.int32)), pa.array((p & np.uint64((1 << BLOCK) - 1)).astype(np.int32))], ["block", "place"])

    def fill(key, pdf):
        on = np.zeros(1 << BLOCK, np.uint8)
        on[pdf["place"].to_numpy()] = 1
        return pd.DataFrame({"block": [key[0]], "bytes": [np.packbits(on, bitorder="little").tobytes()]})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in known.mapInArrow(scan, "block int, place int").distinct().groupBy("block").applyInPandas(fill, "block int, bytes binary").collect():
        at = r["block"] << (BLOCK - 3)
        out[at : at + (1 << (BLOCK - 3))] = np.frombuffer(r["bytes"], np.uint8)
    return out


def passing(hashes: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    """Positions of the hashes that may be known."""
    at, bits = np.arange(len(hashes)), len(filter_).bit_length() + 2
    for m in _PLACES:
        p = (hashes[at] * np.uint64(m)) >> np.uint64(64 - bits)
        at = at[(filter_[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    return at
