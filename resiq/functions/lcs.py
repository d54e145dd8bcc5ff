"""Longest common subsequences of many pairs at once, bit-parallel in numpy.

One 64-bit word holds the dynamic-programming row of a pair whose shorter side has at most 64
letters; all pairs of a batch advance together, one letter of the longer side at a time. Longer
texts take the same recurrence over Python's unbounded integers, pair by pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

BATCH = 1 << 15


def lcs_long(a: str, b: str) -> int:
    """LCS length of one pair of texts of any length."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        m = masks.get(c, 0)
        v = ((v + (v & m)) | (v & ~m)) & full
    return len(a) - v.bit_count()


def lcs_codes(flat: np.ndarray, start: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, letters: int = 26) -> np.ndarray:
    """LCS lengths of the texts i[n], j[n]; text t is flat[start[t] : start[t] + size[t]] with codes below `letters`."""
    i, j = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
    out = np.zeros(len(i), np.int32)
    order = np.argsort(size[j], kind="stable")
    for at in range(0, len(order), BATCH):
        rows = order[at : at + BATCH]
        rows = rows[size[i[rows]] > 0]
        small = size[i[rows]] <= 64
        for r in rows[~small]:
            a, b = (bytes(flat[start[x] : start[x] + size[x]].astype(np.uint8)).decode("latin-1") for x in (i[r], j[r]))
            out[r] = lcs_long(a, b)
        rows = rows[small]
        if not len(rows):
            continue
        texts, slot = np.unique(i[rows], return_inverse=True)
        bits = np.zeros((len(texts), letters + 1), np.uint64)
        n = size[texts]
        owner = np.repeat(np.arange(len(texts)), n)
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        np.bitwise_or.at(bits.reshape(-1), owner * (letters + 1) + flat[start[texts][owner] + pos], np.uint64(1) << pos.astype(np.uint64))
        table, base, begin, longest = bits.reshape(-1), slot * (letters + 1), start[j[rows]], size[j[rows]]
        v = np.full(len(rows), ~np.uint64(0))
        for k in range(int(longest.max())):
            live = int(np.searchsorted(longest, k, "right"))  # rows are sorted by the longer side's size
            m = table[base[live:] + flat[begin[live:] + k]]
            w = v[live:]
            x = w & m
            v[live:] = (w + x) | (w & ~m)
        full = np.where(size[i[rows]] >= 64, ~np.uint64(0), (np.uint64(1) << (size[i[rows]].astype(np.uint64) & np.uint64(63))) - np.uint64(1))
        out[rows] = np.bitwise_count(~v & full)
    return out


def pack(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Texts as (codes, starts, sizes, number of codes)."""
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    seen = np.zeros(int(points.max(initial=0)) + 1, bool)
    seen[points] = True
    code = np.cumsum(seen, dtype=np.int32) - np.int32(1)
    return code[points], np.cumsum(size) - size, size, max(1, int(seen.sum()))


def lcs_products(a: Sequence[str], b: Sequence[str], n: int) -> np.ndarray:
    """(a x b): LCS lengths of each text with each; all have n letters."""
    flat, _, _, letters = pack([*a, *b])
    if not 0 < n <= 64 or letters > 256:
        return np.array([[lcs_long(s, t) for t in b] for s in a], np.int64).reshape(len(a), len(b))
    codes = np.ascontiguousarray(flat[len(a) * n :].reshape(len(b), n).T)
    masks = np.zeros((len(a), letters), np.uint64)
    np.bitwise_or.at(masks, (np.repeat(np.arange(len(a)), n), flat[: len(a) * n]), np.uint64(1) << np.tile(np.arange(n, dtype=np.uint64), len(a)))
    v = np.full((len(a), len(b)), ~np.uint64(0))
    for k in range(n):
        x = v & np.take(masks, codes[k], axis=1)
        v = (v + x) | (v - x)
    return np.bitwise_count(~v & (~np.uint64(0) >> np.uint64(64 - n))).astype(np.int64)


def lcs_pairs(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    flat, start, size, letters = pack([*left, *right])
    n = len(left)
    if letters > 256:  # masks would not stay small
        return np.array([lcs_long(a, b) for a, b in zip(left, right, strict=True)], np.int32)
    return lcs_codes(flat, start, size, np.arange(n), np.arange(n, 2 * n), letters)


@F.pandas_udf(IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    ok = (a.notna() & b.notna()).to_numpy()
    out = pd.array([None] * len(a), dtype="Int32")
    if ok.any():
        out[ok] = lcs_pairs(a[ok].tolist(), b[ok].tolist())
    return pd.Series(out)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence; null where a side is null."""
    return _lcs(a, b)


def residue_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes 0..25, starts, sizes) of an Arrow array of texts over A-Z, without copies a text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return flat - np.uint8(65), ends[:-1] - ends[0], np.diff(ends)
