"""Texts of letters, their tokens, and the order of tokens.

A *text* is a sequence of letters A-Z with an id, a group (texts of different groups never meet) and an integer for the
caller's use. Its *tokens* are its different 5-grams. A `Ranking` puts all tokens into one global order and says how
many of the first ones of a text are *listed*.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resiq.functions.lcs import residue_codes

Q = 5
SPAN = 26**Q
CHUNK = 1 << 13
TEXT_SCHEMA = "tid long, res string, grp int, x int"
#: No token's key.
NONE = np.uint32(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers that looks random."""
    x = x.astype(np.uint32, copy=True)
    for shift, odd in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(odd)
    return x ^ (x >> np.uint32(16))


ODDS = (0x6B4A2D, 0x35C1F7)
LOW24 = np.uint32(0xFFFFFF)


def mix24(x: np.ndarray) -> np.ndarray:
    """A bijection of 24-bit integers, which hold every code of a token."""
    x = x.astype(np.uint32)
    for odd in ODDS:
        x *= np.uint32(odd)
        x &= LOW24
        x ^= x >> np.uint32(12)
    return x


def unmix24(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint32)
    for odd in reversed(ODDS):
        x = x ^ (x >> np.uint32(12))
        x = (x * np.uint32(pow(odd, -1, 1 << 24))) & LOW24
    return x


class Packed:
    """A byte for each token as a broadcast of compressed bytes, opened once a task."""

    def __init__(self, held) -> None:
        self.held, self._table = held, None

    def __getstate__(self) -> dict:
        return {"held": self.held, "_table": None}

    @property
    def value(self) -> np.ndarray:
        if self._table is None:
            self._table = np.frombuffer(pa.decompress(self.held.value, decompressed_size=SPAN, codec="zstd", asbytes=True), np.uint8)
        return self._table


@dataclass(frozen=True)
class Ranking:
    """The order of tokens: by class (0 to 254), then by a hash.

    listed(n): how many of n tokens to list, vectorised. classes: a byte for each of the SPAN tokens, as an array or
    `Packed`; None for one class. idf: the weight of each class. cosine, norm: where cosine > 0, the last tokens
    of a text stay unlisted as long as they cannot bring a dot product of unit vectors to `cosine` by themselves:
    by their residual norm, or by the largest weight that each can have on the other side, whose vector's
    norm is `norm` at least."""

    listed: Callable[[np.ndarray], np.ndarray]
    classes: Any = None
    idf: tuple[float, ...] = ()
    cosine: float = 0.0
    norm: float = 1.0

    def table(self) -> np.ndarray | None:
        return getattr(self.classes, "value", self.classes)

    def key(self, code: np.ndarray) -> np.ndarray:
        """A 32-bit key for each token's code, different for different codes; smaller comes first."""
        out, table = mix24(code), self.table()
        return out if table is None else out | (table[code].astype(np.uint32) << np.uint32(24))

    @staticmethod
    def code(key: np.ndarray) -> np.ndarray:
        return unmix24(key & LOW24)

    def weights(self, key: np.ndarray) -> np.ndarray:
        """Inverse document frequencies of tokens by their keys."""
        return np.asarray(self.idf)[key >> np.uint32(24)]

    def needed(self, owner: np.ndarray, key: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Which tokens, in order for each text, the bounds for the cosine leave to be listed."""
        square = self.weights(key) ** 2
        total = np.bincount(owner, weights=square, minlength=len(count))
        sums = np.cumsum(square)
        rest = (sums[np.maximum(np.cumsum(count) - 1, 0)])[owner] - sums + square  # of this token and all after it
        return np.minimum(np.sqrt(rest / total[owner]), rest / (np.sqrt(total[owner]) * self.norm)) >= self.cosine * (1 - 1e-9)


COLUMNS = (("tid", "<i8"), ("size", "<i4"), ("grp", "<i4"), ("x", "<i4"), ("many", "<i4"))


def planes(v: np.ndarray, kind: str) -> bytes:
    """Integers as planes of bytes, so that high zero bytes cost nothing once compressed."""
    return np.ascontiguousarray(v.astype(kind).view(np.uint8).reshape(len(v), -1).T).tobytes()


@dataclass
class Texts:
    """Texts as columns; letters are codes 0..25."""

    tid: np.ndarray
    flat: np.ndarray
    size: np.ndarray
    grp: np.ndarray
    x: np.ndarray
    start: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.start = np.cumsum(self.size) - self.size

    def __len__(self) -> int:
        return len(self.tid)

    def take(self, rows: np.ndarray) -> Texts:
        size = self.size[rows]
        flat, put = np.empty(int(size.sum()), self.flat.dtype), 0
        for lo in range(0, len(rows), CHUNK):  # in parts that stay in the processor's cache
            n = size[lo : lo + CHUNK]
            at = np.repeat(self.start[rows[lo : lo + CHUNK]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            flat[put : put + len(at)] = self.flat[at]
            put += len(at)
        return Texts(self.tid[rows], flat, size, self.grp[rows], self.x[rows])

    def slice(self, lo: int, hi: int) -> Texts:
        a = int(self.start[lo]) if lo < len(self) else len(self.flat)
        return Texts(self.tid[lo:hi], self.flat[a : a + int(self.size[lo:hi].sum())], self.size[lo:hi], self.grp[lo:hi], self.x[lo:hi])

    def letters(self) -> list[str]:
        whole = (self.flat + np.uint8(65)).astype(np.uint8).tobytes().decode("ascii")
        return [whole[a : a + n] for a, n in zip(self.start.tolist(), self.size.tolist(), strict=True)]

    @staticmethod
    def of(batch: pa.RecordBatch) -> Texts:
        flat, _, size = residue_codes(batch.column("res"))
        ints = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "x")]
        return Texts(batch.column("tid").to_numpy(zero_copy_only=False), flat, size, *ints)

    @staticmethod
    def concat(parts: list[Texts]) -> Texts:
        return Texts(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("tid", "flat", "size", "grp", "x")))

    def pack(self, many: np.ndarray, place: np.ndarray) -> bytes:
        """Compressed, with `many` places for each text. Best if ids rise."""
        cols = {"tid": np.diff(self.tid, prepend=0), "size": self.size, "grp": self.grp, "x": self.x, "many": many}
        raw = b"".join(planes(cols[c], kind) for c, kind in COLUMNS) + planes(place, "<i4") + self.flat.astype(np.uint8).tobytes()
        return struct.pack("<III", len(self), len(place), len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)

    @staticmethod
    def unpack(blob: bytes) -> tuple[Texts, np.ndarray, np.ndarray]:
        """(texts, text of each place, place)."""
        n, m, total = struct.unpack_from("<III", blob)
        raw = pa.decompress(memoryview(blob)[12:], decompressed_size=total, codec="zstd", asbytes=True)
        cols, at = {}, 0
        for c, kind, k in [*((c, kind, n) for c, kind in COLUMNS), ("place", "<i4", m)]:
            width = int(kind[2])
            cols[c] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, k * width, at).reshape(width, k).T).view(kind).reshape(k)
            at += k * width
        t = Texts(np.cumsum(cols["tid"]), np.frombuffer(raw, np.uint8, total - at, at), cols["size"].astype(np.int64), cols["grp"], cols["x"])
        return t, np.repeat(np.arange(n), cols["many"]), cols["place"].astype(np.int64)


@dataclass
class Postings:
    """Tokens of texts in the order (text, key), with a place where each stands."""

    text: np.ndarray
    key: np.ndarray
    place: np.ndarray


def codes(t: Texts) -> np.ndarray:
    """The code of the token that starts at each place of `flat`; without meaning at the last Q - 1 letters of a text."""
    out = np.zeros(len(t.flat), np.uint32)
    n = len(out) - Q + 1
    if n > 0:
        for k in range(Q):
            out[:n] = out[:n] * np.uint32(26) + t.flat[k : n + k]
    return np.minimum(out, np.uint32(SPAN - 1))


def codes_at(t: Texts, text: np.ndarray, place: np.ndarray) -> np.ndarray:
    out, at = np.zeros(len(text), np.uint32), t.start[text] + place
    for k in range(Q):
        out = out * np.uint32(26) + t.flat[at + k]
    return out


#: Keys of a matrix that is sorted at once, so that it stays in the processor's cache.
AT_ONCE = 1 << 17


def key_rows(t: Texts, ranking: Ranking, places: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(texts, matrix): texts of like sizes as rows of their sorted keys, filled up with the largest integer. places: 64 bits, the
    key before its place; else the keys alone."""
    end = np.iinfo(np.uint64 if places else np.uint32).max
    for first in range(0, len(t), CHUNK):
        few = t.slice(first, min(len(t), first + CHUNK))
        n = np.maximum(few.size - Q + 1, 0)
        wide = np.where(n <= 128, -(-n // 8) * 8, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
        keys = np.concatenate([ranking.key(codes(few)), np.zeros(int(wide.max(initial=0)), np.uint32)])
        for w in np.unique(wide[n > 0]).tolist():
            own, place = np.flatnonzero(wide == w), np.arange(w)
            windows, step = np.lib.stride_tricks.sliding_window_view(keys, w), max(1, AT_ONCE // w)
            for lo in range(0, len(own), step):
                rows = own[lo : lo + step]
                m = windows[few.start[rows]]
                if places:
                    m = (m.astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64)
                m[place >= n[rows, None]] = end
                m.sort(axis=1)
                yield first + rows, m


def tokens(t: Texts, ranking: Ranking, whole: bool = False, places: bool = True) -> Postings:
    """Listed tokens (all tokens if `whole`) of the texts. Without `places`, which take longer, they are told as 0."""
    count, parts = np.zeros(len(t), np.int64), []
    for rows, m in key_rows(t, ranking, places):
        key = (m >> np.uint64(32)).astype(np.uint32) if places else m
        keep = key != NONE
        keep[:, 1:] &= key[:, 1:] != key[:, :-1]
        n = keep.sum(axis=1)
        if not whole:
            listed = ranking.listed(n)
            if (n > listed).any():
                keep &= np.cumsum(keep, axis=1, dtype=np.int32) <= listed[:, None]
                n = np.minimum(n, listed)
        count[rows] = n
        parts.append((rows, key[keep], m[keep] & np.uint64(0xFFFFFFFF) if places else 0))
    start = np.cumsum(count) - count
    text = np.repeat(np.arange(len(t)), count)
    key, place = np.zeros(len(text), np.uint32), np.zeros(len(text), np.int64)
    for rows, own, at in parts:
        n = count[rows]
        put = np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(len(own))
        key[put] = own
        if places:
            place[put] = at
    p = Postings(text, key, place)
    if ranking.cosine and not whole:
        keep = ranking.needed(text, key, count)
        p = Postings(text[keep], key[keep], place[keep])
    return p


def first_keys(t: Texts, ranking: Ranking, width: int) -> np.ndarray:
    """The first `width` keys of each text as a row, filled up with NONE."""
    out = np.full((len(t), width), NONE)
    for rows, m in key_rows(t, ranking, False):
        twice = (m[:, 1:] == m[:, :-1]) & (m[:, 1:] != NONE)
        some = np.flatnonzero(twice.any(axis=1))
        if len(some):
            few = m[some]
            few[:, 1:][twice[some]] = NONE
            few.sort(axis=1)
            m[some] = few
        out[rows, : m.shape[1]] = m[:, :width]
    return out


def regroup(batches: Iterator[pa.RecordBatch], rows: int = CHUNK) -> Iterator[Texts]:
    """Batches of texts joined to at least `rows` texts."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(Texts.of(b))
            n += b.num_rows
        if n >= rows:
            yield Texts.concat(held)
            held, n = [], 0
    if held:
        yield Texts.concat(held)


# Counts of tokens

RANGES = 64
WIDTH = -(-SPAN // RANGES)
#: 3-grams: the bucket of a token goes by the one of smallest hash in it, which neighbouring tokens often share.
MINI = 26**3
RANK_OF = np.argsort(np.argsort(mix(np.arange(MINI)))).astype(np.uint16)


def minimizer(code: np.ndarray) -> np.ndarray:
    """The place of the token's 3-gram of smallest hash in the order of hashes."""
    high = code // np.uint32(26)
    mid = high % np.uint32(MINI)
    return np.minimum(np.minimum(RANK_OF[high // np.uint32(26)], RANK_OF[mid]), RANK_OF[code % np.uint32(MINI)])


def minimizer4(code: np.ndarray) -> np.ndarray:
    """The smaller hash of the token's two 4-grams."""
    return np.minimum(mix(code // np.uint32(26)), mix(code % np.uint32(26**4)))


@dataclass
class Counts:
    """n: texts. postings: sum of all counts. df: class of each token's document frequency (eighths of its binary
    logarithm, rounded up; 0 for none and one). hot: the codes of the tokens of more than `hot` texts, rising, and their
    counts. load: postings by minimizer."""

    n: int
    postings: int
    df: np.ndarray
    hot_code: np.ndarray
    hot_n: np.ndarray
    load: np.ndarray

    def idf(self) -> tuple[float, ...]:
        return tuple(np.log1p(self.n / 2 ** (np.arange(256) / 8)).tolist())


def token_counts(texts: DataFrame, hot: int, least: int = 0) -> Counts:
    """In how many texts each token stands, exactly; `df` tells tokens of at most `least` texts as 0. A task sends its counts in RANGES compressed pieces; what comes to
    the driver is a byte a token (SPAN, 12 MB, whatever the data's size), a sum a minimizer, and the hot tokens, which
    are at most postings / hot and at most SPAN."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        plain = Ranking(lambda k: k)
        for t in regroup(batches, 4 * CHUNK):
            p = tokens(t, plain, whole=True, places=False)
            code, m = np.unique(Ranking.code(p.key), return_counts=True)
            total = np.zeros(SPAN, np.int32) if total is None else total
            total[code] += m.astype(np.int32)
            n += len(t)
        if total is not None:
            some = np.flatnonzero(total)
            edges = np.searchsorted(some, np.arange(RANGES + 1) * WIDTH)
            for r in range(RANGES):
                own = some[edges[r] : edges[r + 1]]
                if len(own) or r == 0:
                    raw = planes(np.diff(own, prepend=0), "<i4") + planes(total[own], "<i4")
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([n if r == 0 else 0], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary())], ["r", "n", "m", "blob"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        n = 0
        for b in batches:
            for r, texts_here, m, blob in zip(*(b.column(c).to_pylist() for c in ("r", "n", "m")), b.column("blob"), strict=True):
                n += texts_here
                raw = pa.decompress(blob.as_buffer(), decompressed_size=8 * m, codec="zstd", asbytes=True)
                own, c = (np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * m, 4 * m * k).reshape(4, m).T).view("<i4").reshape(m) for k in (0, 1))
                total = held.setdefault(r, np.zeros(WIDTH, np.int64))
                total[np.cumsum(own) - r * WIDTH] += c
        for r, total in held.items():
            code = np.flatnonzero(total)
            c = total[code]
            df = np.zeros(WIDTH, np.uint8)
            df[code] = np.where(c > least, np.minimum(254, np.ceil(8 * np.log2(c))), 0)
            code += r * WIDTH
            load = np.bincount(minimizer(code.astype(np.uint32)), weights=c, minlength=MINI).astype(np.int64)
            many = c > hot
            cells = [df, load, code[many].astype(np.int64), c[many]]
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([n], pa.int64()), *(pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True)], pa.binary()) for x in cells), pa.array([int(many.sum())], pa.int64())], ["r", "n", "df", "load", "code", "c", "k"])
            n = 0

    tasks = min(RANGES, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = texts.select("tid", "res", "grp", "x").mapInArrow(count, "r int, n long, m long, blob binary")
    rows = parts.repartitionById(tasks, F.pmod("r", F.lit(tasks))).mapInArrow(merge, "r int, n long, df binary, load binary, code binary, c binary, k long").collect()
    df, load, code, c = np.zeros(RANGES * WIDTH, np.uint8), np.zeros(MINI, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in sorted(rows, key=lambda x: x.r):
        get = lambda name, kind, k, x=x: np.frombuffer(pa.decompress(x[name], decompressed_size=k * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)
        df[x.r * WIDTH : (x.r + 1) * WIDTH] = get("df", np.uint8, WIDTH)
        load += get("load", np.int64, MINI)
        if x.k:
            code.append(get("code", np.int64, x.k))
            c.append(get("c", np.int64, x.k))
    return Counts(sum(x.n for x in rows), int(load.sum()), df[:SPAN], np.concatenate(code).astype(np.uint32), np.concatenate(c), load)
