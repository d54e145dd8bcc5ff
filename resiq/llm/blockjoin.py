"""Inverted-list join of short sequences, moved through the shuffle in packed blocks.

1. Each map task turns its texts into one compressed block for each bucket of tokens: a bucket's block holds every text
   that lists one of its tokens, once, and the places of these tokens. A token's bucket goes by its minimizer, the 3-gram
   of smallest hash in it, so that neighbouring tokens mostly share a bucket: a text is copied about half as often as
   it lists tokens, and no oftener however many buckets there are. Minimizers with too many postings for one bucket
   are spread by 4-grams.
2. Each reduce task takes the blocks of one bucket, sorts the postings by token and walks the lists, from each text over
   those of fitting length. Pairs pass an exact bound on letter counts first. A pair is kept only in the list of
   its first shared token, so no later distinct is needed: listed tokens are a prefix of the order, so the first
   shared token of all is listed by both if any is. The caller's `verify` sees each pair once, with both texts at hand.
3. Tokens that more than HOT texts hold are counted exactly (`token_counts`) and salted: their texts fall into
   chunks, and each pair of chunks is a list of its own in some bucket. No pair is lost, no task gets them all.

The bounds are those of the indel ratio r = 2 LCS / (m + n) > `ratio`: lengths and letter counts
differ by no more than m + n - 2 LCS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resiq.functions.lcs import lcs_codes
from resiq.llm.grams import CHUNK, NONE, Counts, Packed, Postings, Ranking, Texts, codes_at, first_keys, minimizer, minimizer4, mix, regroup, token_counts, tokens

#: A token that more texts hold is salted into chunks of this many texts.
HOT = 8192
#: Postings of a bucket, which bound a reduce task's memory.
POSTINGS_A_BUCKET = 1_000_000
#: Chunks of a salted token; above HOT times this, chunks are larger.
MOST_CHUNKS = 4096
#: Pairs of postings that are compared at once, and pairs after which those found are handed on.
STEP, FLUSH = 1 << 16, 1 << 20
#: Keys of pairs that are compared at once.
CELLS = 1 << 15


@dataclass(frozen=True)
class Plan:
    """What both sides of the shuffle must agree on. hot: codes of salted tokens, rising; chunks: of each of them.
    spread_out: of each minimizer, whether its tokens are spread by 4-grams."""

    ranking: Ranking
    buckets: int
    hot: np.ndarray
    chunks: np.ndarray
    spread_out: np.ndarray

    @staticmethod
    def of(ranking: Ranking, counts: Counts, buckets: int, hot: int = HOT) -> Plan:
        chunks = np.minimum(-(-counts.hot_n // hot), MOST_CHUNKS).astype(np.int64)
        return Plan(ranking, buckets, counts.hot_code, chunks, counts.load > counts.postings / buckets)

    def chunked(self, code: np.ndarray) -> np.ndarray:
        """The number of chunks of each token; 0 where it is not salted."""
        out = np.zeros(len(code), np.int64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, code), len(self.hot) - 1)
            out = np.where(self.hot[at] == code, self.chunks[at], 0)
        return out

    def bucket(self, code: np.ndarray, low: np.ndarray) -> np.ndarray:
        """low: 0, or the number of the pair of chunks plus 1."""
        own = minimizer(code).astype(np.uint32)
        much = np.flatnonzero(self.spread_out[own])
        own[much] = minimizer4(code[much]) | np.uint32(1 << 31)
        salted = np.flatnonzero(low)
        own[salted] = mix(code[salted]) ^ (low[salted].astype(np.uint32) * np.uint32(0x9E3779B1))
        return mix(own) % np.uint32(self.buckets)

    def lists(self, p: Postings, code: np.ndarray, t: Texts, bucket: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of p, list, bucket): a row for each list of each posting. A list is named by key, group and chunks.
        bucket: the one that all of p came through, so that only salted lists have to be told apart."""
        many = self.chunked(code)
        rows, low = np.arange(len(code)), np.zeros(len(code), np.int64)
        warm = np.flatnonzero(many)
        if len(warm):
            n = many[warm]
            again = np.repeat(np.arange(len(warm)), n)
            other = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
            chunk = chunk_of(t.tid[p.text[warm]], n)[again]
            cold = np.flatnonzero(many == 0)
            rows = np.concatenate([cold, warm[again]])
            low = np.concatenate([low[cold], np.minimum(chunk, other) * n[again] + np.maximum(chunk, other) + 1])
        name = (p.key[rows].astype(np.uint64) << np.uint64(32)) | (t.grp[p.text[rows]].astype(np.uint64) << np.uint64(24)) | low.astype(np.uint64)
        if bucket is None:
            return rows, name, self.bucket(code[rows], low)
        where, salted = np.full(len(rows), bucket), np.flatnonzero(low)
        where[salted] = self.bucket(code[rows[salted]], low[salted])
        return rows, name, where


def chunk_of(tid: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (mix((tid & 0xFFFFFFFF).astype(np.uint32) ^ np.uint32(0x5BD1E995)) % n.astype(np.uint32)).astype(np.int64)


def pack_blocks(t: Texts, plan: Plan) -> Iterator[tuple[int, bytes]]:
    """(bucket, block) of texts."""
    t = t.take(np.argsort(t.tid, kind="stable"))
    p = tokens(t, plan.ranking)
    rows, _, bucket = plan.lists(p, plan.ranking.code(p.key), t)
    # A salted token may have several lists in one bucket: its place is told once
    name = (bucket.astype(np.int64) * len(t) + p.text[rows]) * (int(t.size.max(initial=0)) + 1) + p.place[rows]
    name.sort()
    name = name[np.diff(name, prepend=-1) > 0]
    owner, place = np.divmod(name, int(t.size.max(initial=0)) + 1)
    new = np.flatnonzero(np.diff(owner, prepend=-1))
    many = np.diff(new, append=len(owner))
    where, text = np.divmod(owner[new], len(t))
    copies = t.take(text)
    first = np.append(new, len(owner))
    edges = np.flatnonzero(np.diff(where, prepend=-1))
    for lo, hi in zip(edges, np.append(edges[1:], len(where)), strict=True):
        yield int(where[lo]), copies.slice(lo, hi).pack(many[lo:hi], place[first[lo] : first[hi]])


def blocks(texts: DataFrame, plan: Plan) -> DataFrame:
    """(bucket, blob): the packed texts of each map task for each bucket. Texts without a token are in none."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in regroup(batches, 4 * CHUNK):
            for bucket, blob in pack_blocks(t, plan):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])

    return texts.select("tid", "res", "grp", "x").mapInArrow(pack, "bucket int, blob binary")


def unpack_blocks(blobs: list[bytes], plan: Plan, bucket: int) -> tuple[Texts, np.ndarray, np.ndarray]:
    """(texts, text, list) of a bucket's blocks: the texts and a row a posting and list."""
    parts = [Texts.unpack(b) for b in blobs]
    shift = np.cumsum([0, *(len(t) for t, _, _ in parts)])
    t = Texts.concat([t for t, _, _ in parts])
    text = np.concatenate([own + s for (_, own, _), s in zip(parts, shift, strict=False)])
    place = np.concatenate([at for _, _, at in parts])
    code = codes_at(t, text, place)
    p = Postings(text, plan.ranking.key(code), place)
    rows, name, where = plan.lists(p, code, t, bucket)
    own = np.flatnonzero(where == bucket)
    return t, text[rows[own]], name[own]


UNARY = (np.uint64(1) << np.arange(5, dtype=np.uint64)) - np.uint64(1)


def signature(t: Texts) -> np.ndarray:
    """Counts of letters in unary, up to 4 a letter in 104 of 128 bits: XOR counts a lower bound of their distance."""
    out = np.zeros((2, len(t)), np.uint64)
    for lo in range(0, len(t), CHUNK):
        few = t.slice(lo, min(len(t), lo + CHUNK))
        owner = np.repeat(np.arange(len(few)), few.size)
        count = np.minimum(np.bincount(few.flat.astype(np.int64) * len(few) + owner, minlength=len(few) * 26), 4).reshape(26, -1)
        for letter in range(26):
            out[letter // 13, lo : lo + len(few)] |= UNARY[count[letter]] << np.uint64(4 * (letter % 13))
    return out


def in_order(size: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Rows by name, then by size; 16 bits at a time, which numpy sorts far quicker."""
    order = np.argsort(size.astype(np.uint16 if size.max(initial=0) < 1 << 16 else np.int64), kind="stable")
    for bits in range(0, 64, 16):
        part = (name >> np.uint64(bits)).astype(np.uint16)
        if (part != part[:1]).any():
            order = order[np.argsort(part[order], kind="stable")]
    return order


#: Sides of texts in a join of two sets, as bits of x.
LEFT, RIGHT = 1, 2


def walk(t: Texts, plan: Plan, text: np.ndarray, name: np.ndarray, ratio: tuple[int, int], cross: bool, tally: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(a, b, first key, last key): pairs of rows of t that share a list and pass the bounds, each once within a turn;
    a turn walks the lists of whole keys from the first to the last. cross: only pairs of a LEFT with a RIGHT text.
    tally: gets the number of pairs of postings that were looked at."""
    num, den = ratio
    wide = int(t.size.max(initial=0)) + 1
    order = in_order(t.size[text], name)
    name, text = name[order], text[order]
    new = np.diff(name, prepend=name[:1] ^ np.uint64(1)) != 0
    rank = np.cumsum(new) - 1
    # Lists that can have no pair leave at once
    of_list = lambda some: np.bincount(rank, weights=some, minlength=int(rank[-1]) + 1 if len(rank) else 0)
    if cross:
        good = (of_list(t.x[text] & LEFT) > 0) & (of_list(t.x[text] & RIGHT) > 0)
    else:
        good = of_list(np.ones(len(rank))) > 1
    keep = np.flatnonzero(good[rank]) if len(rank) else rank
    name, text, rank = name[keep], text[keep], rank[keep]
    used = np.flatnonzero(np.bincount(text, minlength=len(t)))
    if 2 * len(used) > len(t):
        sig = signature(t)
    else:
        sig = np.zeros((2, len(t)), np.uint64)
        sig[:, used] = signature(t.take(used))
    size = t.size[text]
    at = rank * wide + size
    # n > m (2 - r) / r cannot be alike to m
    most = np.minimum(size * (2 * den - num) // num, wide - 1)
    if cross:
        q, d = np.flatnonzero(t.x[text] & RIGHT), np.flatnonzero(t.x[text] & LEFT)
        least = -(-size[q] * num // (2 * den - num))
        start, end = np.searchsorted(at[d], rank[q] * wide + least), np.searchsorted(at[d], rank[q] * wide + most[q], "right")
    else:
        q = d = np.arange(len(text))
        start, end = q + 1, np.searchsorted(at, rank * wide + most, "right")
    n = end - start
    some = np.flatnonzero(n > 0)
    q, start, n = q[some], start[some], n[some]
    key = (name >> np.uint64(32)).astype(np.int64)
    sig_q, sig_d, size_q, size_d = sig.take(text[q], axis=1), sig.take(text[d], axis=1), size[q], size[d]
    low = (name & np.uint64(0xFFFFFF)).astype(np.int64)
    salted = bool(low.any())
    if salted:
        many = plan.chunked(plan.ranking.code(key.astype(np.uint32)))
        chunk = np.where(many > 0, chunk_of(t.tid[text], np.maximum(many, 1)), 0)
        both = np.maximum(low - 1, 0)
        alone = both // np.maximum(many, 1) == both % np.maximum(many, 1)
    sums = np.cumsum(n)
    found: list[np.ndarray] = []
    held, lo, first = 0, 0, 0
    if tally is not None:
        tally.append(int(sums[-1]) if len(sums) else 0)
    while lo < len(q):
        hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + STEP, "right")))
        i = np.repeat(np.arange(lo, hi), n[lo:hi])
        j = np.repeat(start[lo:hi] - (np.cumsum(n[lo:hi]) - n[lo:hi]), n[lo:hi]) + np.arange(len(i))
        apart = np.bitwise_count(sig_q[0, i] ^ sig_d[0, j]).astype(np.int32) + np.bitwise_count(sig_q[1, i] ^ sig_d[1, j])
        apart = np.maximum(apart, np.abs(size_q[i] - size_d[j]))
        ok = np.flatnonzero(den * apart < (den - num) * (size_q[i] + size_d[j]))
        i, j = q[i[ok]], d[j[ok]]
        if salted:
            ok = (low[i] == 0) | (chunk[i] != chunk[j]) | alone[i]
            i, j = i[ok], j[ok]
        a, b = text[i], text[j]
        if cross:
            a, b = a[a != b], b[a != b]
        found.append(np.minimum(a, b) * len(t) + np.maximum(a, b))
        held += len(a)
        if hi == len(q) or (held > FLUSH and key[q[hi]] != key[q[hi - 1]]):
            pairs = np.sort(np.concatenate(found))
            pairs = pairs[np.diff(pairs, prepend=-1) > 0]  # far quicker than np.unique
            if len(pairs):
                yield *np.divmod(pairs, len(t)), int(key[q[first]]), int(key[q[hi - 1]])
            found, held, first = [], 0, hi
        lo = hi


def only(t: Texts, a: np.ndarray, b: np.ndarray) -> tuple[Texts, np.ndarray, np.ndarray]:
    """The texts that pairs have, and the pairs as rows of these."""
    used = np.zeros(len(t), bool)
    used[a] = used[b] = True
    rows, slot = np.flatnonzero(used), np.cumsum(used) - 1
    return t.take(rows), slot[a], slot[b]


@dataclass
class Shared:
    """The shared tokens of pairs; `pair` says whose. one, two: numbers of tokens of each side."""

    pair: np.ndarray
    key: np.ndarray
    one: np.ndarray
    two: np.ndarray


def key_table(p: Postings, count: np.ndarray, width: int) -> np.ndarray:
    """The first `width` keys of each text as a row, filled up with NONE, which is no token's key."""
    table, key = np.full((len(count), width), NONE), p.key
    if count.max(initial=0) > width:
        key = key[np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count) < width]
    table[np.arange(width) < count[:, None]] = key
    return table


def shared_keys(table: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(pairs, keys of a, keys of b, which of those of a stand in b), a column a pair. Pairs come by the numbers of their keys,
    and so many at once that the matrices are no wider than needed and stay in the processor's cache."""
    most = np.minimum(np.maximum(count[a], count[b]), table.shape[1])
    order, lo = np.argsort(most.astype(np.uint16 if table.shape[1] < 1 << 16 else np.int64), kind="stable"), 0
    while lo < len(order):
        rows = order[lo : lo + max(1, CELLS // max(1, int(most[order[lo]])))]
        lo += len(rows)
        wide = max(1, int(most[rows[-1]]))
        one, two = (np.ascontiguousarray(table.take(x[rows], axis=0)[:, :wide].T) for x in (a, b))
        hit, same = np.zeros(one.shape, bool), np.zeros(one.shape, bool)
        for key in two:
            hit |= np.equal(one, key, out=same)
        hit &= one != NONE
        yield rows, one, two, hit


def shared_of(p: Postings, count: np.ndarray, a: np.ndarray, b: np.ndarray) -> Shared:
    """Shared tokens among those of p; those of a pair by key."""
    if count.max(initial=0) <= 64:
        pair, key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for rows, one, _, hit in shared_keys(key_table(p, count, int(count.max(initial=1))), count, a, b):
            pair.append(np.repeat(rows, hit.sum(axis=0)))
            key.append(one.T[hit.T])
        return Shared(np.concatenate(pair), np.concatenate(key), count[a], count[b])
    start = np.cumsum(count) - count

    def of(side: np.ndarray) -> np.ndarray:
        n = count[side]
        at = np.repeat(start[side] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return (np.repeat(np.arange(len(side), dtype=np.uint64), n) << np.uint64(32)) | p.key[at]

    both = np.sort(np.concatenate([of(a), of(b)]))
    hit = both[1:][both[1:] == both[:-1]]
    return Shared((hit >> np.uint64(32)).astype(np.int64), (hit & np.uint64(0xFFFFFFFF)).astype(np.uint32), count[a], count[b])


#: Widths of the tables of keys in which `first_shared` looks, in turn.
WIDTHS = (8, 32)
AT_ONCE = 1 << 16


def first_shared(t: Texts, ranking: Ranking, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest key that both texts of each pair have; each pair must have one.

    A key that is smallest in both sides' first few keys is smallest in all, so a narrow table settles most
    pairs; the rest take a wider one, and then the general way. (No token has key NONE.) A text's keys are sorted once,
    however many pairs it is in."""
    out, left = np.full(len(a), NONE), np.arange(len(a))
    first = first_keys(t, ranking, WIDTHS[-1])
    for width in WIDTHS:
        table = np.ascontiguousarray(first[:, :width])
        for rows, one, _, hit in shared_keys(table, np.full(len(t), width), a[left], b[left]):
            out[left[rows]] = np.where(hit, one, NONE).min(axis=0)
        left = left[out[left] == NONE]
    for at in range(0, len(left), AT_ONCE):
        rows = left[at : at + AT_ONCE]
        few, u, v = only(t, a[rows], b[rows])
        p = tokens(few, ranking, whole=True, places=False)
        s = shared_of(p, np.bincount(p.text, minlength=len(few)), u, v)
        pair, place = np.unique(s.pair, return_index=True)
        out[rows[pair]] = s.key[place]
    return out


#: (texts, all their tokens, numbers of tokens, a, b) -> which pairs pass
Verify = Callable[[Texts, Postings, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def alike(t: Texts, a: np.ndarray, b: np.ndarray, ratio_num: int, ratio_den: int) -> np.ndarray:
    """2 LCS / (m + n) > ratio_num / ratio_den, in integers."""
    lcs = lcs_codes(t.flat, t.start, t.size, a, b).astype(np.int64)
    return 2 * ratio_den * lcs > ratio_num * (t.size[a] + t.size[b])


def at_home(plan: Plan, key: np.ndarray, one: np.ndarray, two: np.ndarray, bucket: int) -> np.ndarray:
    """Whether this bucket is that of the pair's first shared token, with the chunks of both ids where it is salted."""
    code = plan.ranking.code(key)
    n, low = plan.chunked(code), np.zeros(len(key), np.int64)
    rows = np.flatnonzero(n)
    if len(rows):
        c, d = chunk_of(one[rows], n[rows]), chunk_of(two[rows], n[rows])
        low[rows] = np.minimum(c, d) * n[rows] + np.maximum(c, d) + 1
    return plan.bucket(code, low) == bucket


def list_pairs(t: Texts, plan: Plan, bucket: int, text: np.ndarray, name: np.ndarray, verify: Verify, ratio: tuple[int, int], cross: bool, tally: list[int] | None = None) -> tuple[Texts, np.ndarray, np.ndarray]:
    """(texts, a, b): the pairs of a bucket that are at home there, pass `verify` and are alike."""
    out = [(np.zeros(0, np.int64),) * 2]
    for a, b, low, high in walk(t, plan, text, name, ratio, cross, tally):
        # Most pairs meet in several buckets, so that the few at home here are told first
        few, u, v = only(t, a, b)
        key = first_shared(few, plan.ranking, u, v)
        home = np.flatnonzero((key >= low) & (key <= high))
        home = home[at_home(plan, key[home], few.tid[u[home]], few.tid[v[home]], bucket)]
        for at in range(0, len(home), AT_ONCE):  # whole token sets are made for so many pairs at once
            rows = home[at : at + AT_ONCE]
            some, i, j = only(few, u[rows], v[rows])
            p = tokens(some, plan.ranking, whole=True, places=False)
            ok = np.flatnonzero(verify(some, p, np.bincount(p.text, minlength=len(some)), i, j))
            ok = ok[alike(some, i[ok], j[ok], *ratio)]
            out.append((a[rows[ok]], b[rows[ok]]))
    return t, *(np.concatenate(c) for c in zip(*out, strict=True))


def join_blocks(packed: DataFrame, plan: Plan, verify: Verify, ratio: tuple[int, int], cross: bool = False) -> DataFrame:
    """(a, b) for each pair of different texts that meets, passes `verify` and is alike; a < b are tids."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("blob"), strict=True):
                held.setdefault(bucket, []).append(blob.as_buffer())
        for bucket in sorted(held):
            t, a, b = list_pairs(*sorted_out(held.pop(bucket), plan, bucket), verify, ratio, cross)
            a, b = t.tid[a], t.tid[b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    # A task a bucket, by its number: hashing the few numbers would put several into one task
    return packed.repartitionById(plan.buckets, F.col("bucket")).mapInArrow(reduce, "a long, b long")


def sorted_out(blobs: list[bytes], plan: Plan, bucket: int) -> tuple[Texts, Plan, int, np.ndarray, np.ndarray]:
    t, text, name = unpack_blocks(blobs, plan, bucket)
    return t, plan, bucket, text, name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(spark: SparkSession, postings: int) -> int:
    return max(partitions(spark), -(-postings // POSTINGS_A_BUCKET))


def meet(texts: DataFrame, ranking: Ranking, verify: Verify, ratio: tuple[int, int], counts: Counts | None = None, cross: bool = False, buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """The whole join over a table of different texts (TEXT_SCHEMA); see the module."""
    counts = token_counts(texts, hot) if counts is None else counts
    plan = Plan.of(ranking, counts, buckets or bucket_count(texts.sparkSession, counts.postings), hot)
    return join_blocks(blocks(texts, plan), plan, verify, ratio, cross)


def broadcast_table(spark: SparkSession, table: np.ndarray):
    """A byte a token: 12 MB before compression, whatever the data's size."""
    return Packed(spark.sparkContext.broadcast(pa.compress(table.tobytes(), codec="zstd", asbytes=True))) if table.any() else None
