"""Exact pairs of alike texts by pieces: few pairs of two groups are looked at.

The longer text of a pair is cut into pieces, so many that an alignment with the most edits allowed leaves one of them
with at most one edit (or, the last piece, with none). That piece, without a letter if need be, stands in the shorter
text as a window, without a letter if need be: both get keys, and only texts of one key are compared: by counts of
letters, then by LCS. A hash that collides brings a pair too many to the comparison, never one too few.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np

from resiq.functions.lcs import lcs_codes, pack

#: Most edits (insertions, deletions and, with `swaps`, substitutions) between a text of n letters and a shorter one.
Edits = Callable[[int], int]

#: Letters of the longest text that is cut, narrowest piece with an edit; other texts are compared with all.
LONGEST, NARROW = 512, 3
#: Texts of a group at most: a key and a text's number ride in one word.
PLACE = 20
#: Pairs that are looked at together, and from which on those of a key are by themselves.
BLOCK, DENSE = 1 << 17, 2048

#: Pairs that are not worth an index.
FEW = 1 << 24

#: Powers of an odd number modulo 2^64, from -LONGEST to LONGEST, and a number that mixes.
BASE, MIX = 0x9E6C63D0876A9A47, np.uint64(0xD6E8FEB86659FD93)
POWERS = np.array([pow(BASE, k, 1 << 64) for k in range(-LONGEST, LONGEST + 1)], np.uint64)


def indels(limit: Callable) -> Edits:
    """The most indels that a limit leaves a text of n letters with a shorter one: as many as the lengths are apart, or
    two, four, ... more."""

    def most(n: int) -> int:
        apart = np.arange(n + 1)
        d = limit(np.full(n + 1, n), n - apart)
        return int(np.where(d >= apart, d - (d - apart) % 2, 0).max())

    return most


def cuts(n: int, edits: int) -> list[tuple[int, int, bool]] | None:
    """Pieces (start, width, with an edit) of a text of n letters; None if they would be too narrow. All pieces with an
    edit too many need more than `edits` edits."""
    pairs, odd = divmod(edits + 1, 2)
    whole = n if not pairs else (n + 1) // (pairs + 1) - 1 if odd else 0
    if n > LONGEST or (odd and whole < 1) or (pairs and (n - whole) // pairs < NARROW):
        return None
    edges = [(n - whole) * k // pairs for k in range(pairs + 1)] if pairs else [0]
    return [(x, y - x, True) for x, y in zip(edges, edges[1:], strict=False)] + ([(n - whole, whole, False)] if odd else [])


def words(sums: np.ndarray, first: int, x: int, w: int, j: int | None) -> np.ndarray:
    """Words of a hash of w letters from place x on, without the j-th of them, and a text's number; a row of `sums` holds
    the letters before a place, each by a power of BASE. Texts are numbered by length, so those of a key come by length."""
    if j is None or j == w - 1:
        out = (sums[x + w - (j is not None)] - sums[x]) * POWERS[LONGEST - x]
    else:
        out = (sums[x + w] - sums[x + j + 1]) * POWERS[LONGEST - x - 1]
        if j:
            out += (sums[x + j] - sums[x]) * POWERS[LONGEST - x]
    out ^= out >> np.uint64(29)
    out *= MIX
    out &= ~np.uint64((1 << PLACE) - 1)
    out += np.arange(first, first + len(out), dtype=np.uint64)
    return out


def joined(parts: list[np.ndarray]) -> np.ndarray:
    out = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    out.sort()
    return out


def known(p: np.ndarray, parts: Iterator[np.ndarray]) -> np.ndarray:
    """The sorted words of parts whose key may be one of p: a table by the top bits turns most of the others away unsorted."""
    size = min(24, max(12, (8 * len(p)).bit_length()))
    shift = np.uint64(64 - size)
    table = np.zeros(1 << size, bool)
    table[p >> shift] = True
    return joined([q[table[q >> shift]] for q in parts])


class Group:
    """Texts by length, as sums of their codes up to each place (`words`); `order` has their rows."""

    def __init__(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, rows: np.ndarray):
        self.order = rows[np.argsort(size[rows], kind="stable")]
        self.size = size[self.order]
        lengths, first = np.unique(self.size, return_index=True)
        self.first = dict(zip(lengths.tolist(), first.tolist(), strict=True))
        self.sums = {}
        for n, lo, hi in zip(lengths.tolist(), first.tolist(), [*first[1:].tolist(), len(rows)], strict=True):
            if n <= LONGEST:
                sums = np.zeros((n + 1, hi - lo), np.uint64)
                for k in range(n):
                    sums[k + 1] = sums[k] + (flat[start[self.order[lo:hi]] + k].astype(np.uint64) + np.uint64(1)) * POWERS[LONGEST + k]
                self.sums[n] = sums


def kinds(cut: Group, other: Group, edits: Edits, swaps: bool, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted words of pieces and of windows that may meet them, a kind of edit and a width at a time."""
    pieces = {n: cuts(n, edits(n)) or [] for n in cut.sums if n}
    for w, edit in sorted({(w, edit) for ps in pieces.values() for _, w, edit in ps}):
        own = [(n, x) for n, ps in pieces.items() for x, v, e in ps if (v, e) == (w, edit)]
        least, most = min(int(low[n]) for n, _ in own), max(n for n, _ in own)
        texts = [(m, c, other.first[m]) for m, c in other.sums.items() if least <= m <= most]
        pick = lambda j=None: [words(cut.sums[n], cut.first[n], x, w, j) for n, x in own]  # noqa: E731, B023
        see = lambda v, j=None: (words(c, lo, x, v, j) for m, c, lo in texts for x in range(m - v + 1))  # noqa: E731, B023
        whole = joined(pick())
        if not edit:
            yield whole, known(whole, see(w))
            continue
        p = joined([q for j in range(w) for q in pick(j)])
        yield p, known(p, see(w - 1))
        if swaps:
            for j in range(w):
                p = joined(pick(j))
                yield p, known(p, see(w, j))
        yield whole, known(whole, itertools.chain(() if swaps else see(w), *(see(w + 1, j) for j in range(1, w))))


def meetings(p: np.ndarray, q: np.ndarray, cut: Group, other: Group, bits: tuple[np.ndarray, np.ndarray], most: np.ndarray, cap: np.ndarray, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers in cut, numbers in other) of texts of one key whose first word of letter counts is near enough."""
    bp, bq = bits
    mask, shift = np.uint64((1 << PLACE) - 1), np.uint64(PLACE)
    kp, kq = p >> shift, q >> shift
    ip, iq = (p & mask).astype(np.int64), (q & mask).astype(np.int64)
    head = np.flatnonzero(np.diff(kp, prepend=np.uint64(0)) != 0) if len(kp) else np.zeros(0, np.int64)
    if len(kp) and (not len(head) or head[0] != 0):
        head = np.insert(head, 0, 0)
    n = np.diff(np.append(head, len(kp)))
    lo, hi = np.searchsorted(kq, kp[head], "left"), np.searchsorted(kq, kp[head], "right")
    seen = hi > lo
    head, n, lo, hi = head[seen], n[seen], lo[seen], hi[seen]
    large = n * (hi - lo) >= DENSE
    ends = np.append(other.size, [1 << 30])
    for h, c, x, y in zip(*(v[large].tolist() for v in (head, n, lo, hi)), strict=True):
        wide = iq[x:y]
        step = max(1, BLOCK // (y - x))
        for r in range(h, h + c, step):
            i = ip[r : min(h + c, r + step)]
            shortest, longest = int(cut.size[i[0]]), int(cut.size[i[-1]])
            f, t = np.searchsorted(wide, np.searchsorted(ends, [int(low[shortest]), longest + 1]))
            if f == t:
                continue
            j = wide[f:t]
            d = np.bitwise_count(bp[i][:, None] ^ bq[j][None, :])
            hit = np.flatnonzero(d.ravel() <= min(255, int(cap[longest, int(other.size[j[-1]])])))
            if len(hit):
                u, v = np.divmod(hit, len(j))
                yield i[u], j[v]
    head, n, lo, hi = (v[~large] for v in (head, n, lo, hi))
    # Each entry of a small run with its range of the other side
    each = np.repeat(np.arange(len(n)), n)
    row = head[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    many = (hi - lo)[each]
    total = np.cumsum(many)
    at = 0
    while at < len(row):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK, "right")))
        m = many[at:end]
        i = np.repeat(ip[row[at:end]], m)
        j = iq[np.repeat(lo[each[at:end]] - (np.cumsum(m) - m), m) + np.arange(len(i))]
        near = np.flatnonzero(np.bitwise_count(bp[i] ^ bq[j]) <= most[cut.size[i], other.size[j]])
        yield i[near], j[near]
        at = end


def piece_pairs(a: list[str], b: list[str] | None, limit: Callable, edits: Edits, swaps: bool, unary: Callable, scan: Callable, ids: np.ndarray | None = None, keep: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a, rows of b, LCS) of the pairs with at most `limit` indels that `edits` allows, and of them those that
    `keep` takes; without b those of a with itself, the smaller row first. `scan` compares small groups and the texts that
    are not cut. With ids of b, a row of a comes with its partner of the smallest id alone: no more is held, and a pair that
    is not better than that so far is turned away before it is compared."""
    parts = first_pairs(a, b, limit, edits, swaps, unary, scan, ids, keep) if ids is not None else all_pairs(a, b, limit, edits, swaps, unary, scan, None)
    if ids is not None:
        return parts
    i, j, lcs = (np.concatenate(x) for x in zip(*parts, (np.zeros(0, np.int64),) * 3, strict=True))
    _, first = np.unique((i << 32) | j, return_index=True)
    i, j, lcs = i[first], j[first], lcs[first]
    if keep is not None:
        ok = keep(a, a if b is None else b, i, j, lcs)
        i, j, lcs = i[ok], j[ok], lcs[ok]
    return i, j, lcs


def first_pairs(a: list[str], b: list[str], limit: Callable, edits: Edits, swaps: bool, unary: Callable, scan: Callable, ids: np.ndarray, keep: Callable | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    best, found = np.full(len(a), len(ids)), np.zeros(len(a), np.int64)
    for i, j, lcs in all_pairs(a, b, limit, edits, swaps, unary, scan, lambda i, j: rank[j] < best[i]):
        if keep is not None:
            ok = keep(a, b, i, j, lcs)
            i, j, lcs = i[ok], j[ok], lcs[ok]
        at = np.lexsort((rank[j], i))
        at = at[np.diff(i[at], prepend=-1) != 0]
        at = at[rank[j[at]] < best[i[at]]]
        best[i[at]], found[i[at]] = rank[j[at]], lcs[at]
    i = np.flatnonzero(best < len(ids))
    return i, order[best[i]], found[i]


def all_pairs(a: list[str], b: list[str] | None, limit: Callable, edits: Edits, swaps: bool, unary: Callable, scan: Callable, wanted: Callable | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of `piece_pairs` by and by, some more than once. Pairs that are not `wanted` (rows, rows) just then need not come."""
    n = len(a)
    if n * len(a if b is None else b) <= FEW:
        yield scan(a, a if b is None else b, limit, b is None)
        return
    flat, start, size, letters = pack([*a, *(b or [])])
    bits = unary(flat, size, letters)
    words = [w for w in range(3) if bits[w].any()]
    tall = min(LONGEST, int(size.max(initial=0)))
    grid = np.arange(tall + 1)
    cap = limit(grid[:, None], grid[None, :]).astype(np.int16)
    most = np.where(np.abs(grid[:, None] - grid[None, :]) <= cap, cap, np.int16(-1))
    # The shortest text that one of these lengths or more may meet
    low = np.minimum.accumulate(np.where(np.tri(tall + 1, dtype=bool) & (most >= 0), grid, tall + 1).min(axis=1)[::-1])[::-1]
    left = Group(flat, start, size, np.arange(n))
    right = left if b is None else Group(flat, start, size, np.arange(n, len(size)))
    waiting, held, shift = [], 0, 0 if b is None else n
    enough = 1 << (21 if wanted is None else 19)

    def settle() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs = np.concatenate([(np.minimum(x, y) << 32) | np.maximum(x, y) for x, y in waiting])
        pairs.sort()  # much faster here than np.unique, which hashes
        pairs = pairs[np.diff(pairs, prepend=-1) != 0]
        i, j = pairs >> 32, pairs & ((1 << 32) - 1)
        if wanted is not None:
            ok = wanted(i, j - shift)
            i, j = i[ok], j[ok]
        bound = most[size[i], size[j]]
        d = sum(np.bitwise_count(bits[w][i] ^ bits[w][j]) for w in words) if words else np.zeros(len(i), np.uint8)
        ok = (d <= bound) & (i != j)
        i, j, bound = i[ok], j[ok], bound[ok]
        lcs = lcs_codes(flat, start, size, i, j, letters).astype(np.int64)
        ok = size[i] + size[j] - 2 * lcs <= bound
        return i[ok], j[ok] - shift, lcs[ok]

    sides = [(left, right)] if b is None else [(left, right), (right, left)]
    for cut, other in sides:
        of = tuple(bits[words[0] if words else 0][g.order] for g in (cut, other))
        for p, q in kinds(cut, other, edits, swaps, low):
            for i, j in meetings(p, q, cut, other, of, most, cap, low):
                ok = cut.size[i] >= other.size[j]
                i, j = cut.order[i[ok]], other.order[j[ok]]
                if wanted is not None:
                    ok = wanted(np.minimum(i, j), np.maximum(i, j) - shift)
                    i, j = i[ok], j[ok]
                if len(i):
                    waiting.append((i, j))
                    held += len(i)
                if held >= enough or len(waiting) >= 1 << 14:
                    yield settle()
                    waiting, held = [], 0
    if held:
        yield settle()
    # Texts that are not cut, against all that are not longer, or, from the other side, shorter
    other_lengths = [x for x in np.unique(size).tolist() if x and (x > LONGEST or cuts(x, edits(x)) is None)]
    plain = np.flatnonzero(np.isin(size, other_lengths))
    if len(plain):
        every = [*a, *(b or [])]
        for mine in (plain,) if b is None else (plain[plain < n], plain[plain >= n]):
            if len(mine):
                rest = np.arange(n) if b is None or mine[0] >= n else np.arange(n, len(size))
                rest = rest[size[rest] <= size[mine].max()]
                i, j, lcs = scan([every[x] for x in mine], [every[x] for x in rest], limit, False)
                i, j = mine[i], rest[j]
                ok = (i != j) & (size[j] <= size[i])
                yield np.minimum(i, j)[ok], np.maximum(i, j)[ok] - shift, lcs[ok]


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Unit edits between pairs of texts, bit-parallel (Myers, 1999; Hyyrö, 2003): all pairs of a batch advance together;
    pairs of two texts over 64 letters one at a time."""
    out = np.zeros(len(a), np.int64)
    swap = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    short = np.array([len(x) for x, _ in swap], np.int64)
    for k in np.flatnonzero((short == 0) | (short > 64)):
        out[k] = _edits(*swap[k])
    rows = np.flatnonzero((short > 0) & (short <= 64))
    rows = rows[np.argsort([len(swap[k][1]) for k in rows], kind="stable")]
    for at in range(0, len(rows), 1 << 14):
        part = rows[at : at + (1 << 14)]
        flat, start, size, letters = pack([swap[k][0] for k in part] + [swap[k][1] for k in part])
        n = len(part)
        m, long = size[:n], size[n:]
        masks = np.zeros(n * letters, np.uint64)
        owner = np.repeat(np.arange(n), m)
        pos = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
        np.bitwise_or.at(masks, owner * letters + flat[: len(owner)], np.uint64(1) << pos.astype(np.uint64))
        last = (m - 1).astype(np.uint64)
        one = np.uint64(1)
        pv, mv, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), m.copy()
        for k in range(int(long[-1])):
            live = int(np.searchsorted(long, k, "right"))  # sorted by the longer side's size
            eq = masks[np.arange(live, n) * letters + flat[start[n + live :] + k]]
            p, q = pv[live:], mv[live:]
            xv, xh = eq | q, (((eq & p) + p) ^ p) | eq
            ph, mh = q | ~(xh | p), p & xh
            score[live:] += ((ph >> last[live:]) & one).astype(np.int64) - ((mh >> last[live:]) & one).astype(np.int64)
            ph, mh = (ph << one) | one, mh << one
            pv[live:], mv[live:] = mh | ~(xv | ph), ph & xv
        out[part] = score
    return out


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]
