"""Filling fixed-capacity containers with items (problem 7): conflict-constrained best fit.

Items go by falling size. Open bins stand in the order of their residual room; each carries a bitmap of the
duplicate clusters that it holds and belongs to the pool of one source where sources may not mix. The search
takes the smallest residual that fits and goes on to the next larger one until it finds the tightest bin without
a conflict. Copies of one text are one run of equal items, which a single walk over the bins places.

A text above the capacity is cut into pieces of exactly the capacity, which are full containers, and a rest.
The whole table is packed in shards of about SHARD tokens, at most about two and a half times as many, each by one task; a
shard leaves at most about one container a source badly filled, so the loss falls with the size of the shard.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resiq.llm.tokens import VOCABULARY, sized
from resiq.operators.ranks import running
from resiq.session import cut, table

#: Tokens of a shard.
SHARD = 4_000_000


class Bins:
    """Open bins of one pool. `levels[r]` lists the bins with residual r; bit r of `present` says whether it has any."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.levels: dict[int, list[int]] = defaultdict(list)
        self.present = 0
        self.residual: list[int] = []
        self.bitmap: list[int] = []

    def _put(self, b: int) -> None:
        r = self.residual[b]
        self.levels[r].append(b)
        self.present |= 1 << r

    def place(self, size: int, bit: int, count: int) -> list[int]:
        """Bins for `count` equal items of one duplicate cluster (bit 0: of no cluster)."""
        out: list[int] = []
        r = size
        while len(out) < count:
            rest = self.present >> r
            if not rest:
                break
            r += (rest & -rest).bit_length() - 1
            level = self.levels[r]
            if bit:
                fit = [b for b in level if not self.bitmap[b] & bit][: count - len(out)]
                if fit:
                    gone = set(fit)
                    self.levels[r] = level = [b for b in level if b not in gone]
            else:
                take = min(len(level), count - len(out))
                fit = level[len(level) - take :]
                del level[len(level) - take :]
            if not level:
                self.present &= ~(1 << r)
            out += fit
            r += 1
        for b in out:
            self.residual[b] -= size
            self.bitmap[b] |= bit
        for b in out:
            self._put(b)
        while len(out) < count:
            self.residual.append(self.capacity - size)
            self.bitmap.append(bit)
            self._put(len(self.residual) - 1)
            out.append(len(self.residual) - 1)
            if not bit and self.residual[-1] >= size and len(out) < count:  # without conflict, equal items share a bin
                out += self.place(size, 0, count - len(out))
        return out


def pack_shard(size: np.ndarray, pool: np.ndarray, dup: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, numbered over all pools. dup 0: no cluster."""
    known, cluster, members = np.unique(dup, return_inverse=True, return_counts=True)
    conflict = (members > 1) & (known != 0)
    bit_of = np.cumsum(conflict) - 1
    key = np.where(conflict[cluster], cluster, -1)
    order = np.lexsort((np.arange(len(size)), key, pool, -size))
    out = np.zeros(len(size), np.int64)
    pools: dict[int, Bins] = {}
    numbers: dict[tuple[int, int], int] = {}
    at = 0
    while at < len(order):
        i = order[at]
        end = at + 1
        while end < len(order) and key[i] >= 0 and size[order[end]] == size[i] and pool[order[end]] == pool[i] and key[order[end]] == key[i]:
            end += 1
        bins = pools.setdefault(int(pool[i]), Bins(capacity))
        bit = 1 << int(bit_of[cluster[i]]) if key[i] >= 0 else 0
        for item, b in zip(order[at:end], bins.place(int(size[i]), bit, end - at), strict=True):
            out[item] = numbers.setdefault((int(pool[i]), b), len(numbers))
        at = end
    return out


def pack(items: DataFrame, specs: list[tuple[int, int, bool]], shard: int = SHARD) -> DataFrame:
    """(spec_id, container_id, doc_id, piece_no, from_token, to_token) for each piece of each document.

    items: (doc_id, source, tokens, dup). specs: (spec_id, capacity > 0, per_source); others are left out.
    Documents of no tokens need no room and get no row. A null source is a source of its own."""
    specs = [s for s in specs if s[1] and s[1] > 0]
    schema = "spec_id int, shard long, container long, doc_id long, piece_no int, from_token int, to_token int"
    if not specs:
        return items.sparkSession.createDataFrame([], schema).select("spec_id", F.lit("").alias("container_id"), "doc_id", "piece_no", "from_token", "to_token")
    items = cut(items.where("tokens > 0"))
    total = items.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, round(total / shard))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(shards))
    # Where sources may not mix, a large source has shards of its own, and small ones in turn fill common shards
    large = F.col("t") > 1.5 * shard
    sources = items.groupBy("source").agg(F.sum("tokens").alias("t")).withColumn("parts", F.when(large, F.rint(F.col("t") / shard).cast("long")).otherwise(0)).withColumn("small", F.when(large, 0).otherwise(F.col("t")))
    placed = cut(running(sources, ["source"], {"before": "parts", "room": "small"}))
    top = placed.agg(F.sum("parts")).first()[0] or 0
    first = F.when(F.col("parts") > 0, F.col("before")).otherwise(top + F.floor(F.col("room") / shard))
    placed = placed.select(F.col("source").alias("of"), first.alias("first"), F.greatest("parts", F.lit(1)).alias("parts"))
    items = items.join(placed, items["source"].eqNullSafe(placed["of"]))
    own = F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    spec = F.explode(F.array(*(F.struct(F.lit(i).cast("int").alias("spec_id"), F.lit(c).alias("capacity"), F.lit(bool(p)).alias("per_source")) for i, c, p in specs)))
    rows = items.select("doc_id", "source", "tokens", "dup", spread.alias("any"), own.alias("own"), spec.alias("s"))
    rows = rows.select("s.*", F.when(F.col("s.per_source"), F.col("own")).otherwise(F.col("any")).alias("shard"), "doc_id", "source", "tokens", "dup")

    def fill(t: pa.Table) -> pa.Table:
        spec_id, capacity, per_source, shard_no = (t.column(c)[0].as_py() for c in ("spec_id", "capacity", "per_source", "shard"))
        order = np.argsort(t.column("doc_id").to_numpy(), kind="stable")  # the same whatever the order of arrival
        doc, tokens, dup = (t.column(c).to_numpy()[order] for c in ("doc_id", "tokens", "dup"))
        pool = np.zeros(len(doc), np.int64)
        if per_source:
            pool = t.column("source").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)[order].astype(np.int64)
        full, rest = np.divmod(tokens, capacity)
        parts = np.flatnonzero(rest)
        where = pack_shard(rest[parts], pool[parts], dup[parts], capacity)
        n = int(where.max(initial=-1)) + 1
        owner = np.repeat(np.arange(len(doc)), full)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        box = np.concatenate([where, n + np.arange(len(owner))])
        d = np.concatenate([parts, owner])
        no = np.concatenate([full[parts], piece])
        start = no * capacity
        end = np.minimum(start + capacity, tokens[d])
        k = len(d)
        cols = [np.full(k, spec_id), np.full(k, shard_no), box, doc[d], no + 1, start, end]
        return pa.table([pa.array(c.astype(np.int64)).cast(x) for c, x in zip(cols, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()], strict=True)], [f.split()[0] for f in schema.split(", ")])

    out = rows.groupBy("spec_id", "shard").applyInArrow(fill, schema)
    return out.select("spec_id", F.concat_ws("-", "spec_id", "shard", "container").alias("container_id"), "doc_id", "piece_no", "from_token", "to_token")


def read_specs(spark: SparkSession, sf: str) -> list[tuple[int, int, bool]]:
    """pack_specs is a parameter table of a few rows."""
    return [(r.spec_id, r.capacity, r.per_source) for r in table(spark, sf, "pack_specs").orderBy("spec_id").collect()]


def p7_containers(spark: SparkSession, sf: str, path: str = VOCABULARY) -> DataFrame:
    return pack(sized(table(spark, sf, "documents"), path), read_specs(spark, sf))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Per spec: containers, tokens, and the share of room used."""
    per = p7_containers(spark, sf).groupBy("spec_id", "container_id").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("t"))
    specs = table(spark, sf, "pack_specs").select("spec_id", "capacity")
    return per.groupBy("spec_id").agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens")).join(specs, "spec_id").select("spec_id", "capacity", "n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6).alias("fill"))
