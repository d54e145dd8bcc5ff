"""Deduplicating new batches against all history (problem 3) through an incremental inverted index.

The index is a folder:

* `entries-*`, a table (bucket, part, n, blob) bucketed by token bucket: the rare-token prefixes of all accepted texts as
  packed posting blocks. A delivery reads it where it lies: the buckets are the partitions of the probe, and nothing of the
  history goes through a shuffle.
* `plan-*`: the tokens' order, the number of buckets and the salted tokens, a *generation*. They are made from counts over a
  corpus and frozen, as prefixes must share one order. When the index has grown by GROWTH, `refresh` makes a new
  generation from the accepted texts, without repeated ones; that costs a pass, but a constant share of all work.
* `marks`: a file a delivery, written last. A part without a mark does not count, so a delivery that broke off is simply
  made again.

A delivery's texts are packed into prefixes, and in each bucket only the lists in which a new text stands are walked, new
against old. A backlog of batches is one delivery: its texts carry the number of their batch and are compared with the
history once and among themselves, an earlier batch's text being old to a later one's.
"""

from __future__ import annotations

import json
import secrets
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resiq.llm.blockjoin import HOT, LEFT, RIGHT, Plan, at_home, blocks, broadcast_table, bucket_count, list_pairs, shared_of, sorted_out
from resiq.llm.grams import CHUNK, MINI, Counts, Postings, Ranking, Texts, token_counts, tokens
from resiq.llm.pairs import RATIO, copies, text_key
from resiq.session import cut, drop_path, read_folder, shared_dir, table, write_bytes

#: Texts that are alike share so many 5-grams at least (2 of 21 at 25 residues).
OVERLAP = 2
#: A new generation is made when there are this many times the entries that the present one was made for.
GROWTH = 8


def prefix(overlap: int = OVERLAP, classes=None) -> Ranking:
    """Prefix filter: two texts that share `overlap` tokens share one among the first n - overlap + 1 of either,
    whatever the common order. Rarest first, so that the lists that are left out are the longest."""
    return Ranking(lambda n: np.maximum(n - overlap + 1, np.minimum(n, 1)), classes)


def overlap_verify(overlap: int = OVERLAP):
    def verify(t: Texts, p: Postings, count: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = shared_of(p, count, a, b)
        return np.bincount(s.pair, minlength=len(a)) >= np.minimum(overlap, np.minimum(s.one, s.two))

    return verify


def once(t: Texts) -> np.ndarray:
    """A row for each different text: that of the smallest id. Texts are told apart by two sums of 64 bits."""
    place = (np.arange(int(t.size.max(initial=0)), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    sums = np.zeros((2, len(t)), np.uint64)
    for lo in range(0, len(t), CHUNK):
        few = t.slice(lo, min(len(t), lo + CHUNK))
        some = np.flatnonzero(few.size)
        at = place[np.arange(len(few.flat)) - np.repeat(few.start, few.size)] + few.flat.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k, shift in enumerate((29, 32)):
            at = (at ^ (at >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
            if len(some):
                sums[k, lo + some] = np.add.reduceat(at, few.start[some])
    order = np.lexsort((t.tid, *sums))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (*sums, t.size)], axis=0)
    return np.sort(order[new])


def probe(new: list[bytes], old: list[bytes], plan: Plan, bucket: int, overlap: int = OVERLAP, tally: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of new texts, ids of old ones) that are the same or alike and at home in this bucket. Only lists in which
    a new text stands are walked, and only new against old; of equal old texts that of the smallest id counts. Of two
    new texts the one of the smaller `x` is old. `tally` gets the number of pairs of postings that were looked at."""
    t, _, _, text, name = sorted_out(new, plan, bucket)
    batch = t.x
    backlog = bool((batch != batch[:1]).any())
    if not old:
        if not backlog:
            return (np.zeros(0, np.int64),) * 2
        t, a, b = list_pairs(t, plan, bucket, text, name, overlap_verify(overlap), RATIO, False, tally)
        return in_turn(t.tid, batch, a, b)
    u, _, _, other, list_of = sorted_out(old, plan, bucket)
    asked = np.unique(name)
    at = np.minimum(np.searchsorted(asked, list_of), len(asked) - 1)
    met = np.flatnonzero(asked[at] == list_of)
    used = np.flatnonzero(np.bincount(other[met], minlength=len(u)))
    few = u.take(used)
    rows = once(few)
    slot = np.full(len(u), -1, np.int64)
    slot[used[rows]] = np.arange(len(rows)) + len(t)
    met = met[slot[other[met]] >= 0]
    side = lambda x, which: Texts(x.tid, x.flat, x.size, x.grp, np.full(len(x), which, np.int32))
    both = Texts.concat([side(t, RIGHT | LEFT if backlog else RIGHT), side(few.take(rows), LEFT)])
    both, a, b = list_pairs(both, plan, bucket, np.concatenate([text, slot[other[met]]]), np.concatenate([name, list_of[met]]), overlap_verify(overlap), RATIO, True, tally)
    before = np.full(len(both), int(batch.min(initial=0)) - 1, np.int64)
    before[: len(t)] = batch
    return in_turn(both.tid, before, a, b)


def in_turn(tid: np.ndarray, batch: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the later, ids of the earlier) texts of pairs of different batches."""
    some = batch[a] != batch[b]
    a, b = a[some], b[some]
    late = batch[a] > batch[b]
    return tid[np.where(late, a, b)], tid[np.where(late, b, a)]


def hash_of_int(v: np.ndarray) -> np.ndarray:
    """Spark's hash of an integer column, by which it deals rows to buckets (Murmur3, seed 42)."""
    u = np.uint32
    turn = lambda x, k: (x << u(k)) | (x >> u(32 - k))
    k = turn(v.astype(u) * u(0xCC9E2D51), 15) * u(0x1B873593)
    h = turn(u(42) ^ k, 13) * u(5) + u(0xE6546B64) ^ u(4)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).view(np.int32)


def numbers(n: int) -> list[int]:
    """For each bucket a number that Spark deals to the partition of the bucket: each task gets one bucket."""
    v = np.arange(n * (64 + 2 * n.bit_length()))
    where, first = np.unique(hash_of_int(v).astype(np.int64) % n, return_index=True)
    return [int(x) for x in v[first]]


class BatchIndex:
    """Inverted lists of accepted texts in a folder; see the module.

    counts: statistics of a corpus like what is to come, in place of the first delivery's. They and the number of
    buckets bear on speed and memory only."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, overlap: int = OVERLAP, counts: Counts | None = None, hot: int = HOT, growth: int = GROWTH) -> None:
        self.spark, self.path, self.buckets, self.overlap, self.counts, self.hot, self.growth = spark, path, buckets, overlap, counts, hot, growth
        self.plans: dict[int, Plan] = {}

    def _marks(self) -> list[dict]:
        """Of all finished deliveries, in order."""
        return sorted(map(json.loads, read_folder(self.spark, f"{self.path}/marks").values()), key=lambda m: m["no"])

    def _mark(self, own: dict, part: int, no: int, n: int) -> None:
        mark = {k: own[k] for k in ("generation", "buckets", "made_for")} | {"part": part, "no": no, "n": n}
        write_bytes(self.spark, f"{self.path}/marks/{no:09d}-{part}", json.dumps(mark).encode())

    def _entries(self, mark: dict) -> str:
        """The name in this session's catalog of a table whose files are the index."""
        folder = f"{self.path}/entries-{mark['generation']}"
        name = f"resiq_entries_{zlib.crc32(folder.encode()):08x}_{mark['generation']:x}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (bucket int, part long, n int, blob binary) USING parquet CLUSTERED BY (bucket) INTO {mark['buckets']} BUCKETS LOCATION '{folder}'")
        return name

    def _append(self, packed: DataFrame, mark: dict) -> None:
        name = self._entries(mark)
        packed.repartition(mark["buckets"], "bucket").write.mode("append").format("parquet").bucketBy(mark["buckets"], "bucket").saveAsTable(name)  # one file a bucket
        del packed
        self.spark.sparkContext._jvm.System.gc()  # else the shuffled blocks lie on disk beside the table

    def close(self) -> None:
        """Forget the tables in the catalog, remove the folder and what the deliveries left on the executors' disks."""
        for mark in {m["generation"]: m for m in self._marks()}.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {self._entries(mark)}")
        drop_path(self.spark, self.path)
        for plan in self.plans.values():
            if plan.ranking.classes is not None:
                plan.ranking.classes.held.destroy()
        self.plans.clear()
        self.spark.sparkContext._jvm.System.gc()  # shuffle files go with the driver's last references to them

    def _generation(self, counts: Counts) -> dict:
        n = self.buckets or bucket_count(self.spark, counts.postings)
        own = {"generation": secrets.randbits(62), "buckets": n, "made_for": max(1, counts.n)}
        plan = Plan.of(prefix(self.overlap), counts, n, self.hot)
        for k, cell in {"df": counts.df, "hot": plan.hot, "chunks": plan.chunks, "spread": plan.spread_out}.items():
            write_bytes(self.spark, f"{self.path}/plan-{own['generation']}/{k}", zlib.compress(cell.tobytes(), 1))
        return own

    def _plan(self, mark: dict) -> Plan:
        """The generation's plan: a byte a token, 12 MB at any size, and the salted tokens."""
        key = mark["generation"]
        if key not in self.plans:
            cell = {k: zlib.decompress(v) for k, v in read_folder(self.spark, f"{self.path}/plan-{key}").items()}
            ranking = prefix(self.overlap, broadcast_table(self.spark, np.frombuffer(cell["df"], np.uint8)))
            self.plans[key] = Plan(ranking, mark["buckets"], np.frombuffer(cell["hot"], np.uint32), np.frombuffer(cell["chunks"], np.int64), np.frombuffer(cell["spread"], bool)[:MINI])
        return self.plans[key]

    def _packed(self, texts: DataFrame, mark: dict, part: int) -> DataFrame:
        number = F.element_at(F.array(*(F.lit(v) for v in numbers(mark["buckets"]))), F.col("bucket") + 1)
        plain = texts.select("tid", "res", F.lit(0).alias("grp"), F.col("x") if "x" in texts.columns else F.lit(0).alias("x"))
        return blocks(plain, self._plan(mark)).select(number.alias("bucket"), F.lit(part).alias("part"), F.col("bucket").alias("n"), "blob")

    def refresh(self) -> None:
        """Make a new generation from the accepted texts: their counts, buckets and salted tokens, each text once."""
        marks = self._marks()
        if not marks:
            return
        last = marks[-1]
        plan = self._plan(last)

        def accepted(batches):
            for b in batches:
                for n, blob in zip(b.column("n").to_pylist(), b.column("blob"), strict=True):
                    t, _, _ = Texts.unpack(blob.as_buffer())
                    p = tokens(t, plan.ranking)
                    first = np.flatnonzero(np.diff(p.text, prepend=-1))  # a text comes from the bucket of its first token
                    own = at_home(plan, p.key[first], t.tid[p.text[first]], t.tid[p.text[first]], n)
                    t = t.take(p.text[first][own])
                    yield pa.RecordBatch.from_arrays([pa.array(t.tid, pa.int64()), pa.array(t.letters(), pa.string())], ["tid", "res"])

        parts = [m["part"] for m in marks if m["generation"] == last["generation"]]
        rows = self.spark.table(self._entries(last)).where(F.col("part").isin(parts)).select("n", "blob").mapInArrow(accepted, "tid long, res string")
        texts = cut(rows.groupBy("res").agg(F.min("tid").alias("tid")))
        own = self._generation(token_counts(texts.select("tid", "res", F.lit(0).alias("grp"), F.lit(0).alias("x")), self.hot))
        part = secrets.randbits(62)
        self._append(self._packed(texts, own, part), own)
        self._mark(own, part, last["no"] + 1, texts.count())

    def ingest(self, rows: DataFrame) -> DataFrame:
        """(ord_old, ord_new) for each row of one delivery that repeats an accepted row's text or is alike to one: the
        smallest such ord. rows: (ord, res), ord unique over all deliveries. Rows of one delivery are not compared
        with each other. An empty delivery gives no rows and leaves a mark. The result is checkpointed, since by the
        time it is read the index may have grown."""
        keyed = rows.select("ord", "res", *text_key(F.lit(0)))
        texts = cut(keyed.groupBy("k1", "k2").agg(F.min("ord").alias("tid"), F.first("res").alias("res")))
        told = texts.join(self.accept(texts), "tid").select("k1", "k2", "old")
        return cut(keyed.join(told, ["k1", "k2"]).select(F.col("old").alias("ord_old"), F.col("ord").alias("ord_new")))

    def accept(self, texts: DataFrame) -> DataFrame:
        """(tid, old) for each of a delivery's texts (tid, res), which are all different: the smallest id of the
        accepted texts that are the same or alike, if there are any. Checkpointed. With a column x (int) the delivery is a
        backlog of batches numbered by it: texts are different within a batch, and those of earlier ones count as accepted."""
        marks = self._marks()
        mark = marks[-1] if marks else None
        if mark is not None and sum(m["n"] for m in marks if m["generation"] == mark["generation"]) > self.growth * mark["made_for"]:
            self.refresh()
            marks = self._marks()
            mark = marks[-1]
        if mark is None:
            mark = self._generation(self.counts or token_counts(texts.select("tid", "res", F.lit(0).alias("grp"), F.lit(0).alias("x")), self.hot))
        parts = [m["part"] for m in marks if m["generation"] == mark["generation"]]
        part, plan, overlap = secrets.randbits(62), self._plan(mark), self.overlap
        self._append(self._packed(texts, mark, part), mark)

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            out = [np.zeros(0, np.int64)] * 2
            if a.num_rows:
                get = lambda x: [v.as_buffer() for v in x.column("blob")]
                fresh, known = probe(get(a), get(b), plan, a.column("n")[0].as_py(), overlap)
                order = np.lexsort((known, fresh))  # the smallest of each
                fresh, known = fresh[order], known[order]
                one = np.diff(fresh, prepend=-(1 << 62)) != 0
                out = [fresh[one], known[one]]
            return pa.table([pa.array(c) for c in out], ["tid", "old"])

        entries = self.spark.table(self._entries(mark))
        new, old = entries.where(F.col("part") == part), entries.where(F.col("part").isin(parts))
        near = new.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(meet, "tid long, old long")
        found = cut(near.groupBy("tid").agg(F.min("old").alias("old")))
        self._mark(mark, part, marks[-1]["no"] + 1 if marks else 0, texts.count())
        return found


def ingest_all(index: BatchIndex, rows: DataFrame) -> DataFrame:
    """(ord_old, ord_new) as by `ingest` of the batches of (ord, batch_no, res) one after the other, by rising number; they
    are delivered as one backlog. batch_no: an int; rows with a null number are in no batch."""
    rows = rows.where("batch_no is not null")
    keyed = rows.select("batch_no", "ord", "res", *text_key(F.lit(0)))
    texts = cut(keyed.groupBy("batch_no", "k1", "k2").agg(F.min("ord").alias("tid"), F.first("res").alias("res"), F.count("*").alias("n")))
    found = index.accept(texts.withColumn("x", F.col("batch_no").cast("int")))
    told = cut(texts.join(found, "tid").select("batch_no", "k1", "k2", "tid", "old", "n"))
    many = keyed.drop("res").join(told.where("n > 1"), ["batch_no", "k1", "k2"]).select("old", "ord")
    return many.unionAll(told.where("n = 1").select("old", "tid")).toDF("ord_old", "ord_new")


def candidate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return copies(table(spark, sf, "scored_candidates"), "seq", 0, 25, "ord", "batch_no")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """All batches are a backlog: one delivery to an index in the shared folder, which is removed in the end."""
    index = BatchIndex(spark, f"{shared_dir(spark)}/p3-{uuid.uuid4().hex}")
    out = ingest_all(index, candidate_rows(spark, sf))
    index.close()
    return out


def p3_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Per batch: rows, rows that count (25 residues or more), and rows that repeat or resemble an earlier batch's."""
    found = p3_found(spark, sf).select(F.col("ord_new").alias("ord"), F.lit(1).alias("dup"))
    all_rows = table(spark, sf, "scored_candidates").groupBy("batch_no").agg(F.count("*").alias("n_rows"))
    own = candidate_rows(spark, sf).join(found, "ord", "left").groupBy("batch_no").agg(F.count("*").alias("n_counted"), F.count("dup").alias("n_repeats"))
    return all_rows.join(own, "batch_no", "left").select("batch_no", "n_rows", F.coalesce("n_counted", F.lit(0)).alias("n_counted"), F.coalesce("n_repeats", F.lit(0)).alias("n_repeats"))
