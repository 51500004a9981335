"""Attributes as valid and known at event time, by path-copied persistent search trees (problem 6)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class KnownTimeTree:
    """A bitemporal index: one root per known time, each a search tree over valid time.

    ``spans``: ``(known, order, first, last, value)`` in ascending order; of two
    spans that cover a day the later inserted one wins.  Inserting a span copies
    only the nodes on its paths; all older roots stay as they were.
    """

    def __init__(self, spans: list[tuple[int, int, int, object]]):
        cuts = sorted({x for _, first, last, _ in spans for x in (first, last + 1)})
        self.cuts, self.width = cuts, max(len(cuts) - 1, 1)
        self.left, self.right, self.mark = [0], [0], [-1]  # node 0: empty
        self.times: list[int] = []
        self.roots: list[int] = []
        self.values: list[object] = []
        root = 0
        for known, first, last, value in spans:
            self.values.append(value)
            root = self._insert(root, 0, self.width, bisect_left(cuts, first), bisect_left(cuts, last + 1), len(self.values) - 1)
            if self.times and self.times[-1] == known:
                self.roots[-1] = root
            else:
                self.times.append(known)
                self.roots.append(root)

    def _insert(self, node: int, lo: int, hi: int, a: int, b: int, rank: int) -> int:
        new = len(self.mark)
        self.left.append(self.left[node])
        self.right.append(self.right[node])
        self.mark.append(self.mark[node])
        if a <= lo and hi <= b:
            self.mark[new] = rank
            return new
        mid = (lo + hi) // 2
        if a < mid:
            self.left[new] = self._insert(self.left[node], lo, mid, a, b, rank)
        if b > mid:
            self.right[new] = self._insert(self.right[node], mid, hi, a, b, rank)
        return new

    def find(self, known: int, valid: int) -> object | None:
        """The value of the last known span that covers ``valid`` as of ``known``."""
        at = bisect_right(self.times, known) - 1
        if at < 0 or not self.cuts[0] <= valid < self.cuts[-1]:
            return None
        node, lo, hi, leaf, best = self.roots[at], 0, self.width, bisect_right(self.cuts, valid) - 1, -1
        while node:
            best = max(best, self.mark[node])
            if hi - lo == 1:
                break
            mid = (lo + hi) // 2
            if leaf < mid:
                node, hi = self.left[node], mid
            else:
                node, lo = self.right[node], mid
        return self.values[best] if best >= 0 else None


def as_known_at(
    events: DataFrame, key: str, at: str, spans: DataFrame, span_id: str, first: str, last: str, known: str, shard_days: int = 1830, shard_spans: int = 50_000
) -> DataFrame:
    """All ``events`` columns and ``span_id`` of the span valid and known at ``at``; events without one are left out.

    A span covers ``first <= at <= last`` (null ``last``: open) and must have
    ``known <= at`` (null: never known); of several the latest ``known``, then
    ``first``, then ``span_id`` wins.  Null key, ``first`` or ``at`` never match;
    reversed spans cover nothing; repeated spans and events keep the rules above.

    One tree is built per key, shard of ``shard_days`` valid days and piece of about
    ``shard_spans`` spans, so neither a long history nor a hot key ends in one
    group: the answer depends on key and day alone, hence events are reduced to
    distinct (key, day) first - at most ``shard_days`` a group, asked of each piece -
    the best of the pieces' answers counts, and answers are joined back by
    (key, day), where adaptive execution splits skewed keys.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    asked = events.select(F.col(key).alias("k"), day(at).alias("a")).where("k is not null and a is not null").distinct()
    asked = asked.select("k", F.floor(F.col("a") / shard_days).cast("int").alias("sh"), "a")
    # Later trees than the last event's shard are never asked; open ends are clipped there.
    reach = F.lit(2932896)
    held = (
        spans.select(F.col(key).alias("k"), day(known).alias("l"), day(first).alias("a"), F.coalesce(day(last), reach).alias("b"), F.col(span_id).cast("long").alias("id"))
        .where("k is not null and l is not null and a is not null and b >= a")
        .groupBy("k", "l", "a", "b").agg(F.max("id").alias("id"))
    )
    shards = asked.select("k", "sh").distinct()
    held = held.join(shards, "k").where(f"sh >= floor(a / {shard_days}) and sh <= floor(b / {shard_days}) and l < (sh + 1) * {shard_days}")
    pieces = held.groupBy("k", "sh").agg(F.ceil(F.count("*") / shard_spans).cast("int").alias("m")).where("m > 1")
    split = lambda df: df.join(pieces, ["k", "sh"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    held = split(held).select("k", "sh", F.pmod(F.xxhash64("l", "a", "b"), "m").cast("int").alias("piece"), F.lit(0).alias("kind"), "l", "a", "b", "id")
    asked = split(asked).select("k", "sh", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("piece"), F.lit(1).alias("kind"), F.lit(0).alias("l"), "a", F.col("a").alias("b"), F.lit(0).cast("long").alias("id"))
    both = held.unionByName(asked).repartition("k", "sh", "piece").sortWithinPartitions("k", "sh", "piece", "kind", "l", "a", "id")
    k_type = both.schema["k"].dataType.simpleString()
    found = both.mapInArrow(_search, f"k {k_type}, a int, l int, f int, id bigint")
    found = found.groupBy(F.col("k").alias("_k"), F.col("a").alias("_a")).agg(F.max(F.struct("l", "f", "id"))["id"].alias("_found"))
    kept = events.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    joined = kept.join(found, (kept[key] == found["_k"]) & (F.unix_date(kept[at].cast("date")) == found["_a"]))
    return joined.select(*[kept[c] for c in kept.columns if c != span_id], F.col("_found").alias(span_id))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, spans, tree = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = (batch.column(n).to_pylist() for n in ("k", "sh", "piece", "kind", "l", "a", "b", "id"))
        out_k, out_a, out = [], [], []
        for k, sh, piece, kind, known, a, b, i in zip(*cols, strict=True):
            if (k, sh, piece) != group:
                group, spans, tree = (k, sh, piece), [], None
            if kind == 0:
                spans.append((known, a, b, (known, a, i)))
                continue
            if tree is None and spans:
                tree = KnownTimeTree(spans)
            if tree is not None and (hit := tree.find(a, a)) is not None:
                out_k.append(k)
                out_a.append(a)
                out.append(hit)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out_k, batch.schema.field("k").type), pa.array(out_a, pa.int32()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64())],
            names=["k", "a", "l", "f", "id"],
        )
