"""Matching funds of two sources without a common key by label-model linkage (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.label_model import LabelModel
from marlstone.llm.names import Parts, firm, fold, fund
from marlstone.llm.variants import _score
from marlstone.session import written

VOTES = ["title", "coverage", "manager", "objective", "assets", "period", "rival"]
#: How strongly each vote for, and against, counts in the label model's first guess.
FIRST_GUESS = np.array([[1.2, 0.6, 0.5, 0.4, 1.0, 0.7, 0.3], [4.0, 1.0, 0.7, 0.5, 2.0, 1.0, 2.5]])


def components(edges: DataFrame) -> DataFrame:
    """``node, unit``: the least node of each connected component; ``edges``: ``node, hub`` (two kinds of things).

    Each round every node takes the least label within its hubs, hands it to the
    node its own label names, and then takes its label's label (pointer jumping),
    so a chain of n nodes is done in about log n rounds; rounds go on until no
    label moves.  All steps are aggregations with map-side combine and joins by
    node, so a hot hub meets in no task.
    """
    edges = written(edges.where("node is not null and hub is not null").distinct(), "edges")
    label = edges.select("node", F.col("node").alias("unit")).distinct()
    while True:
        hub = edges.join(label, "node").groupBy("hub").agg(F.min("unit").alias("unit"))
        near = edges.join(hub, "hub").groupBy("node").agg(F.min("unit").alias("low"))
        both = label.join(near, "node").select("node", "unit", F.least("unit", "low").alias("low"))
        told = both.select("node", F.col("unit").alias("old"), "low").unionByName(both.where("low < unit").select(F.col("unit").alias("node"), F.lit(None).cast(label.schema["unit"].dataType).alias("old"), "low"))
        told = told.groupBy("node").agg(F.max("old").alias("old"), F.min("low").alias("low"))
        root = told.select(F.col("node").alias("low"), F.col("low").alias("root"))
        step = told.join(root, "low").select("node", F.col("root").alias("unit"), (F.col("root") < F.col("old")).alias("moved"))
        step = written(step, "labels")
        label = step.select("node", "unit")
        if step.where("moved").isEmpty():
            return label


def _titles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ps = [fund(fold(t), repair=True) for t in batch.column("title").to_pylist()]
        keys = [_keys(p) for p in ps]
        cols = [pa.array([getattr(p, f) for p in ps], pa.string()) for f in ("l", "a", "s")]
        yield pa.RecordBatch.from_arrays([*batch.columns, *cols, pa.array(keys, pa.list_(pa.string()))], names=[*batch.schema.names, "l", "a", "s", "keys"])


def _keys(p: Parts) -> list[str]:
    """Blocking keys: family and first four letters of the style (what a cut title keeps), and the whole title less any one letter (what one slip leaves)."""
    if not p.l:
        return []
    whole = p.l + p.a
    return [f"{p.l}|{p.a[:4]}|{p.s}", *sorted({f"~{whole[:i]}{whole[i + 1 :]}|{p.s}" for i in range(len(whole))} | {f"~{whole}|{p.s}"})]


def _firms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fam = [firm(fold(m)).l for m in batch.column("manager").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fam, pa.string())], names=[*batch.schema.names, "family"])


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("lx", "ax", "sx", "ly", "ay", "sy")), strict=True)
        near = [sx == sy and _score(Parts("F", ax, "", lx, sx, 0), Parts("F", ay, "", ly, sy, 0)) >= 0.8 for lx, ax, sx, ly, ay, sy in rows]
        yield pa.RecordBatch.from_arrays([batch.column("fx"), batch.column("fy"), pa.array(near, pa.bool_())], names=["fx", "fy", "near"])


def described(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of both sides at once: ``(side, who, form, n)`` of titles' forms, one row of other attributes each, and the forms.

    ``raw``: ``side, who, title, manager, objective, n, log_sum, log_n, first, last``, pre-aggregated.
    """
    titles = raw.where(F.col("title").rlike(r"\S")).select("title").distinct()
    known = written(titles.mapInArrow(_titles, "title string, l string, a string, s string, keys array<string>"), "titles").where("l != ''")
    form = F.xxhash64("l", "a", "s")
    by = raw.groupBy("side", "who", "title").agg(F.sum("n").alias("n")).join(known, "title").groupBy("side", "who", form.alias("form")).agg(F.sum("n").alias("n"))
    forms = known.groupBy(form.alias("form"), "l", "a", "s").agg(F.first("keys").alias("keys"))
    firms = raw.where("manager is not null").select("manager").distinct().mapInArrow(_firms, "manager string, family string").where("family != ''")
    families = raw.select("side", "who", "manager").distinct().join(firms, "manager").groupBy("side", "who").agg(F.collect_set("family").alias("families"))
    objective = raw.where("objective is not null").groupBy("side", "who", "objective").agg(F.sum("n").alias("n"))
    objective = objective.groupBy("side", "who").agg(F.max_by("objective", F.struct("n", "objective")).alias("objective"))
    size = raw.groupBy("side", "who").agg((F.sum("log_sum") / F.sum("log_n")).alias("log_size"), F.min("first").alias("first"), F.max("last").alias("last"))
    about = size.join(families, ["side", "who"], "left").join(objective, ["side", "who"], "left")
    return written(by, "forms-of"), written(about, "about"), forms


def link_funds(left: DataFrame, right: DataFrame, most: int = 1) -> DataFrame:
    """``fund, unit, confidence`` of pairs of a left fund and a right unit that are the same fund.

    ``left``: ``fund`` and ``right``: ``unit``, each with ``title, manager,
    objective, n, log_sum, log_n, first, last`` (see :func:`described`).

    Candidates share a blocking key of their titles' forms.  Seven functions vote
    for, against or abstain: the title (same form / same but for one slip or a
    cut), its share of the left rows, the managers' families, the objectives (as
    they go together among unambiguous titles), the sizes, the periods, and
    whether a rival unit bears the same title.  A generative model of the votes,
    :class:`LabelModel`, learns how far to trust each and which go together; its
    posterior is the confidence.  A fund keeps its best unit, if more likely than
    not the same; ties go to the nearer size, then the lower unit.

    To the driver come counts per vote pattern (at most 3**7) and objective pair,
    never rows.  Null attributes abstain, repeated rows weigh in counts only,
    empty inputs give an empty result.
    """
    cols = ["title", "manager", "objective", "n", "log_sum", "log_n", "first", "last"]
    both = left.select(F.lit(0).alias("side"), F.col("fund").alias("who"), *cols).unionByName(right.select(F.lit(1).alias("side"), F.col("unit").alias("who"), *cols))
    by, about, forms = described(both)
    lf, rf = (by.where(f"side = {i}").select(F.col("who").alias(n), "form", "n") for i, n in enumerate(("fund", "unit")))
    la, ra = (about.where(f"side = {i}").withColumnRenamed("who", n).drop("side") for i, n in enumerate(("fund", "unit")))
    of = by.groupBy("form").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    keyed = written(forms.join(of, "form").select("form", "l", "a", "s", "lo", "hi", F.explode("keys").alias("key")).withColumn("key", F.xxhash64("key")), "keys")
    x, y = (keyed.where(w).select("key", *[F.col(c).alias(("f" if c == "form" else c) + i) for c in ("form", "l", "a", "s")]) for w, i in (("lo = 0", "x"), ("hi = 1", "y")))
    met = x.join(y, "key").drop("key").dropDuplicates(["fx", "fy"])
    near = met.where("fx != fy").mapInArrow(_likeness, "fx bigint, fy bigint, near boolean")
    rel = near.select("fx", "fy", F.when(F.col("near"), 1).otherwise(0).alias("rel")).unionByName(met.where("fx = fy").select("fx", "fy", F.lit(2).alias("rel")))
    pairs = (
        lf.withColumnRenamed("form", "fx").join(rel, "fx").join(rf.select("unit", F.col("form").alias("fy"), F.col("n").alias("ny")), "fy")
        .groupBy("fund", "unit", "fx").agg(F.max("rel").alias("rel"), F.first("n").alias("n"))
        .groupBy("fund", "unit").agg(F.max("rel").alias("rel"), F.sum(F.when(F.col("rel") > 0, F.col("n"))).alias("like"))
    )
    total = lf.groupBy("fund").agg(F.sum("n").alias("total"))
    la = la.select("fund", *[F.col(c).alias(c + "_l") for c in ("log_size", "first", "last", "families", "objective")])
    ra = ra.select("unit", *[F.col(c).alias(c + "_r") for c in ("log_size", "first", "last", "families", "objective")])
    pairs = written(pairs.join(total, "fund").join(la, "fund").join(ra, "unit").withColumn("share", F.coalesce(F.try_divide("like", "total"), F.lit(0.0))), "pairs")

    goes = _objectives(pairs)
    gap = F.abs(F.col("log_size_l") - F.col("log_size_r"))
    days = F.greatest(F.datediff(F.least("last_l", "last_r"), F.greatest("first_l", "first_r")), F.lit(0)) + 1
    inside = days / (F.datediff("last_l", "first_l") + 1)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0).cast("tinyint")
    same = Window.partitionBy("fund")
    voted = (
        pairs.join(goes, ["objective_l", "objective_r"], "left")
        .withColumn("gap", gap)
        .withColumn("best_gap", F.min(F.when(F.col("rel") > 0, F.col("gap"))).over(same))
        .withColumn("n_like", F.count(F.when(F.col("rel") > 0, 1)).over(same))
        .select(
            "fund", "unit", "gap",
            vote(F.col("rel") == 2, F.col("rel") == 0).alias("title"),
            vote(F.col("share") >= 0.4, F.col("share") < 0.05).alias("coverage"),
            vote(F.arrays_overlap("families_l", "families_r"), F.expr("size(families_l) > 0 and size(families_r) > 0 and not arrays_overlap(families_l, families_r)")).alias("manager"),
            vote(F.col("lift") > 1.5, F.col("lift") < 0.3).alias("objective"),
            vote(F.col("gap") <= 0.7, F.col("gap") >= 1.8).alias("assets"),
            vote(inside >= 0.6, inside < 0.15).alias("period"),
            vote((F.col("n_like") == 1) & (F.col("rel") > 0), (F.col("n_like") > 1) & (F.col("gap") > F.col("best_gap") + 0.3)).alias("rival"),
        )
    )
    voted = written(voted, "votes")
    seen = voted.groupBy(*VOTES).agg(F.count("*").alias("n")).collect()
    spark = left.sparkSession
    schema = ", ".join(f"{v} tinyint" for v in VOTES) + ", confidence double"
    rows = []
    if seen:
        patterns = np.array([[r[v] for v in VOTES] for r in seen])
        post = LabelModel(len(VOTES)).fit(patterns, np.array([r["n"] for r in seen]), FIRST_GUESS)
        rows = [(*map(int, p), float(q)) for p, q in zip(patterns, post, strict=True)]
    believed = voted.join(F.broadcast(spark.createDataFrame(rows, schema)), VOTES).where("confidence > 0.5")
    best = Window.partitionBy("fund").orderBy(F.desc("confidence"), F.coalesce("gap", F.lit(99.0)), "unit")
    return believed.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= most).select("fund", "unit", "confidence")


def _objectives(pairs: DataFrame) -> DataFrame:
    """``objective_l, objective_r, lift``: how much oftener two codes meet in pairs of one title than by chance."""
    met = pairs.where("rel = 2 and objective_l is not null and objective_r is not null").groupBy("objective_l", "objective_r").agg(F.count("*").alias("n"))
    w = lambda *by: F.sum("n").over(Window.partitionBy(*by))
    lift = F.col("n") * w(F.lit(1)) / (w("objective_l") * w("objective_r"))
    return met.select("objective_l", "objective_r", lift.alias("lift"))
