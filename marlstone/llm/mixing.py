"""Mixing sources to target weights by hierarchical budgeting (problem 8)."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def plain_source(source: str | Column) -> Column:
    """Letter case, outer blanks and ``-`` for ``_`` aside."""
    c = F.col(source) if isinstance(source, str) else source
    return F.translate(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), "-", "_")


def plain_language(lang: str | Column) -> Column:
    """A language code of two or three letters in lower case, whatever region follows; anything else is ``und``.

    So a source has a bounded number of leaves, however dirty the column is.
    """
    c = F.col(lang) if isinstance(lang, str) else lang
    code = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(code != "", code).otherwise(F.lit("und"))


@dataclass
class Node:
    """A node of the domain-language-source tree: its weight, what its leaves can take, and its budget."""

    weight: float = 0.0
    capacity: float = 0.0
    budget: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)

    def give(self, amount: float) -> None:
        """Spreads a budget over the children by weight; what one cannot take goes to its siblings.

        No child is given more than its leaves hold, so no shortage is left for the
        node's own siblings unless the whole node is short - then its budget was
        cut to its capacity one level up, before the siblings of that level shared
        the rest.
        """
        self.budget = amount
        weight = sum(c.weight for c in self.children.values())
        for c in sorted((c for c in self.children.values() if c.weight > 0), key=lambda c: c.capacity / c.weight):
            c.give(min(c.capacity, amount * c.weight / weight))
            amount, weight = amount - c.budget, weight - c.weight


def plan(leaves: list[dict], total: float | None = None) -> tuple[dict[tuple[str, str, str], float], float]:
    """Budgets of the ``(domain, lang, source)`` leaves and the size they add up to.

    ``leaves``: ``domain, lang, source, weight, tokens, max_repeats``.  A leaf's
    shortage goes to its siblings first, and only what a whole subtree cannot take
    to its ancestors' other children; leaves without weight get nothing.  Without
    ``total`` the largest size is taken at which no source is short, so that every
    target share is met.
    """
    by_source: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for x in leaves:
        by_source[x["source"]][0] += x["weight"]
        by_source[x["source"]][1] += x["tokens"] * x["max_repeats"]
    if total is None:
        total = min((cap / w for w, cap in by_source.values() if w > 0), default=0.0)
    root = Node()
    for x in leaves:
        path = [root]
        for name in (x["domain"], x["lang"], x["source"]):
            path.append(path[-1].children.setdefault(name, Node()))
        for at in path:
            at.weight += x["weight"]
            at.capacity += x["tokens"] * x["max_repeats"] if x["weight"] > 0 else 0
    root.give(min(total, root.capacity))
    out = {(d, g, s): n.budget for d, dn in root.children.items() for g, gn in dn.children.items() for s, n in gn.children.items()}
    return out, total


def leaves_of(docs: DataFrame, aim: dict[str, tuple[float, int]], domains: dict[str, list[str]]) -> list[dict]:
    """One row per (domain, language, source): a source's share is split over its languages by their tokens."""
    of = {s: d for d, ss in domains.items() for s in ss}
    sizes = [r.asDict() for r in docs.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens")).collect()]
    whole: dict[str, float] = defaultdict(float)
    for r in sizes:
        whole[r["source"]] += r["tokens"]
    return [
        r | {"domain": of.get(r["source"], r["source"]), "weight": aim[r["source"]][0] * r["tokens"] / whole[r["source"]], "max_repeats": aim[r["source"]][1]}
        for r in sorted(sizes, key=lambda r: (r["source"], r["lang"]))
    ]


def usable(counts: DataFrame, targets: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, int]]]:
    """Documents with tokens and a target source, and each source's share and cap."""
    aim = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"]}
    docs = counts.where((F.col("n_tokens") > 0) & F.col("source").isin(list(aim)))
    return docs.select("doc_id", "source", F.coalesce("lang", F.lit("und")).alias("lang"), "n_tokens"), aim


def budgets(counts: DataFrame, targets: DataFrame, domains: dict[str, list[str]] | None = None, total_tokens: float | None = None, all_held: bool = False) -> DataFrame:
    """``domain, lang, source, weight, capacity, budget`` of each leaf (see :func:`mix`)."""
    docs, aim = usable(counts, targets)
    leaves = leaves_of(docs, aim, domains or {})
    got, _ = plan(leaves, float(sum(x["tokens"] for x in leaves)) if all_held else total_tokens)
    rows = [(x["domain"], x["lang"], x["source"], x["weight"], float(x["tokens"] * x["max_repeats"]), got[x["domain"], x["lang"], x["source"]]) for x in leaves]
    return counts.sparkSession.createDataFrame(rows, "domain string, lang string, source string, weight double, capacity double, budget double")


def mix(
    counts: DataFrame, targets: DataFrame, total_tokens: float | None = None, domains: dict[str, list[str]] | None = None, seed: int = 7, buckets: int = 4096,
    all_held: bool = False,
) -> DataFrame:
    """``doc_id, source, lang, n_tokens, repeats`` of the documents chosen.

    ``counts``: ``doc_id, source, lang, n_tokens`` of all documents, ``source`` and
    ``lang`` in plain form (a bounded number of leaves); ``targets``: ``source, target_share, max_repeats`` (a fixed table
    of few rows); ``domains``: the sources of each domain, a source not named is a
    domain of its own; ``all_held``: as many tokens as all these documents have,
    so that short sources' shares go to others.  A leaf is a (domain, language, source); a source's share is
    split over its languages by their tokens.  A leaf's budget is met by whole
    epochs over all its documents and a token-prefix of one more, each epoch in its
    own seeded order; the prefix ends before the document that would pass the
    budget, so a leaf misses it by less than that document.  No document is used
    more than ``max_repeats`` times.

    Documents whose source has no target, and those without tokens, are not used.
    The prefix is found without sorting a leaf: token sums per hash bucket (at most
    ``buckets`` a leaf) name the bucket in which it ends, and only that bucket is
    ordered.  To the driver come one row per leaf and per target.
    """
    docs, aim = usable(counts, targets)
    leaves = leaves_of(docs, aim, domains or {})
    budgets, _ = plan(leaves, float(sum(x["tokens"] for x in leaves)) if all_held else total_tokens)
    rows = []
    for x in leaves:
        budget = budgets[x["domain"], x["lang"], x["source"]]
        epochs = min(int(budget // x["tokens"] + 1e-9), x["max_repeats"])
        rest = int(budget - epochs * x["tokens"] + 1e-6) if epochs < x["max_repeats"] else 0
        rows.append((x["source"], x["lang"], epochs, rest))
    spark = counts.sparkSession
    leaf = spark.createDataFrame(rows, "source string, lang string, epochs int, rest long")

    # The order of the last, partial epoch: a hash of seed, epoch and document.
    order = F.xxhash64(F.lit(seed), "epochs", F.col("doc_id"))
    keyed = docs.join(F.broadcast(leaf), ["source", "lang"]).withColumn("h", order).withColumn("b", F.pmod("h", F.lit(buckets)))
    sums = keyed.groupBy("source", "lang", "b").agg(F.sum("n_tokens").alias("t"))
    upto = Window.partitionBy("source", "lang").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "lang", "b", "t", F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("before"))
    placed = keyed.join(sums, ["source", "lang", "b"])
    full = F.col("before") + F.col("t") <= F.col("rest")
    sure = placed.select("doc_id", "source", "lang", "n_tokens", (F.col("epochs") + F.when(full, 1).otherwise(0)).alias("repeats")).where(
        full | (F.col("before") >= F.col("rest"))
    )
    edge = placed.where(~full & (F.col("before") < F.col("rest")))
    run = Window.partitionBy("source", "lang", "b").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.col("before") + F.sum("n_tokens").over(run) <= F.col("rest")
    edge = edge.select("doc_id", "source", "lang", "n_tokens", (F.col("epochs") + F.when(fits, 1).otherwise(0)).alias("repeats"))
    return sure.unionByName(edge).where("repeats > 0")


def shares(mixture: DataFrame, counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: ``target_share, actual_share, tokens, n_docs, mean_repeats, most_repeats, available_tokens``."""
    used = mixture.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("n_docs"), F.avg("repeats").alias("mean_repeats"),
        F.max("repeats").alias("most_repeats"),
    )
    have = counts.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    out = targets.select("source", "target_share", "max_repeats").join(used, "source", "left").join(have, "source", "left").fillna(0)
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return out.withColumn("actual_share", F.try_divide(F.col("tokens"), whole))
