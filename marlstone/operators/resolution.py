"""Entity resolution by names: TF-IDF cosine matching, guards, margins, tiers and their measures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import cosine
from marlstone.functions import scalars as S
from marlstone.operators.dedup import first_of, top
from marlstone.session import stored, written


def weighed(left: DataFrame, right: DataFrame, first: list[str]) -> tuple[str, Callable[[DataFrame], DataFrame]]:
    """Where the vectors of the right names lie, ordered by ``first`` and id, and what makes such vectors; weights are of both sides' names."""
    grams = S.char_wb_ngrams("name", 2, 4)
    each = left.select(grams.alias("g")).unionByName(right.select(grams.alias("g")))
    counts = stored(each.select(F.explode(F.array_distinct("g")).alias("g")).groupBy("g").agg(F.count("*").alias("df")), "grams")
    total = left.count() + right.count()

    def vectors(d: DataFrame) -> DataFrame:
        d = d.withColumn("grams", grams).drop("name")
        schema = T.StructType([*d.drop("grams").schema.fields, T.StructField("g", T.BinaryType()), T.StructField("w", T.BinaryType())])
        return d.mapInArrow(cosine.weigh(counts, total), schema)

    return stored(vectors(right.orderBy(*first, "id")), "vectors"), vectors


def similar(
    left: DataFrame, right: DataFrame, floor: float, k: int | None, scope: str | None = None, only: DataFrame | None = None, group: str | None = None,
    digits: int | None = None, over: tuple[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """``left_id, right_id, score``: per left id the ``k`` best right names with cosine of at least ``floor``; ties: the lower right id.

    ``left`` and ``right``: ``id, name`` and further columns.  Vectors are of grams within words: raw term counts,
    ``idf = ln((1 + N) / (1 + df)) + 1`` over both sides together, with repeats, unit length.

    No pair is lost: where the rarer grams show that a pair can't reach the floor, the rest of its score is not computed.  No pair is shuffled: the right vectors lie in the shared
    folder, ordered by id, and each task streams them in blocks past its left vectors, of which it keeps the best so far.

    With ``scope``, a column of both sides, pairs are sought within equal scopes only, under the same weights.  ``only``:
    the left ids to look up, if not all; the weights stay those of all names.  ``k``: how many matches of a left name are
    kept, all if None.  With ``group``, a column of the right side, the ``k`` best groups, each by its best name.
    ``digits``: scores that are equal when rounded so are ties.  ``over``: the result of :func:`weighed`, where it serves several calls.
    """
    first = [c for c in (scope, group) if c]
    spark = left.sparkSession
    left = written(left.select("id", "name", *[c for c in first if c == scope]), "names")
    if over is None:
        right = written(right.select("id", "name", *first), "names")
        over = weighed(left, right, first)
    ordered, vectors = over
    if only is not None:
        left = left.join(only, "id", "left_semi")
    # Few bytes are much work: a fixed number of partitions, which adaptive execution does not merge by size.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = left.repartitionByRange(n, scope, "id").sortWithinPartitions(scope) if scope else left.repartition(n)
    out = T.StructType([T.StructField("left_id", left.schema["id"].dataType), T.StructField("right_id", right.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    return vectors(left).mapInArrow(cosine.search(ordered, floor, k, scope, group, digits), out)


def two_pass(left: DataFrame, right: DataFrame, scope: str, scoped: float = 0.8, anywhere: float = 0.85) -> DataFrame:
    """Best match within the scope first; what stays unmatched is tried everywhere.  ``tier`` tells which."""
    a = written(similar(left, right, scoped, 1, scope).withColumn("tier", F.lit("scoped")), "scoped")
    rest = left.select("id").join(a.select(F.col("left_id").alias("id")), "id", "left_anti")
    return a.unionByName(similar(left, right, anywhere, 1, only=rest).withColumn("tier", F.lit("global")))


def digit_guard(a: Column | str, b: Column | str) -> Column:
    """Equal words with digits, and equal designators (none equals none)."""
    return S.digit_tokens(a).eqNullSafe(S.digit_tokens(b)) & S.designator(a).eqNullSafe(S.designator(b))


def family_verdict(families: Column, name: Column, bare: Column, support: Column, least: float = 0.2) -> Column:
    """``agree`` if a family word stands in the name as a word; ``backed`` if the bare score is exact and the scope supports it; else ``veto``."""
    words = F.split(F.upper(name), r"[^A-Z0-9]+")
    return F.when(F.arrays_overlap(families, words), "agree").when((bare >= 0.999999) & (support >= least), "backed").otherwise("veto")


def best_margin(scored: DataFrame, unit: DataFrame) -> DataFrame:
    """Per left id the best right unit, its score and the margin over the best other unit; ``unit``: ``right_id, unit``."""
    s = scored.join(unit, "right_id").groupBy("left_id", "unit").agg(F.max("score").alias("score"))
    w = Window.partitionBy("left_id").orderBy(F.desc("score"), F.asc("unit"))
    two = s.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    best = F.max(F.when(F.col("rn") == 1, F.struct("score", "unit"))).alias("b")
    out = two.groupBy("left_id").agg(best, F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("second"))
    return out.select("left_id", F.col("b.unit").alias("unit"), F.col("b.score").alias("score"), (F.col("b.score") - F.coalesce("second", F.lit(0.0))).alias("margin"))


def accept(df: DataFrame, margin: float = 0.02, unique: float = 0.97) -> DataFrame:
    """Global acceptance: a clear margin, and the families agree, the scope backs the name, or a unique name fits almost exactly.  Needs ``verdict, n_same_name``."""
    return df.where((F.col("margin") >= margin) & (F.col("verdict").isin("agree", "backed") | ((F.col("score") >= unique) & (F.col("n_same_name") == 1))))


def scope_support(accepted: DataFrame, left_scope: DataFrame, right_scope: DataFrame) -> DataFrame:
    """``scope_l, scope_r, support``: the share of a left scope's accepted links that go to a right scope."""
    s = accepted.join(left_scope, "left_id").join(right_scope, "unit").groupBy("scope_l", "scope_r").agg(F.count("*").alias("n"))
    return s.withColumn("support", F.col("n") / F.sum("n").over(Window.partitionBy("scope_l"))).drop("n")


def judged(cand: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """``cand`` (``left_id, unit, score, scope_l, scope_r, families``) with ``support`` and ``verdict``; no support given: none is known yet."""
    if support is None:
        c = cand.withColumn("support", F.lit(0.0))
    else:
        c = cand.join(support.select("scope_l", "scope_r", "support"), ["scope_l", "scope_r"], "left").withColumn("support", F.coalesce("support", F.lit(0.0)))
    return c.withColumn("verdict", family_verdict(F.col("families"), F.col("unit"), F.col("score"), F.col("support")))


def accept_global(verdicts: DataFrame, anywhere: float = 0.85) -> DataFrame:
    """The best unit of each left id among judged candidates of at least ``anywhere``, where :func:`accept` takes it."""
    over = verdicts.where(F.col("score") >= anywhere)
    best = best_margin(over.select("left_id", F.col("unit").alias("right_id"), "score"), over.select(F.col("unit").alias("right_id"), "unit").distinct())
    return accept(best.join(over.drop("score"), ["left_id", "unit"]))


def scope_bootstrap(cand: DataFrame, scoped: float = 0.8, anywhere: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Links in two passes, and the scope support between them.

    ``cand``: one row per ``left_id, unit`` with ``score, scope_l, scope_r, families, n_same_name``.  The first pass
    accepts anywhere; its links tell which scopes belong together.  The second takes what is left: the best unit
    within those scopes first, then anywhere again, with the support known.

    Returns ``left_id, unit, score, tier, pass`` (one row per left id) and ``scope_l, scope_r, support``.
    """
    cols = ["left_id", "unit", "score", "scope_l", "scope_r"]
    first = written(accept_global(judged(cand), anywhere).select(*cols), "links")
    support = written(scope_support(first.select("left_id", "unit"), first.select("left_id", "scope_l"), first.select("unit", "scope_r").distinct()), "support")
    links = lambda d, tier, n: d.select("left_id", "unit", "score", F.lit(tier).alias("tier"), F.lit(n).alias("pass"))
    rest = cand.join(first.select("left_id"), "left_id", "left_anti")
    inside = rest.where(F.col("score") >= scoped).join(support.select("scope_l", "scope_r"), ["scope_l", "scope_r"], "left_semi")
    inside = written(first_of(inside, ["left_id"], [F.desc("score"), F.asc("unit")]).select(*cols), "links")
    rest = rest.join(inside.select("left_id"), "left_id", "left_anti")
    out = links(first, "global", 1).unionByName(links(inside, "scoped", 2)).unionByName(links(accept_global(judged(rest, support), anywhere), "global", 2))
    return out, support


def collapse_classes(df: DataFrame, unit: str, measure: str, flag: str, row: str) -> DataFrame:
    """Many classes to one unit: the measure's sum, the commonest flag (ties: the lesser), the largest class as representative."""
    total = df.groupBy(unit).agg(F.sum(measure).alias(measure), F.max_by(row, F.struct(F.coalesce(measure, F.lit(-1.0)), -F.col(row))).alias("representative"), F.count("*").alias("n_classes"))
    n = df.where(F.col(flag).isNotNull()).groupBy(unit, flag).agg(F.count("*").alias("_n"))
    modal = first_of(n, [unit], [F.desc("_n"), F.asc(flag)]).select(unit, flag)
    return total.join(modal, unit, "left")


def vocabulary(sources: list[tuple[str, DataFrame, str, Column]]) -> DataFrame:
    """``name, source, year`` of all spellings; sources: (label, table, name column, year)."""
    return reduce(DataFrame.unionByName, [df.select(S.normalize_name(c).alias("name"), F.lit(label).alias("source"), y.cast("int").alias("year")) for label, df, c, y in sources]).where("name != ''").distinct()


def best_of_variants(queries: DataFrame, right: DataFrame, floor: float, k: int = 1) -> DataFrame:
    """Several spellings per query (``id, variants array``): a pair's score is its best spelling's."""
    each = queries.select("id", F.posexplode("variants").alias("pos", "name")).select(F.struct("id", "pos").alias("id"), "name")
    s = similar(each, right, floor, k)
    return s.groupBy(F.col("left_id.id").alias("left_id"), "right_id").agg(F.max("score").alias("score"))


def threshold_sweep(scored: DataFrame, truth: Column, score: str = "score", at: tuple[float, ...] = (0.85, 0.9, 0.95)) -> DataFrame:
    """Per threshold: false positives among known negatives, hits among known positives, and the precision they imply."""
    rows = scored.select(truth.alias("t"), score, F.explode(F.array(*[F.lit(x) for x in at])).alias("threshold"))
    n = lambda c: F.count(F.when(c, 1))
    yes = F.col(score) >= F.col("threshold")
    g = rows.groupBy("threshold").agg(n(F.col("t") & yes).alias("tp"), n(~F.col("t") & yes).alias("fp"), n(F.col("t")).alias("pos"), n(~F.col("t")).alias("neg"))
    r = lambda a, b: F.round(F.try_divide(a, b), 6)
    return g.select("threshold", r("fp", "neg").alias("fpr"), r("tp", "pos").alias("accuracy"), r("tp", F.col("tp") + F.col("fp")).alias("precision"))


def coverage_rollup(df: DataFrame, year: Column, tier: Column, linked: Column, weight: Column) -> DataFrame:
    """Linked shares by year and tier over two denominators: rows and weight."""
    y = df.select(year.alias("year"), F.when(linked, tier).otherwise(F.lit("unlinked")).alias("tier"), weight.alias("w"))
    g = y.groupBy("year", "tier").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    w = Window.partitionBy("year")
    return g.select("year", "tier", "n", F.round(F.col("n") / F.sum("n").over(w), 6).alias("row_share"), F.round(F.try_divide(F.col("w"), F.sum("w").over(w)), 6).alias("weight_share"))


def narrow(df: DataFrame, key: str, candidate: str, tests: list[Column]) -> DataFrame:
    """Ordered tests per key: one that leaves a single candidate decides; one that leaves several narrows to them; one that leaves none is ignored.

    Staged as one windowed count per test, whatever the size of a group's candidates.
    """
    out = df.withColumn("_in", F.lit(True))
    for i, t in enumerate(tests):
        kept = F.count(F.when(F.col("_in") & F.coalesce(t, F.lit(False)), 1)).over(Window.partitionBy(key))
        out = out.withColumn(f"_k{i}", kept).withColumn("_in", F.when(F.col(f"_k{i}") > 0, F.col("_in") & F.coalesce(t, F.lit(False))).otherwise(F.col("_in"))).drop(f"_k{i}")
    left = out.where("_in")
    g = left.groupBy(key).agg(F.count("*").alias("n_left"), F.min(candidate).alias(candidate))
    return g.select(key, F.when(F.col("n_left") == 1, F.col(candidate)).alias(candidate), "n_left")


def candidate_status(left: DataFrame, right: DataFrame, on: list[str], right_id: str) -> DataFrame:
    """``none``, ``one`` or ``many`` right rows by composite key, with the id where there is one."""
    r = right.groupBy(*on).agg(F.count("*").alias("_n"), F.min(right_id).alias(right_id))
    status = F.when(F.col("_n").isNull(), "none").when(F.col("_n") == 1, "one").otherwise("many")
    return left.join(r, on, "left").withColumn("status", status).withColumn(right_id, F.when(F.col("_n") == 1, F.col(right_id))).drop("_n")
