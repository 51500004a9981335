"""Variant spellings of names of persons, funds and managers (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.minhash import Bands, bands_for
from marlstone.llm.names import SPELLED, Parts, ends, fold, given, kind_of, like_fund, monge_elkan, order_shown, parse, typo, word
from marlstone.session import written

#: The least q-gram similarity of a pair to be linked (one slip, or an initial for a given name), and the recall wanted there.
SIMILARITY, RECALL, ROWS = 0.5, 0.98, 3
#: How much more q-grams of surnames and family names weigh than those of given names and styles, which many share.
WEIGHT = 3


def grams(p: Parts, q: int = 3) -> set[str]:
    """Padded q-grams of all words of a name, those of the surname or family name ``WEIGHT`` times."""
    def of(w: str) -> set[str]:
        w = "#" * (q - 1) + w + "#" * (q - 1)
        return {w[i : i + q] for i in range(len(w) - q + 1)}

    name = of(p.l)
    return {f"{i}{g}" for i in range(WEIGHT) for g in name} | {"_" + g for w in p.a.split(" ") if w for g in of(w)}


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shown = [x for n, f in zip(batch.column("name").to_pylist(), batch.column("is_fund").to_pylist(), strict=True) for x in order_shown(n, f)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in shown], pa.string()), pa.array([v for _, v in shown], pa.int64())], names=["word", "vote"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = []
        for n, f in zip(batch.column("name").to_pylist(), batch.column("is_fund").to_pylist(), strict=True):
            s = fold(n)
            a, b = ends(s) if kind_of(n, s, f) == "C" else ("", "")
            both.append((given(a), given(b)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in both], pa.string()), pa.array([b for _, b in both], pa.string())], names=[*batch.schema.names, "first", "last"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, fund, lean = (batch.column(c).to_pylist() for c in ("name", "is_fund", "lean"))
        ps = [parse(n, f, v) for n, f, v in zip(names, fund, lean, strict=True)]
        cols = [batch.column("name"), batch.column("n"), *(pa.array([getattr(p, f) for p in ps], pa.string()) for f in ("kind", "a", "m", "l", "s"))]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([p.whole for p in ps], pa.int32())], names=["name", "n", "kind", "a", "m", "l", "s", "whole"])


def readings(names: DataFrame) -> DataFrame:
    """``name, n, kind, a, m, l, s, whole``: the parts of each name, short forms spelled out.

    In a name all in capitals without a comma either order is possible: its first
    and last word are looked up among the words that other names show to be given
    names or surnames.  No other word is corrected or replaced here.
    """
    votes = names.select("name", "is_fund").mapInArrow(_evidence, "word string, vote bigint").groupBy("word").agg(F.signum(F.sum("vote")).cast("int").alias("v"))
    votes = written(votes, "order")
    both = written(names.select("name", "is_fund", "n").mapInArrow(_ends, "name string, is_fund boolean, n bigint, first string, last string"), "ends")
    v = lambda c: votes.select(F.col("word").alias(c), F.col("v").alias("v_" + c))
    leaning = both.where("first != ''").join(v("first"), "first", "left").join(v("last"), "last", "left")
    leaning = leaning.select("name", "is_fund", "n", (F.coalesce("v_first", F.lit(0)) - F.coalesce("v_last", F.lit(0))).alias("lean"))
    rest = both.where("first = ''").select("name", "is_fund", "n", F.lit(0).alias("lean"))
    return leaning.unionByName(rest).mapInArrow(_parsed, "name string, n bigint, kind string, a string, m string, l string, s string, whole int")


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = Bands(ROWS, bands_for(SIMILARITY, RECALL, ROWS))
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_pylist() for c in ("kind", "a", "m", "l", "s")}
        ps = [Parts(k, a, m, l_, s, 0) for k, a, m, l_, s in zip(*cols.values(), strict=True)]
        keys = bands.keys([grams(p) for p in ps])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.ListArray.from_arrays(pa.array(range(0, keys.size + 1, bands.bands), pa.int32()), pa.array(keys.reshape(-1)))],
            names=[*batch.schema.names, "keys"],
        )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        side = [list(zip(*(batch.column(c + i).to_pylist() for c in ("kind", "a", "m", "l", "s", "whole")), strict=True)) for i in "xy"]
        scores = [_score(Parts(*x), Parts(*y)) for x, y in zip(*side, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("idx"), batch.column("idy"), pa.array(scores, pa.float64())], names=["idx", "idy", "score"])


def _same_word(x: str, y: str) -> bool:
    """Two words of titles that are one but for a slip, in the word or in its short form."""
    return x == y or typo(x, y) or (x not in SPELLED and word(x) == y) or (y not in SPELLED and word(y) == x)


def _words(p: Parts) -> list[str]:
    return [w for w in p.a.split(" ") if w and not like_fund(w)]


def _score(x: Parts, y: Parts) -> float:
    """Monge-Elkan similarity of two names; 0 where some word of one has no counterpart in the other.

    A counterpart is the same word, one slip away, an initial of it, or - the last
    word of a title - its beginning; all words run together may also be one slip apart.
    """
    if x.kind == "P":
        fits = x.a == y.a or typo(x.a, y.a) or (min(len(x.a), len(y.a)) == 1 and x.a[0] == y.a[0])
        if not (fits and (x.l == y.l or typo(x.l, y.l))):
            return 0.0
        return monge_elkan([t for t in (x.a, x.m, x.l) if t and (t != x.m or y.m)], [t for t in (y.a, y.m, y.l) if t and (t != y.m or x.m)])
    a, b = _words(x), _words(y)
    ax, ay = "".join(a), "".join(b)
    near = len(a) == len(b) and (x.l == y.l or typo(x.l, y.l)) and all(map(_same_word, a, b))
    cut = x.l == y.l and min(len(ax), len(ay)) >= 4 and ((ax.startswith(ay) and y.whole < 2) or (ay.startswith(ax) and x.whole < 2))
    one, two = x.l + x.a.replace(" ", ""), y.l + y.a.replace(" ", "")
    if near or cut or typo(one, two):
        return max(monge_elkan([x.l, *a], [y.l, *b]), monge_elkan([x.l, ax or x.l], [y.l, ay or y.l]), monge_elkan([x.l + ax], [y.l + ay]))
    # The blank before the word fund may have slipped too.
    ends = [(u, v) for u in (one, one + "FUND") for v in (two, two + "FUND") if typo(u, v)]
    return max((monge_elkan([u], [v]) for u, v in ends), default=0.0)


def _plausible() -> Column:
    """A cheap superset of what :func:`_score` accepts, evaluated inside the join."""
    return F.expr(
        """kindx = kindy and sx = sy and case when kindx = 'P'
           then (mx = '' or my = '' or mx = my) and levenshtein(lx, ly, 2) >= 0
                and (levenshtein(ax, ay, 2) >= 0 or (least(length(ax), length(ay)) = 1 and left(ax, 1) = left(ay, 1)))
           else (levenshtein(lx, ly, 2) >= 0 and levenshtein(ax, ay, 6) >= 0) or levenshtein(concat(lx, ax), concat(ly, ay), 2) >= 0
                or (lx = ly and least(length(ax), length(ay)) >= 4 and (wholex < 2 or wholey < 2)
                    and ((startswith(ax, ay) and wholey < 2) or (startswith(ay, ax) and wholex < 2))) end"""
    )


def stored_names(fields: list[tuple[DataFrame, str, bool]]) -> DataFrame:
    """``name, is_fund, n`` of all names that are neither null nor blank; ``fields``: (table, column, holds fund titles)."""
    parts = [
        df.where(F.col(c).rlike(r"\S")).groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).withColumn("is_fund", F.lit(fund))
        for df, c, fund in fields
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("name").agg(F.max("is_fund").alias("is_fund"), F.sum("n").alias("n"))


def link_variants(names: DataFrame, context: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """``name, cluster`` of every name: names of one cluster denote one person, fund or manager.

    ``names``: ``name, is_fund, n`` (see :func:`stored_names`); ``context``: ``name,
    place`` - where a name occurs, to choose among several possible bearers of a
    shortened name.

    Names are read into parts (see :func:`readings`) and equal readings become
    one form.  Forms meet in MinHash bands over the padded q-grams of all their
    words, as many bands as the collision curve asks for; each word of a pair must
    have its counterpart (see :func:`_score`) and the pair a Monge-Elkan similarity
    of ``least``.  Star clustering: the fullest, best connected form of a
    neighbourhood is its centre, its neighbours are satellites of one centre - of
    several, that with most places in common, then the most frequent.

    Different middle initials, suffixes, series or years never link.  Unreadable
    names are clusters of their own.  Large bands are split by the adaptive skew
    join; nothing is capped.
    """
    read = written(readings(names), "names")
    id_ = F.xxhash64("kind", "a", "m", "l", "s", F.when(F.col("kind") == "O", F.col("name")).otherwise(""), F.when((F.col("kind") != "P"), F.col("whole") >= 2))
    read = read.withColumn("id", id_)
    forms = read.where("kind != 'O' and l != ''").groupBy("id", "kind", "a", "m", "l", "s").agg(F.max("whole").alias("whole"), F.sum("n").alias("n"))
    schema = "id bigint, kind string, a string, m string, l string, s string, whole int, n bigint, keys array<bigint>"
    banded = forms.mapInArrow(_banded, schema).select("id", "kind", "a", "m", "l", "s", "whole", F.explode("keys").alias("key"))
    banded = written(banded, "bands")
    x, y = (banded.select("key", *[F.col(c).alias(c + i) for c in banded.columns if c != "key"]) for i in "xy")
    # Of a pair, x is the lesser id; equal texts of different completeness meet here too.
    pairs = x.join(y, "key").where("idx < idy").where(_plausible()).drop("key").dropDuplicates(["idx", "idy"])
    edges = pairs.mapInArrow(_verified, "idx bigint, idy bigint, score double").where(F.col("score") >= least)
    edges = written(edges, "edges")

    both = edges.select(F.col("idx").alias("u"), F.col("idy").alias("v"), "score").unionByName(edges.select(F.col("idy").alias("u"), F.col("idx").alias("v"), "score"))
    degree = both.groupBy("u").agg(F.count("*").alias("degree"))
    rank = forms.select(F.col("id").alias("u"), "whole", "n").join(degree, "u")
    rank = rank.select("u", F.struct("whole", "degree", "n", "u").alias("rank"), "n")
    ru, rv = rank.select("u", F.col("rank").alias("ru")), rank.select(F.col("u").alias("v"), F.col("rank").alias("rv"), F.col("n").alias("nv"))
    graph = written(both.join(ru, "u").join(rv, "v"), "graph")

    centres, open_ = None, graph.select("u", "v", "ru", "rv")
    while True:  # each round closes at least the best form still open
        # A form is a centre once no open neighbour outranks it; its neighbours close with it.
        best = open_.groupBy("u").agg(F.max("ru").alias("ru"), F.max("rv").alias("rv"))
        new = written(best.where("ru > rv").select("u"), "centres")
        centres = new if centres is None else centres.unionByName(new)
        near = open_.join(new.withColumnRenamed("u", "v"), "v", "left_semi").select("u")
        shut = new.unionByName(near).distinct()
        rest = open_.join(shut, "u", "left_anti").join(shut.withColumnRenamed("u", "v"), "v", "left_anti")
        # Forms whose neighbours all closed as satellites stand alone and are centres too.
        lone = open_.select("u").distinct().join(shut, "u", "left_anti").join(rest.select("u"), "u", "left_anti")
        centres = centres.unionByName(lone)
        open_ = written(rest, "open")
        if open_.isEmpty():
            break

    centres = written(centres.distinct(), "all-centres")
    choice = graph.join(centres.withColumnRenamed("u", "v"), "v", "left_semi").join(centres, "u", "left_anti").select("u", "v", "score", "nv")
    choice = choice.withColumn("ways", F.count("*").over(Window.partitionBy("u")))
    if context is not None:
        at = context.join(read.select("name", "id"), "name").select("id", "place").where("place is not null").distinct()
        sure = centres.select("u", F.col("u").alias("v")).unionByName(choice.where("ways = 1").select("u", "v"))
        homes = sure.join(at, sure["u"] == at["id"]).select("v", "place").distinct()
        open_choice = choice.where("ways > 1").select("u", "v")
        shared = open_choice.join(at, open_choice["u"] == at["id"]).select("u", "v", "place").join(homes, ["v", "place"]).groupBy("u", "v").agg(F.count("*").alias("shared"))
        choice = choice.join(shared, ["u", "v"], "left").fillna(0, ["shared"])
    else:
        choice = choice.withColumn("shared", F.lit(0))
    pick = Window.partitionBy("u").orderBy(F.desc("shared"), F.desc("score"), F.desc("nv"), "v")
    star = choice.withColumn("rn", F.row_number().over(pick)).where("rn = 1").select(F.col("u").alias("id"), F.col("v").alias("centre"))
    return read.select("name", "id").join(star, "id", "left").select("name", F.coalesce("centre", "id").alias("cluster"))


def variant_pairs(clusters: DataFrame) -> DataFrame:
    """``name_a, name_b``: all pairs of different spellings of one cluster, ``name_a`` the lesser."""
    a, b = clusters.select("cluster", F.col("name").alias("name_a")), clusters.select("cluster", F.col("name").alias("name_b"))
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b")
