"""Text analytics over documents; kernels of :mod:`marlstone.functions.style` in Arrow batches, the rest inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import style as K


def per_text(df: DataFrame, keep: list[str], inputs: list[str], schema: str, kernel: Callable[..., list[dict]]) -> DataFrame:
    """Runs ``kernel(*inputs) -> rows`` on every row: ``keep`` columns and those of ``schema``.  A row with a null input gives none."""
    rows = df.select(*keep, *[F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs)])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if not f.name.startswith("_in"))
    arrow = rows.schema
    types = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [pa.field(f.name, to_arrow_type(arrow[f.name].dataType)) for f in arrow if not f.name.startswith("_in")] + [pa.field(f.name, to_arrow_type(f.dataType)) for f in types]
    out_schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Kept columns are never turned into Python values: their rows are taken as often as the kernel gives any.
        for batch in batches:
            at, out = [], []
            for j, args in enumerate(zip(*(batch.column(f"_in{i}").to_pylist() for i in range(len(inputs))), strict=True)):
                if not any(a is None for a in args):
                    got = kernel(*args)
                    out += got
                    at += [j] * len(got)
            kept_rows = [batch.column(k).take(pa.array(at, pa.int64())) for k in keep]
            made = [pa.array([r.get(f.name) for r in out], f.type) for f in fields[len(keep) :]]
            yield pa.RecordBatch.from_arrays(kept_rows + made, schema=out_schema)

    return rows.mapInArrow(run, f"{kept}, {schema}")


def features(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    return per_text(df, keep, [text], ", ".join(f"{f} double" for f in K.FEATURES), lambda t: [K.features(t)])


def window_features(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    schema = "unit int, " + ", ".join(f"{f} double" for f in K.FEATURES)
    return per_text(df, keep, [text], schema, lambda t: [{"unit": i} | u for i, u in enumerate(K.windows(t))])


def reference_stats(df: DataFrame, text: str) -> dict[str, tuple[float, float]]:
    """Mean and deviation of each scored feature over all windows of a reference corpus: one row comes to the driver."""
    w = window_features(df.withColumn("_k", F.lit(0)), ["_k"], text)
    r = w.agg(*[F.avg(f).alias(f"m_{f}") for f in K.SCORED], *[F.stddev_pop(f).alias(f"s_{f}") for f in K.SCORED]).first()
    return {f: (r[f"m_{f}"], r[f"s_{f}"]) for f in K.SCORED if r[f"m_{f}"] is not None}


def scores(df: DataFrame, keep: list[str], text: str, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return per_text(df, keep, [text], "score double", lambda t: [{"score": K.score(t, stats)}])


def pattern_hits(df: DataFrame, keep: list[str], text: str, patterns: dict[str, str]) -> DataFrame:
    """``line, col, end, label, quote`` of every match of the patterns, line by line, 1-based, letter case aside; empty matches are none."""
    compiled = [(label, re.compile(p, re.I)) for label, p in patterns.items()]

    def hits(t: str) -> list[dict]:
        return [
            {"line": i, "col": m.start() + 1, "end": m.end() + 1, "label": label, "quote": m.group()}
            for i, line in enumerate(t.split("\n"), 1) for label, p in compiled for m in p.finditer(line) if m.group()
        ]

    return per_text(df, keep, [text], "line int, col int, end int, label string, quote string", hits)


def collapse(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping spans of a line as one, with all labels: an island starts where a span begins at or after every end before it."""
    w = Window.partitionBy(*keys, "line").orderBy("col", F.desc("end"), "label")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = hits.withColumn("_new", F.when(before.isNull() | (F.col("col") >= before), 1).otherwise(0)).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = g.groupBy(*keys, "line", "_g").agg(F.min("col").alias("col"), F.max("end").alias("end"), F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels"))
    return out.drop("_g")


def bag_of_words(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    w = df.select(*keep, F.explode(F.split(F.lower(text), r"[^a-z0-9]+")).alias("word")).where("word != ''")
    return w.groupBy(*keep, "word").agg(F.count("*").alias("n"))


def fragments_present(quote: Column, source: Column, least: int = 15) -> Column:
    """Whether every fragment of an elided quote of at least ``least`` characters stands in the source, blanks squeezed."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    frags = F.filter(F.transform(F.split(quote, r"\.{3}|…"), lambda f: F.trim(flat(f))), lambda f: F.length(f) >= least)
    return F.forall(frags, lambda f: F.contains(flat(source), f))


def full_text(df: DataFrame, text: str, phrase: str, around: int = 40) -> DataFrame:
    """Rows that hold the phrase, with a snippet around its first place."""
    at = F.locate(phrase.lower(), F.lower(text))
    return df.where(at > 0).withColumn("snippet", F.substring(F.col(text), F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(phrase))))
