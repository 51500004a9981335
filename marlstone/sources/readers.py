"""Sources: parquet, delimited text in strict and drifting forms, JDBC, NDJSON, text headers and submissions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaError(ValueError):
    """A frame that is not what its reader declared."""


def check_schema(df: DataFrame, expected: Iterable[str], name: str, exact: bool = False) -> DataFrame:
    """Refuses a frame without the expected columns (or, if ``exact``, with others); never coerces."""
    want = list(expected)
    missing, more = [c for c in want if c not in df.columns], [c for c in df.columns if c not in want]
    if missing or (exact and more):
        raise SchemaError(f"{name}: missing {missing}" + (f", unexpected {more}" if exact else ""))
    return df


def parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """One or many files or globs; columns and filter reach the scan."""
    df = spark.read.parquet(*paths)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def delimited(spark: SparkSession, path: str, schema: str | T.StructType | None = None, header: bool = True) -> DataFrame:
    """CSV or TSV by suffix (also gzipped); with a schema nothing is guessed."""
    sep = "\t" if path.removesuffix(".gz").rstrip("/").endswith(".tsv") else ","
    r = spark.read.option("sep", sep).option("header", header)
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)


def strict_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headerless TSV; a line with another number of fields than the schema, or a value of another type, fails the read.

    Lines are split by hand first: the CSV reader pads short lines with nulls in silence.
    """
    n = len(schema)
    lines = spark.read.text(path).select(F.split("value", "\t", -1).alias("f"))
    wrong = F.raise_error(F.concat(F.lit(f"expected {n} fields, found "), F.size("f").cast("string")))
    checked = lines.select(F.when(F.size("f") == n, F.col("f")).otherwise(wrong.cast("array<string>")).alias("f"))
    cast = [F.when(F.col("f")[i] != "", F.col("f")[i]).cast(fld.dataType).alias(fld.name) for i, fld in enumerate(schema)]
    return checked.select(*cast)


def quarantine(df: DataFrame, valid: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the rest with their reason; null counts as not passing.  Nothing is dropped."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok).withColumn("quarantine_reason", F.lit(reason))


def vintages(frames: list[DataFrame], aliases: dict[str, list[str]], keys: dict[str, int], nulls: tuple[str, ...] = ("", "NA", "N/A", ".")) -> DataFrame:
    """Vintages with drifting headers as one frame: aliases to canonical names, null words to null, keys padded with zeros."""
    out = None
    for df in frames:
        low = {c.strip().lower(): c for c in df.columns}
        cols = []
        for name, others in aliases.items():
            found = next((low[a] for a in [name, *others] if a in low), None)
            if found is None:
                continue
            v = F.trim(F.col(f"`{found}`").cast("string"))
            v = F.when(~v.isin(*nulls), v)
            cols.append((F.lpad(v, keys[name], "0") if name in keys else v).alias(name))
        part = df.select(*cols)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def after_preamble(spark: SparkSession, path: str, skip: int, schema: str) -> DataFrame:
    """CSV files, each after ``skip`` lines of preamble and its header line.

    Lines of a split are numbered on from where it starts; a file's first split is
    known by its offset, so files may be split and packed in any way.  The preamble
    must lie in the first split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), (F.col("_metadata.file_block_start") == 0).alias("first")).withColumn("n", F.monotonically_increasing_id())
    begins = lines.where("first").groupBy("f").agg(F.min("n").alias("n0"))  # one row a file
    body = lines.join(begins, "f").where(~F.col("first") | (F.col("n") - F.col("n0") > skip))
    return body.select(F.from_csv("value", schema).alias("r")).select("r.*")


def jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A query over JDBC; ``partition``: column, lower, upper and number of ranges read in parallel."""
    r = spark.read.format("jdbc").option("url", url).option("query" if partition is None else "dbtable", query if partition is None else f"({query}) q").options(**options)
    if partition:
        c, lo, hi, n = partition
        r = r.option("partitionColumn", c).option("lowerBound", lo).option("upperBound", hi).option("numPartitions", n)
    return r.load()


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Newline-delimited JSON; a torn line is left out, others stand."""
    lines = spark.read.text(path)
    read = lines.select(F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return read.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def header_bytes(spark: SparkSession, path: str, size: int = 4096, end: str = "</SEC-HEADER>") -> DataFrame:
    """``path, head``: the first ``size`` bytes of each file as text, cut at the end of its header; no more of a file is read."""
    files = spark.read.format("binaryFile").load(path).select("path")  # the listing alone: contents are not asked for

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column("path").to_pylist():
                fs, at = pa_fs.FileSystem.from_uri(p if "://" in p else p.replace("file:/", "file:///", 1))
                with fs.open_input_file(at) as f:
                    out.append(f.read(size).decode("utf-8", "replace").split(end, 1)[0])
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], names=["path", "head"])

    return files.mapInArrow(heads, "path string, head string")


def submission(df: DataFrame, text: str) -> DataFrame:
    """One row per ``<DOCUMENT>`` of a full submission: position, type, file name and body."""
    block = F.posexplode(F.regexp_extract_all(text, F.lit(r"(?s)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))).alias("pos", "b")
    tag = lambda n: F.trim(F.regexp_extract("b", rf"<{n}>([^\n<]*)", 1)).alias(n.lower())
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, block).select(*keep, "pos", tag("TYPE"), tag("SEQUENCE"), tag("FILENAME"), F.regexp_extract("b", r"(?s)<TEXT>(.*?)</TEXT>", 1).alias("body"))


def xlsx(spark: SparkSession, path: str, sheet: int, header: list[str]) -> DataFrame:
    """:func:`workbooks` of the files at ``path``."""
    return workbooks(spark.read.format("binaryFile").load(path), sheet, header)


def workbooks(files: DataFrame, sheet: int, header: list[str]) -> DataFrame:
    """Rows of one sheet of each workbook (``path, content``) as strings, taken for the right one by its header row's content, not by a file name.

    Columns are those of ``header``, in that order wherever they stand; rows above the header row are left out.
    Workbooks without such a row give none.
    """
    import pyarrow as pa

    fields = ["path", *header]

    def run(batches):
        for batch in batches:
            out = []
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = _sheet(content, sheet)
                at = next((i for i, r in enumerate(rows) if set(header) <= {c.strip() for c in r}), None)
                if at is not None:
                    where = [[c.strip() for c in rows[at]].index(h) for h in header]
                    out += [[p, *(r[i] if i < len(r) and r[i] != "" else None for i in where)] for r in rows[at + 1 :] if any(r)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else [[]] * len(fields))], names=fields)

    return files.select("path", "content").mapInArrow(run, ", ".join(f"`{f}` string" for f in fields))


def _sheet(content: bytes, sheet: int) -> list[list[str]]:
    """Cells of a sheet by row, gaps as empty text."""
    import io
    import re
    import xml.etree.ElementTree as ET
    import zipfile

    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(ns + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(ns + "si")]
        root = ET.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    rows = []
    for row in root.iter(ns + "row"):
        cells: list[str] = []
        for c in row.iter(ns + "c"):
            letters = re.match(r"[A-Z]+", c.get("r", "A")).group(0)
            col = 0
            for ch in letters:
                col = col * 26 + ord(ch) - 64
            v = c.find(ns + "v")
            text = "".join(t.text or "" for t in c.iter(ns + "t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
            cells += [""] * (col - 1 - len(cells)) + [shared[int(text)] if c.get("t") == "s" and text else text]
        rows.append(cells)
    return rows
