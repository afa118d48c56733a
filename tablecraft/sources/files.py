"""Delimited, JSON and Parquet sources and sinks, dataset catalog and versioned snapshots."""

from __future__ import annotations

import csv
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType, TimestampType

from tablecraft.functions.cells import blank_missing, text
from tablecraft.operators.profile import version_diff
from tablecraft.sources.records import records

DELIMITERS = ("\t", ",", ";", "|")
LATIN = ("ISO-8859-1", "LATIN-1", "LATIN1", "ISO8859-1")


def sniff_delimiter(lines: Sequence[str]) -> str | None:
    """Delimiter whose field count is steady over the first five non-blank lines."""
    sample = [line for line in lines if line.strip()][:5]
    best, best_score = None, 1.0
    for d in DELIMITERS:
        widths = [line.count(d) + 1 for line in sample]
        if widths and widths[0] > 1:
            score = (100 if len(set(widths)) == 1 else 0) + sum(widths) / len(widths)
            if score > best_score:
                best, best_score = d, score
    return best


def _file_kinds(spark: SparkSession, path: str) -> dict[tuple[bool, bool], list[str]]:
    """Files by (not UTF-8, with quoted line breaks), from one scan; one small row for each file comes to the driver.

    A line with an odd number of quotes begins or ends a cell that goes on over the line's end.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (~F.is_valid_utf8("value")).alias("latin"), (quotes % 2 == 1).alias("broken"))
    found = lines.groupBy("file").agg(F.bool_or("latin").alias("latin"), F.bool_or("broken").alias("broken")).collect()
    out: dict[tuple[bool, bool], list[str]] = {}
    for r in found:
        out.setdefault((r["latin"], r["broken"]), []).append(unquote(r["file"]))
    return out


def _read_strings(spark: SparkSession, records: DataFrame, options: Mapping[str, object], schema=None) -> DataFrame:
    """Rows of a column of CSV records; the reader takes a Dataset of strings, which has no name in Python."""
    reader = spark.read.options(**options) if schema is None else spark.read.options(**options).schema(schema)
    strings = getattr(records._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.csv(strings), spark)


def _record_ways(spark: SparkSession, files: str | list[str], latin: bool, header: bool, options: Mapping[str, object]) -> list[Callable]:
    """Readers of files with line breaks in cells, one for each header: ``read(schema, infer)``. Files are split over tasks."""
    found = records(spark, files, latin).where("value <> ''")
    options = {**options, "header": False}

    def way(rows, names):
        def read(schema=None, infer=True):
            if schema is not None:
                return _read_strings(spark, rows, options, StructType([StructField(f"_c{i}", f.dataType) for i, f in enumerate(schema)])).toDF(*schema.names)
            df = _read_strings(spark, rows, {**options, "inferSchema": infer})
            if not df.columns and names:  # headers only
                df = spark.createDataFrame([], StructType([StructField(n, StringType()) for n in names]))
            return df.toDF(*names) if names else df
        return read

    if not header:
        return [way(found.select("value"), None)]
    heads = found.groupBy("file").agg(F.min(F.struct("block", "seq", "value")).alias("head"))
    by_text: dict[str, list[tuple]] = {}
    for r in heads.collect():  # one row a file
        by_text.setdefault(r["head"]["value"], []).append((r["file"], r["head"]["block"], r["head"]["seq"]))
    out = []
    for text_, members in sorted(by_text.items()):
        first = F.broadcast(spark.createDataFrame(members, "file string, first_block bigint, first_seq bigint"))
        body = found.join(first, "file").where("block > first_block OR (block = first_block AND seq > first_seq)").select("value")
        out.append(way(body, next(csv.reader(text_.removeprefix("\ufeff").splitlines(True), delimiter=str(options["sep"])))))
    return out


# Kinds of number in the order in which one holds the other.
_NUMBERS = ("int", "bigint", "double")


def _widest(kinds: Sequence[DataType]) -> DataType:
    """The narrowest type that holds the cells of all parts: equal types, the wider number, a timestamp for dates, or text."""
    names = {k.simpleString() for k in kinds}
    if len(names) == 1:
        return kinds[0]
    if names <= set(_NUMBERS):
        return max(kinds, key=lambda k: _NUMBERS.index(k.simpleString()))
    if names == {"date", "timestamp"}:
        return TimestampType()
    return StringType()


def _together(ways: Sequence[Callable], infer: bool) -> DataFrame:
    """All parts by column name, missing columns null, each column in the narrowest type that holds the cells of all parts."""
    if len(ways) == 1:
        return _named(ways[0](None, infer))
    schemas = [way(None, infer).schema for way in ways]
    kinds: dict[str, list] = {}
    for f in (f for s in schemas for f in s):
        kinds.setdefault(f.name, []).append(f.dataType)
    parts = [way(StructType([StructField(f.name, _widest(kinds[f.name])) for f in s]), infer) for way, s in zip(ways, schemas)]
    return _named(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def read_csv(spark: SparkSession, path: str, header: bool = True, infer: bool = True, sep: str = ",",
             schema=None, encoding: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """CSV with a header. Each file is judged by itself: one with bytes that are not UTF-8 is read as Latin-1, one with
    quoted cells that hold line breaks is cut into records first, by as many tasks as it has splits.

    Files of other headers are merged by column name, missing columns are null. Naming ``encoding``, ``multi_line`` and
    ``schema`` saves the extra reads that finding them takes. White space around cells is kept.
    """
    options = dict(sep=sep, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if encoding is not None and multi_line is not None:
        kinds = {(encoding.upper() in LATIN, multi_line): path}
    else:
        found = _file_kinds(spark, path) or {(False, False): path}
        kinds = {}
        for (latin, broken), names in sorted(found.items()):
            as_latin = latin if encoding is None else encoding.upper() in LATIN
            kinds.setdefault((as_latin, broken if multi_line is None else multi_line), []).extend([path] if len(found) == 1 else names)
    ways: list[Callable] = []
    for (latin, broken), files in kinds.items():
        if broken:
            ways += _record_ways(spark, files, latin, header, options)
        else:
            code = encoding or ("ISO-8859-1" if latin else "UTF-8")
            ways.append(lambda schema=None, infer=True, files=files, code=code: spark.read.csv(
                files, schema=schema, inferSchema=infer if schema is None else None, header=header, encoding=code, **options))
    if schema is None:
        return _together(ways, infer)
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return reduce(DataFrame.unionByName, [way(wanted) for way in ways])


def _named(df: DataFrame) -> DataFrame:
    """Strip names; a blank header cell becomes Col_i."""
    return df.toDF(*[
        f"Col_{i}" if not c.strip() or c == f"_c{i - 1}" else c.strip() for i, c in enumerate(df.columns, start=1)
    ])


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All-text landing table: sniffed delimiter, quoted fields, null tokens, blank lines skipped.

    Each file is judged by itself, as in ``read_csv``: bytes that are not UTF-8 are read as Latin-1, and files in which a quoted
    cell goes on over a line's end are cut into records first. Files of other headers are merged by column name.
    """
    lines = [r["value"] for r in spark.read.text(path).filter("trim(value) <> ''").limit(5).collect()]
    options = dict(sep=sniff_delimiter(lines) or ",", escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    kinds = _file_kinds(spark, path) or {(False, False): [path]}
    ways: list[Callable] = []
    for (latin, broken), names in sorted(kinds.items()):
        files = path if len(kinds) == 1 else names
        if broken:
            ways += _record_ways(spark, files, latin, True, options)
        else:
            ways.append(lambda schema=None, infer=False, files=files, code="ISO-8859-1" if latin else "UTF-8": spark.read.csv(
                files, schema=schema, inferSchema=False if schema is None else None, header=True, encoding=code, **options))
    raw = _together(ways, False)
    return raw.select(*[blank_missing(c).alias(c) for c in raw.columns]).dropna("all")


def read_json(spark: SparkSession, path: str, schema=None, whole_file: bool | None = None) -> DataFrame:
    """Objects, one per line, or files that each hold an array of objects or one object.

    Unless told, the first line decides: a line that is not a complete object means whole files.
    Line files are split over many tasks, so write large data that way and name the schema.
    """
    if whole_file is None:
        first = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
        line = first[0]["value"].strip() if first else "{}"
        whole_file = not (line.startswith("{") and line.endswith("}"))
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path, multiLine=whole_file)


def read_request(spark: SparkSession, request: Mapping[str, object]) -> DataFrame:
    """Table of a request: ``records`` or ``rows`` (list of objects), or ``csv_text`` as all-text columns."""
    rows = request.get("records") or request.get("rows")
    if rows:
        payload = json.dumps(rows)
        schema = spark.range(1).select(F.schema_of_json(F.lit(payload))).first()[0]
        return spark.createDataFrame([(payload,)], "value string").select(F.inline(F.from_json("value", schema)))
    first, *rest = [line for line in str(request["csv_text"]).splitlines() if line.strip()]
    sep = sniff_delimiter([first, *rest[:4]]) or ","
    names = [h.strip() or f"Col_{i}" for i, h in enumerate(next(csv.reader([first], delimiter=sep)), start=1)]
    schema = ", ".join(f"`{n}` string" for n in names)
    cells = spark.createDataFrame([(line,) for line in rest], "value string").select(
        F.from_csv("value", schema, {"sep": sep, "escape": '"'}).alias("r"))
    return cells.select("r.*")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, crlf: bool = False) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', lineSep="\r\n" if crlf else "\n",
                                   ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tabs and line breaks inside cells become blanks."""
    flat_cells(df).write.mode("overwrite").csv(path, header=True, sep="\t")


def flat_cells(df: DataFrame) -> DataFrame:
    return df.select(*[F.regexp_replace(text(c), r"[\t\r\n]+", " ").alias(c) for c in df.columns])


def preview(df: DataFrame, order_by: Sequence[str], n: int = 100) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def dataset_catalog(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``name, size_kb, modified`` of the files in a folder, newest first; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.round(F.col("length") / 1024, 2).alias("size_kb"),
        F.col("modificationTime").alias("modified"),
    ).orderBy(F.desc("modified"), "name")


def dataset_shapes(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """``name, rows, columns`` of named tables; rows are counted from file statistics where these are kept."""
    one = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("columns"))
        for name, df in datasets.items()]
    return reduce(DataFrame.unionByName, one)


VERSION_ROW = "version int, row_count bigint, columns array<string>, saved_at timestamp, attempt string"


def save_version(df: DataFrame, folder: str, version: int) -> None:
    """Write one snapshot aside, then publish it by one manifest row; earlier versions stay.

    Every save has a folder of its own, so two writers of one version cannot mix and a lost save leaves nothing that readers see. The
    manifest row is one file, which appears whole or not at all. Of several saves of a version the last published counts.
    """
    spark = df.sparkSession
    attempt = uuid.uuid4().hex
    path = f"{folder}/data/version={version}/{attempt}"
    df.write.mode("errorifexists").parquet(path)
    meta = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(version).cast("int").alias("version"), "row_count", F.array(*[F.lit(c) for c in df.columns]).cast("array<string>").alias("columns"),
        F.current_timestamp().alias("saved_at"), F.lit(attempt).alias("attempt"))
    meta.coalesce(1).write.mode("append").parquet(f"{folder}/meta")


def _published(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest row in force for each version."""
    rows = spark.read.schema(VERSION_ROW).parquet(f"{folder}/meta")
    last = F.max_by(F.struct("row_count", "columns", "saved_at", "attempt"), F.struct("saved_at", "attempt"))
    return rows.groupBy("version").agg(last.alias("last")).select("version", "last.*")


def load_version(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """A published snapshot; a version that was never published is an error."""
    row = _published(spark, folder).where(F.col("version") == version).first()
    if row is None:
        raise ValueError(f"version {version} was not saved in {folder}")
    return spark.read.parquet(f"{folder}/data/version={version}/{row['attempt']}")


def list_versions(spark: SparkSession, folder: str) -> DataFrame:
    return _published(spark, folder).select("version", "row_count", "columns", "saved_at").orderBy("version")


def compare_versions(spark: SparkSession, folder: str, old: int, new: int) -> DataFrame:
    return version_diff(load_version(spark, folder, old), load_version(spark, folder, new), old)
