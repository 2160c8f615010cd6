"""Reading and writing of result tables and of what goes with them."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Sequence
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spectrail import schemas
from spectrail.sources.shared import saved


def read_tsv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None, header: bool | str = True, file_label: bool = False) -> DataFrame:
    """A tab-separated table, without quoting, in which bad rows are dropped whatever columns are read later.

    A row is bad if its number of fields is not the header's, or if a field does not have its column's type. Empty fields
    are null; strings keep their blanks, numbers may have some. Columns that ``schema`` names get its types, the others
    are strings. ``header`` is True, False (columns c0, c1 ..) or "auto": the first line is one where it holds a name of the
    schema or no number. All files share the first one's columns.
    """
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.text(paths)
    first = spark.read.text(paths[0]).where("value <> ''").first()
    if first is None:
        kinds = schema or T.StructType()
        return spark.createDataFrame([], T.StructType([*kinds, T.StructField("_file", T.StringType())]) if file_label else kinds)
    names = first["value"].split("\t")
    if header == "auto":
        known = {f.name for f in schema} if schema else set()
        header = bool(known & set(names)) or not any(re.fullmatch(r"\s*[-+]?[\d.]+(?:[eE][-+]?\d+)?\s*", x) for x in names)
    columns = names if header else [f.name for f in schema] if schema and len(schema) == len(names) else [f"c{i}" for i in range(len(names))]
    types = {f.name: f.dataType for f in schema} if schema else {}
    rows = lines.select(F.split("value", "\t", -1).alias("_f"), "value", *([F.col("_metadata.file_path").alias("_file")] if file_label else []))
    rows = rows.where(F.size("_f") == len(columns))
    if header:
        rows = rows.where(F.col("value") != first["value"])
    if len(columns) == 1:
        rows = rows.where("value <> ''")
    raw = [F.nullif(F.get("_f", F.lit(i)), F.lit("")) for i in range(len(columns))]
    typed = [x if isinstance(types.get(c, T.StringType()), T.StringType) else x.try_cast(types[c]) for c, x in zip(columns, raw, strict=True)]
    good = F.lit(True)
    for x, y in zip(raw, typed, strict=True):
        good = good & (x.isNull() | y.isNotNull())
    rows = rows.where(good)
    return rows.select(*[x.alias(c) for c, x in zip(columns, typed, strict=True)], *(["_file"] if file_label else []))


def read_results(spark: SparkSession, path: str, schema: T.StructType = schemas.PSMS) -> DataFrame:
    """Search results: Parquet where the path ends so, else a table with tabs and a header. A missing path is an error on any storage."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path) if path.endswith(".parquet") else read_tsv(spark, path, schema)


def tsv_to_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType | None = None, header: bool | str = "auto", files: int | None = None) -> None:
    """Converts a table with tabs; ``files`` asks for a number of files, as 1."""
    df = read_tsv(spark, source, schema, header)
    (df.coalesce(files) if files else df).write.mode("overwrite").parquet(target)


def with_row_position(spark: SparkSession, path: str, name: str = "sage_fragment_idx") -> DataFrame:
    """A Parquet table with each row's place, counted over its files in the order of their names.

    Places within a file come from the reader; of other files only their numbers of rows are needed.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_file").withColumn(name, F.col("_start") + F.col("_row")).drop("_file", "_row", "_start", "_n")


def _glob(pattern: str) -> re.Pattern[str]:
    """A pattern for paths: ** stands for any folders, none included, * and ? for characters of one name."""
    parts = re.split(r"(\*\*/|\*|\?)", pattern)
    known = {"**/": "(?:[^/]+/)*", "*": "[^/]*", "?": "[^/]"}
    return re.compile("".join(known.get(x, re.escape(x)) for x in parts))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _listed(spark: SparkSession, folder: str, pattern: str) -> list[tuple[str, str]]:
    """(path, label) of what matches below a folder on any storage that Spark reads; only names are looked at, no content."""
    name = pattern.rsplit("/", 1)[-1]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(folder).select("path")
    root = unquote(urlparse(folder).path).rstrip("/")
    out = []
    for uri in sorted(r["path"] for r in rows.collect()):  # one row for each result file
        path = unquote(urlparse(uri).path)
        if path == root:
            out.append((folder, folder))
        elif path.startswith(root + "/") and _glob(pattern).fullmatch(path[len(root) + 1 :]):
            out.append((folder.rstrip("/") + path[len(root) :], path[len(root) + 1 :]))
    return out


def discover(inputs: Sequence[str], pattern: str = "**/results.sage.tsv", spark: SparkSession | None = None) -> tuple[list[tuple[str, str]], list[str]]:
    """((path, label) of each result file, inputs without any). A file is itself, a folder gives what matches, in order.

    Inputs with a scheme (file://, hdfs:// and so on) are listed by Spark's reader and need a session; a missing one is an error.
    """
    found: list[tuple[str, str]] = []
    empty = []
    for given in inputs:
        if "://" in given:
            if spark is None:
                raise ValueError(f"{given} needs a session")
            if not _exists(spark, given):
                raise FileNotFoundError(given)
            here = [(given, given)] if given.endswith(".parquet") else _listed(spark, given, pattern)
            found += here
        else:
            item = Path(given)
            if item.is_file() or item.suffix == ".parquet":
                found.append((str(item), str(item)))
                continue
            here = [(str(p), str(p.relative_to(item))) for p in sorted(item.glob(pattern))]
            found += here
        if not here:
            empty.append(given if "://" in given else str(item))
    return found, empty


def _label_of(uri: str, path: str) -> bool:
    """Whether a reader's file lies at the given path, a file or a folder."""
    name = unquote(urlparse(uri).path)
    own = urlparse(path).path if "://" in path else str(Path(path).resolve())
    return name == own.rstrip("/") or name.startswith(own.rstrip("/") + "/")


def _heads(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(_file, head): the first line that is not empty, of each file of tables with tabs that has one.

    Least places are found by hashing, which holds one number for each file; only then are the lines there taken, so no task sorts a file's lines.
    """
    place = F.monotonically_increasing_id().alias("_place")
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), place)
    lines = lines.where("_block = 0 AND value <> ''")
    first = saved(lines.groupBy("_file").agg(F.min("_place").alias("_place")))  # one row for each file
    return lines.join(first, ["_file", "_place"]).select("_file", F.col("value").alias("head"))


def read_many(spark: SparkSession, files: Sequence[tuple[str, str]], schema: T.StructType = schemas.PSMS) -> DataFrame:
    """Search results of many files as one table, with their labels in ``label``.

    Tables with tabs are one scan for each header that occurs among them, Parquet files one for each schema; labels join by file.
    """
    names = [f.name for f in schema]
    out = spark.createDataFrame([], T.StructType([*schema, T.StructField("label", T.StringType())]))
    for path, _ in files:
        if not _exists(spark, path):
            raise FileNotFoundError(path)
    tabs, parts = [x for x in files if not x[0].endswith(".parquet")], []
    if tabs:
        heads = _heads(spark, [p for p, _ in tabs]).collect()  # one row for each file
        for head in sorted({r["head"] for r in heads}):
            own = sorted(r["_file"] for r in heads if r["head"] == head)
            parts.append((read_tsv(spark, [unquote(u) for u in own], schema, file_label=True), own))
    by_schema: dict[str, list[str]] = {}
    for path in (p for p, _ in files if p.endswith(".parquet")):
        by_schema.setdefault(spark.read.parquet(path).schema.json(), []).append(path)
    for own in by_schema.values():
        df = spark.read.parquet(*own)
        parts.append((df.select(*names, F.col("_metadata.file_path").alias("_file")), df.inputFiles()))
    for df, uris in parts:
        pairs = [(re.sub("^file:/+", "file:/", u), label) for u in uris for path, label in files if _label_of(u, path)]
        # one row for each file; from Arrow, so that Spark knows how small it is and need not deal and sort the rows by file
        labels = spark.createDataFrame(pa.table({"_file": [u for u, _ in pairs], "label": [x for _, x in pairs]}, pa.schema({"_file": pa.string(), "label": pa.string()})))
        out = out.unionByName(df.select(*[F.col(f.name).cast(f.dataType) for f in schema], "_file").join(labels, "_file").select(*names, "label"))
    return out


def write_mapping(tables, path: str) -> None:
    """The mapping's three tables in a folder."""
    for name, df in (("precursors", tables.precursors.orderBy("mapped_idx")), ("mapping", tables.mapping.orderBy("mapping_row")), ("mz_delta_quantiles", tables.mz_delta_quantiles)):
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}.parquet")


def read_summary(path: str) -> dict[str, int]:
    """Counts of a summary table's first row, by name; a label column is passed over."""
    names, values = (line.split("\t") for line in Path(path).read_text().splitlines()[:2])
    return {n: int(v) for n, v in zip(names, values, strict=True) if n != "label"}


# Names of the metrics in a log.
METRICS = ("ions", "peptides", "proteins", "psms")


def log_metrics(text: str, phrase: str = "Final report numbers after FDR filtering") -> dict[str, int | None]:
    """Numbers like ``psms=12`` of a log's first line with the phrase; the last of each counts, a missing one is None."""
    line = next((x for x in text.splitlines() if phrase in x), None)
    found = dict(re.findall(r"\b(ions|peptides|proteins|psms)=(\d+)", line or ""))
    if not found:
        raise ValueError("no line with the numbers after filtering")
    return {m: int(found[m]) if m in found else None for m in METRICS}


def log_metrics_of(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same for a table of such lines: a column for each number, null where it is missing."""
    last = lambda m: F.element_at(F.regexp_extract_all(column, F.lit(rf"\b{m}=(\d+)"), F.lit(1)), -1)
    found = {m: F.when(F.regexp_count(column, F.lit(rf"\b{m}=\d+")) > 0, last(m)).cast("bigint") for m in METRICS}
    return lines.select("*", *[x.alias(m) for m, x in found.items()])


def read_sidecar(path: str) -> dict:
    """A run's description: engine, dataset and configuration, and what else is given; texts it points to are read if they can be."""
    info = json.loads(Path(path).read_text())
    missing = [k for k in ("search_engine", "dataset", "cfg") if k not in info]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return info | {"pipeline_config": slurp(info.get("pipeline_config_path")), "search_config": slurp(info.get("search_config_path"))}


def slurp(path: str | None) -> str | None:
    """A text file, or None where there is none to read."""
    try:
        return Path(path).read_text() if path else None
    except OSError:
        return None


def score_label(path: str) -> tuple[str, str]:
    """A TOML configuration's extraction method and, where that is "score", its parameters as k=v, for the labels of plots."""
    with open(path, "rb") as f:
        own = tomllib.load(f)["pseudomsms"]
    method = own["tofs_extraction_method"]
    params = own.get("tofs_extraction_params", {}) if method == "score" else {}
    return method, " | ".join(f"{k}={v}" for k, v in params.items())


def read_marker(path: str) -> int:
    """The run that a marker file names."""
    for line in Path(path).read_text().splitlines():
        key, _, value = line.partition("=")
        if key == "run_id":
            return int(value)
    raise ValueError(f"{path} names no run")


def write_marker(path: str, run: dict) -> None:
    # Keys of a marker file.
    keys = ("run_id", "accepted", "acceptance_reason", "status", "regression", "message")
    Path(path).write_text("".join(f"{k}={'' if run.get(k) is None else run[k]}\n" for k in keys))
