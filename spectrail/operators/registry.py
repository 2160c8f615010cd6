"""A registry of search runs on storage without updates.

Tables are appended to: ``runs`` and ``snapshots`` hold what was recorded, ``events`` what happened to a run later. The
current state of a run is its record with its events applied in order.

A change is one transaction: its rows are written to folders of their own, and then a version file that names them is put
where none is yet. Readers take what version files name, so a writer that breaks off leaves nothing visible; of two writers
that read the same version one finds its file there already, reads again and repeats its change.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrail import schemas
from spectrail.sources.shared import saved
from spectrail.sources.versions import Versions

KEY = ("dataset", "cfg", "search_engine")
EVENTS = T.StructType([T.StructField("event_seq", T.LongType()), T.StructField("run_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("regression", T.IntegerType()), T.StructField("message", T.StringType())])
_DEFAULTS = {"accepted": 0, "status": "unreviewed", "regression": 0}


class RegistryError(ValueError):
    """A request that the registry can't carry out."""


def migrated(runs: DataFrame) -> DataFrame:
    """Runs of any older form with all columns and their defaults; accepted but unreviewed ones become reviewed. Idempotent."""
    names = {c.lower() for c in runs.columns}
    columns = []
    for field in schemas.RUNS:
        column = F.col(field.name).cast(field.dataType) if field.name.lower() in names else F.lit(None).cast(field.dataType)
        columns.append((F.coalesce(column, F.lit(_DEFAULTS[field.name])) if field.name in _DEFAULTS else column).alias(field.name))
    rows = runs.select(*columns)
    old = (F.col("accepted") == 1) & (F.col("status") == "unreviewed")
    return rows.withColumns(
        {
            "message": F.when(old, F.coalesce("message", "acceptance_reason")).otherwise(F.col("message")),
            "regression": F.when(old, F.lit(0)).otherwise(F.col("regression")),
            "status": F.when(old, F.lit("reviewed")).otherwise(F.col("status")),
        }
    )


def reviewed(runs: DataFrame, run_id: int, regression: int, message: str | None) -> DataFrame:
    """The run as reviewed; its message is overwritten, even by null."""
    own = F.col("id") == run_id
    return runs.withColumns({"status": F.when(own, F.lit("reviewed")).otherwise(F.col("status")), "regression": F.when(own, F.lit(regression)).otherwise(F.col("regression")), "message": F.when(own, F.lit(message).cast("string")).otherwise(F.col("message"))})


def previous_best(runs: DataFrame) -> DataFrame:
    """Each run with the largest peptide count among the other runs of its dataset, configuration and engine; null without.

    Without listing pairs: of each key's two largest counts the larger one of another run.
    """
    best = runs.where("peptide_count IS NOT NULL").groupBy(*KEY).agg(F.max(F.struct("peptide_count", "id")).alias("first"))
    joined = runs.join(best, list(KEY), "left")
    second = joined.where((F.col("id") != F.col("first.id")) & F.col("peptide_count").isNotNull()).groupBy(*KEY).agg(F.max("peptide_count").alias("second"))
    joined = joined.join(second, list(KEY), "left")
    return joined.select(*runs.columns, F.when(F.col("id") == F.col("first.id"), F.col("second")).otherwise(F.col("first.peptide_count")).alias("previous_best"))


def check_bests(runs: DataFrame, run_id: int) -> None:
    """Raises unless the run exists and its peptide count is above all others of its key."""
    rows = runs.where(F.col("id") == run_id).take(1)
    if not rows:
        raise RegistryError(f"no run {run_id}")
    run = rows[0]
    if run["peptide_count"] is None:
        raise RegistryError(f"run {run_id} has no peptide count")
    others = runs.where(F.col("id") != run_id)
    for k in KEY:
        others = others.where(F.col(k) == run[k])
    best = others.agg(F.max("peptide_count")).first()[0]
    if best is not None and run["peptide_count"] <= best:
        raise RegistryError(f"run {run_id} has {run['peptide_count']} peptides, a run before it {best}")


def bested(runs: DataFrame, run_id: int, message: str | None = None) -> DataFrame:
    """Unreviewed other runs of the run's key as bested; a message only replaces theirs where it is given."""
    key = runs.where(F.col("id") == run_id).select(*[F.col(k).alias(f"_{k}") for k in KEY])  # one row
    joined = runs.join(F.broadcast(key), [F.col(k) == F.col(f"_{k}") for k in KEY], "left")
    hit = F.col(f"_{KEY[0]}").isNotNull() & (F.col("id") != run_id) & (F.col("status") == "unreviewed")
    joined = joined.withColumns({"message": F.when(hit, F.coalesce(F.lit(message).cast("string"), F.col("message"))).otherwise(F.col("message")), "status": F.when(hit, F.lit("bested")).otherwise(F.col("status"))})
    return joined.select(*runs.columns)


TABLES = {"runs": schemas.RUNS, "snapshots": schemas.SNAPSHOTS, "events": EVENTS}
#: How often a change is repeated when other writers come before it.
ATTEMPTS = 20


class Registry:
    """A registry in a folder: tables ``runs``, ``snapshots`` and ``events``, and ``versions``, which says what belongs to them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/versions")

    def _table(self, name: str, version: int | None = None) -> DataFrame:
        kinds = T.StructType([T.StructField(f.name, f.dataType) for f in TABLES[name]])
        folders = [f for v in self.versions.read(version) for f in v.get(name, [])]
        if not folders:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(*[f"{self.path}/{f}" for f in folders])

    def _written(self, name: str, rows: DataFrame | list[tuple]) -> str:
        """Rows in a folder that no version names yet."""
        folder = f"{name}/{uuid.uuid4().hex}"
        df = self.spark.createDataFrame(rows, TABLES[name]).coalesce(1) if isinstance(rows, list) else rows
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _change(self, make: Callable[[int], tuple[dict[str, DataFrame | list[tuple]], int]]) -> int:
        """Commits what ``make`` returns for the version that it is given, tables' new rows and a result, and returns the result."""
        for _ in range(ATTEMPTS):
            version = self.versions.last()
            tables, result = make(version)
            if not tables:
                return result
            named = {name: [self._written(name, rows)] for name, rows in tables.items()}
            if self.versions.put(version + 1, named):
                return result
        raise RegistryError(f"other writers came first {ATTEMPTS} times")

    def init(self) -> None:
        """Creates the registry where it is missing."""
        if self.versions.last() == 0:
            self.versions.put(1, {})

    def adopt(self, runs: DataFrame) -> None:
        """Takes over runs of any older form, with their numbers, in one transaction."""
        self._change(lambda version: ({"runs": migrated(runs)}, 0))

    def snapshots(self) -> DataFrame:
        return self._table("snapshots")

    def runs(self, version: int | None = None) -> DataFrame:
        """The current state, or that of a version: the last event that sets a column decides; bested events without a message keep the one before."""
        version = self.versions.last() if version is None else version
        rows = migrated(self._table("runs", version))
        by = Window.partitionBy("run_id").orderBy(F.desc("event_seq"))
        events = self._table("events", version)
        speaks = (F.col("kind") == "reviewed") | F.col("message").isNotNull()
        last = events.withColumn("_n", F.row_number().over(by)).where("_n = 1").select("run_id", F.col("kind").alias("_kind"))
        said = events.where(speaks).withColumn("_n", F.row_number().over(by)).where("_n = 1").select("run_id", F.lit(True).alias("_said"), F.col("message").alias("_message"))
        judged = events.where("kind = 'reviewed'").withColumn("_n", F.row_number().over(by)).where("_n = 1").select("run_id", F.col("regression").alias("_regression"))
        joined = rows.withColumnRenamed("id", "run_id").join(last, "run_id", "left").join(said, "run_id", "left").join(judged, "run_id", "left").withColumnRenamed("run_id", "id")
        out = joined.withColumns({"status": F.coalesce("_kind", "status"), "message": F.when(F.col("_said"), F.col("_message")).otherwise(F.col("message")), "regression": F.coalesce("_regression", "regression")})
        return out.select(*[f.name for f in schemas.RUNS])

    def record(self, run: dict, git_rows: Iterable[dict] = ()) -> int:
        """Adds a run and its snapshots in one transaction and returns its id. Accepted runs are reviewed at once."""
        accepted, git = bool(run.get("accepted")), list(git_rows)
        row = {"status": "reviewed" if accepted else "unreviewed", "regression": 0, "message": run.get("acceptance_reason"), "run_date": datetime.datetime.now(datetime.timezone.utc).isoformat()} | run

        def make(version: int) -> tuple[dict, int]:
            new = (self._table("runs", version).agg(F.max("id")).first()[0] or 0) + 1
            tables = {"runs": [tuple((row | {"id": new, "accepted": int(accepted)}).get(f.name) for f in schemas.RUNS)]}
            if git:
                first = (self._table("snapshots", version).agg(F.max("id")).first()[0] or 0) + 1
                tables["snapshots"] = [(first + i, new, g["repo_name"], g["repo_url"], g["commit_hash"]) for i, g in enumerate(git)]
            return tables, new

        return self._change(make)

    def review(self, run_id: int, regression: int, message: str | None) -> None:
        def make(version: int) -> tuple[dict, int]:
            if not self._table("runs", version).where(F.col("id") == run_id).take(1):
                raise RegistryError(f"no run {run_id}")
            return {"events": [(version + 1, run_id, "reviewed", regression, message)]}, run_id

        self._change(make)

    def mark_bested(self, run_id: int, message: str | None = None) -> int:
        """Marks the older unreviewed runs that this one is better than; returns their number. The ids stay on the executors."""

        def make(version: int) -> tuple[dict, int]:
            runs = self.runs(version)
            check_bests(runs, run_id)
            before = runs.select("id", F.col("status").alias("_was"))
            hit = bested(runs, run_id).join(before, "id").where("status = 'bested' AND _was <> 'bested'")
            events = saved(hit.select(F.lit(version + 1).cast("long").alias("event_seq"), F.col("id").alias("run_id"), F.lit("bested").alias("kind"), F.lit(None).cast("int").alias("regression"), F.lit(message).cast("string").alias("message")))
            n = events.count()
            return ({"events": events} if n else {}), n

        return self._change(make)


def capture_commits(get_commits: Callable[[], Iterable[str]]) -> list[dict]:
    """Rows of a commit list (name, url, type, value by tabs; # starts a remark) that are commits; the command is the caller's."""
    out = []
    for line in get_commits():
        fields = line.rstrip("\n").split("\t")
        if not line.startswith("#") and len(fields) == 4 and fields[2] == "commit":
            out.append({"repo_name": fields[0], "repo_url": fields[1], "commit_hash": fields[3]})
    return out
