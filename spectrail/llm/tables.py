"""What the corpus operators share on the side of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectrail.sources.shared import saved

#: A word, for Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def bucketed_before(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, rows_per_bucket: int = 1_000) -> DataFrame:
    """Adds ``out``: the sum of ``value`` (whole numbers) over the rows of the same ``keys`` that come before.

    The order within a key is ``hash(order), order``: random but the same in each run, for which ``order`` must tell rows apart.
    No task holds a key: hashes are cut into equal ranges (buckets), sums of buckets are added up in a table
    that is smaller by ``rows_per_bucket``, and windows run inside a bucket only.
    """
    spark = df.sparkSession
    hashed = df.withColumn("_h", F.xxhash64(*order)).withColumn("_v", value.cast("long"))
    hashed = saved(hashed)
    buckets = max(1, -(-hashed.count() // rows_per_bucket))
    # the high 32 bits of the hash, as 0 .. 2**32 - 1, onto 0 .. buckets - 1
    bucket = F.floor((F.shiftrightunsigned("_h", 32) * F.lit(buckets).cast("long")) / F.lit(2**32)).cast("long")
    hashed = hashed.withColumn("_b", bucket)
    sums = hashed.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    # buckets of buckets: no window runs over more than about the square root of a key's buckets
    step = max(1, int(buckets**0.5))
    sums = saved(sums.withColumn("_g", F.floor(F.col("_b") / step).cast("long")))
    coarse = sums.groupBy(*keys, "_g").agg(F.sum("_s").alias("_gs"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("_g0", F.coalesce(F.sum("_gs").over(before(*keys).orderBy("_g")), F.lit(0))).drop("_gs")
    same = lambda a, b, names: [a[k].eqNullSafe(b[k]) for k in names]
    starts = sums.withColumn("_b0", F.coalesce(F.sum("_s").over(before(*keys, "_g").orderBy("_b")), F.lit(0)))
    starts = starts.join(coarse, same(starts, coarse, [*keys, "_g"])).select(*(starts[k] for k in keys), starts["_b"], (F.col("_b0") + F.col("_g0")).alias("_start"))
    inside = hashed.withColumn("_in", F.coalesce(F.sum("_v").over(before(*keys, "_b").orderBy("_h", *order)), F.lit(0)))
    joined = inside.join(starts, same(inside, starts, [*keys, "_b"]))
    return joined.select(*(inside[c] for c in df.columns), (F.col("_start") + F.col("_in")).alias(out))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of ``links``, the least node that can be reached.

    Each round gives a node the least label among its neighbours' and then that label's own label,
    so chains get shorter by half; labels stay in tables, and rounds end when none changes.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = saved(both.union(both.select("v", "u")).distinct())
    labels = saved(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("m"))
        better = labels.join(near, F.col("node") == F.col("u"), "left").select("node", "label", F.least("label", F.coalesce("m", "label")).alias("next"))
        better = saved(better)
        tops = better.select(F.col("node").alias("top"), F.col("next").alias("above"))
        jumped = better.join(tops, F.col("next") == F.col("top"), "left").select("node", "label", F.least("next", F.coalesce("above", "next")).alias("next"))
        jumped = saved(jumped)
        changed = not jumped.where("next <> label").isEmpty()
        labels = jumped.select("node", F.col("next").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """``names``, lengthened where ``df`` has such a column, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def with_columns_of(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, in its order."""
    return df.select(*like.columns)


def text_batches(df: DataFrame, rows: int = 1_000) -> DataFrame:
    """``df``; from now on the session hands at most ``rows`` rows at once to Python, since they hold whole texts.

    A batch is held several times, by Spark and by Python, so its size counts for an executor's memory.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    return df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
