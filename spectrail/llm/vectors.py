"""Near duplicates among embeddings by a subspace pigeonhole join.

Unit vectors with cosine c are at squared distance 2 - 2 c. After a rotation the dimensions are split into blocks; if the
whole squared distance is within the budget, some block's is within its part of it, by its dimensions. So each block is
range-joined alone. PIVOTS directions cut a block into cells of equal chances; a part is at home with the pivot it points to
most, and visits each cell that is no further away than half the radius: two parts within the radius stand on either side of
the plane between their pivots, and one of them is that near to it. Pairs within a block's budget are verified in full, in
double precision; the union over blocks counts each pair once, in the first block that admits it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm.tables import components, read, saved
from spectrail.llm.words import mixed

#: Blocks of dimensions, directions that cut a block into cells, vectors that these are chosen from, and the most vectors that
#: one task compares on a side.
BLOCKS, PIVOTS, SAMPLE, GROUP = 4, 64, 4096, 16_384
_SLACK = 1e-9
_CELLS = "dim int, block int, cell int, p int, q int, chunk int, home int, vec_id long, copies long, visits binary, vector binary"


class Subspaces:
    """A fixed rotation of vectors of ``dim`` dimensions, its blocks, their budgets and their pivots.

    Pivots come from ``sample``, each as far from the others as can be; random directions fill up what it does not give.
    They decide where pairs are compared, not which ones are found.
    """

    def __init__(self, dim: int, cosine: float, sample: np.ndarray | None = None, blocks: int = BLOCKS, pivots: int = PIVOTS):
        n = max(1, min(blocks, dim // 2))
        rng = np.random.default_rng(7)
        self.edges = [round(i * dim / n) for i in range(n + 1)]
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        self.rotation = q * np.sign(np.diag(r))
        total = max(0.0, 2 - 2 * cosine)
        self.budgets = np.array([total * (b - a) / dim for a, b in zip(self.edges, self.edges[1:])]) + _SLACK
        rows = np.zeros((0, dim)) if sample is None else self.units(sample) @ self.rotation
        self.pivots = [_far(np.concatenate([rows[:, a:b], rng.normal(size=(2 * pivots, b - a))]), len(rows), pivots) for a, b in zip(self.edges, self.edges[1:])]

    def units(self, raw: np.ndarray) -> np.ndarray:
        raw = raw.astype(np.float64)
        raw = raw / np.abs(raw).max(1, keepdims=True)  # so that squares neither overflow nor vanish
        return raw / np.sqrt((raw * raw).sum(1, keepdims=True))

    def cells(self, rotated: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The home cell of each vector's part, and which cells it visits, as (vectors, cells)."""
        pivots = self.pivots[block]
        along = rotated[:, self.edges[block] : self.edges[block + 1]] @ pivots.T
        home = along.argmax(1)
        apart = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(2))
        at = np.arange(len(home))
        # the distance to the plane between two pivots, which goes through the origin
        visits = along[at, home][:, None] - along <= apart[home] * (np.sqrt(self.budgets[block]) / 2 + _SLACK)
        visits[at, home] = False
        return home, visits


def _far(parts: np.ndarray, first: int, n: int) -> np.ndarray:
    """Up to ``n`` directions among ``parts``, of the first ``first`` while they last, no two alike."""
    size = np.sqrt((parts * parts).sum(1, keepdims=True))
    parts = parts / np.maximum(size, 1e-300)
    usable = size[:, 0] > 1e-6
    picked: list[int] = []
    nearest = np.full(len(parts), -2.0)
    for low, high in ((0, first), (first, len(parts))):
        while len(picked) < n and usable[low:high].any():
            k = low + int(np.where(usable[low:high], nearest[low:high], 9).argmin())
            if nearest[k] > 1 - 1e-6:
                break
            picked.append(k)
            usable[k] = False
            nearest = np.maximum(nearest, parts @ parts[k])
    return parts[picked]


def _to_cells(spaces: dict[int, np.ndarray], chunks: dict[tuple[int, int, int], int], cosine: float, kind: str, whole: bool = True):
    """Rows of vectors to a row for each block's home cell and for each cell that is visited there; without ``whole`` the
    vectors stay behind."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Subspaces] = {}
        for rows in batches:
            for at in range(0, rows.num_rows, 2000):
                batch = rows.slice(at, 2000)
                ids, copies, dims = (np.asarray(batch.column(i)) for i in range(3))
                data = np.asarray(batch.column(3).flatten()).astype(kind)
                starts = np.cumsum(dims) - dims
                for dim in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == dim)
                    sub = known.setdefault(dim, Subspaces(dim, cosine, spaces.get(dim)))
                    vectors = data[starts[own][:, None] + np.arange(dim)]
                    rotated = sub.units(vectors) @ sub.rotation
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim * vectors.itemsize), len(own), [None, pa.py_buffer(vectors.tobytes())]).cast(pa.binary())
                    for block in range(len(sub.budgets)):
                        home, visits = sub.cells(rotated, block)
                        row, cell = np.nonzero(visits)
                        row, cell = np.concatenate([np.arange(len(own)), row]), np.concatenate([home, cell])
                        n = np.array([chunks.get((dim, block, c), 1) for c in range(visits.shape[1])])
                        mine = (mixed(ids[own].astype(np.uint64)) >> np.uint64(1)).astype(np.int64)[row] % n[cell]
                        times = n[cell]
                        other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        row, cell, mine = np.repeat(row, times), np.repeat(cell, times), np.repeat(mine, times)
                        take = pa.array(row)
                        marks = np.packbits(visits, axis=1)
                        flags = pa.FixedSizeBinaryArray.from_buffers(pa.binary(marks.shape[1]), len(own), [None, pa.py_buffer(marks.tobytes())]).cast(pa.binary())
                        same = np.full(len(row), dim)
                        numbers = (same, np.full(len(row), block), cell, np.minimum(mine, other), np.maximum(mine, other), mine, home[row])
                        columns = [pa.array(x.astype(np.int32)) for x in numbers] + [pa.array(ids[own][row]), pa.array(copies[own][row])]
                        columns += [flags.take(take), raw.take(take)] if whole else [pa.array([b""] * len(row), pa.binary())] * 2
                        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _CELLS.split(", ")])

    return each


def _near(a: np.ndarray, b: np.ndarray, most: float, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) at a squared distance of about ``most`` or less, tile by tile; with ``upper``, a is b and pairs come once."""
    square = lambda x: (x * x).sum(1, keepdims=True)
    left = np.hstack([-2 * a, square(a), np.ones((len(a), 1))]).astype(np.float32)
    right = np.hstack([b, np.ones((len(b), 1)), square(b)]).astype(np.float32).T.copy()
    for i in range(0, len(a), 1024):
        for j in range(i if upper else 0, len(b), 4096):
            near = (left[i : i + 1024] @ right[:, j : j + 4096]) <= np.float32(most + 1e-5)
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            if upper:
                keep = x < y
                x, y = x[keep], y[keep]
            if len(x):
                yield x, y


def _compared(cosine: float, kind: str):
    """The vectors of a cell to (vec_id, links, root): links that count here, and the least vector its links reach here."""

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim, block, cell, p, q = (int(x) for x in key)
        sub = Subspaces(dim, cosine)
        ids, copies = rows["vec_id"].to_numpy(), rows["copies"].to_numpy()
        units = sub.units(np.frombuffer(b"".join(rows["vector"]), kind).reshape(len(rows), dim))
        rotated = units @ sub.rotation
        part = rotated[:, sub.edges[block] : sub.edges[block + 1]]
        homes, chunk = rows["home"].to_numpy(), rows["chunk"].to_numpy()
        home = homes == cell
        visits = np.unpackbits(np.frombuffer(b"".join(rows["visits"]), np.uint8).reshape(len(rows), -1), axis=1)
        links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
        sets = [(home & (chunk == p), None)] if p == q else [(home & (chunk == p), home & (chunk == q))]
        sets += [(home & (chunk == p), ~home & (chunk == q))] + ([] if p == q else [(home & (chunk == q), ~home & (chunk == p))])
        for one, two in sets:
            a = np.flatnonzero(one)
            b = a if two is None else np.flatnonzero(two)
            if not len(a) or not len(b):
                continue
            for x, y in _near(part[a], part[b], sub.budgets[block], two is None):
                for at in range(0, len(x), 100_000):
                    i, j = a[x[at : at + 100_000]], b[y[at : at + 100_000]]
                    # where each of two visits the other's home, the pair counts in the lower cell
                    once = (homes[j] >= cell) | (visits[i, homes[j]] == 0)
                    i, j = i[once], j[once]
                    good = (units[i] * units[j]).sum(1) >= cosine
                    i, j = i[good], j[good]
                    if not len(i):
                        continue
                    squares = (rotated[i] - rotated[j]) ** 2
                    within = np.stack([squares[:, s:e].sum(1) <= m for s, e, m in zip(sub.edges, sub.edges[1:], sub.budgets)], 1)
                    first = within.argmax(1) == block
                    i, j = i[first], j[first]
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    _join(i, j, root)
        has = links > 0
        low = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(low, root, ids)
        return pd.DataFrame({"vec_id": ids[has], "links": links[has], "root": low[root][has]})

    return each


def _join(i: np.ndarray, j: np.ndarray, root: np.ndarray) -> None:
    """Joins the ends of links in ``root`` (each row's label, that of its group)."""
    while True:
        low = np.minimum(root[i], root[j])
        high = np.maximum(root[i], root[j])
        if (low == high).all():
            return
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def near_vectors(vectors: DataFrame, cosine: float = 0.9, group: int = GROUP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors``.

    Vectors link at a cosine of ``cosine`` (over 0) or more, in double precision; those of other lengths are not compared.
    Null vectors, empty ones, those of zeros only and those with null, infinite or NaN components link with nothing. Rows
    that repeat a vec_id count as rows of their own. A null vec_id gets no links and no component and is kept.
    Equal vectors are one vector until the end, with the number of its copies. Other columns are not read.
    """
    kind = "<f8" if "double" in dict(vectors.dtypes)[vector_col] else "<f4"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    same = saved(rows.where("fine").groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")))
    each = same.select("vec_id", "copies", F.size("v").alias("dim"), "v")
    # pivots come from a sample that SAMPLE bounds; it only decides where pairs meet
    spaces = {}
    for r in each.orderBy(F.xxhash64("v"), "vec_id").limit(SAMPLE).select("dim", "v").collect():
        spaces.setdefault(r["dim"], []).append(list(r["v"]))
    spaces = {dim: np.array(v, kind) for dim, v in spaces.items()}
    chunks: dict = {}
    if same.count() > group:
        at = ["dim", "block", "cell"]
        sizes = each.mapInArrow(_to_cells(spaces, {}, cosine, kind, whole=False), _CELLS).groupBy(*at).count().where(F.col("count") > group)
        # a length of vectors has BLOCKS * PIVOTS cells at most
        chunks = {tuple(r[k] for k in at): -(-r["count"] // group) for r in sizes.collect()}
    cells = each.repartition(max(1, same.sparkSession.sparkContext.defaultParallelism)).mapInArrow(_to_cells(spaces, chunks, cosine, kind), _CELLS)
    found = saved(cells.groupBy("dim", "block", "cell", "p", "q").applyInPandas(_compared(cosine, kind), "vec_id long, links long, root long"))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("others"))
    groups = components(found, "vec_id", "root")
    reps = same.select("v", "copies", F.col("vec_id").alias("rep"))
    reps = reps.join(counts, F.col("rep") == F.col("vec_id"), "left").drop("vec_id").join(groups, F.col("rep") == F.col("node"), "left")
    reps = saved(reps.select("v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    linked = rows.where("fine").join(reps, "v").select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op9_sql() -> str:
    """The same by all pairs, in DuckDB's SQL."""
    return r"""WITH RECURSIVE v AS (SELECT vec_id, embedding::double[] AS v FROM embeddings),
fine AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM v
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.9),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
lows AS (SELECT a, min(b) AS low FROM reached GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM v LEFT JOIN counts ON counts.a = vec_id LEFT JOIN lows ON lows.a = vec_id"""
