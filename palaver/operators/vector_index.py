"""Exact vector top-k without a full scan: vectors in folders by centroid, left out by the triangle inequality of angles.

A folder (cell) holds the vectors nearest to its centroid, in order of their angle to it, and is known
by the least and the greatest of those angles.  No vector of a cell can be nearer to the query than
the query's angle to the centroid less the greatest one; a search reads the nearest cells first, and
then only those cells, and of them only those row groups, that can still hold one of the best.  The
centroids come from a bounded sample; whatever they are, the result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators.messages import visible
from palaver.operators.retrieval import cosine, ranked

#: Vectors that the centroids are fitted on, and centroids at most.
SAMPLE, MOST_CELLS = 20_000, 4096
#: Angles are compared with this much to spare: scores are rounded to six places, and sums of doubles aren't exact.
SPARE = 2e-3
VECTORS = "key bigint, vector array<double>, angle double, cell int"
CELLS = "cell int, centroid array<double>, near double, far double, n bigint"


def _units(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1; zero vectors stay zero."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(vectors), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of a bounded sample; centroids that lose all vectors go."""
    rng = np.random.default_rng(0)
    now = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        own = (sample @ now.T).argmax(axis=1)
        sums = np.zeros_like(now)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        now = (sums / np.where(norms > 0, norms, 1))[norms[:, 0] > 0]
    return now


def build(vectors: DataFrame, path: str, key: str, vector: str, cells: int | None = None) -> None:
    """Write the vectors (key, vector) under ``path``; null, empty and zero vectors and those of another length than most are left out.

    They have a cosine of 0 with every query of that length, and searches give positive ones only.
    """
    spark = vectors.sparkSession
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    slim = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    sizes = slim.where(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    usable = slim.where((F.size("vector") == (sizes["d"] if sizes else -1)) & (norm > 0) & (norm < float("inf")))
    n = sizes["n"] if sizes else 0
    rate = max(1, n // SAMPLE)
    drawn = usable.where(F.pmod(F.xxhash64("key"), F.lit(rate)) == 0).select("vector").limit(2 * SAMPLE).collect()
    sample = _units(pa.array([r["vector"] for r in drawn], pa.list_(pa.float64()))) if drawn else np.zeros((0, 1))
    known = _centroids(sample, min(MOST_CELLS, cells or max(1, int(n**0.5) // 2))) if len(sample) else sample

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column(1))
            near = units @ known.T
            own = near.argmax(axis=1) if len(known) else np.zeros(len(units), dtype=np.int64)
            angle = np.arccos(np.clip(near[np.arange(len(units)), own], -1, 1)) if len(known) else np.zeros(len(units))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(angle), pa.array(own.astype(np.int32))], names=["key", "vector", "angle", "cell"])

    filed = usable.mapInArrow(placed, VECTORS)
    # a cell of very many vectors is several files, each with its own range of angles
    filed.repartitionByRange("cell", "angle").sortWithinPartitions("cell", "angle").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spread = spark.read.schema(VECTORS).parquet(f"{path}/vectors").groupBy("cell").agg(F.min("angle").alias("near"), F.max("angle").alias("far"), F.count(F.lit(1)).alias("n"))
    places = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(known)], "cell int, centroid array<double>")
    places.join(spread, "cell").select([c.split()[0] for c in CELLS.split(", ")]).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


@dataclass
class Cell:
    """A cell as a query sees it: the least angle that its vectors can have to it, and its centroid's angle."""

    cell: int
    least: float
    angle: float
    n: int


def plan(spark: SparkSession, path: str, query: list[float], most: int) -> tuple[list[Cell], list[Cell]]:
    """The cells that are read first, which hold twice ``most`` vectors, and the others, nearest first.

    Queries that are zero or of another length than the vectors have no cells.
    """
    q, cells = np.asarray(query, dtype=float), []
    for r in spark.read.schema(CELLS).parquet(f"{path}/cells").collect():  # at most MOST_CELLS
        c = np.asarray(r["centroid"])
        if len(c) == len(q) and np.any(q):
            angle = float(np.arccos(np.clip(c @ q / (np.linalg.norm(q) * np.linalg.norm(c)), -1, 1)))
            cells.append(Cell(r["cell"], max(0.0, angle - r["far"], r["near"] - angle), angle, r["n"]))
    cells.sort(key=lambda x: (x.least, x.angle))
    before = np.cumsum([0, *(c.n for c in cells)])[:-1]
    first = int(np.searchsorted(before, 2 * most))
    return cells[:first], cells[first:]


def within(cells: list[Cell], least_score: float) -> tuple[list[Cell], float]:
    """Those cells that may hold a vector of at least this score, and the angle that it may have."""
    widest = float(np.arccos(np.clip(least_score, -1, 1))) + SPARE
    return [c for c in cells if c.least <= widest], widest


def search(spark: SparkSession, path: str, query: list[float], most: int, scope: DataFrame | None = None) -> DataFrame:
    """(key, score, rank) by cosine with the query vector, only positive ones, as ``retrieval.nearest`` gives them.

    ``scope``: the keys that may be found (one column), if not all: those that are visible and whose
    vector is of the content in force (see ``embedded``).  It holds before the best are taken.
    """
    first, others = plan(spark, path, query, most)
    vectors = spark.read.schema(VECTORS).parquet(f"{path}/vectors")
    target = F.array(*[F.lit(float(x)) for x in query])

    def scored(rows: DataFrame) -> DataFrame:
        if scope is not None:
            rows = rows.join(scope.toDF("key"), "key", "left_semi")
        return rows.select("key", F.round(cosine(F.col("vector"), target), 6).alias("score")).where("score > 0")

    best = scored(vectors.where(F.col("cell").isin([c.cell for c in first]))).orderBy(F.desc("score"), "key").limit(most).collect()
    left, widest = within(others, best[-1]["score"] if len(best) == most else 0.0)
    found = spark.createDataFrame([(r["key"], r["score"]) for r in best], "key bigint, score double")
    if left:
        # of a cell only the vectors whose own angle to the centroid lets them be near enough
        bands = [(F.col("cell") == c.cell) & F.col("angle").between(c.angle - widest, c.angle + widest) for c in left]
        found = found.unionByName(scored(vectors.where(_any(bands))))
    return ranked(found, [F.desc("score"), F.asc("key")], most)


def embedded(index: DataFrame, embeddings: DataFrame, model: str, key: str = "message_id") -> DataFrame:
    """The keys of visible messages that have a vector of this model: the scope of a search."""
    done = embeddings.where((F.col("embedding_model") == model) & (F.col("embedding_status") == "done") & F.col("embedding_vector").isNotNull())
    return visible(index).join(done.select(key), key, "left_semi").select(key)


def _any(conditions: list[Column]) -> Column:
    """One condition, as a balanced tree."""
    while len(conditions) > 1:
        conditions = [conditions[i] | conditions[i + 1] if i + 1 < len(conditions) else conditions[i] for i in range(0, len(conditions), 2)]
    return conditions[0]
