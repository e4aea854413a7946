"""Nearest sections by an inverted-file index: centroids of a bounded sample cut the sections into cells, and a query looks into few of them.

Every section is in the cell of its nearest centroid, whatever the sample. A query first looks into the cells of its nearest centroids. By the
triangle inequality no section of another cell is nearer than the distance to its centroid less the cell's radius; the exact way then looks
into all cells for which that leaves something to find.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Centroids are fitted on so many sections, those of the least hashes; there are so many of them, and a query looks into so many cells first.
SAMPLE, CELLS, PROBES = 20_000, 64, 4
#: Sections and queries that meet in one task.
BLOCK = 4096
#: Distances are rounded to six digits, so a cell may hold an equal one if its bound is this near.
SLACK = 2e-6


def matrix(part: pa.Table | pa.RecordBatch) -> np.ndarray:
    column = part.column("embedding")
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(part.num_rows, -1)


def measure(group: pa.Table) -> pa.Table:
    """(vec_id, section_id, distance): of a group's rows that are not held, the nearest held one by cosine distance, of equals the least id."""
    found, held, asked = [], group.filter(group.column("held")), group.filter(pc.invert(group.column("held")))
    if asked.num_rows and held.num_rows:
        held = held.sort_by("vec_id")
        ids, there, asking = held.column("vec_id").to_numpy(), matrix(held), matrix(asked)
        lengths = np.linalg.norm(there, axis=1)[None, :]
        for i in range(0, len(asking), 512):
            q = asking[i:i + 512]
            far = np.round(1 - q @ there.T / np.maximum(np.linalg.norm(q, axis=1)[:, None] * lengths, 1e-300), 6)
            best = far.argmin(axis=1)
            found.append((ids[best], far[np.arange(len(q)), best]))
    section, distance = (np.concatenate([np.empty(0, k), *(f[i] for f in found)]) for i, k in enumerate((np.int64, np.float64)))
    return pa.table({"vec_id": asked.column("vec_id").cast(pa.int64()) if found else pa.array([], pa.int64()), "section_id": pa.array(section.astype(np.int64)), "distance": pa.array(distance)})


def units(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1; those of length 0 stay."""
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)[:, None]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of each row of a from each of b."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def centroids(sections: DataFrame, cells: int = CELLS, sample: int = SAMPLE, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """At most `cells` centroids of the units of a bounded sample of sections, by Lloyd's rounds from the first distinct ones; a single zero without sections. They are the same for any partitioning."""
    drawn = sections.select("vec_id", "embedding").orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample).toPandas()
    if not len(drawn):
        return np.zeros((1, 1))
    x = units(np.stack(drawn["embedding"].to_list()).astype(np.float64))
    middles = x[np.sort(np.unique(x, axis=0, return_index=True)[1])[:cells]]
    for _ in range(rounds):
        own = apart(x, middles).argmin(axis=1)
        sums, counts = np.zeros_like(middles), np.bincount(own, minlength=len(middles))
        np.add.at(sums, own, x)
        middles = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], middles)
    return middles


def _mapped(rows: DataFrame, make: Callable[[np.ndarray, pa.RecordBatch], tuple], more: str) -> DataFrame:
    """rows repeated by make(units, batch) -> (places of rows, columns), with these columns."""
    names = [*rows.columns, *(x.split()[0] for x in more.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                places, columns = make(units(matrix(batch)), batch)
                taken = batch.take(pa.array(places))
                yield pa.RecordBatch.from_arrays([*taken.columns, *map(pa.array, columns)], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, {more}")


def _searched(asked: DataFrame, placed: DataFrame, sizes: dict[int, int], block: int) -> DataFrame:
    """The nearest section of those in the cells that (vec_id, embedding, cell) look into. Cells are dealt into blocks and their queries into parts, and each part meets each block in a group of its own."""
    looks = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each cell
    pieces = lambda counts: F.coalesce(F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, -(-n // block))))[F.col("cell")], F.lit(1)) if counts else F.lit(1)
    blocks, parts = pieces(sizes), pieces(looks)
    own = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = placed.where(F.col("cell").isin(list(looks))).select(F.lit(True).alias("held"), "vec_id", "embedding", "cell", own(blocks).alias("block"), each(parts).alias("part"))
    asking = asked.select(F.lit(False).alias("held"), "vec_id", "embedding", "cell", each(blocks).alias("block"), own(parts).alias("part"))
    return held.unionByName(asking).groupBy("cell", "block", "part").applyInArrow(measure, "vec_id long, section_id long, distance double")


def nearest_by_index(queries: DataFrame, sections: DataFrame, exact: bool = True, cells: int = CELLS, probes: int = PROBES, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, section_id, distance): each query's nearest section by cosine distance, of equals the least id; without `exact`, of those in its first cells.

    A vector of length 0 is at distance 1 from all. Equal queries get one row for each id; no sections give no rows. What goes to the driver
    is the sample and a row for each cell."""
    queries, sections = (df.select("vec_id", "embedding") for df in (queries, sections))
    middles = centroids(sections, cells, sample)

    def nearest_cell(unit: np.ndarray, batch: pa.RecordBatch) -> tuple:
        far = apart(unit, middles)
        cell = far.argmin(axis=1)
        zero = ~unit.any(axis=1)
        return np.arange(len(unit)), (np.where(zero, -1, cell).astype(np.int32), np.where(zero, 0.0, far[np.arange(len(unit)), cell]))

    if not middles.any() and sections.isEmpty():
        return queries.sparkSession.createDataFrame([], "vec_id long, section_id long, distance double")
    placed = written(_mapped(sections, nearest_cell, "cell int, far double"))
    seen = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()  # a row for each cell
    sizes = {r["cell"]: r["n"] for r in seen}
    known = np.array([r["cell"] for r in seen if r["cell"] >= 0], np.int32)
    radius = np.array([r["radius"] for r in seen if r["cell"] >= 0])
    least = placed.agg(F.min("vec_id")).scalar()
    first_cells = min(probes, len(known))

    def look(unit: np.ndarray, batch: pa.RecordBatch) -> tuple:
        live = unit.any(axis=1).nonzero()[0]
        order = np.argsort(apart(unit[live], middles[known]), axis=1, kind="stable")[:, :first_cells]
        return np.repeat(live, order.shape[1]), (known[order.ravel()],)

    def look_again(unit: np.ndarray, batch: pa.RecordBatch) -> tuple:
        far = apart(unit, middles[known])
        bound = np.maximum(far - radius[None, :] - 1e-7, 0) ** 2 / 2  # unit vectors' cosine distance
        open_ = bound <= batch.column("distance").to_numpy()[:, None] + SLACK
        np.put_along_axis(open_, np.argsort(far, axis=1, kind="stable")[:, :first_cells], False, axis=1)
        row, cell = open_.nonzero()
        return row, (known[cell],)

    best = lambda df: df.groupBy("vec_id").agg(F.min(F.struct("distance", "section_id")).alias("m")).select("vec_id", "m.section_id", F.col("m.distance").alias("distance"))
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    nothing = queries.where(length == 0).select(F.col("vec_id").cast("long").alias("vec_id"), least.cast("long").alias("section_id"), F.lit(1.0).alias("distance")).distinct()
    zeros = queries.where(length > 0).select(F.col("vec_id").cast("long").alias("vec_id"), placed.where("cell = -1").agg(F.min("vec_id")).scalar().cast("long").alias("section_id"), F.lit(1.0).alias("distance")).where("section_id is not null")
    found = nothing.unionByName(zeros)
    if len(known):
        found = written(best(found.unionByName(_searched(_mapped(queries, look, "cell int"), placed, sizes, block))))
        if exact:
            again = _mapped(queries.join(found.select("vec_id", "distance"), "vec_id").select("vec_id", "embedding", "distance"), look_again, "cell int").drop("distance")
            found = found.unionByName(_searched(again, placed, sizes, block))
    return best(found)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of queries whose section is at the distance of the exact one."""
    both = exact.select("vec_id", F.col("distance").alias("_least")).join(found, "vec_id", "left")
    return both.agg(F.avg(F.coalesce((F.col("distance") <= F.col("_least")).cast("double"), F.lit(0.0)))).first()[0]
