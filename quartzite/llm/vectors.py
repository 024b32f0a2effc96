"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them, one representative per group.

Every vector has one home cell, that of the centroid it is closest to among those of its label.  A vector within the angle of
another is at most sin(angle) away from the border between their cells, so it also visits every cell c with
v.(c_home - c) <= sin(angle) |c_home - c|; comparing each cell's own vectors with its own and visiting ones then finds every
link from its own side, exactly once.

Cells are made by levels: a label, and then each cell that has more than PER_CELL own vectors, is split into up to FAN cells, so
their number grows with the vectors of each label and no level's model is large.  Each split is fitted in a task of its own on a
sample by hash of at most 2 SAMPLE vectors; models are a table that is dealt to the same tasks as the vectors, and nothing goes
to the driver.  A cell whose vectors are so close together that a split would compare almost as many pairs stays whole.  Equal
vectors count once with their number; cells are cut into blocks of a fixed size and pairs of blocks are compared, so a crowded
cell is many tasks; of a block pair only counts and a spanning forest leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.llm.common import arrow_batches, components, drop, materialize, new_path, width

#: Vectors that a split is fitted on (twice as many at most, by chance); cells of a split at most; vectors that a cell is meant to have.
SAMPLE, FAN, PER_CELL = 2000, 64, 4000
#: Rows that are assigned to cells together; rows of a block; share of the pairs that a split may leave.
DEAL, BLOCK, WORTH = 1 << 14, 2048, 0.8
SLACK = 1e-9
ROW = "cell string, own boolean, rep long, n long, unit binary"


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) to unit vectors in double precision as bytes; null where the vector links with nothing."""
    for batch in batches:
        vectors = batch.column(2)
        sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten()
        starts = np.cumsum(sizes) - sizes
        values = flat.to_numpy(zero_copy_only=False) if not flat.null_count else np.where(np.asarray(flat.is_null()), np.nan, flat.fill_null(0.0).to_numpy(zero_copy_only=False))
        sizes = np.where(np.asarray(batch.column(1).is_valid()), sizes, 0)
        out: list[bytes | None] = [None] * len(sizes)
        for dim in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == dim)
            x = values[starts[rows][:, None] + np.arange(dim)]
            fine = np.isfinite(x).all(axis=1)
            rows, x = rows[fine], x[fine]
            big = np.abs(x).max(axis=1) if len(x) else np.zeros(0)
            rows, x = rows[big > 0], x[big > 0] / big[big > 0][:, None]
            x /= np.linalg.norm(x, axis=1)[:, None]
            for i, u in zip(rows.tolist(), x, strict=True):
                out[i] = u.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "label", "unit"])


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: unit centroids maximising the sum of cosines, farthest-first start, deterministic."""
    c = x[:1]
    best = x @ c[0]
    while len(c) < k and best.min() < 1 - 1e-12:
        c = np.vstack([c, x[best.argmin()]])
        best = np.maximum(best, x @ c[-1])
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 0, total / np.where(norm, norm, 1)[:, None], c)
    return c


def visits(x: np.ndarray, c: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, matrix of the cells that each of the unit vectors `x` belongs to or visits)."""
    sine = np.sqrt(max(0.0, 1 - cosine * cosine)) + SLACK
    dot = x @ c.T
    home = dot.argmax(axis=1)
    apart = np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2)
    near = dot[np.arange(len(x)), home][:, None] - dot <= sine * apart[home] + SLACK
    near[np.arange(len(x)), home] = True
    return home, near


def _matrix(units: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(units.to_pylist()), np.float64).reshape(len(units), -1)


def _split(table: pa.Table, cosine: float, per_cell: int, sample: int, fan: int) -> pa.Table:
    """The sample (cell, n, h, unit) of one cell to its centroids, where a split is worth its visits: (cell, n, model)."""
    table = table.sort_by("h").slice(0, 2 * sample)
    x, n = _matrix(table.column("unit").combine_chunks()), table.column("n")[0].as_py()
    c = centroids(x, min(fan, -(-n // per_cell)))
    home, near = visits(x, c, cosine)
    own = np.bincount(home, minlength=len(c))
    fine = len(c) > 1 and own @ near.sum(axis=0) <= WORTH * len(x) ** 2
    return table.slice(0, int(fine)).select(["cell", "n"]).append_column("model", pa.array([c.tobytes()] * int(fine), pa.binary()))


def _assign(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """(tile, kind, cell, own, rep, n, unit) sorted by tile and kind, the model first, to a row for each cell of the split that a vector is in."""
    for rows in _tiles(batches):
        cell, own, rep, n, unit = rows.columns[2:]
        if len(rep) < 2:
            continue
        x = _matrix(unit.slice(1))
        c = np.frombuffer(unit[0].as_py(), np.float64).reshape(-1, x.shape[1])
        home, near = visits(x, c, cosine)
        r, k = np.nonzero(near)
        at = pa.array(r + 1)
        mine = np.asarray(own.slice(1).fill_null(False))[r] & (home[r] == k)
        names = pa.array([f"{cell[0].as_py()}/{i}" for i in range(len(c))])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(k)), pa.array(mine), rep.take(at), n.take(at), unit.take(at)], ["cell", "own", "rep", "n", "unit"])


def cells_of(same: DataFrame, cosine: float) -> tuple[DataFrame, list[str]]:
    """(cell, own, rep, n, unit): each vector's home cell and those it visits; and the tables it is read from."""
    spark, paths = same.sparkSession, []
    per_cell, size, fan = PER_CELL, SAMPLE, FAN

    def split_one(table: pa.Table) -> pa.Table:
        return _split(table, cosine, per_cell, size, fan)

    cells = same.select(F.concat_ws("/", F.lit("c"), F.md5("label"), F.length("unit")).alias("cell"), F.lit(True).alias("own"), "rep", "n", "unit")
    done = []
    while True:
        crowded = cells.where("own").groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > PER_CELL).withColumnRenamed("cell", "of")
        sample = cells.where("own").withColumn("h", F.xxhash64("rep")).join(crowded, F.col("cell") == F.col("of"))
        sample = sample.where(F.pmod("h", F.lit(1 << 40)) < F.lit(float(SAMPLE << 40)) / F.col("size"))
        path = new_path(spark, "model")
        model = materialize(sample.select("cell", F.col("size").alias("n"), "h", "unit").groupBy("cell").applyInArrow(split_one, "cell string, n long, model binary"), "model", path)
        paths.append(path)
        if model.isEmpty():
            return _union([*done, cells]), paths
        split = model.select(F.col("cell").alias("of"), F.ceil(F.col("n") / DEAL).cast("long").alias("deals"))
        done.append(cells.join(split, F.col("cell") == F.col("of"), "left_anti"))
        vectors = cells.join(split, F.col("cell") == F.col("of")).select(F.concat_ws("|", "cell", F.pmod(F.xxhash64("rep"), "deals")).alias("tile"), F.lit(1).alias("kind"), "cell", "own", "rep", "n", "unit")
        headers = model.join(split, F.col("cell") == F.col("of")).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
        headers = headers.select(F.concat_ws("|", "cell", "deal").alias("tile"), F.lit(0).alias("kind"), "cell", F.lit(None).cast("boolean").alias("own"), F.lit(0).cast("long").alias("rep"), "n", F.col("model").alias("unit"))
        path = new_path(spark, "cells")
        dealt = headers.unionByName(vectors).repartition(width(spark), "tile").sortWithinPartitions("tile", "kind")
        cells = materialize(dealt.mapInArrow(partial(_assign, cosine=cosine), ROW), "cells", path)
        paths.append(path)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, tile by tile."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        tile = rest.column(0).to_pylist()
        start = 0
        for i in range(1, len(tile)):
            if tile[i] != tile[i - 1]:
                yield rest.slice(start, i - start)
                start = i
        rest = rest.slice(start)
    if rest is not None and rest.num_rows:
        yield rest


def _compare(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """(tile, side, rep, n, unit), side 0 the own rows, 1 those they are compared with.  Rows (a, b, links): a's links found here, and an edge where b is given."""
    for rows in _tiles(batches):
        side, rep, n = (rows.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        x = _matrix(rows.column(4))
        own, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links, a, b = np.zeros(len(own), np.int64), [], []
        names, at = np.unique(rep, return_inverse=True)
        tree = np.arange(len(names))
        for i in range(0, len(own), 256):
            part = own[i : i + 256]
            hit = (x[part] @ x[others].T >= cosine) & (rep[part][:, None] != rep[others][None, :])
            links[i : i + 256] = hit @ n[others]
            for p in np.flatnonzero(hit.any(axis=1)):  # an edge wherever two trees meet
                far = at[others[hit[p]]]
                met, first = np.unique(tree[far], return_index=True)
                mine = tree[at[part[p]]]
                for t, f in zip(met[met != mine], first[met != mine], strict=True):
                    tree[tree == t] = mine
                    a.append(rep[part[p]])
                    b.append(names[far[f]])
        some = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep[own[some]], np.array(a, np.int64)])), pa.array([None] * int(some.sum()) + [int(v) for v in b], pa.int64()), pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)]))], ["a", "b", "links"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row per vector: (id, n_links long, component_id long, kept boolean), linked if the labels are equal and the cosine is >= `cosine`.

    A vector that is null, empty or zero, has a null or non-finite component, a null label or a null id, links with nothing;
    so do vectors of different lengths with one another.  Repeated rows are vectors of their own; of an id that stands at several
    vectors each row has the links of its own vector.  An empty table stays empty, other columns are ignored whatever their names.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    same_path, unit_path = new_path(spark, "equal"), new_path(spark, "unit")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    unit = materialize(src.mapInArrow(_clean, "id long, label string, unit binary"), "unit", unit_path)
    good = unit.where("unit is not null and id is not null")
    # equal vectors: one representative with their number
    same = materialize(good.groupBy("label", "unit").agg(F.min("id").alias("low"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()), "equal", same_path)
    cells, paths = cells_of(same, cosine)

    # blocks of fixed size by hash, and for each cell all pairs (own block, any block)
    per = cells.groupBy("cell").agg(F.sum(F.col("own").cast("long")).alias("own_n"), F.count("*").alias("all_n"))
    per = per.select("cell", F.greatest(F.lit(1), F.ceil(F.col("own_n") / BLOCK)).alias("ob"), F.ceil(F.col("all_n") / BLOCK).alias("ab")).where("own_n > 0")
    cut = cells.join(per, "cell").withColumn("h", F.xxhash64("rep"))
    left = cut.where("own").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ab") - 1))).select(F.concat_ws("|", "cell", F.pmod("h", "ob"), "k").alias("tile"), F.lit(0).alias("side"), "rep", "n", "unit")
    right = cut.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ob") - 1))).select(F.concat_ws("|", "cell", "k", F.pmod("h", "ab")).alias("tile"), F.lit(1).alias("side"), "rep", "n", "unit")
    tiles = left.unionByName(right)
    found = materialize(tiles.repartition(width(spark), "tile").sortWithinPartitions("tile").mapInArrow(partial(_compare, cosine=cosine), "a long, b long, links long"), "links")
    drop(spark, *paths)
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("far"))
    # a node is (smallest id, vector), so that a component's smallest node has its smallest id
    node = lambda x: same.select(F.col("rep").alias(x), F.struct("low", "rep").alias(f"n{x}"))
    edges = found.where("b is not null").select("a", "b").join(node("a"), "a").join(node("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    comp = components(edges).select(F.col("node.rep").alias("node"), F.col("component.low").alias("least"))
    reps = same.join(links, same.rep == links.a, "left").join(comp, same.rep == comp.node, "left")
    reps = reps.select(F.col("label").alias("l"), F.col("unit").alias("u"), (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "low").alias("component_id"))
    some = good.join(reps, (good.label == reps.l) & (good.unit == reps.u)).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    rest = unit.where("unit is null or id is null").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return some.unionByName(rest)


def op4_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = {
    "op4_embedding_near_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT vec_id, label, v FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, CAST((SELECT count(*) FROM links WHERE a = e.vec_id) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN c USING (vec_id)""",
}
