"""Embedding near-duplicates by PCA-ordered tiled comparison (operator 3).

Vectors are scaled to unit length and turned into the basis of their principal
components, largest first. Within a label they are dealt to tiles by their
leading coordinates; two tiles are compared only if boxes round their leading
coordinates come near enough, as cosine >= t means a distance of at most
sqrt(2 - 2t). A comparison accumulates products over leading dimensions first
and stops as soon as partial product + product of the suffix norms cannot reach
the threshold for any pair. What survives is decided by the cosine of the
vectors as given, in double precision.

Equal vectors collapse to one class first, and a tile pair reports link counts
and a spanning forest of its links, so no task or row grows with the square of
a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .textblocks import batch_rows, scratch_dir, stored

THRESHOLD = 0.98
#: Vectors a tile holds about; a task holds two tiles.
TILE = 512
#: Leading coordinates of a tile's box.
BOX = 6
#: Width of the cells, over the first two coordinates, that tiles are cut from.
CELL = 0.25
#: Quantiles of the third coordinate by which a crowded cell is cut into parts.
CUTS = 64
#: Lengths of at most so many distinct vectors are compared in one pass over all such lengths, the others in one each.
FEW = 64
#: Dimensions accumulated before each bound.
STEPS = (4, 12, 28)


def _lists(column: pa.Array) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Orthonormal basis (columns), by falling second moment of the unit vectors; d * d sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                x = np.array(_lists(batch.column(0)), np.float64)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], ["i", "s"])

    got = vectors.select("x").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
    moments = np.zeros(dims * dims)
    moments[got["i"].to_numpy()] = got["s"].to_numpy()
    values, axes = np.linalg.eigh(moments.reshape(dims, dims))
    return axes[:, np.argsort(-values, kind="stable")]


def reaching(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Index pairs (2, n) of unit vectors, leading dimensions first, whose product may reach `threshold`."""
    slack = threshold - 1e-9
    i, j, partial, done = None, None, np.zeros((len(a), len(b))), 0
    for step in (*[s for s in STEPS if s < a.shape[1]], a.shape[1]):
        if i is None:
            partial += a[:, done:step] @ b[:, done:step].T
            rest = np.linalg.norm(a[:, step:], axis=1)[:, None] * np.linalg.norm(b[:, step:], axis=1)[None]
            keep = partial + rest >= slack
            if keep.mean() < 0.1 or step == a.shape[1]:
                i, j = np.nonzero(keep)
                partial = partial[i, j]
        else:
            partial = partial + np.einsum("nd,nd->n", a[i, done:step], b[j, done:step])
            keep = partial + np.linalg.norm(a[i, step:], axis=1) * np.linalg.norm(b[j, step:], axis=1) >= slack
            i, j, partial = i[keep], j[keep], partial[keep]
        done = step
        if i is not None and not len(i):
            break
    return np.array([i, j])


def forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with edges (u, v)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        path = []
        while root.setdefault(x, x) != x:
            path.append(x)
            x = root[x]
        for p in path:
            root[p] = x
        return x

    out = []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _tiles(classes: DataFrame, dims: int, axes: np.ndarray) -> DataFrame:
    """One row a tile: label, tile, ids, copies, the vectors (double, row by row) and the box of their leading coordinates.

    Cells of a grid over the first two coordinates are cut into tiles of about TILE vectors along the
    third, and by a hash where CUTS ranges of that are not enough, so that a crowded cell is many tiles and never one.
    """

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(_lists(batch.column(3)), np.float64)
                y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes
                cells = [pa.array(np.floor(y[:, k] / CELL).astype(np.int64) if k < dims else np.zeros(len(y), np.int64)) for k in (0, 1)]
                third = pa.array(y[:, 2] if dims > 2 else np.zeros(len(y)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *cells, third], ["label", "id", "copies", "x", "c0", "c1", "y2"])

    schema = f"label {classes.schema['label'].dataType.simpleString()}, id long, copies long, x array<double>, c0 long, c1 long, y2 double"
    turned = stored(classes.select("label", "id", "copies", "x").mapInArrow(turn, schema), "tiles-turned")
    cells = turned.groupBy("label", "c0", "c1").agg(F.ceil(F.count("*") / TILE).alias("parts"), F.percentile_approx("y2", [k / CUTS for k in range(1, CUTS)], 10 * CUTS).alias("cuts"))
    # Of n parts, the vector's range of the third coordinate has n / CUTS, the hash tells which; below CUTS parts, several ranges share one.
    at = F.size(F.filter("cuts", lambda c: c < F.col("y2")))
    each = F.greatest(F.lit(1), F.ceil(F.col("parts") / CUTS))
    dealt = turned.join(cells, ["label", "c0", "c1"]).withColumn("part", F.floor(at * F.least("parts", F.lit(CUTS)) / CUTS) * each + F.pmod(F.xxhash64("id"), each)).drop("y2", "cuts")

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, x = table["id"].to_numpy(), np.array(_lists(table["x"].chunk(0)), np.float64)
        order = np.argsort(ids)
        y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes[:, :BOX]
        cell = ":".join(str(key[k].as_py()) for k in (1, 2, 3))
        blobs = [pa.array([v.tobytes()], pa.binary()) for v in (ids[order], table["copies"].to_numpy()[order], x[order])]
        boxes = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (y.min(axis=0), y.max(axis=0))]
        keys = [pa.array([key[k].as_py()], key[k].type) for k in (0, 1, 2)]
        return pa.Table.from_arrays([keys[0], pa.array([cell]), *keys[1:], *blobs, *boxes], ["label", "tile", "c0", "c1", "ids", "copies", "x", "lo", "hi"])

    kind = classes.schema["label"].dataType.simpleString()
    packed = dealt.groupBy("label", "c0", "c1", "part").applyInArrow(pack, f"label {kind}, tile string, c0 long, c1 long, ids binary, copies binary, x binary, lo array<double>, hi array<double>")
    return stored(packed, "tiles")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", threshold: float = THRESHOLD) -> DataFrame:
    """key, n_links, component_id, kept for each vector, linked by cosine >= threshold within equal labels.

    Null labels, null or empty vectors, zero vectors and vectors with null or
    non-finite components link with nothing: n_links 0, their own component.
    Vectors of another length than the most of their table's first are compared
    with those of their own length only. Repeated rows are links of each other.
    An empty table gives an empty result; extra columns are dropped.
    """
    spark = vectors.sparkSession
    x = F.col("x")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    given = vectors.select(vectors[key].alias("id"), (vectors[label] if label else F.lit(0)).alias("label"), vectors[vector].cast("array<double>").alias("x"))
    given = given.withColumn("good", F.coalesce(good & F.col("label").isNotNull(), F.lit(False)))
    hashed = given.withColumn("cid", F.when(F.col("good"), F.xxhash64("label", "x")))
    classes = hashed.filter("good").groupBy("cid").agg(F.min("label").alias("label"), F.count("*").alias("copies"), F.min("id").alias("least"), F.min("x").alias("x"))
    classes = stored(classes.select("label", F.col("cid").alias("id"), "copies", "least", "x"), "vector-classes")
    lengths = classes.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).filter("n > 1")
    few = lengths.filter(F.col("n") <= FEW).select("d")
    parts = [_compare_few(classes.withColumn("d", F.size("x")).join(few, "d", "left_semi"), threshold)]
    parts += [_compare(classes.filter(F.size("x") == row["d"]), row["d"], threshold) for row in lengths.filter(F.col("n") > FEW).orderBy("d").collect()]
    with batch_rows(spark, 16):
        path = scratch_dir(spark, "vector-links")
        for part in parts:  # one after the other, so that plans stay small
            part.write.mode("append").parquet(path)
        linked = spark.read.schema(parts[0].schema).parquet(path)
    roots = components(linked.filter("u is not null").select("u", "v"), "vectors").withColumnRenamed("node", "id")
    counts = linked.filter("id is not null").groupBy("id").agg(F.sum("links").alias("links"))
    labelled = classes.select("id", "copies", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component"))
    result = labelled.join(smallest, "root").join(counts, "id", "left").select(F.col("id").alias("cid"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    out = hashed.select("id", "cid").join(result, "cid", "left").select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _links(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, turned: np.ndarray, ids2: np.ndarray, copies2: np.ndarray, x2: np.ndarray, turned2: np.ndarray, same: bool, threshold: float) -> pa.RecordBatch | None:
    """Links between two sets of vectors (`turned`: of unit length, by any orthonormal axes): link counts and forest edges."""
    i, j = reaching(turned, turned2, threshold)
    if same:
        i, j = i[i < j], j[i < j]
    cosine = np.einsum("nd,nd->n", x[i], x2[j]) / (np.sqrt(np.einsum("nd,nd->n", x[i], x[i])) * np.sqrt(np.einsum("nd,nd->n", x2[j], x2[j])))
    i, j = i[cosine >= threshold], j[cosine >= threshold]
    if not len(i):
        return None
    links, links2 = np.bincount(i, copies2[j], len(ids)).astype(np.int64), np.bincount(j, copies[i], len(ids2)).astype(np.int64)
    edges = forest(ids[i], ids2[j])
    nodes = np.concatenate([ids[links > 0], ids2[links2 > 0]])
    n, m = len(nodes), len(edges)
    none, some = np.ones, np.zeros
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.append(nodes, np.zeros(m, np.int64)), mask=np.append(some(n, bool), none(m, bool))),
            pa.array(np.concatenate([links[links > 0], links2[links2 > 0], np.zeros(m, np.int64)]), mask=np.append(some(n, bool), none(m, bool))),
            *(pa.array(np.append(np.zeros(n, np.int64), np.array([e[c] for e in edges], np.int64)), mask=np.append(none(n, bool), some(m, bool))) for c in (0, 1)),
        ],
        ["id", "links", "u", "v"],
    )


def _compare_few(classes: DataFrame, threshold: float) -> DataFrame:
    """`_compare` for lengths of few vectors each (column d), all lengths in one pass: every pair of a label and length."""

    def run(table: pa.Table) -> pa.Table:
        ids, copies, x = table["id"].to_numpy(), table["copies"].to_numpy(), np.array(table["x"].to_pylist(), np.float64)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        found = _links(ids, copies, x, unit, ids, copies, x, unit, True, threshold)
        kinds = pa.schema([(c, pa.int64()) for c in ("id", "links", "u", "v")])
        return kinds.empty_table() if found is None else pa.Table.from_batches([found])

    return classes.select("label", "d", "id", "copies", "x").groupBy("label", "d").applyInArrow(run, "id long, links long, u long, v long")


def _compare(classes: DataFrame, dims: int, threshold: float) -> DataFrame:
    """Rows (id, links, null, null) with partial link counts and (null, null, u, v) with forest edges."""
    axes = principal_axes(classes, dims)
    tiles = _tiles(classes, dims, axes)
    # A link spans at most sqrt(2 - 2t) in any coordinate, so it joins cells at most `reach` apart.
    span = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    reach = int(np.ceil(span / CELL))
    boxes = tiles.select("label", "tile", "c0", "c1", "lo", "hi")
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    left = boxes.withColumn("d0", F.explode(steps)).withColumn("d1", F.explode(steps)).withColumns({"j0": F.col("c0") + F.col("d0"), "j1": F.col("c1") + F.col("d1")})
    right = boxes.select(F.col("label").alias("label2"), F.col("tile").alias("tile2"), F.col("c0").alias("j0"), F.col("c1").alias("j1"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    gap = F.aggregate(F.zip_with(F.zip_with("lo", "hi2", lambda a, b: a - b), F.zip_with("lo2", "hi", lambda a, b: a - b), lambda p, q: F.greatest(p, q, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v * v)
    near = left.join(right, ["j0", "j1"]).filter((F.col("label") == F.col("label2")) & (F.col("tile") <= F.col("tile2")) & (gap <= span * span)).select("label", "tile", "tile2")
    body = tiles.select("label", "tile", "ids", "copies", "x")
    pairs = near.join(body, ["label", "tile"]).join(body.select("label", F.col("tile").alias("tile2"), F.col("ids").alias("ids2"), F.col("copies").alias("copies2"), F.col("x").alias("x2")), ["label", "tile2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same, *data = (batch.column(c)[k].as_py() for c in range(7))
                ids, copies, ids2, copies2 = (np.frombuffer(data[c], np.int64) for c in (0, 1, 3, 4))
                x, x2 = (np.frombuffer(data[c]).reshape(-1, dims) for c in (2, 5))
                unit, unit2 = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, x2))
                found = _links(ids, copies, x, unit @ axes, ids2, copies2, x2, unit2 @ axes, same, threshold)
                if found is not None:
                    yield found

    chosen = pairs.select((F.col("tile") == F.col("tile2")).alias("same"), "ids", "copies", "x", "ids2", "copies2", "x2")
    return chosen.mapInArrow(run, "id long, links long, u long, v long")


def op3_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
