"""Near-duplicate documents by min-max hashing (operator 5).

Each permutation of the shingle hashes yields two signature values, the
minimum and the maximum, so 144 evaluations a shingle give 288 values. A band
joins both values of three permutations: documents of Jaccard J share one with
probability J**6, and 48 bands miss a pair of J = 0.8 with probability below
1e-6. Nothing else filters pairs: every two texts that share a band are
compared on their full shingle sets, or are known to be connected.

Only connectivity is asked for, so pairs are not enumerated. Equal sets
collapse to one class. The most connected member of a band's bucket is its
pivot, and all buckets of one pivot form a cell, which holds each of its
classes once however many bands they share. A cell is dealt to tiles of
bounded size with the pivot's text in each; a tile compares its members with
the pivot and then only those that the pivot does not link with the others.
Where a cell has several tiles, its members outside the component that most of
it belongs to are then compared with the cell's other tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .components import components
from .textblocks import _MULTIPLIERS, chunks, column, discard, hash_bitmap, hash_spans, in_bitmap, mix, small_batches, stored, windows, word_spans

BANDS, PERMUTATIONS_A_BAND = 48, 3
WIDTH, PERCENT = 4, 80
#: Shingles in a tile about (one text may have more).
TILE = 1 << 20
_rng = np.random.Generator(np.random.PCG64(515))
_A = _rng.integers(1, 2**63, BANDS * PERMUTATIONS_A_BAND, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 2**63, BANDS * PERMUTATIONS_A_BAND, dtype=np.uint64)
_C = _rng.integers(1, 2**63, 2 * PERMUTATIONS_A_BAND, dtype=np.uint64) | np.uint64(1)


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row with fewer words is one shingle, one without words has none."""
    starts, ends, first = word_spans(buf, offsets)
    words = hash_spans(buf, starts, ends, lower=True)
    hashes, at = windows(words, first, width)
    bounds = np.searchsorted(at, first)
    out = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for row in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < width)):
        own = words[first[row] : first[row + 1]]
        out[row] = mix((own * _MULTIPLIERS[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))
    return out


def signature(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of each non-empty set under each permutation: two (permutations, sets) arrays."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.cumsum([0, *map(len, sets[:-1])]) if sets else np.zeros(0, int)
    low, high = (np.zeros((len(_A), len(sets)), np.uint64) for _ in range(2))
    if len(flat):
        for k in range(len(_A)):
            v = flat * _A[k] + _B[k]
            low[k], high[k] = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
    return low, high


def estimate(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Unbiased estimate of the Jaccard similarity from min-max signatures, column by column."""
    return ((a[0] == b[0]).mean(axis=0) + (a[1] == b[1]).mean(axis=0)) / 2


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit key a band and set: (sets, bands)."""
    both = np.concatenate([low.reshape(BANDS, PERMUTATIONS_A_BAND, -1), high.reshape(BANDS, PERMUTATIONS_A_BAND, -1)], axis=1)
    return mix((both * _C[None, :, None]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)).T


def sketches(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """doc, text_hash, n (set size), cid (hash of the set; null for an empty set), bands."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in chunks(column(batch, "t")):
                sets = shingles(buf, offsets, width)
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                chosen = [sets[k] for k in full]
                cid, keys = np.zeros(len(sets), np.int64), np.zeros((0, BANDS), np.int64)
                if len(full):
                    starts = np.cumsum([0, *map(len, chosen[:-1])])
                    cid[full] = mix(np.add.reduceat(mix(np.concatenate(chosen)), starts) + size[full].astype(np.uint64)).view(np.int64)
                    keys = band_keys(*signature(chosen)).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]), pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(size), pa.array(cid, mask=size == 0), bands], ["doc", "text_hash", "n", "cid", "bands"])

    picked = docs.select(docs[key].alias("doc"), docs[text].alias("t"), F.xxhash64(docs[text]).alias("h"))
    return picked.mapInArrow(run, f"doc {kind}, text_hash long, n long, cid long, bands array<long>")


def _similar(common: np.ndarray, n: np.ndarray, m: int, percent: int) -> np.ndarray:
    return 100 * common >= percent * (n + m - common)


class Sets:
    """Shingle sets laid end to end, to be compared with one set at a time."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.starts = np.cumsum(self.size) - self.size
        self.known, self.index = np.unique(np.concatenate(sets), return_inverse=True)
        self._mark = np.zeros(len(self.known), np.int64)

    def similar(self, own: np.ndarray, percent: int) -> np.ndarray:
        """Whether each set is as similar to `own` (distinct hashes, in order)."""
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        at = at[self.known[at] == own]
        self._mark[at] = 1
        common = np.add.reduceat(self._mark[self.index], self.starts)
        self._mark[at] = 0
        return _similar(common, self.size, len(own), percent)


def tile_links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges that connect all linked sets of a tile whose first set is the pivot."""
    if len(sets) < 2:
        return []
    if len(sets) == 2:
        common = np.array([len(np.intersect1d(*sets, assume_unique=True))])
        return [(0, 1)] if _similar(common, np.array([len(sets[0])]), len(sets[1]), percent)[0] else []
    every = Sets(sets)
    root = np.arange(len(sets))
    near = every.similar(sets[0], percent)
    root[near] = 0
    edges = [(0, k) for k in np.flatnonzero(near).tolist() if k]
    for k in np.flatnonzero(~near).tolist():
        if not (root != root[k]).any():
            continue
        linked = np.flatnonzero(every.similar(sets[k], percent) & (root != root[k]))
        roots, first = np.unique(root[linked], return_index=True)
        for r, i in zip(roots.tolist(), linked[first].tolist(), strict=True):
            edges.append((k, i))
            root[root == r] = root[k]
    return edges


def _edges(u: list[int], v: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], width: int) -> Iterator[tuple[tuple, list[int], list[int], list[np.ndarray]]]:
    """(key, roles, cids, sets) of each run of equal keys; rows come sorted by key and role."""
    held, roles, cids, sets = None, [], [], []
    for batch in batches:
        names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        role, cid = batch.column("role").to_pylist(), batch.column("cid").to_pylist()
        for i, _, buf, offsets in chunks(column(batch, "t")):
            for k, own in enumerate(shingles(buf, offsets, width), i):
                if names[k] != held:
                    if sets:
                        yield held, roles, cids, sets
                    held, roles, cids, sets = names[k], [], [], []
                roles.append(role[k])
                cids.append(cid[k])
                sets.append(own)
    if sets:
        yield held, roles, cids, sets


def _within_tiles(rows: DataFrame, parts: int, width: int, percent: int) -> DataFrame:
    """Edges (u, v) among the texts of each tile: rows cid, pivot, salt, role (0: the pivot itself), t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, cids, sets in _groups(batches, ["pivot", "salt"], width):
            found = tile_links(sets, percent)
            if found:
                yield _edges([cids[a] for a, _ in found], [cids[b] for _, b in found])

    small_batches(rows.sparkSession)
    dealt = rows.select("cid", "pivot", "salt", "role", "t").repartition(parts, "pivot", "salt").sortWithinPartitions("pivot", "salt", "role")
    return dealt.mapInArrow(run, "u long, v long")


def _across_tiles(rows: DataFrame, parts: int, width: int, percent: int) -> DataFrame:
    """Edges between the members of role 0 and of role 1 in each (pivot, part, salt); the first are held, the second stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left, ids, every = None, [], [], None
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in ("pivot", "part", "salt")), strict=True))
            role, cid = batch.column("role").to_pylist(), batch.column("cid").to_pylist()
            u, v = [], []
            for i, _, buf, offsets in chunks(column(batch, "t")):
                for k, own in enumerate(shingles(buf, offsets, width), i):
                    if names[k] != held:
                        held, left, ids, every = names[k], [], [], None
                    if role[k] == 0:
                        left.append(own)
                        ids.append(cid[k])
                    elif left:
                        every = every or Sets(left)
                        for m in np.flatnonzero(every.similar(own, percent)).tolist():
                            u.append(ids[m])
                            v.append(cid[k])
            yield _edges(u, v)

    small_batches(rows.sparkSession)
    dealt = rows.select("cid", "pivot", "part", "salt", "role", "t").repartition(parts, "pivot", "part", "salt").sortWithinPartitions("pivot", "part", "salt", "role")
    return dealt.mapInArrow(run, "u long, v long")


def linked_classes(docs: DataFrame, text: str, key: str, width: int, percent: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """(sketch rows: doc, text_hash, n, cid, bands; links: cid, root of every class linked with another)."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    sketch = stored(sketches(docs, text, key, width), "minhash-sketch")
    classes = stored(sketch.filter("cid is not null").groupBy("cid").agg(F.min("text_hash").alias("text_hash"), F.max("n").alias("n"), F.first("bands").alias("bands")), "minhash-classes")
    rows = classes.select("cid", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    member = stored(rows.join(shared, "band"), "minhash-members")  # buckets of several classes
    weight = member.groupBy("cid").agg(F.sum("size").alias("weight"))
    pivot = member.join(weight, "cid").groupBy("band").agg(F.max(F.struct("weight", "cid")).alias("top")).select("band", F.col("top.cid").alias("pivot"))
    cell = stored(member.join(pivot, "band").select("cid", "pivot").distinct(), "minhash-cells")
    discard(member)
    known = stored(classes.join(cell.select("cid").distinct(), "cid", "left_semi").select("cid", "text_hash", "n"), "minhash-known")
    discard(classes)

    # One text of each class in a cell: a bounded bitmap keeps most other texts out of the shuffle, the join is exact.
    bitmap = hash_bitmap(known.select("text_hash"), "minhash-bitmap")
    whole = in_bitmap(docs.select(docs[text].alias("t"), F.xxhash64(docs[text]).alias("text_hash")), "text_hash", bitmap).filter("_may")
    texts = stored(whole.groupBy("text_hash").agg(F.first("t").alias("t")).join(known, "text_hash").select("cid", "t"), "minhash-texts")
    discard(bitmap)

    sized = cell.join(known.select("cid", "n"), "cid")
    tiles = stored(sized.groupBy("pivot").agg(F.ceil(F.sum("n") / tile).cast("long").alias("tiles")), "minhash-tiles")  # written first, so that a hot cell's rows can be split in the join
    dealt = stored(sized.join(tiles, "pivot").withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("tiles"))), "minhash-dealt")
    heads = tiles.select(F.col("pivot").alias("cid"), "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("salt"), F.lit(0).alias("role"))
    rest = dealt.filter("cid <> pivot").select("cid", "pivot", "salt", F.lit(1).alias("role"))
    edges = stored(_within_tiles(texts.join(rest.unionByName(heads), "cid"), parts, width, percent), "minhash-edges")
    roots = components(edges, "minhash").withColumnRenamed("node", "cid")

    several = dealt.filter("tiles > 1")
    if not several.isEmpty():
        several = stored(several.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "minhash-several")
        most = several.groupBy("pivot", "root").agg(F.count("*").alias("c")).groupBy("pivot").agg(F.max(F.struct("c", "root")).alias("top")).select("pivot", F.col("top.root").alias("most"))
        apart = several.join(most, "pivot").filter("root <> most")
        deals = apart.groupBy("pivot").agg(F.ceil(F.sum("n") / tile).cast("long").alias("deals"))
        salts, shares = (F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)) for c in ("tiles", "deals"))
        left = apart.join(deals, "pivot").select("cid", "pivot", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("deals")).alias("part"), salts.alias("salt"), F.lit(0).alias("role"))
        right = several.join(deals, "pivot").select("cid", "pivot", shares.alias("part"), "salt", F.lit(1).alias("role"))
        more = _across_tiles(texts.join(left.unionByName(right), "cid"), parts, width, percent)
        edges = stored(edges.union(more.filter("u <> v")), "minhash-all-edges")
        roots = components(edges, "minhash-all").withColumnRenamed("node", "cid")
    discard(texts, cell, known, dealt, tiles)
    return sketch, roots


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """key, n_shingles, component_id, kept: the near-duplicate class of every document.

    Null texts and texts without words have an empty set and link with nothing.
    Fewer words than `width` count as one shingle. Equal sets always link.
    component_id is the smallest key reachable by links; rows that repeat a key
    share their class's result. An empty table gives an empty result; extra
    columns are dropped. A null key gets the component of its class, or null
    where it is alone.
    """
    sketch, roots = linked_classes(docs, text, key, width, percent, tile)
    least = sketch.filter("cid is not null").groupBy("cid").agg(F.min("doc").alias("least"))
    linked = least.join(roots, "cid")
    component = linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("cid", "component")
    # Written first, so that the join below reads two plain shuffles and the rows of one hot set can be split.
    label = stored(least.join(component, "cid", "left").select("cid", F.coalesce("component", "least").alias("component")), "minhash-label")
    out = sketch.select("doc", "n", "cid").join(label, "cid", "left").withColumn("component", F.coalesce("component", "doc"))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc").eqNullSafe(F.col("component")).alias("kept"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """`docs` with one row of each near-duplicate class, all its columns unchanged.

    The row of the smallest key stays (of equal keys that of the smallest text
    hash, of repeated rows one); a null key stays only where its class has no
    other. Texts without words, null ones included, link with nothing and all
    stay. An empty table gives an empty result.
    """
    sketch, roots = linked_classes(docs, text, key, width, percent, tile)
    named = F.concat_ws(":", F.coalesce(F.col("doc").cast("string"), F.lit("-")), F.col("doc").isNull().cast("string"), F.col("text_hash").cast("string"))
    rows = sketch.filter("cid is not null").select("cid", "doc", "text_hash").join(roots, "cid", "left").select(F.coalesce("root", "cid").alias("root"), "doc", "text_hash", named.alias("_k"))
    groups = rows.groupBy("root").agg(F.count("*").alias("rows"), F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "text_hash", "_k")).alias("top")).filter("rows > 1")
    groups = stored(groups.select("root", F.col("top._k").alias("best")), "minhash-groups")  # written first, so that a hot group's rows can be split in the join
    # Rows of groups of several: whether they are the one that stays.
    judged = stored(rows.join(groups, "root").select("_k", "text_hash", (F.col("_k") == F.col("best")).alias("stays")).distinct(), "minhash-judged")
    bitmap = hash_bitmap(judged.select("text_hash"), "minhash-judged-bitmap")
    own_key = F.concat_ws(":", F.coalesce(docs[key].cast("string"), F.lit("-")), docs[key].isNull().cast("string"), F.xxhash64(docs[text]).cast("string"))
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), own_key.alias("_k"), F.xxhash64(docs[text]).alias("text_hash"))
    whole = in_bitmap(own, "text_hash", bitmap)
    found = whole.filter("_may").join(judged.select("_k", "stays"), "_k", "left")
    stay = [whole.filter("not _may"), found.filter("stays is null"), found.filter("stays").dropDuplicates(["_k"])]
    free, unjudged, best = (x.select("row.*") for x in stay)
    return free.unionAll(unjudged).unionAll(best)


def op5_minmax_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows for `documents`, by `near_duplicates` with four-word shingles and a similarity of 0.8."""
    return near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
