"""Sequence packing by non-negative least squares (operator 10).

Documents become ids plus one end id and are cut into full windows and a
remainder. The remainders' length histogram (a table of at most `window`
rows) goes to the driver, where shallow combinations of up to three length
bins that fill a window are enumerated and their repeat counts solved by
non-negative least squares. Blocks of a bounded number of pieces then carry
out their share of the rounded plan, and pack what it leaves by best fit,
longest first.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .bpe_tree import vocabulary_path
from .pretok import PieceTable
from .textblocks import chunks, column, small_batches, stored

WINDOW, END_ID, DEFAULT_VOCABULARY = 2048, 1, "byte_bpe_50k.json"
#: Lengths are planned in bins of this many tokens (rounded up), so a planned sequence wastes under BIN a piece.
BIN = 8
#: Pieces a block holds about; a block is packed in one task.
BLOCK_PIECES = 1 << 16

_tables: dict[str, PieceTable] = {}


#: Stands between pieces that are encoded in one call; pieces that hold it go one by one.
_BETWEEN, _JOINED = "\0", 64


def _table(path: str) -> PieceTable:
    if path not in _tables:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        whole, joined = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for tokenizer in (whole, joined):
            tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # The pieces are given, so they are only parted again and turned to bytes.
        joined.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(_BETWEEN, "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        (between,) = whole.encode(_BETWEEN, add_special_tokens=False).ids

        def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            texts = [p.decode() for p in pieces]
            odd = [k for k, t in enumerate(texts) if _BETWEEN in t]
            if odd:
                each = [x.ids for x in whole.encode_batch_fast(texts, add_special_tokens=False)]
                sizes = np.array([len(x) for x in each], np.int64)
                return np.array([i for x in each for i in x], np.uint32), sizes
            parts = [_BETWEEN.join([*texts[k : k + _JOINED], ""]) for k in range(0, len(texts), _JOINED)]
            ids = np.fromiter(chain.from_iterable(x.ids for x in joined.encode_batch_fast(parts, add_special_tokens=False)), np.uint32)
            ends = np.flatnonzero(ids == between)
            return ids[ids != between], np.diff(np.append(-1, ends)) - 1

        _tables[path] = PieceTable(encode)
    return _tables[path]


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """Cut each document's ids into windows: key, start, length, ids_crc32, doc_tokens.

    Null text counts as empty, which is the end id alone. Repeated rows stay repeated.
    """
    path = vocabulary or vocabulary_path(DEFAULT_VOCABULARY)
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        end = np.array([END_ID], "<u4")
        for batch in batches:
            for i, j, buf, offsets in chunks(column(batch, "t")):
                ids, first = table.tokens(buf, offsets)
                row, start, length, crc, total = [], [], [], [], []
                for k in range(j - i):
                    own = np.append(ids[first[k] : first[k + 1]], end).astype("<u4")
                    for a in range(0, len(own), window):
                        part = own[a : a + window]
                        row.append(i + k)
                        start.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        total.append(len(own))
                keys = batch.column(0).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["k", "start", "length", "crc", "total"])

    out = docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, start long, length long, crc long, total long")
    return out.toDF(key, "start", "length", "ids_crc32", "doc_tokens")


def combinations(units: int) -> list[tuple[int, ...]]:
    """Ascending tuples of one to three positive bins that sum to `units`."""
    out = [(units,)]
    out += [(a, units - a) for a in range(1, units // 2 + 1)]
    out += [(a, b, units - a - b) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]
    return out


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Lawson-Hanson active-set non-negative least squares."""
    n = matrix.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(target).max()))
    for _ in range(rounds):
        gradient = matrix.T @ (target - matrix @ x)
        gradient[passive] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= 1e-7 * scale:
            break
        passive[best] = True
        while True:
            at = np.flatnonzero(passive)
            part = matrix[:, at]
            solution = np.linalg.solve(part.T @ part + 1e-10 * np.eye(len(at)), part.T @ target)
            if (solution > 0).all():
                x[:] = 0
                x[at] = solution
                break
            bad = solution <= 0
            old = x[at]
            step = float((old[bad] / np.maximum(old[bad] - solution[bad], 1e-300)).min())
            moved = old + step * (solution - old)
            moved[bad & (moved <= 1e-12 * scale)] = 0
            x[:] = 0
            x[at] = moved
            passive[at[moved <= 0]] = False
            if not passive.any():
                break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, bin_size: int = BIN) -> list[tuple[tuple[int, ...], float]]:
    """Combinations of bins and how often each is to be filled, most frequent first.

    Short bins weigh little in the residual: what is left of them is easily packed greedily.
    """
    units = window // bin_size
    counts = np.zeros(units + 1)
    for length, n in histogram.items():
        counts[-(-length // bin_size)] += n
    combos = [c for c in combinations(units) if all(counts[b] for b in c)]
    if not combos:
        return []
    matrix = np.zeros((units + 1, len(combos)))
    for k, combo in enumerate(combos):
        for b in combo:
            matrix[b, k] += 1
    weight = np.where(np.arange(units + 1) < units // 8, 0.1, 1.0)
    used = counts > 0
    x = nnls((matrix * weight[:, None])[used], (counts * weight)[used])
    return sorted(((combos[k], float(x[k])) for k in np.flatnonzero(x > 0)), key=lambda p: (-p[1], p[0]))


def pack_block(lengths: np.ndarray, plan_: list[tuple[tuple[int, ...], float]], share: float, window: int = WINDOW, bin_size: int = BIN) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece of one block, and the number of sequences."""
    n = len(lengths)
    sequence, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    fill: list[int] = []

    def put(piece: int, seq: int) -> None:
        sequence[piece], offset[piece] = seq, fill[seq]
        fill[seq] += int(lengths[piece])

    for piece in np.flatnonzero(lengths == window).tolist():
        fill.append(0)
        put(piece, len(fill) - 1)
    stock: dict[int, list[int]] = {}
    rest = np.flatnonzero(lengths < window)
    order = rest[np.argsort(-lengths[rest], kind="stable")]
    for piece, b in zip(order.tolist(), (-(-lengths[order] // bin_size)).tolist(), strict=True):
        stock.setdefault(b, []).append(piece)
    for combo, repeats in plan_:
        need = {b: combo.count(b) for b in combo}
        times = min([int(repeats * share + 0.5), *(len(stock.get(b, ())) // k for b, k in need.items())])
        for _ in range(times):
            fill.append(0)
            for b in combo:
                put(stock[b].pop(), len(fill) - 1)
    spaces: dict[int, list[int]] = {}
    mask = 0
    for seq, used in enumerate(fill):
        if used < window:
            spaces.setdefault(window - used, []).append(seq)
            mask |= 1 << (window - used)
    for piece in [p for p in order.tolist() if sequence[p] < 0]:
        size = int(lengths[piece])
        fitting = mask >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            seq = spaces[space].pop()
            if not spaces[space]:
                mask &= ~(1 << space)
        else:
            seq, space = len(fill), window
            fill.append(0)
        put(piece, seq)
        if space > size:
            spaces.setdefault(space - size, []).append(seq)
            mask |= 1 << (space - size)
    return sequence, offset, len(fill)


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, window: int = WINDOW, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Pack all documents into sequences of at most `window` ids.

    One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. Pieces of one sequence lie gapless from offset 0. Null and empty
    texts are one piece of the end id; repeated rows are packed as often as
    they come; an empty table gives no rows; extra columns are dropped.
    """
    # The serial number, fixed by writing it, deals repeated rows to all blocks.
    cut = stored(pieces(docs, text, key, vocabulary, window).withColumn("serial", F.monotonically_increasing_id()), "packing-pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    total = sum(histogram.values())
    histogram.pop(window, None)
    plan_ = plan(histogram, window)
    blocks = max(1, round(total / block_pieces))
    kind = docs.schema[key].dataType.simpleString()
    rest_total = max(1, sum(histogram.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        block = pa.Table.from_batches(got).sort_by([("start", "ascending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending"), ("k", "ascending")])
        lengths = block["length"].to_numpy()
        sequence, offset, _ = pack_block(lengths, plan_, float((lengths < window).sum()) / rest_total, window)
        ids = sequence + (TaskContext.get().partitionId() << 32)
        yield from block.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset)).combine_chunks().to_batches(max_chunksize=50_000)

    schema = f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    dealt = cut.withColumnRenamed(key, "k").repartition(blocks, F.xxhash64("serial")).drop("serial")
    return dealt.mapInArrow(run, schema).withColumnRenamed("k", key)


def op10_packing_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
