"""Language-model scoring with an Elias-Fano n-gram trie (operator 9).

A model of any order from two (ORDER in the query) with modified discounts,
each order interpolated with the next lower one and the bigrams with add-one
unigrams. Documents are gathered into blocks of bounded text. Each block asks
each shard for its distinct words and n-grams, with its own training counts; a
shard sums those, builds its part of the trie and answers the same requests
from it by successor search among a context's continuations. An n-gram lies in
the shard of its first word, so every level of a path is in one trie, and the
position of a node is the pointer to its range in the next level. Nothing is
broadcast but the at most HOT words so frequent that their continuations are
dealt to several shards. Discounts are parameters, so a score does not depend
on how many shards there are. A successor is known by 32 bits of its word's
hash among the successors of one context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .eliasfano import TrieShard
from .textblocks import batch_rows, chunks, column, crc_remainder, give_back, hash_spans, mix, small_batches, stored, word_spans

ORDER = 3
BLOCK_BYTES = 8 << 20
#: Training tokens a shard holds about.
SHARD_TOKENS = 1_000_000
SUCCESSOR_BYTES = 4
_SHIFT = np.uint64(64 - 8 * SUCCESSOR_BYTES)
#: What is taken from counts of 1, 2 and 3 or more (0: nothing) and given to the next lower order.
DISCOUNTS = (0.0, 0.5, 0.75, 0.9)
#: Contexts with a larger share of the tokens than 1 / HOT (so at most HOT of them) are dealt by successor too, SALTS ways.
HOT, SALTS = 1000, 64
END, START = (mix(np.array([k], np.uint64))[0] for k in (0xE2D, 0x57A27))
#: Codes of quantised log10 probabilities: 1 to 255 for 0 to -8.5; 0 stands for none.
STEP = 8.5 / 254


def quantise(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, 1 + np.clip(np.rint(-np.log10(np.maximum(p, 1e-30)) / STEP), 0, 254), 0).astype(np.uint8)


def restored(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (-(code.astype(np.float64) - 1) * STEP), 0.0)


_zstd: list = []


def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    if not _zstd:
        _zstd.extend((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    return _zstd[0], _zstd[1]


def _bytes(x: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of each number, byte by byte."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _numbers(data: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :size] = raw.T
    return out.view("<u8").ravel()


def _planes(x: np.ndarray, size: int) -> bytes:
    """`_bytes`, compressed: rare high bytes take no room."""
    return _codec()[0].compress(_bytes(x, size))


def _unplaned(data: bytes, size: int) -> np.ndarray:
    return _numbers(_codec()[1].decompress(data), size)


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (mix(key + np.uint64(0x51)) % np.uint64(shards)).astype(np.int64)


class Block:
    """Documents of a block as token ids over the block's own words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, train: np.ndarray):
        self.words, self.counts, self.tokens, self.sizes, self.train = words, counts, tokens, sizes, train

    @classmethod
    def build(cls, hashes: np.ndarray, sizes: np.ndarray, train: np.ndarray) -> Block:
        words, inverse = np.unique(hashes, return_inverse=True)
        rank = np.argsort(-np.bincount(inverse, minlength=len(words)), kind="stable")
        place = np.empty(len(words), np.int64)
        place[rank] = np.arange(len(words))
        tokens = place[inverse]
        return cls(words[rank], np.bincount(tokens[np.repeat(train, sizes)], minlength=len(words)), tokens, sizes, train)

    def ordered_words(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Word ids by (shard, hash), and their shards."""
        shard = _shard(self.words, shards)
        order = np.lexsort((self.words, shard))
        return order, shard[order]

    def grams(self, order: int, shards: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]:
        """Context hash and shard of each distinct bigram, and for each order from two (parent, short successor, training count, each token's n-gram or -1).

        Bigrams are sorted by (shard, context, successor), longer n-grams by
        (parent, successor), where the parent is the place of the n-gram
        without its last word. A document's start is one word of context.
        """
        first = np.cumsum(self.sizes) - self.sizes
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[first[self.sizes > 0]] = len(self.words)
        weights = np.repeat(self.train, self.sizes)
        pairs, inverse = np.unique(before << 32 | self.tokens, return_inverse=True)
        count = np.bincount(inverse, weights=weights, minlength=len(pairs)).astype(np.int64)
        hashes = np.append(self.words, START)
        context, successor = hashes[pairs >> 32], hashes[pairs & 0xFFFFFFFF]
        salted = np.isin(context, hot)
        shard = _shard(context + np.where(salted, (successor % np.uint64(SALTS) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0)), shards)
        short = successor >> _SHIFT
        sort = np.lexsort((short, context, shard))
        place = np.empty(len(sort), np.int64)
        place[sort] = np.arange(len(sort))
        levels = [(np.zeros(0, np.int64), short[sort], count[sort], place[inverse])]
        depth = np.arange(len(self.tokens)) - np.repeat(first, self.sizes)
        short = self.words >> _SHIFT
        by_short = np.argsort(short, kind="stable")
        rank = np.empty(len(short), np.int64)
        rank[by_short] = np.arange(len(short))
        for k in range(3, order + 1):
            own = np.flatnonzero(depth >= k - 2)
            longer, inverse = np.unique(levels[-1][3][own - 1] << 32 | rank[self.tokens[own]], return_inverse=True)
            count = np.bincount(inverse, weights=weights[own], minlength=len(longer)).astype(np.int64)
            at = np.full(len(self.tokens), -1)
            at[own] = inverse
            levels.append((longer >> 32, short[by_short[longer & 0xFFFFFFFF]], count, at))
        return context[sort], shard[sort], levels


def blocks(docs: DataFrame, text: str, key: str, train: str) -> DataFrame:
    """One row a block: block, ids, train, sizes, words, counts, tokens."""
    kind = docs.schema[key].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        size = made = 0

        def flush() -> pa.RecordBatch:
            ids, hashes, sizes, flags = (list(x) for x in zip(*held, strict=True))
            b = Block.build(np.concatenate(hashes), np.concatenate(sizes), np.concatenate(flags))
            keys = pa.concat_arrays(ids)
            blobs = [_planes(b.sizes, 4), b.train.astype(np.uint8).tobytes(), b.words.tobytes(), _planes(b.counts, 4), _planes(b.tokens, 4)]
            number = (TaskContext.get().partitionId() << 24) + made
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), *(pa.array([x], pa.binary()) for x in blobs)], ["block", "ids", "sizes", "train", "words", "counts", "tokens"])

        for batch in batches:
            flags = np.array(batch.column(2).to_pylist(), bool)
            for i, j, buf, offsets in chunks(column(batch, "t")):
                starts, ends, first = word_spans(buf, offsets)
                sizes = np.diff(first) + 1
                hashes = np.full(int(sizes.sum()), END)
                inside = np.ones(len(hashes), bool)
                inside[np.cumsum(sizes) - 1] = False
                hashes[inside] = hash_spans(buf, starts, ends, lower=True)
                held.append((batch.column(0).slice(i, j - i), hashes, sizes, flags[i:j]))
                size += len(buf) + 64 * (j - i)
                if size >= BLOCK_BYTES:
                    yield flush()
                    held, size, made = [], 0, made + 1
        if held:
            yield flush()

    picked = docs.select(docs[key].alias("k"), docs[text].alias("t"), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    schema = f"block long, ids array<{kind}>, sizes binary, train binary, words binary, counts binary, tokens binary"
    return stored(picked.mapInArrow(run, schema), "lm-blocks")


def _block(row: dict) -> Block:
    return Block(np.frombuffer(row["words"], np.uint64), _unplaned(row["counts"], 4).astype(np.int64), _unplaned(row["tokens"], 4).astype(np.int64), _unplaned(row["sizes"], 4).astype(np.int64), np.frombuffer(row["train"], np.uint8).astype(bool))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one; what Arrow holds of earlier ones is given back."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _hot(table: DataFrame, tokens: int) -> dict[int, int]:
    """Contexts of more than 1 / HOT of the training tokens, with their exact counts: at most HOT rows reach the driver.

    Blocks where a word is rarer than half that share leave it out of the first pass, so a word at the
    limit may stay unsalted; the second pass counts the found ones exactly.
    """

    def run_over(chosen: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    words, counts = np.append(np.frombuffer(row["words"], np.uint64), START), _unplaned(row["counts"], 4).astype(np.int64)
                    counts = np.append(counts, np.int64(sum(row["train"])))
                    pick = (np.isin(words, chosen) if chosen is not None else counts >= max(1, counts.sum() // (2 * HOT))) & (words != END)
                    yield pa.RecordBatch.from_arrays([pa.array(words[pick].view(np.int64)), pa.array(counts[pick])], ["w", "n"])

        return table.select("words", "counts", "train").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))

    found = run_over(None).filter(F.col("n") > tokens // HOT).toArrow()["w"].to_numpy().view(np.uint64)
    exact = run_over(found).toArrow() if len(found) else None
    return dict(zip(exact["w"].to_numpy().view(np.uint64).tolist(), exact["n"].to_numpy().tolist(), strict=True)) if exact is not None else {}


def _requests(table: DataFrame, shards: int, hot: np.ndarray, order: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                b = _block(row)
                by_shard, word_shard = b.ordered_words(shards)
                context, shard, levels = b.grams(order, shards, hot)
                wa, ba = (np.searchsorted(x, np.arange(shards + 1)) for x in (word_shard, shard))
                cuts = [ba]  # where each shard's n-grams begin, by order
                for parent, *_ in levels[1:]:
                    cuts.append(np.searchsorted(parent, cuts[-1]))
                out = []
                for s in np.flatnonzero((np.diff(wa) > 0) | (np.diff(ba) > 0)).tolist():
                    w, p = slice(wa[s], wa[s + 1]), slice(ba[s], ba[s + 1])
                    own = context[p]
                    change = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
                    spans, successors, counts = [_planes(np.diff(np.append(change, len(own))), 4)], [], []
                    for k, (parent, successor, count, _) in enumerate(levels):
                        g = slice(cuts[k][s], cuts[k][s + 1])
                        if k:
                            above = cuts[k - 1][s], cuts[k - 1][s + 1]
                            spans.append(_planes(np.bincount(parent[g] - above[0], minlength=above[1] - above[0]), 4))
                        successors.append(_bytes(successor[g], SUCCESSOR_BYTES))
                        counts.append(_planes(count[g], 4))
                    out.append((s, row["block"], b.words[by_shard[w]].tobytes(), _planes(b.counts[by_shard[w]], 4), own[change].tobytes(), spans, successors, counts))
                names = ["shard", "block", "words", "counts", "contexts", "spans", "successors", "grams"]
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3, *[pa.list_(pa.binary())] * 3]
                del b, context, shard, levels, parent, successor, count, own
                for i in range(0, len(out), 8):
                    yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out[i : i + 8]], kinds[k]) for k in range(8)], names)

    kinds = "words binary, counts binary, contexts binary, spans array<binary>, successors array<binary>, grams array<binary>"
    return table.drop("ids").mapInArrow(run, f"shard long, block long, {kinds}")


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=counts, minlength=len(unique)).astype(np.int64)


def _summed(parents: np.ndarray, successors: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (parent, successor) with a count, in order, and their counts over all blocks (whose rows come sorted)."""
    own = np.flatnonzero(counts > 0)
    key = parents[own].astype(np.uint64) << np.uint64(8 * SUCCESSOR_BYTES) | successors[own]
    order = np.argsort(key, kind="stable")
    key, n = key[order], counts[own][order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    key = key[at]
    return (key >> np.uint64(8 * SUCCESSOR_BYTES)).astype(np.int64), key & np.uint64((1 << 8 * SUCCESSOR_BYTES) - 1), np.add.reduceat(n, at) if len(at) else np.zeros(0, np.int64)


def answer(rows: list[dict], hot: dict[int, int], discounts: tuple[float, ...] = DISCOUNTS) -> tuple[list[tuple], tuple[int, int], list[tuple[int, float]]]:
    """One shard's answers (block, word counts, codes of n-grams and of their contexts by order), its (tokens, distinct words) and hot contexts' discounted mass."""
    words, totals = _sums(np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows]), np.concatenate([_unplaned(r["counts"], 4) for r in rows]))
    asked, given, masses = None, [], []
    for k in range(len(rows[0]["grams"])):
        spans = [_unplaned(r["spans"][k], 4).astype(np.int64) for r in rows]
        sizes = [int(x.sum()) for x in spans]
        successors = np.concatenate([_numbers(r["successors"][k], SUCCESSOR_BYTES) for r in rows])
        counts = np.concatenate([_unplaned(r["grams"][k], 4) for r in rows]).astype(np.int64)
        if k == 0:  # what has a range here: contexts by the rank of their hash, then the n-grams of the level above
            hashes, heads = np.unique(np.concatenate([np.frombuffer(r["contexts"], np.uint64) for r in rows]), return_inverse=True)
        else:
            heads = asked
        c, s, count = _summed(np.repeat(heads, np.concatenate(spans)), successors, counts)
        if k == 0:
            seen, bounds = np.unique(c, return_index=True)
            distinct, bounds = hashes[seen], np.append(bounds, len(c))
        else:
            bounds = np.searchsorted(c, np.arange(len(trie.codes) + 1))
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        cut = np.array(discounts)[np.minimum(count, 3)]
        total, mass = (np.bincount(owner, weights=x, minlength=len(bounds) - 1) for x in (count, cut))
        weight = mass / np.maximum(total, 1)
        if k == 0:
            is_hot = np.isin(distinct, np.array(list(hot), np.uint64))
            total[is_hot] = [hot[x] for x in distinct[is_hot].tolist()]
            weight = np.where(is_hot, 0, mass / np.maximum(total, 1))
            masses = list(zip(distinct[is_hot].tolist(), mass[is_hot].tolist(), strict=True))
        codes = quantise((count - cut) / np.maximum(total[owner], 1))
        trie = TrieShard.build(distinct if k == 0 else np.zeros(0, np.uint64), bounds, s, codes)
        if k == 0:
            place = np.full(len(hashes), -1)
            place[seen] = np.arange(len(seen))
            index = place[heads]
        else:
            index = asked
        asked = trie.child(np.repeat(index, np.concatenate(spans)), successors)
        weights = quantise(weight)
        reply = np.where(asked >= 0, trie.codes[asked], 0).astype(np.uint8) if len(trie.codes) else np.zeros(len(asked), np.uint8)
        back = np.where(index >= 0, weights[index], 0).astype(np.uint8) if len(weights) else np.zeros(len(index), np.uint8)
        given.append((np.split(reply, np.cumsum(sizes)[:-1]), np.split(back, np.cumsum([len(x) for x in spans])[:-1])))
    out = []
    for i, r in enumerate(rows):
        own = totals[np.searchsorted(words, np.frombuffer(r["words"], np.uint64))]
        out.append((r["block"], _planes(own, 5), [c[i].tobytes() for c, _ in given], [w[i].tobytes() for _, w in given]))
    return out, (int(totals.sum()), int((totals > 0).sum())), masses


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", train: str = "train", order: int = ORDER, discounts: tuple[float, ...] = DISCOUNTS) -> DataFrame:
    """key, train, n_tokens, n_known, train_tokens, base_score, score for every document; `train` marks those learned from.

    `order` is the length of the longest n-grams, two at least; `discounts` are what counts of 0, 1, 2 and more lose.
    Null and empty texts are the end token alone. Without training documents
    every score is that of an empty model. Repeated rows count as often as they
    come. An empty table gives an empty result; extra columns are dropped.
    """
    if order < 2:
        raise ValueError("order is two at least")
    spark = docs.sparkSession
    table = blocks(docs, text, key, train)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(_unplaned(x, 4).sum()) for x in batch.column(0).to_pylist()], pa.int64())], ["n"])

    with batch_rows(spark, 64):
        tokens = int(table.select("counts").mapInArrow(sizes, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0)
        hot = _hot(table, tokens)
    hot_keys = np.array(sorted(hot), np.uint64)
    shards = max(12, -(-tokens // SHARD_TOKENS))

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = -1, []
        for batch in batches:
            for row in _rows(batch):
                if row["shard"] != shard and held:
                    yield from replies(shard, held)
                    held = []
                shard = row["shard"]
                held.append(row)
        if held:
            yield from replies(shard, held)

    def replies(shard: int, held: list[dict]) -> Iterator[pa.RecordBatch]:
        out, (n, v), masses = answer(held, hot, discounts)
        held.clear()
        names = ["shard", "block", "words", "codes", "weights", "n", "v", "hot", "mass"]
        k, m = len(out), len(masses)
        rows = [(shard, b, w, c, g, None, None, None, None) for b, w, c, g in out] + [(shard, None, None, None, None, n, v, None, None)]
        rows += [(shard, None, None, None, None, None, None, int(np.uint64(h).astype(np.int64)), x) for h, x in masses]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        for a in range(0, k + 1 + m, 64):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a : a + 64]], kinds[i]) for i in range(9)], names)
        give_back()

    answers = _requests(table, shards, hot_keys, order).repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(serve, "shard long, block long, words binary, codes array<binary>, weights array<binary>, n long, v long, hot long, mass double")
    with batch_rows(spark, 8):
        answers = stored(answers, "lm-answers")
    total = answers.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_all, v_all = int(total["n"] or 0), int(total["v"] or 0)
    masses = {int(np.int64(r["hot"]).astype(np.uint64)): r["mass"] for r in answers.filter("hot is not null").groupBy("hot").agg(F.sum("mass").alias("mass")).collect()}  # at most HOT rows
    hot_weight = np.array([masses.get(k, 0.0) / max(1, hot[k]) for k in hot_keys.tolist()])
    kind = docs.schema[key].dataType.simpleString()

    def finish(key_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        b = _block(row)
        replies = sorted(right.select(["shard", "words", "codes", "weights"]).to_pylist(), key=lambda r: r["shard"])
        by_shard, _ = b.ordered_words(shards)
        counts = np.zeros(len(b.words), np.float64)
        counts[by_shard] = np.concatenate([_unplaned(r["words"], 5) for r in replies])
        context, shard, levels = b.grams(order, shards, hot_keys)
        change = np.append(True, (context[1:] != context[:-1]) | (shard[1:] != shard[:-1]))[: len(context)]
        group = np.cumsum(change) - 1
        unigram = (counts + 1) / (n_all + v_all + 1)
        base = np.log10(unigram)[b.tokens]
        p = unigram[b.tokens]
        for k, (parent, _, _, place) in enumerate(levels):
            codes, weight = (restored(np.concatenate([np.frombuffer(r[c][k], np.uint8) for r in replies])) for c in ("codes", "weights"))
            weight = np.where(weight > 0, weight, 1.0)[parent if k else group]
            if k == 0 and len(hot_keys):
                at = np.minimum(np.searchsorted(hot_keys, context), len(hot_keys) - 1)
                weight = np.where(hot_keys[at] == context, hot_weight[at], weight)
            own = place >= 0
            p[own] = codes[place[own]] + weight[place[own]] * p[own]
        value = np.log10(p)
        doc = np.repeat(np.arange(len(b.sizes)), b.sizes)
        per = lambda x: np.bincount(doc, weights=x, minlength=len(b.sizes))
        ids = left["ids"].combine_chunks().chunk(0) if isinstance(left["ids"], pa.ChunkedArray) and left["ids"].num_chunks > 1 else left["ids"].chunk(0)
        arrays = [ids.flatten(), pa.array(b.train), pa.array(b.sizes), pa.array(per(counts[b.tokens] > 0).astype(np.int64)), pa.array(np.full(len(b.sizes), n_all)), pa.array(per(base)), pa.array(per(value))]
        return pa.Table.from_arrays(arrays, ["k", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"k {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    replies = answers.filter("block is not null").select("shard", "block", "words", "codes", "weights")
    done = table.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema)
    return done.withColumnsRenamed({"k": key})


def op9_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", (crc_remainder("doc_id", 7) != 2).alias("train"))
    rows = score(docs)
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
