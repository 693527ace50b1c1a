"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed bigram over all words: every word of the training part
is a state, and so is the start. An arc carries the log-probability of a seen
pair of words, and where a state has no arc its failure arc leads, at the
backoff weight, to the root, whose arcs are the add-one unigram model over all
words.

Counts of words and of pairs cover the whole training part and have no bound,
so they are never broadcast: documents are packed into batches, each batch
asks the count shards for its own words and pairs, and the answers travel back
to it. Pairs of the most frequent ``states`` words would be asked by every
batch; a dense automaton over these words answers them in place, with the same
weights.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import dropped, released, stored, texts
from .blobs import LOWER, buckets_for, input_bytes, pack, tidied, unpack, word_hashes

#: Words whose pairs are answered by the dense automaton; a cache, whose size
#: changes no score.
STATES = 2048
#: Weight of the root's distribution against a state's own counts.
BACKOFF = 64.0
#: Words of a batch; a longer document is a batch of its own.
BATCH_WORDS = 1 << 20
#: No word is empty: the hash of the empty string stands for the end.
END = b""
#: No word holds a space: stands before the first word of a document.
START = b" "

PACKED = "batch_id long, doc_ids array<long>, trained array<boolean>, lens array<long>, tokens binary, words binary, counts binary"


def is_held(doc_id: int | None, fold: int, held: int) -> bool:
    """A null doc_id is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % fold == held


def _packed(fold: int, held: int, batch_words: int):
    def run(batches):
        made = 0

        def flush(docs, hashes):
            nonlocal made
            lens = [len(h) for h in hashes]
            words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            train = [not is_held(d, fold, held) for d in docs]
            counts = np.bincount(tokens[np.repeat(train, lens)], minlength=len(words))
            made += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId() << 32 | made], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([train], pa.list_(pa.bool_())),
                    pa.array([lens], pa.list_(pa.int64())),
                    pa.array([pack(tokens.astype(np.uint32))], pa.binary()),
                    pa.array([words.tobytes()], pa.binary()),
                    pa.array([pack(counts.astype(np.uint32))], pa.binary()),
                ],
                names=["batch_id", "doc_ids", "trained", "lens", "tokens", "words", "counts"],
            )

        docs, hashes, held_words = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = word_hashes([*text.translate(LOWER).split(), END])
                docs.append(doc)
                hashes.append(own)
                held_words += len(own)
                if held_words >= batch_words:
                    yield flush(docs, hashes)
                    docs, hashes, held_words = [], [], 0
        if docs:
            yield flush(docs, hashes)

    return run


def _cut(batch_id: int, keys: np.ndarray, counts: np.ndarray, shards: int):
    """Sorted keys and their counts, a record batch for each shard that has
    any; a key's highest bits are its shard."""
    own = keys >> np.uint64(64 - shards.bit_length() + 1) if shards > 1 else np.zeros(len(keys), np.uint64)
    at = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(keys)]
    for a, b in zip(at, at[1:], strict=False):
        if a < b:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([int(own[a])], pa.int32()), "batch_id": [batch_id], "words": [keys[a:b].tobytes()], "counts": [pack(counts[a:b])]})


def _asked(shards: int):
    """Each batch's distinct words and their counts, cut by shard."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _cut(row["batch_id"], np.frombuffer(row["words"], np.uint64), unpack(row["counts"], "<u4"), shards)

    return run


def pair_keys(words: np.ndarray, tokens: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of each token's word with the word before it."""
    own = words[tokens]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[np.cumsum(lens) - lens] = word_hashes([START])[0]
    out = before * np.uint64(0x9E3779B97F4A7C15) + own
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def uncached(kinds: np.ndarray, lens: np.ndarray, k: int) -> np.ndarray:
    """Tokens whose pair the dense automaton of ``k`` words does not hold."""
    return (kinds == k) | (paired(kinds, lens, k + 1) == k)


def _asked_pairs(shared, shards: int):
    """Each batch's distinct pairs outside the dense automaton and their
    counts in training documents, cut by shard."""

    def run(batches):
        top = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                lens, train = np.array(row["lens"]), np.array(row["trained"], dtype=bool)
                words, tokens = np.frombuffer(row["words"], np.uint64), unpack(row["tokens"], "<u4")
                out = uncached(classes_of(words, top)[tokens], lens, len(top))
                keys, place = np.unique(pair_keys(words, tokens, lens)[out], return_inverse=True)
                counts = np.bincount(place[np.repeat(train, lens)[out]], minlength=len(keys))
                yield from _cut(row["batch_id"], keys, counts.astype(np.uint32), shards)

    return run


def pack_counts(values: np.ndarray) -> bytes:
    """Packed in the least width that holds them, which is the first byte."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + pack(values.astype(f"<u{width}"))


def unpack_counts(data: bytes) -> np.ndarray:
    return unpack(data[1:], f"<u{data[0]}").astype(np.int64)


def _answered(states: int):
    """One shard: its total counts, sent back to every batch in the order of
    its words; the shard's size and most frequent words in a row of their own."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words, place = np.unique(np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows]), return_inverse=True)
        asked = [unpack(r["counts"], "<u4") for r in rows]
        totals = np.bincount(place, weights=np.concatenate(asked), minlength=len(words)).astype(np.int64)
        ends = np.cumsum([len(a) for a in asked])
        top = np.lexsort((words, -totals))[:states]
        top = top[totals[top] > 0]
        n, shard = len(rows), rows[0]["shard"]
        return pa.table(
            {
                "batch_id": pa.array([r["batch_id"] for r in rows] + [None], pa.int64()),
                "shard": pa.array([shard] * (n + 1), pa.int32()),
                "totals": pa.array([pack_counts(totals[place[e - len(a) : e]]) for a, e in zip(asked, ends, strict=True)] + [None], pa.binary()),
                "n": pa.array([None] * n + [int(totals.sum())], pa.int64()),
                "v": pa.array([None] * n + [int((totals > 0).sum())], pa.int64()),
                "top_words": pa.array([None] * n + [words[top].view(np.int64).tolist()], pa.list_(pa.int64())),
                "top_counts": pa.array([None] * n + [totals[top].tolist()], pa.list_(pa.int64())),
            }
        )

    return run


ANSWERS = "batch_id long, shard int, totals binary, n long, v long, top_words array<long>, top_counts array<long>"


def classes_of(words: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Class of each word: its place among the sorted ``top``, else their
    number (the rare words)."""
    if not len(top):
        return np.zeros(len(words), dtype=np.int64)
    at = np.minimum(np.searchsorted(top, words), len(top) - 1)
    return np.where(top[at] == words, at, len(top))


def paired(symbols: np.ndarray, lens: np.ndarray, start: int) -> np.ndarray:
    """The symbol before each one, ``start`` at the head of each document."""
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[np.cumsum(lens) - lens] = start
    return before


BLOCK_ROWS = 32


def _pairs(shared):
    def run(batches):
        top = shared.value
        k = len(top)
        seen = np.zeros((k + 2, k + 1), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                lens, train = np.array(row["lens"]), np.array(row["trained"], dtype=bool)
                symbols = classes_of(np.frombuffer(row["words"], np.uint64), top)[unpack(row["tokens"], "<u4")]
                use = np.repeat(train, lens)
                key = (paired(symbols, lens, k + 1) * (k + 1) + symbols)[use]
                found, n = np.unique(key, return_counts=True)
                seen.reshape(-1)[found] += n
        for at in range(0, k + 2, BLOCK_ROWS):
            block = seen[at : at + BLOCK_ROWS]
            if block.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "counts": [pack(block.reshape(-1))]})

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = sum(unpack(x, "<i8") for x in table.column("counts").to_pylist())
    return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([pack(total)], pa.binary())})


class Automaton:
    """States 0..k-1 are frequent words, k the rare ones, k+1 the start;
    ``arcs[s, c]`` is NaN where state s has no arc for class c."""

    def __init__(self, pairs: np.ndarray, root: np.ndarray, backoff: float):
        total = pairs.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            weights = np.log10((pairs + backoff * root) / (total + backoff))
        self.arcs = np.where(pairs > 0, weights, np.nan).astype(np.float32)
        self.failure = np.log10(backoff / (total[:, 0] + backoff))
        self.root = np.log10(root)
        self.start = len(root)

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        """Follow the arc, or the failure arc and then the root's."""
        weight = float(self.arcs[state, symbol])
        if weight != weight:
            weight = float(self.failure[state] + self.root[symbol])
        return symbol, weight

    def run(self, symbols: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Weights along one left-to-right pass over each document: the state
        carried to a symbol is the one its predecessor led to."""
        states = paired(symbols, lens, self.start)
        weights = self.arcs[states, symbols].astype(np.float64)
        return np.where(np.isnan(weights), self.failure[states] + self.root[symbols], weights)


def _scored(shared, fold: int, held: int):
    def run(batches):
        automaton, top, n, v, backoff = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                lens = np.array(row["lens"])
                counts = [np.concatenate([np.zeros(0, np.int64), *(unpack_counts(a["totals"]) for a in row["answers"] if a["pairs"] == pairs)]) for pairs in (False, True)]
                totals = counts[0]
                words, tokens = np.frombuffer(row["words"], np.uint64), unpack(row["tokens"], "<u4")
                kinds = classes_of(words, top)[tokens]
                root = ((totals + 1) / (n + v + 1))[tokens]
                out = uncached(kinds, lens, len(top))
                _, place = np.unique(pair_keys(words, tokens, lens)[out], return_inverse=True)
                # each training document starts once and ends once
                starts = totals[np.searchsorted(words, word_hashes([END])[0])]
                left = paired(totals[tokens], lens, starts)[out]
                weights = automaton.run(kinds, lens)
                weights[out] = np.log10((counts[1][place] + backoff * root[out]) / (left + backoff))
                at = np.cumsum(lens) - lens
                add = lambda x: np.add.reduceat(x, at)  # noqa: E731  no document is without a token: each has its end
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "held_out": pa.array([is_held(d, fold, held) for d in row["doc_ids"]], pa.bool_()),
                        "n_tokens": lens,
                        "n_known": add((totals > 0)[tokens].astype(np.int64)),
                        "train_tokens": np.full(len(lens), n, dtype=np.int64),
                        "base_score": add(np.log10(root)),
                        "score": add(weights),
                    }
                )

    return run


def scored(docs: DataFrame, fold: int = 7, held: int = 2, states: int = STATES, backoff: float = BACKOFF, batch_words: int = BATCH_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score and score (log10).

    Learns from rows whose crc32(doc_id as text) mod ``fold`` is not ``held``.
    Null and empty texts have one token, the end; a very long text is a batch
    of its own; rows of one doc_id are scored each; an empty table gives an
    empty result. With no training row all
    words are unknown and both scores are 0. Words, and pairs of words, are
    told apart by 64-bit hashes. ``states`` changes no score.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    shards = buckets_for(input_bytes(rows))
    packed = stored(rows.mapInArrow(tidied(_packed(fold, held, batch_words)), PACKED), "packed")
    asked = packed.select("batch_id", "words", "counts").mapInArrow(tidied(_asked(shards)), "shard int, batch_id long, words binary, counts binary")
    answers = stored(asked.groupBy("shard").applyInArrow(_answered(states), ANSWERS), "answers")
    released(spark)
    n, v = (x or 0 for x in answers.agg(F.sum("n"), F.sum("v")).first())
    tops = answers.where("batch_id is null").select(F.explode(F.arrays_zip("top_words", "top_counts")).alias("t")).select("t.top_words", "t.top_counts")
    picked = tops.orderBy(F.desc("top_counts"), "top_words").limit(states).collect()
    top = np.array([r[0] for r in picked], dtype=np.int64).view(np.uint64)
    order = np.argsort(top)
    top, frequent = top[order], np.array([r[1] for r in picked], dtype=np.int64)[order]
    k = len(top)
    sent = spark.sparkContext.broadcast(top)
    blocks = packed.select("trained", "lens", "words", "tokens").mapInArrow(tidied(_pairs(sent)), "block int, counts binary")
    pairs = np.zeros((k + 2, k + 1), dtype=np.int64)
    for r in blocks.groupBy("block").applyInArrow(_summed, "block int, counts binary").collect():
        block = unpack(bytes(r["counts"]), "<i8").reshape(-1, k + 1)
        pairs[r["block"] : r["block"] + len(block)] = block
    rare = n - int(frequent.sum()) + v - k + 1
    root = np.append(frequent + 1, rare) / (n + v + 1)
    shared = spark.sparkContext.broadcast((Automaton(pairs, root, backoff), top, n, v, backoff))
    asked = packed.select("batch_id", "trained", "lens", "words", "tokens").mapInArrow(tidied(_asked_pairs(sent, shards)), "shard int, batch_id long, words binary, counts binary")
    pair_answers = stored(asked.groupBy("shard").applyInArrow(_answered(0), ANSWERS), "pair_answers")
    released(spark)
    every = answers.withColumn("pairs", F.lit(False)).unionByName(pair_answers.withColumn("pairs", F.lit(True))).where("batch_id is not null")
    back = every.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pairs", "shard", "totals"))).alias("answers"))
    joined = packed.select("batch_id", "doc_ids", "lens", "tokens", "words").join(back, "batch_id")
    return joined.mapInArrow(tidied(_scored(shared, fold, held)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
