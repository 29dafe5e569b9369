"""Language-model scoring by prediction by partial matching.

Byte contexts up to order 3 are counted over the training documents. A byte is coded in its
longest known context; an unseen one escapes to the next shorter context (escape method C:
distinct successors over occurrences plus distinct), where the successors already refused
are excluded from the counts. The code lengths of all bytes and of one end mark add up to the
document's log probability.

Beside it stands the add-one unigram score over words. Neither words nor byte contexts gather
in one place: documents are dealt to blocks of bounded size, a block sends one row per distinct
word and one per distinct four-byte string, and gets the word's total and the string's code
length back, so a word in every document costs one row per block. No count is dropped: code
lengths are taken where all strings of the same two middle bytes meet (at most 65,536 of them),
which hold orders 3 and 2 whole; orders 1 and 0 (at most 65,536 pairs) go to every task.

Defined results: a null text is the empty text, which still has its end token and end mark.
Every input row gives one output row, repeated rows and null ids included. Without training
rows all counts are 0. Words are told apart by 64-bit hashes. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WordHashes, as_bytes, blocks_of, row_key, slices, written

ORDER = 3
PAD = b"\x00" * ORDER
END = b"\x00"
END_WORD = np.uint64(0x0E0D0E0D0E0D0E0D)  # stands for the end token
# Rows of a block: its texts and words fit easily in one task.
BLOCK_ROWS = 6000
# Groups that the two middle bytes of strings are dealt to: about 16 of 65,536 each.
MIDDLE_GROUPS = 1 << 12
# Four-byte strings that fit_trie keeps by default, the most frequent, above a power of two: a
# model small enough for one process. Documents are scored without it, by all counts.
MAX_NODES = 1 << 20


def codes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte (and end mark) with the three before it as one number, and the count per text."""
    data = np.frombuffer(PAD + b"".join(t.lower() + END + PAD for t in texts), np.uint8).astype(np.uint32)
    codes = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    # The pads between two texts are contexts only, never coded.
    coded = np.ones(len(codes), bool)
    ends = np.cumsum(sizes + ORDER)
    for k in range(ORDER):
        coded[ends - 1 - k] = False
    return codes[coded], sizes


def level_of(k: int, codes: np.ndarray, counts: np.ndarray, below: dict[str, np.ndarray] | None) -> dict[str, np.ndarray]:
    """Order k from counted strings: pairs (context and successor) with counts, contexts with totals,
    distinct successors, and the mass that exclusion takes at the next shorter order, ``below``."""
    short = codes & np.uint32((1 << 8 * (k + 1)) - 1)
    pairs, inverse = np.unique(short, return_inverse=True)
    n = np.bincount(inverse, counts, len(pairs)) if len(pairs) else np.zeros(0)
    contexts, start = np.unique(pairs >> np.uint32(8), return_index=True)
    total = np.add.reduceat(n, start) if len(start) else np.zeros(0)
    distinct = np.diff(np.append(start, len(pairs))).astype(float)
    level = {"pairs": pairs, "n": n, "contexts": contexts, "total": total, "distinct": distinct}
    if k and len(pairs):
        shorter = pairs & np.uint32((1 << 8 * k) - 1)
        level["mass"] = np.add.reduceat(below["n"][np.searchsorted(below["pairs"], shorter)], start)
    return level


@dataclass(frozen=True)
class PpmTrie:
    """Counts of four-byte strings, with what each shorter context needs derived from them."""

    codes: np.ndarray  # uint32, ascending
    counts: np.ndarray  # int64

    @cached_property
    def levels(self) -> list[dict[str, np.ndarray]]:
        out = []
        for k in range(ORDER + 1):
            out.append(level_of(k, self.codes, self.counts, out[-1] if out else None))
        return out


def code_lengths(levels: list[dict[str, np.ndarray]], codes: np.ndarray) -> np.ndarray:
    """Bits that each code's last byte costs after the three before it."""
    bits = np.zeros(len(codes))
    open_ = np.ones(len(codes), bool)
    mass, gone = np.zeros(len(codes)), np.zeros(len(codes))
    for k in range(ORDER, -1, -1):
        level = levels[k]
        if not len(level["pairs"]):
            continue
        pair = codes & np.uint32((1 << 8 * (k + 1)) - 1)
        at = np.minimum(np.searchsorted(level["contexts"], pair >> np.uint32(8)), len(level["contexts"]) - 1)
        known = open_ & (level["contexts"][at] == pair >> np.uint32(8))
        distinct = level["distinct"][at] - gone
        left = known & (distinct > 0)  # with nothing left, the escape is certain and free
        size = level["total"][at] - mass + distinct
        spot = np.minimum(np.searchsorted(level["pairs"], pair), len(level["pairs"]) - 1)
        hit = left & (level["pairs"][spot] == pair)
        miss = left & ~hit
        bits[hit] += np.log2(size[hit] / level["n"][spot[hit]])
        bits[miss] += np.log2(size[miss] / distinct[miss])
        open_ &= ~hit
        if k:
            mass = np.where(known, level["mass"][at], mass)
            gone = np.where(known, level["distinct"][at], gone)
        else:
            gone = np.where(known, level["distinct"][at], 0)
    bits[open_] += np.log2(np.maximum(256 - gone[open_], 1))
    return bits


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(codes, return_inverse=True)
    return unique, np.bincount(inverse, counts, len(unique)).astype(np.int64)


def fit_trie(training: DataFrame, text_col: str = "text", *, max_nodes: int = MAX_NODES) -> PpmTrie:
    """Count a trie of bounded size over all rows of ``training``; tasks send distinct strings with counts."""

    def run(batches):
        codes, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in slices(batches, column=0):
            found, _ = codes_of([t or b"" for t in as_bytes(batch.column(0))])
            inverse, unique = pd.factorize(found)
            codes, counts = _summed(np.r_[codes, unique], np.r_[counts, np.bincount(inverse, minlength=len(unique))])
        for at in range(0, len(codes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(codes[at:at + (1 << 16)].astype(np.int64)), pa.array(counts[at:at + (1 << 16)])], ["code", "n"])

    counted = training.select(text_col).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).persist()
    steps = [1 << j for j in range(40)]
    sizes = counted.agg(*[F.sum((F.col("n") >= s).cast("bigint")).alias(f"s{j}") for j, s in enumerate(steps)]).first()
    least = next(s for s, size in zip(steps, sizes) if (size or 0) <= max_nodes)
    kept = counted.where(F.col("n") >= least).toArrow()
    counted.unpersist()
    codes, counts = kept.column(0).to_numpy().astype(np.uint32), kept.column(1).to_numpy()
    order = np.argsort(codes)
    return PpmTrie(codes[order], counts[order])


def score_documents(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", *,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: id, in_training, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` marks the rows to learn from. ``score`` is the log10 probability under the byte
    model, ``base_score`` under the add-one word model.
    """
    blocks = blocks_of(df, rows=block_rows)
    dealt = (df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(training, F.lit(False)).alias("_train"),
                       F.pmod(row_key(id_col, text_col), F.lit(blocks)).cast("int").alias("_block"))
             .repartition("_block"))
    id_type = dealt.schema["_id"].dataType.simpleString()

    def words(key: tuple, docs: pa.Table) -> pa.Table:
        hashes, seen, counts = WordHashes(), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in slices(docs.to_batches()):
            found, weight = [], []
            for text, train in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                ids = np.append(hashes.of((text or b"").lower().split()), END_WORD)
                found.append(ids)
                weight.append(np.full(len(ids), int(train)))
            seen, counts = _summed(np.concatenate([seen, *found]), np.concatenate([counts, *weight]))
        return pa.table({"_block": pa.array(np.full(len(seen), key[0].as_py(), np.int32)), "_word": pa.array(seen.view(np.int64)), "_n": pa.array(counts)})

    def strings(key: tuple, docs: pa.Table) -> pa.Table:
        seen, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in slices(docs.to_batches()):
            trains = np.array(batch.column(2).to_pylist(), bool)
            codes, lengths = codes_of([t or b"" for t in as_bytes(batch.column(1))])
            inverse, unique = pd.factorize(codes)
            counted = np.bincount(inverse, np.repeat(trains, lengths), len(unique))
            seen, counts = _summed(np.r_[seen, unique], np.r_[counts, counted])
        return pa.table({"_block": pa.array(np.full(len(seen), key[0].as_py(), np.int32)), "_code": pa.array(seen.astype(np.int64)), "_n": pa.array(counts)})

    used = written(dealt.groupBy("_block").applyInArrow(strings, "_block int, _code bigint, _n bigint"), "ppm-strings")
    pairs = used.groupBy(F.expr("_code & 65535").alias("_pair")).agg(F.sum("_n").alias("_n")).where("_n > 0").toArrow()
    low = [pairs.column(0).to_numpy().astype(np.uint32), pairs.column(1).to_numpy()]
    zero = level_of(0, *low, None)
    shipped = df.sparkSession.sparkContext.broadcast([zero, level_of(1, *low, zero)])  # at most 65,536 pairs

    def cost(found: pa.Table) -> pa.Table:
        codes, n = found.column("_code").to_numpy().astype(np.uint32), found.column("_n").to_numpy()
        known = n > 0
        levels = list(shipped.value)
        for k in (ORDER - 1, ORDER):
            levels.append(level_of(k, codes[known], n[known], levels[-1]))
        return pa.table({"_code": found.column("_code"), "_bits": pa.array(code_lengths(levels, codes))})

    middle = F.pmod(F.xxhash64(F.expr("(_code >> 8) & 65535")), F.lit(MIDDLE_GROUPS)).cast("int")
    priced = (used.groupBy("_code").agg(F.sum("_n").alias("_n")).groupBy(middle.alias("_middle"))
              .applyInArrow(cost, "_code bigint, _bits double"))

    sent = dealt.groupBy("_block").applyInArrow(words, "_block int, _word bigint, _n bigint")
    # A word has at most one row per block.
    same = "PARTITION BY _word"
    totals = sent.select("_block", "_word", F.expr(f"sum(_n) OVER ({same})").alias("_total"), F.expr(f"min(_block) OVER ({same}) = _block").alias("_first"))
    sums = totals.where("_first").agg(F.struct(
        F.coalesce(F.sum("_total"), F.lit(0)).alias("all"),
        F.coalesce(F.sum((F.col("_total") > 0).cast("bigint")), F.lit(0)).alias("distinct")).alias("_sums"))

    def sorted_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        return keys[order], values[order]

    def score(key: tuple, docs: pa.Table, counts: pa.Table) -> pa.Table:
        keys, of_words = counts.column("_key").to_numpy(), counts.column("_bits").is_null().to_numpy()
        known, total = sorted_by(keys[of_words].view(np.uint64), counts.column("_total").to_numpy()[of_words].astype(np.int64))
        strings_, price = sorted_by(keys[~of_words].astype(np.uint32), counts.column("_bits").to_numpy()[~of_words])
        hashes, parts = WordHashes(), []
        for batch in slices(docs.to_batches()):
            texts = [(t or b"").lower() for t in as_bytes(batch.column(1))]
            ids = [np.append(hashes.of(t.split()), END_WORD) for t in texts]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            c = total[np.searchsorted(known, np.concatenate(ids))]
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            codes, lengths = codes_of(texts)
            inverse, unique = pd.factorize(codes)
            bits = np.add.reduceat(price[np.searchsorted(strings_, unique)][inverse], np.r_[0, np.cumsum(lengths)[:-1]])
            parts.append(pa.table({
                "_id": batch.column(0), "in_training": batch.column(2), "n_tokens": pa.array(sizes),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
                "_logs": pa.array(np.add.reduceat(np.log10(c + 1.0), starts)), "score": pa.array(-bits * np.log10(2.0))}))
        return pa.concat_tables(parts)

    back = totals.select("_block", F.col("_word").alias("_key"), "_total", F.lit(None).cast("double").alias("_bits")).unionByName(
        used.join(priced, "_code").select("_block", F.col("_code").alias("_key"), F.lit(0).cast("bigint").alias("_total"), "_bits"))
    scored = dealt.groupBy("_block").cogroup(back.groupBy("_block")).applyInArrow(
        score, f"_id {id_type}, in_training boolean, n_tokens bigint, n_known bigint, _logs double, score double")
    corpus = scored.withColumn("_sums", sums.scalar())
    each = F.log10(F.col("_sums.all") + F.col("_sums.distinct") + F.lit(1.0))
    return corpus.select(
        F.col("_id").alias(id_col), "in_training", "n_tokens", "n_known", F.col("_sums.all").alias("train_tokens"),
        (F.col("_logs") - F.col("n_tokens") * each).alias("base_score"), "score")
