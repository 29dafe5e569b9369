"""Exact removal of long repeats across documents, found by recompression.

Words get global names (hashes). Rounds then name short runs of a symbol, and pairs of a left
and a right symbol, by what they consist of; which symbols are left or right in a round follows
from their names. A name so depends on nothing but the words of its symbol and of a bounded
surrounding, hence equal passages get equal symbols inside, in whatever documents they stand,
without any exchange. Each window of ``window`` words elects the symbol of highest priority
that its own words determine; equal windows elect equal symbols.

Spark then gathers elected symbols (with the words around them hashed in) across documents. Only
windows whose symbol stands in two documents are hashed whole (128 bits) and compared: that
verifies every repeat exactly, with the smallest id that holds it.

Scale: one row per elected symbol, about one in eleven words; texts move once, by row; exact
copies of whole documents are settled first, by their word sequence. Hot symbols and windows
combine map-side and are joined as plain tables, which AQE splits.

Defined results: windows are judged on the input. Null and empty texts have no words. Rows with
a null id neither lose words nor cause losses. Rows of the same id never remove from each other;
repeated rows get equal results. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Tables, WordHashes, as_bytes, mixed, row_key, slices, spans_mask, unused

WINDOW = 50
LONGEST_RUN = 3
# Widest symbol, in words, that each pair round may make.
PAIR_WIDTHS = (4, 8)
# Words to either side that a final symbol may depend on: a run is judged by LONGEST_RUN words,
# a pair by its neighbour, which is at most as wide as the round before made it.
MARGIN = LONGEST_RUN + sum((LONGEST_RUN, *PAIR_WIDTHS[:-1]))
WIDEST = PAIR_WIDTHS[-1]

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


class RangeHash:
    """Hashes of any range of words, from running sums of word hash times power."""

    def __init__(self, words: np.ndarray, base: np.uint64):
        power = np.full(len(words) + 1, base)
        power[0] = 1
        self.back = np.full(len(words) + 1, _inverse(base))
        self.back[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(self.back, out=self.back)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mixed(words ^ base) * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def symbols_of(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, starts and widths of the symbols after all rounds; none crosses a document."""
    n = len(words)
    new = np.ones(n, bool)
    new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    size = np.repeat(length, length)
    short = (size > 1) & (size <= LONGEST_RUN)
    keep = new | ~short
    width = np.where(short, size, 1)[keep]
    start = np.flatnonzero(keep)
    name = np.where(width > 1, mixed(words[keep] + _ODD * width.astype(np.uint64)), words[keep])
    owner = doc[keep]
    for turn, widest in enumerate(PAIR_WIDTHS):
        left = mixed(name ^ np.uint64(turn + 1)) & np.uint64(1) == 0
        joined = left[:-1] & ~left[1:] & (owner[:-1] == owner[1:]) & (width[:-1] + width[1:] <= widest)
        at = np.flatnonzero(joined)
        name[at] = mixed(mixed(name[at] + np.uint64(turn + 1)) * _ODD + name[at + 1])
        width[at] += width[at + 1]
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        name, start, width, owner = name[keep], start[keep], width[keep], owner[keep]
    return name, start, width


def elected(words: np.ndarray, doc: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows that start at ``first``: index of the symbol each elects, then all starts and ends."""
    name, start, width = symbols_of(words, doc)
    end = start + width
    if not len(first):
        return np.zeros(0, np.int64), start, end
    low = np.searchsorted(start, first + MARGIN)
    high = np.searchsorted(end, first + window - MARGIN, side="right") - 1
    rank = mixed(name ^ _BASES[0])
    best = [np.arange(len(name))]
    span = 1
    while span * 2 <= int((high - low).max()) + 1:
        a, b = best[-1][:-span], best[-1][span:]
        best.append(np.where(rank[a] >= rank[b], a, b))  # the earlier one of equals
        span *= 2
    level = np.log2(high - low + 1).astype(np.int64)
    out = np.zeros(len(first), np.int64)
    for j, table_ in enumerate(best):
        mine = level == j
        a, b = table_[low[mine]], table_[high[mine] - (1 << j) + 1]
        out[mine] = np.where(rank[a] >= rank[b], a, b)
    return out, start, end


class Slice:
    """The words of a slice of documents in one row, with their windows."""

    def __init__(self, texts: list[bytes | None], hashes: WordHashes, window: int):
        split = [(t or b"").split() for t in texts]
        self.split = split
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.words = hashes.of([w for s in split for w in s])
        self.doc = np.repeat(np.arange(len(split)), self.sizes)
        self.begin = np.cumsum(self.sizes) - self.sizes
        room = np.repeat(self.begin + self.sizes, self.sizes) - np.arange(len(self.words))
        self.first = np.flatnonzero(room >= window)
        self.window = window
        self.ranges = RangeHash(self.words, _BASES[0])

    def keys(self) -> np.ndarray:
        """Per window: the hash of its elected symbol with the surrounding words that made it."""
        choice, start, end = elected(self.words, self.doc, self.first, self.window)
        return self.ranges.of(start[choice] - MARGIN, end[choice] + MARGIN)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each document's word sequence."""
        second = RangeHash(self.words, _BASES[1])
        return tuple(r.of(self.begin, self.begin + self.sizes) for r in (self.ranges, second))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the windows at these places of ``first``."""
        at = self.first[which]
        return tuple(r.of(at, at + self.window) for r in (self.ranges, RangeHash(self.words, _BASES[1])))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), _signed(values))


def _elections(docs: DataFrame, window: int) -> DataFrame:
    """Per row: number of words, 128 bits of the sequence, distinct keys of the elected symbols."""
    id_type = docs.schema["_id"].dataType.simpleString()

    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches, column=2):
            part = Slice(as_bytes(batch.column(2)), hashes, window)
            keys, owner = part.keys(), part.doc[part.first]
            order = np.lexsort((keys, owner))
            keys, owner = keys[order], owner[order]
            once = np.ones(len(keys), bool)
            once[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            a, b = part.whole()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(part.sizes), _signed(a), _signed(b), _lists(keys[once], owner[once], batch.num_rows)],
                ["_row", "_id", "_size", "_a", "_b", "_keys"])

    return docs.mapInArrow(run, f"_row bigint, _id {id_type}, _size bigint, _a bigint, _b bigint, _keys array<bigint>")


def _windows(candidates: DataFrame, window: int) -> DataFrame:
    """Rows (_a, _b, _id, _row, _start) of the windows whose elected symbol is among the row's ``_keys``."""
    id_type = candidates.schema["_id"].dataType.simpleString()

    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches, column=2, most=1 << 21):
            part = Slice(as_bytes(batch.column(2)), hashes, window)
            lists = batch.column(3)
            wanted = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(wanted) or not len(part.first):
                continue
            owner = part.doc[part.first]
            # Keys are compared together with the row they belong to.
            salt = mixed(np.arange(batch.num_rows, dtype=np.uint64))
            of_list = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            hit = np.flatnonzero(np.isin(part.keys() ^ salt[owner], wanted ^ salt[of_list]))
            a, b = part.windows(hit)
            rows = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays(
                [_signed(a), _signed(b), batch.column(1).take(rows), batch.column(0).take(rows), pa.array((part.first[hit] - part.begin[owner[hit]]).astype(np.int32))],
                ["_a", "_b", "_id", "_row", "_start"])

    return candidates.mapInArrow(run, f"_a bigint, _b bigint, _id {id_type}, _row bigint, _start int")


def _kept_text(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked gone; a gap that held a line end keeps one."""
    out, last, fresh = [], 0, True
    for word, drop in zip(_WORD.finditer(text), gone):
        if drop:
            fresh = True
            continue
        between = text[last:word.start()]
        out.append((b"" if not out else b"\n" if b"\n" in between else b" ") if fresh else between)
        out.append(word.group())
        last, fresh = word.end(), False
    return b"".join(out)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row per input row: id, row_key, n_words, n_removed, kept_sha256 and the cleaned text.

    Every word is removed that lies in a window of ``window`` consecutive words which also
    starts in a row of smaller id.
    """
    if window < 2 * MARGIN + 2 * WIDEST - 1:
        raise ValueError(f"windows of fewer than {2 * MARGIN + 2 * WIDEST - 1} words may hold no symbol they determine")
    rows = df.select(row_key(id_col, text_col).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()

    tables = Tables(df.sparkSession)
    seen = tables.written(_elections(rows, window).where(F.col("_id").isNotNull()), "elections")
    # Whole copies: all but those of the smallest id lose every window.
    classes = tables.written(seen.where(F.col("_size") >= window).groupBy("_a", "_b", "_size")
                      .agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).where("_least < _most").drop("_most"), "copies")
    judged = tables.written(seen.where(F.col("_size") >= window).join(classes, ["_a", "_b", "_size"], "left")
                            .select("_row", "_id", "_keys", F.coalesce(F.col("_id") > F.col("_least"), F.lit(False)).alias("_copy")), "judged")
    symbols = judged.where("NOT _copy").select("_row", "_id", F.explode("_keys").alias("_key"))
    shared = tables.written(symbols.groupBy("_key").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).where("_least < _most").select("_key"), "shared-symbols")
    candidates = symbols.join(shared, "_key").groupBy("_row").agg(F.collect_set("_key").alias("_keys"))

    # The same exchange of the rows serves the verification and the removal below.
    placed = rows.repartition("_row")
    opened = placed.join(candidates, "_row").select("_row", "_id", "_text", "_keys")
    windows = tables.written(_windows(opened, window), "windows", keep=True)
    least = tables.written(windows.groupBy("_a", "_b").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most"))
                    .where("_least < _most").select("_a", "_b", "_least"), "least", keep=True)
    starts = (windows.join(least, ["_a", "_b"]).where(F.col("_id") > F.col("_least"))
              .groupBy("_row").agg(F.collect_set("_start").alias("_starts"), F.lit(False).alias("_copy")))
    copied = tables.written(judged.where("_copy").select("_row").distinct(), "copied", keep=True)
    tables.drop()
    copies = copied.select("_row", F.lit(None).cast("array<int>").alias("_starts"), F.lit(True).alias("_copy"))
    marked = placed.join(starts.unionByName(copies), "_row", "left").select("_row", "_id", "_text", "_starts", "_copy")

    def run(batches):
        for batch in slices(batches, column=2):
            sizes, removed, shas, texts = [], [], [], []
            for text, found, copy in zip(as_bytes(batch.column(2)), batch.column(3), batch.column(4).to_pylist()):
                words = (text or b"").split()
                gone = None
                if copy:
                    gone = np.ones(len(words), bool)
                elif copy is not None:
                    gone = spans_mask(found.values.to_numpy(zero_copy_only=False), window, len(words))
                left = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                sizes.append(len(words))
                removed.append(len(words) - len(left))
                shas.append(hashlib.sha256(b" ".join(left)).hexdigest())
                if with_text:
                    texts.append(text if gone is None else _kept_text(text, gone))
            cleaned = pa.array(texts, pa.binary()).cast(pa.string()) if with_text else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas), cleaned],
                                             ["row_key", id_col, "n_words", "n_removed", "kept_sha256", "cleaned"])

    return marked.mapInArrow(run, f"row_key bigint, `{id_col}` {id_type}, n_words bigint, n_removed bigint, kept_sha256 string, cleaned string")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``df`` with cleaned texts (and their sizes in ``size_col``, if there is one); rows left without any
    word, that had some, go. Columns of any name stay."""
    cleaned = substring_dedup(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    key, text, emptied = (unused(c, df.columns) for c in ("_changed_key", "_changed_text", "_changed_emptied"))
    changed = cleaned.where("n_removed > 0").select(
        F.col("row_key").alias(key), F.col("cleaned").alias(text), (F.col("n_removed") == F.col("n_words")).alias(emptied)).distinct()
    joined = df.join(changed, row_key(id_col, text_col) == F.col(key), "left").where(f"{emptied} IS NULL OR NOT {emptied}")
    new = {text_col: F.coalesce(F.col(text), F.col(text_col))}
    if size_col in df.columns:
        new[size_col] = F.when(F.col(key).isNull(), F.col(size_col)).otherwise(F.char_length(text).cast(df.schema[size_col].dataType))
    return joined.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])
