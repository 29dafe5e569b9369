"""Grouping spelling variants: words at one edit, found by pivotal grams, lead to their frequent form.

Bigrams are ordered by how many words hold them, rarest first. The prefix of a word are its first
three in that order; one edit spoils at most two bigrams, and of two disjoint ones at most one. So
of two disjoint bigrams of a prefix (the pivots, chosen by dynamic programming to be as rare as
possible) one stays, and it stands in the prefix of the other word if that word's prefix ends no
earlier in the order. Of bigrams as common as the third, the next two count to the prefix as well:
an edit moves at most two others ahead.

Position limits: where a pivot stays, all of the word on one side of it stays at its distance from
that end, and of the other side one half does. The index key is the pivot with those parts; both
sides of the join list few keys per word, and Spark's edit distance verifies what meets. Pairs are
joined as a plain table by key, never gathered per bigram.

Words are counted in map tasks by blocks before the exchange. The bigrams of the alphabet (26 and
64 letters, at most 8,100) are counted over all words and broadcast.

Defined results: null and empty texts have no words; a null id reads as '' in the hash that spoils
words. Repeated rows count each. Ties for a form go to the smallest word by code points. An empty
table, or one without words, gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Tables, as_bytes, slices

SHORTEST = 7
# A letter is dropped from a run if this divides its hash, so that variants arise.
SPOILED = 31
# How much more frequent a form must be.
FORM_RATIO = 10
# Words whose counts one task holds before it hands them on.
HELD_WORDS = 1 << 17
EDITS, GRAM = 1, 2
PREFIX = EDITS * GRAM + 1


def _counted(shortest: int, spoiled: int):
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)

    def run(batches):
        held: Counter[str] = Counter()
        for batch in slices(batches):
            for name, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if not text:
                    continue
                seed = crc32(b"%s:" % (name or "").encode())
                for word, times in Counter(runs.findall(text.lower().decode())).items():
                    h = crc32(word.encode(), seed)
                    if h % spoiled == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < shortest:
                            continue
                    held[word] += times
                if len(held) >= HELD_WORDS:
                    yield _batch(held)
                    held.clear()
        yield _batch(held)

    def _batch(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return run


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shortest: int = SHORTEST, spoiled: int = SPOILED) -> DataFrame:
    """(word, n) of the letter runs of all texts, A-Z lowered; a run whose crc32 with the id is a
    multiple of ``spoiled`` lacks one letter."""
    rows = df.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_counted(shortest, spoiled), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def gram_order(words: DataFrame) -> dict[bytes, int]:
    """Rank of every bigram, by the number of its places in all words, then by its letters."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, GRAM))).alias("_gram"))
    counted = grams.groupBy("_gram").count().collect()  # at most 90 * 90 rows
    return {g.encode("latin-1"): k for k, (_, g) in enumerate(sorted((r["count"], r["_gram"]) for r in counted))}


def prefix_of(word: bytes, rank: dict[bytes, int]) -> tuple[list[tuple[int, int]], int]:
    """((rank, position) of the bigrams in the word's prefix, rank that the prefix ends with)."""
    order = sorted([(rank[word[p:p + GRAM]], p) for p in range(len(word) - 1)])
    last = order[PREFIX - 1][0]
    end = PREFIX
    while end < PREFIX + 2 * EDITS and end < len(order) and order[end][0] == last:
        end += 1
    return order[:end], last


def pivots_of(prefix: list[tuple[int, int]]) -> list[int]:
    """Positions of two disjoint bigrams of the prefix with the least sum of ranks.

    By position: the best single pivot that ends before each bigram, then the best pair."""
    places = sorted((p, r) for r, p in prefix)
    best_pair, best_one, waiting = None, None, []
    for p, r in places:
        while waiting and waiting[0][0] <= p - GRAM:
            q, s = waiting.pop(0)
            if best_one is None or s < best_one[0]:
                best_one = (s, q)
        if best_one is not None and (best_pair is None or best_one[0] + r < best_pair[0]):
            best_pair = (best_one[0] + r, best_one[1], p)
        waiting.append((p, r))
    return [best_pair[1], best_pair[2]]


def _keys(word: bytes, places: list[int], shifts: tuple[int, ...]) -> list[int]:
    """Hashed index keys of the bigrams at ``places``; ``shifts`` are the lengths, against its own, that
    the side with the edit may have in the other word."""
    size, out = len(word), set()
    digest = xxhash.xxh3_64_intdigest
    for p in places:
        end = p + GRAM
        # The edit is right of the bigram: all to its end stays, and the first or second half of the rest.
        rest = size - end
        for t in {rest + d for d in shifts}:
            if t >= 0:
                half = t // 2
                out.add(digest(b"a%d|" % end + word[:end + half]) if half <= rest else 0)
                out.add(digest(b"b%d|" % end + word[:end] + b"|" + word[size - (t - half):] if t - half else b"b%d|" % end + word[:end] + b"|") if t - half <= rest else 0)
        # The edit is left of it.
        for t in {p + d for d in shifts}:
            if t >= 0:
                half = t // 2
                out.add(digest(b"c%d|" % (size - p) + word[:half] + b"|" + word[p:]) if half <= p else 0)
                out.add(digest(b"d%d|" % (size - p) + word[p - (t - half):]) if t - half <= p else 0)
    out.discard(0)
    return list(out)


def _indexed(words: DataFrame, rank: dict[bytes, int], pivots: bool) -> DataFrame:
    """(word, n, _last, _key): a row per index key, of the pivots or of the whole prefix."""
    shipped = words.sparkSession.sparkContext.broadcast(rank)

    def run(batches):
        order = shipped.value
        for batch in batches:
            lasts, keys = [], []
            for word in batch.column(0).to_pylist():
                word = word.encode("latin-1")
                prefix, last = prefix_of(word, order)
                lasts.append(last)
                keys.append(_keys(word, pivots_of(prefix), (0,)) if pivots else _keys(word, [p for _, p in prefix], (-EDITS, 0, EDITS)))
            flat = np.fromiter((k for ks in keys for k in ks), np.uint64).view(np.int64)
            offsets = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lasts, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                                             ["word", "n", "_last", "_keys"])

    found = words.select("word", "n").mapInArrow(run, "word string, n bigint, _last int, _keys array<bigint>")
    return found.select("word", "n", "_last", F.explode("_keys").alias("_key"))


def near_words(words: DataFrame, tables: Tables) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of ``words`` (of at least 4 letters) at exactly one edit."""
    rank = gram_order(words)
    asks = _indexed(words, rank, True).select(F.col("word").alias("_a"), F.col("n").alias("_an"), F.col("_last").alias("_al"), "_key")
    holds = _indexed(words, rank, False).select(F.col("word").alias("_b"), F.col("n").alias("_bn"), F.col("_last").alias("_bl"), "_key")
    met = asks.join(holds.hint("merge"), "_key").where("_al <= _bl AND _a <> _b AND abs(char_length(_a) - char_length(_b)) <= 1")
    pairs = met.where(F.levenshtein("_a", "_b", EDITS) == EDITS)
    first = F.col("_a") < F.col("_b")
    one = F.struct(F.col("_a").alias("word"), F.col("_an").alias("n"))
    two = F.struct(F.col("_b").alias("word"), F.col("_bn").alias("n"))
    once = tables.written(pairs.select(F.when(first, one).otherwise(two).alias("_low"), F.when(first, two).otherwise(one).alias("_high")).distinct(), "near-words")
    return once.select(F.explode(F.array(F.struct(F.col("_low").alias("x"), F.col("_high").alias("y")), F.struct(F.col("_high").alias("x"), F.col("_low").alias("y")))).alias("_z")).select(
        F.col("_z.x.word").alias("word"), F.col("_z.x.n").alias("n"), F.col("_z.y.word").alias("near"), F.col("_z.y.n").alias("near_n"))


def roots_of(forms: DataFrame, tables: Tables) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by doubling the steps until none moves.

    A form is ``FORM_RATIO`` times as frequent, so chains have no circles and few steps."""
    ends = tables.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ends.select(F.col("word").alias("_at"), F.col("root").alias("_further"))
        ends = tables.written(ends.select("word", "root").join(further.hint("merge"), F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")), "roots")
        if ends.where("_moved").isEmpty():
            return ends.select("word", "root")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shortest: int = SHORTEST, spoiled: int = SPOILED,
                      least: int = 2, ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word with at least ``least`` occurrences.

    form: the most frequent word at one edit, if it is at least ``ratio`` times as frequent;
    root: the end of the chain of forms, or the word itself."""
    if shortest < 4 or ratio < 2:
        raise ValueError("words need 4 letters for a prefix, forms a ratio of 2")
    tables = Tables(df.sparkSession)
    words = tables.written(word_counts(df, id_col, text_col, shortest=shortest, spoiled=spoiled).where(F.col("n") >= least), "words")
    best = near_words(words, tables).groupBy("word").agg(
        F.count("*").alias("n_near"), F.max("n").alias("n"), F.min(F.struct((-F.col("near_n")).alias("_less"), F.col("near").alias("_word"))).alias("_top"))
    enough = -F.col("_top._less") >= ratio * F.col("n")
    judged = tables.written(best.select("word", "n_near", F.when(enough, F.col("_top._word")).alias("form"), F.when(enough, -F.col("_top._less")).alias("form_n")), "forms")
    roots = roots_of(judged.where("form IS NOT NULL"), tables)
    out = tables.written(words.join(judged.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"), "variants", keep=True)
    tables.drop()
    return out
