"""Benchmark decontamination: a hash set of normalised test windows is looked up in every
window of the training words; hits are verified word by word and spans or documents removed.

Built-in expressions only. Each test window is filed under its longest word. A document's
words are exploded inside one generated stage and probe those words; only probes that hit
leave it, and are then verified against all the window's words. While the test windows are
within ``broadcast_rows`` (counted, and at most 13 words each) they are broadcast; a larger
set is joined by shuffle.

Defined results: null and empty texts have no words and are clean. Items without words, null
or empty, match nothing. Every document row gives one output row; rows that repeat in id and
text get the same result, and rows that share only the id are judged apart. Repeated items
count once per item_id. Items with a null id are looked for and their hits count, but they are not
in the list of ids or its size. Only the named columns are read, so other names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, UPPER, row_key

WINDOW = 13
# Test windows that may be broadcast: 13 words each, some tens of MB.
BROADCAST_ROWS = 100_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the text after lowering A-Z; an empty array for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def test_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct (item, words) windows with the anchor: the longest word, the earliest of those."""
    words = items.select(F.col(id_col).alias("_item"), words_of(F.col(text_col)).alias("_all")).where("size(_all) > 0")
    width = F.least(F.lit(window), F.size("_all"))
    cut = words.select("_item", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("_all") - width + 1), lambda i: F.slice("_all", i, width))).alias("_window")).distinct()
    longest = F.array_max(F.transform("_window", lambda w: F.length(w)))
    at = F.array_position(F.transform("_window", lambda w: F.length(w)), longest).cast("int") - 1
    return cut.select("_item", "_window", at.alias("_offset"), F.element_at("_window", at + 1).alias("_anchor"), F.size("_window").alias("_width"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", *, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document row: id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans, row_key.

    ``hit_spans`` are the (start, width) spans, in words from 0, that hold a test window.
    A document is contaminated if hit words make up a twentieth of it or more.
    """
    windows = test_windows(items, item_id, item_text, window)
    # Windows of equal words are probed once; the items they stand for are attached after.
    grouped = windows.groupBy("_window", "_offset", "_anchor", "_width").agg(F.collect_set("_item").alias("_items"))
    probes = grouped.groupBy("_anchor").agg(F.collect_list(F.struct("_window", "_offset", "_width", "_items")).alias("_filed"))
    small = windows.limit(broadcast_rows + 1).count() <= broadcast_rows
    if small:
        probes = F.broadcast(probes)

    keyed = docs.select(F.col(doc_id), row_key(doc_id, text_col).alias("_row"), words_of(F.col(text_col)).alias("_words"))
    placed = keyed.select("_row", "_words", F.posexplode("_words").alias("_at", "_word"))
    start = F.col("_at") - F.col("_w._offset")
    if small:
        opened = placed.join(probes, placed["_word"] == probes["_anchor"]).select("_row", "_words", "_at", F.explode("_filed").alias("_w"))
        hits = (opened.where(start >= 0)
                .where(F.slice("_words", F.greatest(start, F.lit(0)) + 1, F.col("_w._width")) == F.col("_w._window"))
                .select("_row", start.alias("_start"), F.col("_w._width").alias("_width"), F.col("_w._items").alias("_items")))
    else:
        # The words do not travel with every probe: candidates meet their document once.
        probed = placed.drop("_words").join(probes, placed["_word"] == probes["_anchor"])
        filed = (probed.select("_row", "_at", F.explode("_filed").alias("_w")).where(start >= 0)
                 .groupBy("_row").agg(F.collect_list(F.struct(start.alias("_start"), "_w")).alias("_candidates")))
        met = keyed.dropDuplicates(["_row"]).select(F.col("_row").alias("_of"), "_words")
        true = F.filter("_candidates", lambda c: F.slice("_words", c._start + 1, c._w._width) == c._w._window)
        hits = (filed.join(met, filed["_row"] == met["_of"]).select("_row", F.explode(true).alias("_c"))
                .select("_row", F.col("_c._start").alias("_start"), F.col("_c._w._width").alias("_width"), F.col("_c._w._items").alias("_items")))
    # One document's hits at most meet here, and no more than it has words.
    found = hits.groupBy("_row").agg(
        F.array_sort(F.collect_set(F.struct("_start", "_width"))).alias("_spans"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("_items"))), lambda i: i.cast("string"))).alias("_ids"))
    covered = F.aggregate(
        "_spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x._start + x._width - F.greatest(s.end, x._start))).cast("bigint").alias("n"),
                              F.greatest(s.end, x._start + x._width).alias("end")),
        lambda s: s.n)
    result = found.select("_row", covered.alias("_hit"), F.size("_ids").cast("bigint").alias("_n_items"), F.array_join("_ids", ",").alias("_joined"), "_spans")
    base = docs.select(F.col(doc_id), row_key(doc_id, text_col).alias("_row"), F.size(words_of(F.col(text_col))).cast("bigint").alias("n_words"))
    joined = base.join(result, "_row", "left")
    n_hit = F.coalesce(F.col("_hit"), F.lit(0).cast("bigint"))
    return joined.select(
        F.col(doc_id), "n_words", n_hit.alias("n_hit"), F.coalesce("_n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.sha2(F.coalesce("_joined", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.col("_spans").alias("hit_spans"), F.col("_row").alias("row_key"))


def remove_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without its contaminated rows; all columns stay."""
    judged = contamination(docs, items, doc_id, text_col, **options)
    bad = judged.where("contaminated").select(F.col("row_key").alias("_bad")).distinct()
    return docs.join(bad, row_key(doc_id, text_col) == bad["_bad"], "left_anti")


SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bwin AS (SELECT DISTINCT item_id, least(13, len(w)) AS width, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM bw WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM bwin),
dwin AS (SELECT doc_id, i, width, array_to_string(w[i:i + width - 1], ' ') AS g
  FROM (SELECT doc_id, w, width, unnest(generate_series(1, len(w) - width + 1)) AS i FROM dw, widths WHERE len(w) >= width)),
hits AS (SELECT doc_id, item_id, i, d.width FROM dwin d JOIN bwin b ON d.g = b.g AND d.width = b.width),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + width - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN spots USING (doc_id) LEFT JOIN its USING (doc_id)"""
