"""Jaccard join of documents on word n-grams by a token-group matrix, exact.

Documents with the same n-gram set are one set. Similar sets are partitioned into groups by
their smallest hashed n-gram, groups into chunks of bounded size, and chunks, once their own links
are counted, into cells: the connected sets of a chunk. The matrix holds which group's token union
has which token; only tokens that the prefix bound makes necessary are stored: of two sets that
link, both hold at least ``SHARE`` common ones among their first tokens in one global order, and
each of these stands where enough tokens follow for the overlap still needed. Groups are bounded
against each other by the tokens shared with a union, by sizes and by those places; a qualifying
chunk is opened, and there a query's overlap with each member is counted, exactly.

Only links matter: one set of each cell first asks the largest cell of its tokens, and then only
cells of different components ask, the smaller one the larger one's chunk. No link between
different texts can be lost: every pair that passes the bounds is either counted or already
connected. Joins hold a row per cell, token and chunk, never all pairs of cells.

The order puts tokens that many documents of one task share last (a bounded list, by count); it
only decides how many candidates there are, not the result. Tokens and sets are told apart by
64-bit hashes.

Defined results: null, empty and blank texts have no n-grams and link with nothing. Every input
row gives one output row; repeated rows share their result. Null ids link through their text but
are never the smallest id unless alone. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .text import Tables, WordHashes, as_bytes, grams, mixed, row_key, slices, unused, written

SHARE = 3
CHUNK = 128
QUERIES_PER_OPENING = 512
# Most tokens in the list that orders common tokens last, and the count from which a task reports one.
COMMON_TOKENS = 1 << 17
REPORTED_FROM = 6

_GROUP_SALT = np.uint64(0x5851F42D4C957F2D)


def token_set(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-gram hashes, ascending; a shorter text is one token, no words are none."""
    if len(words) < n:
        return grams(words, len(words)) if len(words) else words
    return np.unique(grams(words, n))


def _sets(texts: list[bytes | None], hashes: WordHashes, n: int) -> list[np.ndarray]:
    return [token_set(hashes.of((t or b"").lower().split()), n) for t in texts]


def common_tokens(rows: DataFrame, n: int, most: int = COMMON_TOKENS) -> np.ndarray:
    """Tokens that tasks see in many documents, the most frequent first, at most ``most``."""

    def run(batches):
        hashes = WordHashes()
        tokens, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in slices(batches, column=0):
            found, times = np.unique(np.concatenate(_sets(as_bytes(batch.column(0)), hashes, n)), return_counts=True)
            again = times > 1
            tokens, where = np.unique(np.r_[tokens, found[again]], return_inverse=True)
            counts = np.bincount(where, np.r_[counts, times[again]], len(tokens)).astype(np.int64)
        keep = counts >= REPORTED_FROM
        yield pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(counts[keep])], ["token", "n"])

    reported = rows.select("_text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = reported.orderBy(F.desc("n"), "token").limit(most).select("token").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def _prefixes(rows: DataFrame, n: int, per_100: int, common) -> DataFrame:
    """Per row: size, set hash, group and the tokens that the prefix bound needs."""
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(batches):
        hashes, late = WordHashes(), common.value
        for batch in slices(batches, column=2):
            sizes, names, groups, firsts = [], [], [], []
            for tokens in _sets(as_bytes(batch.column(2)), hashes, n):
                size = len(tokens)
                need = -(-per_100 * size // 100)  # overlap that any partner needs
                length = size - need + min(SHARE, need)
                if size and len(late):
                    spot = np.minimum(np.searchsorted(late, tokens), len(late) - 1)
                    is_late = late[spot] == tokens
                    ordered = np.concatenate([tokens[~is_late][:length], tokens[is_late]])[:length]
                else:
                    ordered = tokens[:length]
                sizes.append(size)
                names.append(int(mixed(tokens).sum(dtype=np.uint64)))
                groups.append(int(mixed(tokens ^ _GROUP_SALT).min()) if size else 0)
                firsts.append(ordered)
            joined = np.concatenate(firsts).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()),
                 pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(np.array(groups, np.uint64).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(f) for f in firsts])].astype(np.int32)), pa.array(joined))],
                ["_row", "_id", "_size", "_set", "_group", "_first"])

    return rows.mapInArrow(run, f"_row bigint, _id {id_type}, _size int, _set bigint, _group bigint, _first array<bigint>")


class Chunk:
    """Postings of the members of a chunk, to count a query's overlap with all of them at once."""

    def __init__(self, members: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, members), np.int64, len(members))
        tokens = np.concatenate(members)
        order = np.argsort(tokens, kind="stable")
        self.owner = np.repeat(np.arange(len(members)), self.sizes)[order]
        self.union, self.start, self.count = np.unique(tokens[order], return_index=True, return_counts=True)

    def linked(self, query: np.ndarray, per_100: int) -> np.ndarray:
        spot = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        spot = spot[self.union[spot] == query]
        # The bound: not even the whole union overlaps the query enough.
        if 100 * len(spot) < per_100 * len(query):
            return np.zeros(0, np.int64)
        count = self.count[spot]
        at = np.repeat(self.start[spot] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        overlap = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * overlap >= per_100 * (len(query) + self.sizes - overlap))


def _roots(pairs: list[tuple[int, int]], n: int) -> list[int]:
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def _inside(members: DataFrame, n: int, per_100: int) -> DataFrame:
    """(_set, _label) of every member: its chunk's component, named by one of its sets."""

    def run(table_: pa.Table) -> pa.Table:
        names = table_.column("_set").to_pylist()
        sets = _sets(as_bytes(table_.column("_text").combine_chunks()), WordHashes(), n)
        chunk = Chunk(sets)
        root = _roots([(i, int(j)) for i, s in enumerate(sets) for j in chunk.linked(s, per_100) if j > i], len(sets))
        return pa.table({"_set": pa.array(names, pa.int64()), "_label": pa.array([names[r] for r in root], pa.int64())})

    return members.groupBy("_chunk").applyInArrow(run, "_set bigint, _label bigint")


def _opened(openings: DataFrame, members: DataFrame, texts: DataFrame, n: int, per_100: int, tables: Tables) -> DataFrame:
    """(a, b) labels linked by counting queries (_set, _label, _chunk) against members (_set, _label, _chunk).

    A chunk with many queries is opened in several places, each with a bounded part of them."""
    parts = tables.written(openings.groupBy("_chunk").agg(F.ceil(F.count("*") / QUERIES_PER_OPENING).cast("int").alias("_parts")), "openings")
    asks = openings.join(parts, "_chunk").select("_set", "_label", "_chunk", F.pmod(F.xxhash64("_set"), F.col("_parts")).cast("int").alias("_part"), F.lit(True).alias("_asks"))
    holds = members.join(parts, "_chunk").select("_set", "_label", "_chunk", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(False).alias("_asks"))

    def run(table_: pa.Table) -> pa.Table:
        sets = _sets(as_bytes(table_.column("_text").combine_chunks()), WordHashes(), n)
        labels, asks_ = table_.column("_label").to_pylist(), table_.column("_asks").to_pylist()
        held = [i for i, q in enumerate(asks_) if not q]
        found = set()
        if held:
            chunk = Chunk([sets[i] for i in held])
            for i, q in enumerate(asks_):
                if q:
                    found.update((labels[i], labels[held[j]]) for j in chunk.linked(sets[i], per_100))
        found = [(a, b) for a, b in found if a != b]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return (asks.unionByName(holds).join(texts, "_set").groupBy("_chunk", "_part")
            .applyInArrow(run, "a bigint, b bigint"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5, per_100: int = 80,
                       chunk: int = CHUNK) -> DataFrame:
    """One row per input row: id, row_key, n_shingles, component_id (the smallest id reachable by links)
    and component_row (row_key of the row with that id; of equal ids the smallest).

    Two rows link when 100 * intersection >= ``per_100`` * union of their distinct word ``n``-grams
    (words split at ASCII white space, A-Z lowered).
    """
    spark = df.sparkSession
    rows = df.select(row_key(id_col, text_col).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    tables = Tables(spark)
    written = tables.written  # dropped at the end, unless kept
    common = spark.sparkContext.broadcast(common_tokens(rows, n))  # at most COMMON_TOKENS values
    seen = written(_prefixes(rows, n, per_100, common), "prefixes")

    full = seen.where("_size > 0")
    large = written(full.groupBy("_group").agg(F.count_distinct("_set").alias("_sets")).where(F.col("_sets") > chunk), "large-groups")
    part = F.pmod(F.xxhash64("_set"), F.ceil(F.col("_sets") / chunk).cast("bigint"))
    chunked = full.join(large, "_group", "left").select(
        "_row", "_set", "_size", "_first", F.when(F.col("_sets").isNull(), F.col("_group")).otherwise(F.xxhash64("_group", part)).alias("_chunk"))

    # The matrix: tokens that stand in the unions of two chunks or more. These joins are merge joins
    # at every size, so that AQE can split a token or chunk that very many rows have.
    # _left: how many of a set's tokens stand from this one on, in the global order.
    entries = chunked.select("_set", "_size", "_chunk", F.posexplode("_first").alias("_at", "_token")).withColumn("_left", F.col("_size") - F.col("_at"))
    wide = written(entries.groupBy("_token").agg(F.min("_chunk").alias("_low"), F.max("_chunk").alias("_high"))
                   .where("_low < _high").select("_token"), "wide-tokens")
    matrix = written(entries.join(wide.hint("merge"), "_token").groupBy("_token", "_chunk", "_set").agg(
        F.first("_size").alias("_size"), F.first("_left").alias("_left")), "matrix")
    spread = [F.min("_size").alias("_low"), F.max("_size").alias("_high"), F.max("_left").alias("_left")]
    unions = written(matrix.groupBy("_token", "_chunk").agg(*spread), "unions")
    # Sizes fit, and so do places: the first SHARE common tokens of two sets stand where, in either, as
    # many tokens follow as the overlap still needs. The least need of any two sets decides.
    asking = [F.col("_low").alias("_from"), F.col("_high").alias("_to"), F.col("_left").alias("_mine")]
    larger = lambda x, y: F.greatest(F.col(x), F.ceil(per_100 * F.col(y) / 100))
    need = F.ceil(per_100 * (larger("_from", "_low") + larger("_low", "_from")) / (100 + per_100))
    fits = ((100 * F.col("_high") >= per_100 * F.col("_from")) & (100 * F.col("_to") >= per_100 * F.col("_low"))
            & (F.least("_mine", "_left") + (SHARE - 1) >= need))
    share = F.least(F.lit(SHARE), F.ceil(F.col("_from") * per_100 / 100))
    # First bound, union against union: what no two members can pass, no query needs to ask.
    pairs = written(unions.select("_token", F.col("_chunk").alias("_own"), *asking)
                    .join(unions, "_token").where("_own < _chunk").where(fits)
                    .groupBy("_own", "_chunk").agg(F.count("*").alias("_shared"), F.min("_from").alias("_from"))
                    .where(F.col("_shared") >= share).select("_own", "_chunk"), "qualifying")

    # Texts of the sets that are looked at: members of chunks of several sets, and of qualifying pairs.
    places = written(chunked.groupBy("_set").agg(F.min("_chunk").alias("_chunk"), F.min("_row").alias("_row")), "places")
    several = places.groupBy("_chunk").agg(F.count("*").alias("_n")).where("_n > 1").select("_chunk")
    busy = written(several.union(pairs.select("_chunk")).union(pairs.select("_own")).distinct(), "busy-chunks")
    looked = written(places.join(busy.hint("merge"), "_chunk"), "looked-at")
    texts = written(rows.join(looked.select("_row", "_set").hint("merge"), "_row").groupBy("_row", "_set").agg(F.first("_text").alias("_text")).drop("_row"), "texts")

    inside = written(_inside(looked.select("_set", "_chunk").join(texts.hint("merge"), "_set"), n, per_100), "inside")
    members = written(looked.select("_set", "_chunk").join(inside, "_set"), "members")

    # From here on a group is a cell: the sets of one component inside a chunk, under that set's name.
    # Its union holds only what connected sets hold, so a chunk of unrelated sets asks set by set.
    cells = written(matrix.join(inside.hint("merge"), "_set", "left").groupBy("_token", F.coalesce("_label", "_set").alias("_cell")).agg(
        F.min("_chunk").alias("_chunk"), F.count("*").alias("_n"), *spread), "cells")
    # The set that names a cell goes ahead, to the largest cell of each token: one row per cell and token.
    largest = cells.groupBy("_token").agg(F.max(F.struct("_n", "_cell", "_chunk")).alias("_top")).select("_token", F.col("_top._cell").alias("_at"), F.col("_top._chunk").alias("_to"))
    ahead = written(cells.join(largest.hint("merge"), "_token").where("_chunk <> _to").groupBy("_cell", "_at", "_to").agg(F.count("*").alias("_shared"))
                    .where(F.col("_shared") >= SHARE).select(F.col("_cell").alias("_set"), F.col("_cell").alias("_label"), F.col("_to").alias("_chunk")).distinct(), "ahead")
    found = written(_opened(ahead, members, texts, n, per_100, tables), "links-ahead")
    joined = components(found)
    # What is left: cells of different components that the bound lets pass. Tokens of one component drop
    # out. A cell asks a chunk with which it shares enough tokens where a larger cell of another component
    # stands (of two cells the smaller asks, by size and then by name): a row per cell, token and chunk.
    sizes = members.groupBy(F.col("_label").alias("_cell")).agg(F.count("*").alias("_sets"))
    named = cells.join(joined.withColumnRenamed("node", "_cell"), "_cell", "left").join(sizes, "_cell", "left").select(
        "_token", "_chunk", "_low", "_high", "_left", F.coalesce("component", "_cell").alias("_component"), F.struct(F.coalesce("_sets", F.lit(1)).alias("n"), "_cell").alias("_rank"))
    open_ = named.groupBy("_token").agg(F.min("_component").alias("_least"), F.max("_component").alias("_most")).where("_least < _most").select("_token")
    named = written(named.join(open_.hint("merge"), "_token"), "open-cells")
    # The largest cell in a chunk, and the largest one of any other component; a chunk has few cells.
    whole = [F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.max("_left").alias("_left")]
    ranked = named.groupBy("_token", "_chunk", "_component").agg(F.max("_rank").alias("_rank"), *whole)
    held = ranked.groupBy("_token", "_chunk").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("_rank", "_component")), False), 1, 2).alias("_top"), *whole)
    own = named.select("_token", F.col("_rank").alias("_own"), F.col("_chunk").alias("_at"), F.col("_component").alias("_a"), *asking)
    other = F.when(F.col("_top")[0]["_component"] != F.col("_a"), F.col("_top")[0]["_rank"]).otherwise(F.try_element_at("_top", F.lit(2))["_rank"])
    turns = written(own.join(held, "_token").where((F.col("_at") != F.col("_chunk")) & (other > F.col("_own")) & fits)
                    .groupBy(F.col("_own._cell").alias("_label"), "_chunk").agg(F.count("*").alias("_shared"), F.min("_from").alias("_from"))
                    .where(F.col("_shared") >= share).select("_label", "_chunk"), "turns")
    asks = members.drop("_chunk").join(turns, "_label")
    rest = written(asks.join(ahead.select("_set", "_chunk"), ["_set", "_chunk"], "left_anti"), "asking-late")
    if not rest.isEmpty():
        more = written(_opened(rest, members, texts, n, per_100, tables), "links-late")
        joined = components(found.union(more))

    classes = inside.join(joined, inside["_label"] == joined["node"], "left").select("_set", F.coalesce("component", "_label").alias("_class"))
    placed = written(seen.select("_row", "_id", "_size", "_set").join(classes, "_set", "left")
                     .withColumn("_class", F.when(F.col("_size") > 0, F.coalesce("_class", "_set"))), "classes", keep=True)
    least = written(placed.where("_size > 0").groupBy("_class").agg(F.min("_id").alias("_least"), F.min(F.struct(F.col("_id").isNull().alias("_no"), "_id", "_row"))["_row"].alias("_first_row"),
                                                                             F.count("*").alias("_n")).where("_n > 1").drop("_n"), "least-ids", keep=True)
    tables.drop()
    return placed.join(least, "_class", "left").select(
        F.col("_id").alias(id_col), F.col("_row").alias("row_key"), F.col("_size").cast("bigint").alias("n_shingles"),
        F.coalesce("_least", "_id").alias("component_id"), F.coalesce("_first_row", "_row").alias("component_row"))


def one_of_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5, per_100: int = 80) -> DataFrame:
    """``df`` with one row of each group of linked rows: that of the smallest id, null ids last, then of
    the smallest row key, then (of rows equal in id and text) of the smallest other columns. Rows
    without words stay. Columns of any name and type stay."""
    judged = jaccard_components(df, id_col, text_col, n=n, per_100=per_100).where("n_shingles > 0")
    # Rows that are equal in id and text share their key: of those that stay, only repeated keys are listed.
    listed = judged.groupBy("row_key", (F.col("row_key") == F.col("component_row")).alias("_stays")).agg(F.count("*").alias("_n"))
    verdict = written(listed.where("NOT _stays OR _n > 1").select("row_key", "_stays"), "near-verdict")
    at, gone, repeated = (unused(c, df.columns) for c in ("_row_key", "_gone_key", "_repeated_key"))
    keyed = df.withColumn(at, row_key(id_col, text_col))
    stays = keyed.join(verdict.select(F.col("row_key").alias(gone)), F.col(at) == F.col(gone), "left_anti").select(*df.columns)
    again = keyed.join(verdict.where("_stays").select(F.col("row_key").alias(repeated)), F.col(at) == F.col(repeated), "left_semi")
    # Maps have no order: their text decides.
    order = F.struct(*[F.to_json(c) if f.dataType.typeName() == "map" else F.col(c) for f, c in zip(df.schema, df.columns)])
    one = again.groupBy(at).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")
    return stays.unionByName(one)
