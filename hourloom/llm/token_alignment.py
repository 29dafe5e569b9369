"""Alignment of two tokenizers' tokens on the same text, by diagonal run skipping.

Both encodings of a text are arrays of end offsets in bytes. While token ``i`` of one and
``i + shift`` of the other end together, the walk jumps: it compares 1, 2, 4, ... further ends
at the current shift and narrows the last, failed jump by halves. Where ends differ, the group
up to the next common end is resolved token by token, and the shift follows from its sizes.

Each text is encoded once. Texts are dealt to blocks of bounded bytes; a block lists its distinct
linked id pairs once, with the number of its documents that hold each, and its documents refer to
that list. Spark adds up the counts of a pair over all blocks, finds each first id's highest, and
sends every block the counts of the pairs it lists: the exchange grows with blocks times
vocabulary, not with links. A pair that every block has combines map-side, and its join is a
merge join, which AQE splits.

The first tokenizer is a byte-level BPE (its JSON file), the second a sentencepiece model; both
files are read by the driver and broadcast (a few MB). Texts of Latin letters are encoded with the
same ranks by a faster library; the tests hold both equal.

Defined results: null and empty texts, and texts that either tokenizer does not give back byte by
byte (a normalised character, say), have no tokens: zeros and an empty digest. Every input row
gives one output row, repeated rows count as documents of their own, null ids stay null. An empty
table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Tables, as_bytes, slices, written

# Bytes of text in a block.
BLOCK_BYTES = 1 << 22

# The split pattern that byte-level BPE files of this kind mean by "ByteLevel".
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Outside Latin, classes may differ between Unicode versions; long unbroken runs are slow in the faster library.
LONGEST_RUN = 1000
_NOT_LATIN = re.compile("[^\x00-ɏ]")
_SPACES = re.compile(r"\s{%d}" % LONGEST_RUN)


def _plain(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        if _NOT_LATIN.search(text):
            return False
    return max(map(len, text.split(" "))) < LONGEST_RUN and not _SPACES.search(text)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable bytes stand for
    themselves, the others for U+0100 onwards in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """Token ids of a byte-level BPE file, special strings read as plain text, and each id's bytes."""

    def __init__(self, text: str):
        import tiktoken
        import tokenizers

        self.slow = tokenizers.Tokenizer.from_str(text)
        self.slow.encode_special_tokens = True
        symbol, vocabulary = byte_symbols(), json.loads(text)["model"]["vocab"]
        ranks = {bytes(symbol[c] for c in token): i for token, i in vocabulary.items()}
        self.bytes = [b""] * (max(self.slow.get_vocab().values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.fast = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def decode(self, ids: list[int]) -> bytes:
        return self.fast.decode_bytes(ids)

    def encode(self, text: str) -> list[int]:
        if _plain(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


class PieceModel:
    """Token ids of a sentencepiece model (which puts a space before the text) and each id's bytes."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def encode(self, text: str) -> np.ndarray:
        return self.model.EncodeAsNumpy(text)


class TokenizerPair:
    """Both encodings of texts."""

    def __init__(self, bpe: str, pieces: bytes):
        self.first, self.second = ByteBpe(bpe), PieceModel(pieces)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, list[int], list[int]] | None:
        """(ids, ids, ends, ends), or None if either does not give the text back byte by byte."""
        target = b" " + text.encode()
        ids_a, ids_b = self.first.encode(" " + text), self.second.encode(text)
        if self.first.decode(ids_a) != target or self.second.decode(ids_b) != target:
            return None
        ids_a, ids_b = np.array(ids_a, np.int64), ids_b.astype(np.int64)
        return ids_a, ids_b, np.cumsum(self.first.lengths[ids_a]).tolist(), np.cumsum(self.second.lengths[ids_b]).tolist()


@lru_cache(maxsize=1)
def _encoders(bpe: str, pieces: bytes) -> TokenizerPair:
    return TokenizerPair(bpe, pieces)


def skip_runs(ends_a: list[int], ends_b: list[int]) -> tuple[list[tuple[int, int, bool]], list[int], list[int]]:
    """Segments (first i, first j, whether a one-to-one stretch), each up to the next one, and the links
    of the other segments, the irregular groups, as positions i and positions j.

    Both arrays are ascending and end at the same offset."""
    segments, links_a, links_b = [], [], []
    i = j = 0
    n = len(ends_a)
    while i < n:
        a, b = ends_a[i], ends_b[j]
        if a == b:
            segments.append((i, j, True))
            i += 1
            j += 1
            step = 1
            while (ahead := ends_a[i:i + step]) and ahead == ends_b[j:j + step]:
                i += len(ahead)
                j += len(ahead)
                step *= 2
            while step > 1:
                step //= 2
                ahead = ends_a[i:i + step]
                if len(ahead) == step and ahead == ends_b[j:j + step]:
                    i += step
                    j += step
        else:
            segments.append((i, j, False))
            links_a.append(i)
            links_b.append(j)
            while a != b:
                if a < b:
                    i += 1
                    a = ends_a[i]
                else:
                    j += 1
                    b = ends_b[j]
                links_a.append(i)
                links_b.append(j)
            i += 1
            j += 1
    return segments, links_a, links_b


class Alignment:
    """Groups and links of one text."""

    def __init__(self, ids_a, ids_b, ends_a: list[int], ends_b: list[int]):
        self.ids_a, self.ids_b = np.asarray(ids_a, np.int64), np.asarray(ids_b, np.int64)
        self.segments, self.links_a, self.links_b = skip_runs(ends_a, ends_b)
        self.bounds = bounds = np.array([*chain.from_iterable(self.segments), len(ids_a), len(ids_b), False], np.int64).reshape(-1, 3)
        self.stretch = bounds[:-1, 2] == 1
        self.first_a, self.first_b = bounds[:-1, 0][self.stretch], bounds[:-1, 1][self.stretch]
        self.length = np.diff(bounds[:, 0])[self.stretch]
        self.n_groups = int(self.length.sum()) + int((~self.stretch).sum())

    def linked(self) -> tuple[np.ndarray, np.ndarray]:
        """Token positions of all links: those of the stretches, then those of irregular groups."""
        length = self.length
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        return (np.concatenate([np.repeat(self.first_a, length) + step, np.array(self.links_a, np.int64)]),
                np.concatenate([np.repeat(self.first_b, length) + step, np.array(self.links_b, np.int64)]))

    def text(self, names: "GroupNames") -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group in order."""
        n, m = len(self.ids_a), len(self.ids_b)
        last_a, last_b = self._last(0, n), self._last(1, m)
        end_a, end_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        # Where each token stands: after all tokens of earlier groups, the second tokenizer's after the first's.
        out = np.empty(n + m, np.int64)
        out[np.arange(n) + np.repeat(np.r_[0, end_b[:-1]], np.diff(end_a, prepend=0))] = 2 * self.ids_a + last_a
        out[np.arange(m) + np.repeat(end_a, np.diff(end_b, prepend=0))] = 2 * self.ids_b + last_b + 2 * names.n
        return names.table.take(out).tobytes().translate(None, b"\0")[:-1]

    def _last(self, side: int, n: int) -> np.ndarray:
        """Which tokens end their group: all in stretches, the last one of an irregular group."""
        flags = np.ones(n, bool)
        starts, ends = self.bounds[:-1, side][~self.stretch], self.bounds[1:, side][~self.stretch]
        size = ends - starts - 1
        flags[np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = False
        return flags


class GroupNames:
    """Ids in decimal with what follows them: inside a group, at the end of its first side, of its second.
    Filled up with zeros to 8 bytes (or a multiple), which are copied as one number."""

    def __init__(self, n: int):
        self.n = n
        names = np.array([f"{i}{mark}" for end in ("|", ";") for i in range(n) for mark in (",", end)], "S")
        self.table = names.astype(f"S{-(-names.itemsize // 8) * 8}")


_BLOCK_SCHEMA = ("_block bigint, _id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
                 "_links array<int>, _times array<int>, _pairs array<bigint>, _docs array<int>")


def _blocks(df: DataFrame, id_col: str, text_col: str, bpe: str, pieces: bytes, block_bytes: int) -> DataFrame:
    """A row per document (its links as steps along the block's list of pairs) and one per block with that list."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = _BLOCK_SCHEMA.format(id_type=rows.schema["_id"].dataType.simpleString())
    shipped = df.sparkSession.sparkContext.broadcast((bpe, pieces))

    def run(batches):
        both = _encoders(*shipped.value)
        width = len(both.second.bytes)
        names = GroupNames(max(len(both.first.bytes), width))
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, most=block_bytes):
            out, codes, known = [], [], {}
            for raw in as_bytes(batch.column(1)):
                if raw in known:  # a copy within the block
                    out.append(out[known[raw]])
                    codes.append(codes[known[raw]])
                    continue
                known[raw] = len(out)
                row, code = (0, 0, 0, 0, ""), np.zeros(0, np.int64)
                if raw and (encoded := both.encode(raw.decode())):
                    ids_a, ids_b, ends_a, ends_b = encoded
                    found = Alignment(ids_a, ids_b, ends_a, ends_b)
                    at_a, at_b = found.linked()
                    code = found.ids_a[at_a] * width + found.ids_b[at_b]
                    row = (len(ids_a), len(ids_b), found.n_groups, len(code), hashlib.sha256(found.text(names)).hexdigest())
                out.append(row)
                codes.append(np.unique(code, return_counts=True))
            pairs, docs = np.unique(np.concatenate([c for c, _ in codes]), return_counts=True)
            steps = [np.diff(np.searchsorted(pairs, c), prepend=0).astype(np.int32) for c, _ in codes]
            offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in steps])].astype(np.int32))
            n, none = len(out), pa.nulls(len(out))
            columns = [pa.array(np.full(n, block)), batch.column(0), *(pa.array([r[k] for r in out], pa.int64()) for k in range(4)),
                       pa.array([r[4] for r in out], pa.string()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(steps))),
                       pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([t for _, t in codes]).astype(np.int32))),
                       none.cast(pa.list_(pa.int64())), none.cast(pa.list_(pa.int32()))]
            names_ = ["_block", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_links", "_times", "_pairs", "_docs"]
            documents = pa.RecordBatch.from_arrays(columns, names_)
            yield documents
            listed = {"_block": pa.array([block]), "_pairs": pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(pairs)),
                      "_docs": pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(docs.astype(np.int32)))}
            yield pa.RecordBatch.from_arrays([listed.get(f.name, pa.nulls(1, f.type)) for f in documents.schema], names_)
            block += 1

    return rows.mapInArrow(run, schema), len(_encoders(bpe, pieces).second.bytes)


def _judged(key, documents: pa.Table, counted: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's documents from the counts of its pairs."""
    order = np.argsort(counted.column("_at").to_numpy())
    count = counted.column("_count").to_numpy()[order]
    best = counted.column("_best").to_numpy()[order]
    links, times = documents.column("_links").combine_chunks(), documents.column("_times").combine_chunks()
    sizes = links.value_lengths().to_numpy()
    steps, starts = links.flatten().to_numpy().astype(np.int64), np.cumsum(sizes) - sizes
    run = np.cumsum(steps)
    before = np.r_[0, run][starts]  # sum of the steps of all documents before
    at = run - np.repeat(before, sizes)
    weight = times.flatten().to_numpy().astype(np.int64)
    n_best = np.add.reduceat(np.r_[weight * best[at], 0], np.minimum(starts, len(at))) if len(sizes) else np.zeros(0, np.int64)
    total = np.add.reduceat(np.r_[weight * count[at], 0], np.minimum(starts, len(at))) if len(sizes) else np.zeros(0, np.int64)
    kept = documents.select(["_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return (kept.append_column("n_best", pa.array(np.where(sizes > 0, n_best, 0).astype(np.int64)))
            .append_column("count_sum", pa.array(np.where(sizes > 0, total, 0).astype(np.int64))))


def align_tokens(df: DataFrame, bpe: str, pieces: bytes, id_col: str = "doc_id", text_col: str = "text", *,
                 block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) for the byte-level BPE file ``bpe`` and the sentencepiece model ``pieces``.

    documents: id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.
    pairs: a, b, n_docs (documents that hold the pair linked) and best (whether no pair of ``a`` has more).
    """
    tables = Tables(df.sparkSession)
    found, width = _blocks(df, id_col, text_col, bpe, pieces, block_bytes)
    blocks = written(found, "aligned")
    listed = blocks.where("_pairs IS NOT NULL").select("_block", F.posexplode(F.arrays_zip("_pairs", "_docs")).alias("_at", "_z")).select(
        "_block", "_at", F.col("_z._pairs").alias("_pair"), F.col("_z._docs").alias("_n"))
    a = F.expr(f"_pair div {width}")
    pairs = tables.written(listed.groupBy("_pair").agg(F.sum("_n").alias("_count")), "pair-counts")
    # One row per id of the first vocabulary.
    top = pairs.groupBy(a.alias("_a")).agg(F.max("_count").alias("_top"))
    judged = written(pairs.withColumn("_a", a).join(F.broadcast(top), "_a").select("_pair", "_a", "_count", (F.col("_count") == F.col("_top")).alias("_best")), "pairs")
    tables.drop()
    counted = listed.join(judged.select("_pair", "_count", "_best").hint("merge"), "_pair").select(F.col("_block").alias("_home"), "_at", "_count", "_best")
    documents = blocks.where("_pairs IS NULL").drop("_pairs", "_docs")
    id_type = blocks.schema["_id"].dataType.simpleString()
    out = documents.groupBy("_block").cogroup(counted.groupBy("_home")).applyInArrow(
        _judged, f"_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint")
    return (out.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"),
            judged.select(F.col("_a").cast("int").alias("a"), F.expr(f"cast(_pair % {width} as int)").alias("b"), F.col("_count").alias("n_docs"), F.col("_best").alias("best")))


def read_models(bpe_path: str, pieces_path: str) -> tuple[str, bytes]:
    with open(bpe_path, encoding="utf-8") as bpe, open(pieces_path, "rb") as pieces:
        return bpe.read(), pieces.read()
