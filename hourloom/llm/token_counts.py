"""Token counts under a unigram model, shared over a trie of pre-tokens.

The distinct pre-tokens of a batch (a run of non-spaces with at most one space before it, or a
run of spaces) are put in order, which walks their trie depth first: the best score of each
prefix is computed once and kept while later pre-tokens share that prefix; the piece count at
each terminal is stored and summed over documents.

Piece scores follow the vocabulary's ranks by Zipf's law; a vocabulary is read, never trained.
Ties between segmentations go to the shorter last piece.

Defined results: null and empty texts have 0 tokens. Every input row gives one output row;
only the id and text columns are read.
"""

from __future__ import annotations

import base64
import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import as_bytes, map_rows, slices

PRE_TOKEN = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+?(?= [^\x20\x09-\x0D])|[\x20\x09-\x0D]+")
# Pre-tokens whose counts one Python worker remembers before it starts afresh.
REMEMBERED = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a tiktoken-style file: base64 piece, space, rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Natural log of 1 / ((rank + 1) * H), the Zipf share of each rank."""
    total = sum(1.0 / (r + 1) for r in ranks.values())
    return {piece: -math.log((r + 1) * total) for piece, r in ranks.items()}


class TrieCounter(dict):
    """Pre-token -> number of pieces of its best segmentation."""

    def __init__(self, scores: dict[bytes, float]):
        super().__init__()
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.missing = min(scores.values(), default=0.0) - 10.0

    def learn(self, tokens: set[bytes]) -> None:
        """Score ``tokens`` in order, reusing the forward scores of the prefix shared with the last one."""
        get, longest = self.scores.get, self.longest
        best, pieces, last = [0.0], [0], b""
        for token in sorted(tokens):
            shared = 0
            for a, b in zip(last, token):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], pieces[shared + 1:]
            for end in range(shared + 1, len(token) + 1):
                # An unknown byte stands as a piece of its own at a low score.
                top, count = best[end - 1] + get(token[end - 1:end], self.missing), pieces[end - 1] + 1
                for start in range(end - 2, max(-1, end - longest - 1), -1):
                    score = get(token[start:end])
                    if score is not None and best[start] + score > top:
                        top, count = best[start] + score, pieces[start] + 1
                best.append(top)
                pieces.append(count)
            self[token] = pieces[-1]
            last = token


def token_counts(df: DataFrame, scores: dict[bytes, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Map-only: id, n_pretokens and n_tokens of every row."""
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    id_type = rows.schema[0].dataType.simpleString()
    shipped = df.sparkSession.sparkContext.broadcast(scores)  # bounded by the vocabulary

    def run(batches):
        counter = TrieCounter(shipped.value)
        for batch in slices(batches):
            split = [PRE_TOKEN.findall(t) if t else [] for t in as_bytes(batch.column(1))]
            new = set(chain.from_iterable(split)).difference(counter)
            if len(counter) + len(new) > REMEMBERED:
                counter.clear()
                new = set(chain.from_iterable(split))
            counter.learn(new)
            totals = [sum(map(counter.__getitem__, s)) for s in split]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.fromiter(map(len, split), np.int64, len(split))), pa.array(totals, pa.int64())],
                [id_col, "n_pretokens", "n_tokens"])

    return map_rows(rows, run, f"`{id_col}` {id_type}, n_pretokens bigint, n_tokens bigint")
