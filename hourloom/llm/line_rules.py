"""Line-first cleaning: rules judge every line, failed lines go, and a document that
loses too much of its text is rejected.

Defined results: a null text has no words (all counts 0, failed by the base rule, cleaned
text null); an empty text likewise with cleaned text ''. Every input row gives one output
row, repeated rows included; null ids pass through. Only the id and text columns are read,
so other columns cannot clash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import WordHashes, as_bytes, grams, map_rows, slices, spans_mask

SYMBOLS = b"#*$%&|<>"

# Rules of a line, named as they are reported.
#   symbols      at least this many symbol characters, and this share of words carrying one
#   navigation   separators between short entries, as menus and breadcrumbs have them
#   boilerplate  fixed phrases of site furniture
#   shouting     words in capitals ending in exclamation marks
#   repetition   few distinct words for the line's length
SYMBOL_WORDS_PER_100 = 30
SHOUTED_WORDS_PER_100 = 50
DISTINCT_WORDS_PER_100 = 30
REPETITION_FROM_WORDS = 12
SEPARATOR_WORDS_PER_100 = 20
# Phrases of site furniture.
BOILERPLATE = (
    b"accept cookies", b"all rights reserved", b"click here", b"cookie policy", b"enable javascript",
    b"lorem ipsum", b"privacy policy", b"sign in to", b"subscribe to our newsletter", b"terms of use",
)

_BOILERPLATE = re.compile(b"|".join(map(re.escape, BOILERPLATE)))
_SEPARATORS = frozenset((b"|", b">", b">>", b"\xc2\xbb", b"\xc2\xb7", b"\xe2\x80\xba"))
_HAS_SEPARATOR = re.compile(b"|".join(map(re.escape, sorted(_SEPARATORS))))
_HAS_SYMBOL = re.compile(b"[" + re.escape(SYMBOLS) + b"]")
_SHOUTED = re.compile(rb"[^a-z!]*!!+[.,]?\Z")


def failed_rule(line: bytes) -> str | None:
    """The first rule that a line breaks; blank lines break none."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    if _HAS_SEPARATOR.search(line):
        separators = sum(w in _SEPARATORS for w in words)
        if separators >= 2 and 100 * separators >= SEPARATOR_WORDS_PER_100 * n:
            return "navigation"
    if _HAS_SYMBOL.search(line):
        if 100 * sum(_HAS_SYMBOL.search(w) is not None for w in words) >= SYMBOL_WORDS_PER_100 * n:
            return "symbols"
    if line.count(b"!!") and 100 * sum(_SHOUTED.match(w) is not None for w in words) >= SHOUTED_WORDS_PER_100 * n:
        return "shouting"
    if _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    if n >= REPETITION_FROM_WORDS and 100 * len(set(words)) < DISTINCT_WORDS_PER_100 * n:
        return "repetition"
    return None


def _repeat_words(hashes: np.ndarray) -> int:
    """Positions inside a 3-word window that occurs at least twice in the text."""
    windows = grams(hashes, 3)
    if not len(windows):
        return 0
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    return int(spans_mask(starts, 3, len(hashes)).sum()) if len(starts) else 0


def _measured(text: bytes, hashes: WordHashes):
    words = text.split()
    chars = len(str(b"".join(words), "utf-8", "replace"))
    seen: set[bytes] = set()
    again = 0
    kept: list[bytes] = []
    failed: dict[str, int] = {}
    lost = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                again += 1
            seen.add(line)
        rule = failed_rule(line)
        if rule:
            failed[rule] = failed.get(rule, 0) + 1
            lost += len(line.split())
        else:
            kept.append(line)
    return (len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), again,
            _repeat_words(hashes.of(words)), lost, failed, b"\n".join(kept))


SCHEMA = """{id} {id_type}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,
n_repeat_words bigint, n_lost_words bigint, failed_lines map<string, int>, cleaned string"""


def line_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
               max_lost_per_100: int = 50, min_words: int = 50) -> DataFrame:
    """One row per input row: counts, lines failed by each rule, cleaned text, verdicts.

    ``kept`` is false if the base rule fails (fewer than ``min_words`` words, or over half
    of them in repeated 3-word windows) or if more than ``max_lost_per_100`` of 100 words
    stood in failed lines. Map-only: one scan, no shuffle.
    """
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            out = [(0, 0, 0, 0, 0, 0, {}, None) if t is None else _measured(t, hashes) for t in as_bytes(batch.column(1))]
            cols = list(zip(*out)) if out else [()] * 8
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:6]],
                      pa.array([list(m.items()) for m in cols[6]], pa.map_(pa.string(), pa.int32())),
                      pa.array(cols[7], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                      "n_repeat_words", "n_lost_words", "failed_lines", "cleaned"])

    measured = map_rows(rows, run, SCHEMA.format(id=f"`{id_col}`", id_type=id_type))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumns({
        "base_failed": base,
        "kept": ~base & (100 * F.col("n_lost_words") <= max_lost_per_100 * F.col("n_words")),
    })
