"""Secrets by fixed patterns, and by the formats inferred from them.

What the base patterns find are labelled credentials, by kind. Their formats (each letter or digit
stands for the character class of its segment, punctuation for itself) make a prefix tree; states
whose ends and next symbols are statistically compatible (Hoeffding bound, down their subtrees) are
merged into a probabilistic automaton, which keeps per transition the characters seen. Every other
candidate of every text is scored: log likelihood of its format and characters in a kind's
automaton, less that under a letter-pair model of all candidates of the corpus. A candidate above
the threshold of the best kind is a secret too; thresholds come from labelled credentials kept out
of the fit.

The automata learn from at most ``SAMPLE`` credentials a kind, of at most ``LONGEST`` characters,
chosen by hash; the letter pairs are counted over all documents. Both passes are map-only but for
that count, whose rows are bounded by the alphabet and by distinct credentials.

Defined results: a null text is empty; an empty text has no spans and an empty ``spans``. Every
input row gives one output row, repeated rows equal results; an empty table, or one without
credentials, adds nothing to the base. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Tables, slices

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]+(?:\.[A-Za-z0-9+/_-]+)*={0,2}")
SHORTEST = 6

SAMPLE = 2_000
LONGEST = 200
# Confidence of the compatibility test.
ALPHA = 0.05
# Weight of an end or character never seen in a state.
UNSEEN = 0.01
# Share of candidates taken to be secrets before looking at them.
PRIOR = 1e-6
# Candidates whose verdicts one Python worker remembers before it starts afresh.
REMEMBERED = 300_000

_SEGMENT = re.compile("[A-Za-z0-9]+")
_SIZES = {"d": 10, "h": 16, "H": 16, "l": 26, "u": 26, "c": 52, "a": 36, "A": 36, "m": 62}
_LOWER_HEX, _UPPER_HEX = set("0123456789abcdef"), set("0123456789ABCDEF")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) of the fixed patterns, by start, then kind as listed."""
    found = []
    lower = text.lower()
    if "pass" in lower or "secret" in lower or "token" in lower or "api" in lower:
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def _class_of(segment: str) -> str:
    if segment.isdigit():
        return "d"
    if segment.isalpha():
        return "l" if segment.islower() else "u" if segment.isupper() else "c"
    if segment.islower():
        return "h" if _LOWER_HEX.issuperset(segment) else "a"
    if segment.isupper():
        return "H" if _UPPER_HEX.issuperset(segment) else "A"
    return "m"


def format_of(value: str) -> str:
    """One symbol per character: the class of its run of letters and digits, or the character itself.
    Runs are taken whole, so that a random key has one class throughout."""
    return _SEGMENT.sub(lambda m: _class_of(m[0]) * len(m[0]), value)


class FormatAutomaton:
    """A probabilistic automaton over format symbols, merged from the prefix tree of labelled values."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.seen = [0]
        self.ends = [0]
        self.chars: list[dict[str, Counter]] = [{}]
        self.used: list[Counter] = [Counter()]
        for value in sorted(values):
            self._add(value)
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _state(self) -> int:
        self.next.append({})
        self.seen.append(0)
        self.ends.append(0)
        self.chars.append({})
        self.used.append(Counter())
        return len(self.next) - 1

    def _add(self, value: str) -> None:
        at = 0
        self.seen[0] += 1
        for symbol, char in zip(format_of(value), value):
            if symbol not in self.next[at]:
                self.next[at][symbol] = self._state()
            self.used[at][symbol] += 1
            self.chars[at].setdefault(symbol, Counter())[char] += 1
            at = self.next[at][symbol]
            self.seen[at] += 1
        self.ends[at] += 1

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(x / n - y / m) > self._bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether ends and next symbols of two states, and of the states they lead to, may be one distribution."""
        waiting, done = [(a, b)], set()
        while waiting:
            a, b = waiting.pop()
            if a == b or (a, b) in done:
                continue
            done.add((a, b))
            n, m = self.seen[a], self.seen[b]
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for symbol in self.used[a].keys() | self.used[b].keys():
                if self._differ(self.used[a][symbol], n, self.used[b][symbol], m):
                    return False
            waiting += [(self.next[a][s], self.next[b][s]) for s in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, into: int, state: int) -> None:
        """Add the tree below ``state`` to the automaton at ``into``."""
        waiting = [(into, state)]
        while waiting:
            a, b = waiting.pop()
            if a == b:
                continue
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            self.used[a] += self.used[b]
            for symbol, counted in self.chars[b].items():
                self.chars[a].setdefault(symbol, Counter()).update(counted)
            for symbol, target in self.next[b].items():
                if symbol in self.next[a]:
                    waiting.append((self.next[a][symbol], target))
                else:
                    self.next[a][symbol] = target

    def _merge_states(self) -> None:
        kept = [0]
        while True:
            inside = set(kept)
            edge = [(-self.seen[t], k, s, t) for k, q in enumerate(kept) for s, t in self.next[q].items() if t not in inside]
            if not edge:
                break
            _, k, symbol, state = min(edge)
            same = next((q for q in kept if self._compatible(q, state)), None)
            if same is None:
                kept.append(state)
            else:
                self.next[kept[k]][symbol] = same
                self._fold(same, state)
        self.states = kept

    def path(self, formats: str) -> list[int] | None:
        """States passed, or None if the format leaves the automaton."""
        at, out = 0, [0]
        for symbol in formats:
            at = self.next[at].get(symbol)
            if at is None:
                return None
            out.append(at)
        return out

    def log_likelihood(self, value: str, formats: str) -> float:
        states = self.path(formats)
        if states is None:
            return -math.inf
        total = 0.0
        for at, symbol, char in zip(states, formats, value):
            counted, size = self.chars[at][symbol], _SIZES.get(symbol, 1)
            n = self.used[at][symbol]
            total += math.log(n / (self.seen[at] + UNSEEN)) + math.log((counted.get(char, 0) + UNSEEN) / (n + UNSEEN * size))
        last = states[-1]
        return total + math.log((self.ends[last] + UNSEEN) / (self.seen[last] + UNSEEN))


class PairModel:
    """Letter pairs of all candidates, 0 standing for both ends."""

    def __init__(self, counts: dict[str, int]):
        pairs = np.ones((128, 128))
        for pair, n in counts.items():
            pairs[ord(pair[0]) % 128, ord(pair[1]) % 128] += n
        self.table = np.log(pairs / pairs.sum(1, keepdims=True)).tolist()

    def log_likelihood(self, value: str) -> float:
        codes = value.encode()
        table = self.table
        return sum(table[a][b] for a, b in zip(b"\0" + codes, codes + b"\0"))


def pair_counts(texts: list[str]) -> dict[str, int]:
    """Letter pairs of all candidates in the texts, their ends included."""
    found = "\0".join(["", *(c for t in texts for c in _CANDIDATE.findall(t) if len(c) >= SHORTEST), ""])
    codes = np.frombuffer(found.encode(), np.uint8).astype(np.int32)
    counted = np.bincount(codes[:-1] * 128 + codes[1:])
    return {chr(k // 128) + chr(k % 128): int(counted[k]) for k in np.flatnonzero(counted) if k}


def _without(text: str, spans: list) -> str:
    for start, _, end, _ in reversed(spans):
        text = text[:start] + " " + text[end:]
    return text


def _labelled(batches):
    for batch in slices(batches, column=0):
        texts = [t for t in batch.column(0).to_pylist() if t]
        counted: Counter[tuple[str, str]] = Counter()
        for k, text in enumerate(texts):
            if spans := base_spans(text):
                counted.update((KINDS[kind], value[:LONGEST + 1]) for _, kind, _, value in spans)
                texts[k] = _without(text, spans)
        counted.update({("", pair): n for pair, n in pair_counts(texts).items()})
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counted], pa.string()), pa.array([v for _, v in counted], pa.string()),
                                          pa.array(list(counted.values()), pa.int64())], ["kind", "value", "n"])


class FormatModel:
    """Automata and thresholds by kind, and the letter pairs they are held against."""

    def __init__(self, labelled: dict[str, list[str]], pairs: dict[str, int], prior: float = PRIOR):
        self.pairs = PairModel(pairs)
        self.automata: dict[str, tuple[FormatAutomaton, float]] = {}
        for kind, values in labelled.items():
            kept_out = [v for v in values if hashlib.md5(v.encode()).digest()[0] % 5 == 0]
            learned = [v for v in values if hashlib.md5(v.encode()).digest()[0] % 5 != 0]
            if not kept_out or not learned:
                continue
            automaton = FormatAutomaton(learned)
            scores = sorted(x for v in kept_out if (x := self._ratio(automaton, v, format_of(v))) > -math.inf)
            if scores:
                self.automata[kind] = automaton, max(scores[len(scores) // 100], -math.log(prior))

    def _ratio(self, automaton: FormatAutomaton, value: str, formats: str) -> float:
        mine = automaton.log_likelihood(value, formats)
        return mine - self.pairs.log_likelihood(value) if mine > -math.inf else mine

    def kind_of(self, value: str, paths: dict[str, list[str]]) -> str | None:
        """The kind whose automaton takes the value best, if above its threshold; ``paths`` remembers
        which automata take a format."""
        formats = format_of(value)
        kinds = paths.get(formats)
        if kinds is None:
            if len(paths) >= REMEMBERED:
                paths.clear()
            kinds = paths[formats] = [k for k, (a, _) in self.automata.items() if a.path(formats) is not None]
        best = max(((self._ratio(self.automata[k][0], value, formats) - self.automata[k][1], k) for k in kinds), default=(-1.0, None))
        return best[1] if best[0] >= 0 else None


def fit_format_model(df: DataFrame, text_col: str = "text", *, sample: int = SAMPLE, longest: int = LONGEST) -> FormatModel:
    """Automata of the kinds that the base patterns find in ``df``."""
    tables = Tables(df.sparkSession)
    found = tables.written(df.select(F.col(text_col).alias("_text")).mapInArrow(_labelled, "kind string, value string, n bigint")
                           .groupBy("kind", "value").agg(F.sum("n").alias("n")), "credentials")
    pairs = {r["value"]: r["n"] for r in found.where("kind = ''").collect()}  # at most the alphabet squared
    usable = found.where((F.col("kind") != "") & (F.char_length("value") <= longest))
    labelled: dict[str, list[str]] = defaultdict(list)
    for kind, n in usable.groupBy("kind").count().collect():
        # By hash, with room: a share that meets 0.8 of the bound stays under it, and the limit never cuts.
        share = min(1.0, 0.8 * sample / n)
        below = F.pmod(F.xxhash64("value"), F.lit(1 << 20)) < int(share * (1 << 20))
        chosen = usable.where((F.col("kind") == kind) & (F.lit(share >= 1.0) | below)).select("value").limit(sample)
        labelled[kind] = sorted(r["value"] for r in chosen.collect())
    tables.drop()
    return FormatModel({k: labelled[k] for k in KINDS if k in labelled}, pairs)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


class Scanner:
    """Spans of texts under one model, remembering verdicts on candidates."""

    def __init__(self, model: FormatModel):
        self.model, self.verdicts, self.paths = model, {}, {}

    def verdict(self, value: str) -> str | None:
        if value not in self.verdicts:
            if len(self.verdicts) >= REMEMBERED:
                self.verdicts.clear()
            self.verdicts[value] = self.model.kind_of(value, self.paths)
        return self.verdicts[value]

    def added(self, text: str, base: list) -> list[tuple[int, int, int]]:
        known = self.verdicts
        candidates = {c for c in _CANDIDATE.findall(text) if len(c) >= SHORTEST}
        secrets = {c for c in candidates if (known[c] if c in known else self.verdict(c))}
        if not secrets:
            return []
        out, taken = [], [(start, end) for start, _, end, _ in base]
        k = 0
        reach = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
        for m in _CANDIDATE.finditer(text):
            if m[0] in secrets:
                while k < len(taken) and taken[k][0] < m.end():
                    k += 1
                if not k or reach[k - 1] <= m.start():
                    out.append((m.start(), KINDS.index(self.verdict(m[0])), m.end()))
        return out


def scan_secrets(df: DataFrame, model: FormatModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Map-only: id, n_assign, n_access, n_hex, base_sha256 (of the base spans), spans (all, as
    kind:start:end by start) and n_added of every row."""
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    id_type = rows.schema[0].dataType.simpleString()
    shipped = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        scanner = Scanner(shipped.value)
        for batch in slices(batches):
            counts, digests, spans, added = [], [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = scanner.added(text or "", base)
                plain = [s[:3] for s in base]
                counts.append([sum(kind == k for _, kind, _ in plain) for k in range(3)])
                digests.append(hashlib.sha256(_joined(plain).encode()).hexdigest())
                spans.append(_joined(sorted(plain + more)))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint")
