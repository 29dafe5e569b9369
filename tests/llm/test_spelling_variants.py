import random
import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from hourloom.llm import spelling_variants as sv
from hourloom.llm.queries import QUERIES
from hourloom.llm.text import Tables

from .cases import edges, frame

LETTERS = [*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xC0, 0x100))]


def one_edit(word, letters=LETTERS):
    for k in range(len(word) + 1):
        yield from (word[:k] + c + word[k:] for c in letters)
        if k < len(word):
            yield word[:k] + word[k + 1:]
            yield from (word[:k] + c + word[k + 1:] for c in letters)


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}
    near = {w: {v for v in one_edit(w) if v in n and v != w} for w in n if len(w) < 60}
    long = [w for w in n if len(w) >= 60]
    for w in long:  # few: compared one by one
        near[w] = {v for v in n if v != w and abs(len(v) - len(w)) <= 1 and _at_one(w, v)}
    form = {}
    for w, vs in near.items():
        top = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return Counter(out)


def _at_one(a, b):
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a != b and (a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:])


def same(got, rows):
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(tuple(r) for r in got.collect()) == (want := brute(rows))
    return want


@settings(max_examples=400, deadline=None)
@given(st.text("abÿ", min_size=7, max_size=14), st.integers(0, 200), st.randoms(use_true_random=False), st.dictionaries(st.sampled_from([a + b for a in "abÿ" for b in "abÿ"]), st.integers(0, 5)))
def test_keys_of_near_words_meet(word, pick, rng, weight):
    """Whatever the order of bigrams: words at one edit share a key, from the one whose prefix ends first."""
    others = sorted(set(one_edit(word, "abÿ")) - {word})
    other = others[pick % len(others)]
    if len(other) < 7:
        return
    grams = sorted((weight.get(a + b, 0), a + b) for a in "abÿ" for b in "abÿ")
    rank = {g.encode("latin-1"): k for k, (_, g) in enumerate(grams)}
    sides = [(w, *sv.prefix_of(w, rank)) for w in (word.encode("latin-1"), other.encode("latin-1"))]
    for a, b in ((0, 1), (1, 0)):
        if sides[a][2] <= sides[b][2]:
            asks = set(sv._keys(sides[a][0], sv.pivots_of(sides[a][1]), (0,)))
            assert asks & set(sv._keys(sides[b][0], [p for _, p in sides[b][1]], (-1, 0, 1)))


def test_pivots_are_the_rarest_disjoint_pair():
    rng = random.Random(3)
    for _ in range(500):
        prefix = sorted(zip(rng.choices(range(6), k=5), rng.sample(range(9), 5)))
        p, q = sv.pivots_of(prefix)
        rank = {at: r for r, at in prefix}
        pairs = [rank[a] + rank[b] for a in rank for b in rank if b - a >= 2]
        assert q - p >= 2 and rank[p] + rank[q] == min(pairs)


def variants():
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdeß") for _ in range(rng.randrange(6, 12))) for _ in range(150)]
    rows = []
    for k in range(400):
        out = []
        for _ in range(30):
            w = base[min(int(rng.expovariate(0.05)), len(base) - 1)]
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abcé") + w[at:], w[:at] + rng.choice("abcÉ") + w[at + 1:]])
            out.append(rng.choice([w, w.upper(), w.capitalize()]))
        rows.append((k, " ".join(out)))
    return rows


def test_variants_match_brute_force(spark):
    rows = [*edges(), *variants(), (None, "aaaaaaaa aaaaaaa " * 20), (800, "planetary " * 300 + "planetry " * 20 + "plametry " * 2), (900, "x" * 40_000 + " " + "x" * 40_001 + " " + "ab" * 20_000), (900, "x" * 40_000 + " " + "x" * 40_001), (901, "ab" * 20_000)]
    want = same(sv.spelling_variants(frame(spark, rows)), rows)
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 3 for r in want)


def test_chains_end_at_their_root(spark):
    steps = [f"w{chr(97 + k)}" for k in range(19)]
    forms = spark.createDataFrame([(a, b) for a, b in zip(steps, steps[1:])], "word string, form string")
    tables = Tables(spark)
    assert {r["word"]: r["root"] for r in sv.roots_of(forms, tables).collect()} == {w: steps[-1] for w in steps[:-1]}


def test_empty(spark):
    assert sv.spelling_variants(frame(spark, [])).count() == 0
    assert sv.spelling_variants(frame(spark, [(1, None), (2, "short words only"), (3, "")])).count() == 0


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert len(same(QUERIES["op11_spelling_variants"](spark, sf), rows)) > 10_000
