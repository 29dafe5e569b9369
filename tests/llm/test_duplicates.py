import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from hourloom.llm import group_join, substring_dedup
from hourloom.llm.components import components
from hourloom.llm.queries import QUERIES

from .cases import edges, frame, keyed, prose


def brute_repeats(rows, window):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                g = tuple(w[k:k + window])
                first[g] = min(i, first.get(g, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


def passages():
    rng = random.Random(5)
    shared = [prose(1000 + k, n) for k, n in enumerate((49, 50, 51, 60, 140))] + ["run " * 90, "p q " * 60, "one two three " * 40, "r " * 51, "s s t " * 30]
    rows = []
    for i in range(70):
        parts = [prose(i * 7 + k, rng.randrange(0, 60)) for k in range(3)]
        parts += rng.sample(shared, rng.randrange(0, 4))
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    rows += [(200 + i, rows[3][1]) for i in range(6)] + [(300, rows[4][1] + " more"), (300, rows[4][1] + " more"), (301, rows[4][1].replace("\n", " "))]
    return rows


@pytest.mark.parametrize("window", [50, 37])
def test_repeats_match_brute_force(spark, window):
    rows = [*edges(), *passages()]
    got = substring_dedup.substring_dedup(frame(spark, rows), window=window).collect()
    want = brute_repeats(rows, window)
    assert any(0 < r[2] < r[1] for r in want)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == Counter(want)
    for r in got:  # the text left has the words left
        assert hashlib.sha256(b" ".join((r["cleaned"] or "").encode().split())).hexdigest() == r["kept_sha256"]


def test_repeats_on_a_small_alphabet(spark):
    rng = random.Random(8)
    base = [rng.choice("ab") for _ in range(4000)]
    rows = [(i, " ".join(base[at:at + rng.randrange(40, 400)])) for i, at in enumerate(rng.randrange(3500) for _ in range(40))]
    got = substring_dedup.substring_dedup(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == Counter(brute_repeats(rows, 50))


def test_symbols_depend_on_their_surrounding_only():
    rng = np.random.default_rng(2)
    for alphabet in (2, 5, 1000):
        inner = rng.integers(0, alphabet, 50).astype(np.uint64)
        seen = set()
        for _ in range(30):
            before, after = (rng.integers(0, alphabet, rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
            words = np.concatenate([before, inner, after])
            pick, start, end = substring_dedup.elected(words, np.zeros(len(words), int), np.array([len(before)]), 50)
            seen.add((int(start[pick[0]]) - len(before), int(end[pick[0]]) - len(before)))
        assert len(seen) == 1


def test_repeats_edges(spark):
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(frame(spark, []), window=20)


def test_repeats_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = keyed(QUERIES["op10_substring_dedup"](spark, sf))
    assert {i: tuple(r)[1:] for i, r in got.items()} == {w[0]: w[1:] for w in brute_repeats(rows, 50)}


def brute_components(rows, n, per_100):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= per_100 * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [(i, len(s), least.get(top(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def near_copies():
    rng = random.Random(11)
    rows, at = [], 100
    for family in range(8):
        base = prose(500 + family, rng.choice((8, 30, 80, 150)), 3000).split()
        for _ in range(rng.choice((2, 5, 30))):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10_000)}"
            rows.append((at, " ".join(copy).title() if rng.random() < 0.2 else " ".join(copy)))
            at += 1
    shared = prose(900, 40, 3000)
    rows += [(at + k, shared + " " + prose(2000 + k, 60, 3000)) for k in range(25)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,per_100,chunk", [(4, 85, 128), (5, 80, 4), (4, 85, 2)])
def test_components_match_brute_force(spark, n, per_100, chunk):
    rows = [*edges(), *near_copies()]
    got = group_join.jaccard_components(frame(spark, rows), n=n, per_100=per_100, chunk=chunk).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute_components(rows, n, per_100))


def test_chain_of_links_is_one_component(spark):
    words = prose(1, 400, 100_000).split()
    rows = [(i, " ".join(words[2 * i:2 * i + 100])) for i in range(100)]
    got = keyed(group_join.jaccard_components(frame(spark, rows), n=5, per_100=80, chunk=4))
    assert {r["component_id"] for r in got.values()} == {0}


def test_common_list_does_not_change_results(spark, monkeypatch):
    rows = near_copies()
    monkeypatch.setattr(group_join, "REPORTED_FROM", 1)
    many = group_join.jaccard_components(frame(spark, rows), n=4, per_100=85).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in many) == Counter(brute_components(rows, 4, 85))


def test_components_edges(spark):
    assert group_join.jaccard_components(frame(spark, [])).count() == 0
    only = group_join.jaccard_components(frame(spark, [(1, None), (2, " "), (None, "")])).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in only) == Counter([(1, 0, 1), (2, 0, 2), (None, 0, None)])


def test_component_helper(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (6, 6), (None, 1), (9, 8), (8, 7), (7, 9)], "a bigint, b bigint")
    assert {(r["node"], r["component"]) for r in components(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7), (8, 7), (9, 7)}
    assert components(links.where("a > 99")).count() == 0


def star(n, edits, seed):
    """Near copies of one text: linked to it and, at few common edits, hardly to each other."""
    rng = random.Random(seed)
    base = prose(seed, 120, 5000).split()
    rows = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(len(w)), edits):
            w[at] = f"e{rng.randrange(10 ** 6)}"
        rows.append(" ".join(w))
    return rows


@pytest.mark.parametrize("chunk", [4, 128])
def test_stars_and_shared_passages_match_brute_force(spark, chunk):
    """Groups of copies that link through few texts, and unrelated texts that share a passage."""
    passage = prose(77, 40, 5000)
    texts = [t for k, (n, edits) in enumerate(((30, 2), (40, 3), (30, 4))) for t in star(n, edits, 50 + k)]
    texts += [f"{prose(600 + k, 25 + k % 30, 9000)} {passage} {prose(900 + k, 10, 9000)}" for k in range(60)]
    rows = list(enumerate(texts))
    got = keyed(group_join.jaccard_components(frame(spark, rows), n=4, per_100=85, chunk=chunk))
    want = brute_components(rows, 4, 85)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (n, c) for i, n, c in want}
    assert 60 < len({c for _, _, c in want}) < len(rows)


def test_components_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = keyed(QUERIES["op6_group_join"](spark, sf))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {
        i: (n, i if c is None else c) for i, n, c in brute_components(rows, 4, 85)}
