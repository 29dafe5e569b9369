import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from hourloom.llm import token_alignment as ta
from hourloom.llm.queries import ALIGNED, QUERIES

from .cases import edges, frame

BPE, PIECES = ta.read_models(*ALIGNED)


def brute(rows):
    """The contract by plain loops, with the two libraries the contract names."""
    a_model = tokenizers.Tokenizer.from_str(BPE)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_proto=PIECES)
    symbol = ta.byte_symbols()
    found, holders = [], defaultdict(set)
    for k, (_, text) in enumerate(rows):
        links, groups, n_a, n_b = [], [], 0, 0
        if text:
            a = a_model.encode(" " + text, add_special_tokens=False)
            b = b_model.encode(text)
            a_bytes = [bytes(symbol[c] for c in a_model.id_to_token(i)) for i in a.ids]
            b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b_model.id_to_piece, b)]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                n_a, n_b = len(a.ids), len(b)
                spans = []
                for parts in (a_bytes, b_bytes):
                    at, out = 0, []
                    for p in parts:
                        out.append((at, at + len(p)))
                        at += len(p)
                    spans.append(out)
                cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
                low = 0
                for cut in cuts:
                    groups.append(",".join(str(i) for i, s in zip(a.ids, spans[0]) if low < s[1] <= cut) + "|" +
                                  ",".join(str(i) for i, s in zip(b, spans[1]) if low < s[1] <= cut))
                    low = cut
                links = [(i, j) for i, x in zip(a.ids, spans[0]) for j, y in zip(b, spans[1]) if x[0] < y[1] and y[0] < x[1]]
        for pair in links:
            holders[pair].add(k)
        found.append((links, groups, n_a, n_b))
    top = defaultdict(int)
    for (i, _), docs in holders.items():
        top[i] = max(top[i], len(docs))
    return [(row[0], n_a, n_b, len(groups), len(links), sum(len(holders[p]) == top[p[0]] for p in links), sum(len(holders[p]) for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for row, (links, groups, n_a, n_b) in zip(rows, found)]


def same(df, rows):
    got = Counter(tuple(r) for r in df.collect())
    assert got == Counter(brute(rows))
    return got


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=60), st.integers(0, 40))
def test_runs_match_brute_force(first, second, equal):
    """Random ends with a long equal stretch in the middle."""
    a, b = [*first, *[1] * equal, 1], [*second, *[1] * equal, 1]
    a[0] += max(0, sum(second) - sum(first))
    b[0] += max(0, sum(first) - sum(second))
    ends = [[sum(x[:k + 1]) for k in range(len(x))] for x in (a, b)]
    found = ta.Alignment(list(range(len(a))), list(range(len(b))), *ends)
    starts = [[0, *e[:-1]] for e in ends]
    links = {(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]}
    got = list(zip(*(x.tolist() for x in found.linked())))
    assert len(got) == len(set(got)) and set(got) == links
    assert found.n_groups == len(set(ends[0]) & set(ends[1])) == found.text(ta.GroupNames(200)).count(b"|")


def test_probing_jumps_over_one_stretch():
    ends = list(range(1, 2001))
    assert ta.skip_runs(ends, ends) == ([(0, 0, True)], [], [])


def test_alignment_matches_brute_force(spark):
    rng = random.Random(4)
    words = "the Überraschung ça va naïve 12345 don't x== <|endoftext|> </s> <0x41> ▁   　 你好 \U0001f600 é \t\t \n\n AAAA".split(" ")
    rows = [r for r in edges() if r[0] not in (10, 11)]  # the quadratic check cannot take the longest
    rows += [(100 + k, rng.choice(["", " ", "  "]).join(rng.choice(words) + rng.choice([" ", "", "  "]) for _ in range(rng.randrange(1, 60)))) for k in range(60)]
    for size in (1 << 22, 300):
        documents, pairs = ta.align_tokens(frame(spark, rows), BPE, PIECES, block_bytes=size)
        got = same(documents, rows)
        assert any(r[1] for r in got) and any(not r[1] for r in got)
        assert pairs.groupBy("a").agg({"n_docs": "max"}).count() == pairs.where("best").select("a").distinct().count()


def test_long_texts_keep_every_link(spark):
    rows = [(1, "a" * 30_000), (2, " " * 5_000), (3, "word " * 20_000), (4, "x" * 999 + " é" * 4_000)]
    for r in ta.align_tokens(frame(spark, rows), BPE, PIECES)[0].collect():
        assert 0 < r["n_groups"] <= min(r["n_a"], r["n_b"]) and r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] == r["count_sum"]


def test_empty_table(spark):
    documents, pairs = ta.align_tokens(frame(spark, []), BPE, PIECES)
    assert documents.count() == 0 and pairs.count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_fast_encoder_equals_the_named_one(spark, sf):
    """Same ids from the faster library, on every document and on all single Latin characters in context."""
    model = ta.ByteBpe(BPE)
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r[0]]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1\n{chr(c)}  x" for c in range(0x250)]
    for text in texts:
        assert model.encode(text) == model.slow.encode(text, add_special_tokens=False).ids


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 3000 OR text IS NULL").collect()]
    documents = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000 OR text IS NULL")
    same(ta.align_tokens(documents, BPE, PIECES)[0], rows)
    got = QUERIES["op13_token_alignment"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] for r in got)


def test_ids_stay_arrays():
    """Ids are converted to arrays once per text; the array form gives the ids of the list form."""
    both = ta.TokenizerPair(BPE, PIECES)
    for text in ["", "a", "Zwei  Sätze.\n\nTwo\tlines <s> é", "x" * 3000, "snow ☃ and 日本語 " * 20]:
        assert both.second.encode(text).tolist() == both.second.model.encode(text)
    ids_a, ids_b, ends_a, ends_b = both.encode("Some plain words, 12 of them")
    assert ids_a.dtype == ids_b.dtype == "int64" and ends_a[-1] == ends_b[-1] == len(" Some plain words, 12 of them")
    assert ta.GroupNames(200).table.itemsize == 8 and ta.GroupNames(10**4).table[0] == b"0,"
