import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from hourloom.llm import decontaminate, ppm_score
from hourloom.llm.queries import QUERIES
from hourloom.llm.text import held_out

from .cases import edges, frame, keyed, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def training(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 != 2


def base_scores(rows):
    tokens = [WORD.findall((t or "").translate(LOWER)) + ["\n"] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens) if training(i) for w in ws)
    total = sum(counts.values())
    each = total + len(counts) + 1
    return [(len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10((counts[w] + 1) / each) for w in ws)) for ws in tokens]


def test_base_score_matches_brute_force(spark):
    rows = [*edges(), *[(i, prose(i, i % 40, 60).upper()) for i in range(20, 80)]]
    got = ppm_score.score_documents(frame(spark, rows), ~held_out("doc_id", 7), block_rows=9).collect()
    want = Counter((i, n, k, t, round(s, 6)) for (i, _), (n, k, t, s) in zip(rows, base_scores(rows)))
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["in_training"] == training(r["doc_id"]) and r["score"] < 0 for r in got)


def test_ppm_probabilities_sum_to_one():
    texts = [prose(k, 50, 30).encode() for k in range(5)] + [b"", b"zz top"]
    codes, sizes = ppm_score.codes_of(texts)
    assert sizes.tolist() == [len(t) + 1 for t in texts] and len(codes) == sizes.sum()
    trie = ppm_score.PpmTrie(*ppm_score._summed(codes, [1] * len(codes)))
    rng = random.Random(0)
    for _ in range(40):
        text = rng.choice(texts) or b"ab"
        at = rng.randrange(len(text))
        context = (b"\0\0\0" + text)[at:at + 3] if rng.random() < 0.7 else bytes(rng.randrange(256) for _ in range(3))
        every = [int.from_bytes(context, "big") << 8 | s for s in range(256)]
        bits = ppm_score.code_lengths(trie.levels, __import__("numpy").array(every, "uint32"))
        assert abs(sum(2.0 ** -b for b in bits) - 1) < 1e-9


def test_ppm_by_hand_and_order_of_texts(spark):
    docs = frame(spark, [(1, "the cat sat on the mat. " * 40), (3, "the cat sat on the hat. " * 40)])
    trie = ppm_score.fit_trie(docs)
    known, _ = ppm_score.codes_of([b"the cat sat on the mat."])
    odd, _ = ppm_score.codes_of([b"xqzj kvw gpf bdm 12 %%%."])
    assert ppm_score.code_lengths(trie.levels, known).sum() < 0.3 * ppm_score.code_lengths(trie.levels, odd).sum()
    lone = ppm_score.PpmTrie(*ppm_score._summed(ppm_score.codes_of([b"a"])[0], [1, 1]))
    # 'a' then the end: each context has one of one successor, so each costs one bit in method C.
    assert abs(ppm_score.code_lengths(lone.levels, ppm_score.codes_of([b"a"])[0]).sum() - 2) < 1e-9


def test_trie_bound_keeps_the_frequent(spark):
    trie = ppm_score.fit_trie(frame(spark, [(i, prose(i, 200)) for i in range(10)]), max_nodes=50)
    assert 0 < len(trie.codes) <= 50 and trie.counts.min() > 1


def test_scores_use_every_count(spark):
    rng = random.Random(4)
    rows = [(i, "".join(map(chr, rng.choices(range(0x21, 0x7F), k=20_000)))) for i in range(70)] + [(90, "\u0416\u0414 \u65e5\u672c"), (93, "zz \u0416\u0414 \u672c")]
    learns = [i < 60 or i == 90 for i, _ in rows]
    codes, _ = ppm_score.codes_of([t.encode() for (_, t), learn in zip(rows, learns) if learn])
    trie = ppm_score.PpmTrie(*ppm_score._summed(codes, np.ones(len(codes))))
    assert len(trie.codes) > 1 << 20
    got = keyed(ppm_score.score_documents(frame(spark, rows), F.col("doc_id").isin([i for (i, _), learn in zip(rows, learns) if learn]), block_rows=9))
    for i, text in rows:
        want = -ppm_score.code_lengths(trie.levels, ppm_score.codes_of([text.encode()])[0]).sum() * math.log10(2)
        assert abs(got[i]["score"] - want) < 1e-9 * abs(want)


def test_scores_without_rows_or_training(spark):
    assert ppm_score.score_documents(frame(spark, []), F.lit(True)).count() == 0
    got = ppm_score.score_documents(frame(spark, [(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in got)
    assert sorted(round(r["score"] / -math.log10(256), 6) for r in got) == [1, 4]


def test_score_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = keyed(QUERIES["op8_ppm_score"](spark, sf))
    for (i, _), (n, k, t, s) in zip(rows, base_scores(rows)):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not training(i), n, k, t) and abs(r["base_score"] - s) < 1e-6 * abs(s)


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        if item is not None and w:
            k = min(13, len(w))
            for i in range(len(w) - k + 1):
                windows.setdefault(tuple(w[i:i + k]), set()).add(item)
    out = []
    for i, text in docs:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for at in range(len(w)):
            for k in range(1, 14):
                if at + k <= len(w) and (items_ := windows.get(tuple(w[at:at + k]))):
                    hit.update(range(at, at + k))
                    found |= items_
        ids = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def contaminated_docs():
    passage = prose(77, 40)
    items = [(1, passage), (1, passage), (2, "Short Item, here!"), (3, None), (4, "..."), (10, prose(77, 20)), (None, passage), (5, "x " * 20)]
    docs = [*edges(), (50, prose(1, 30) + " " + passage.upper().replace(" ", ", ") + " " + prose(2, 20)), (51, "a short item here and a short ITEM here"),
            (52, " ".join(prose(77, 40).split()[5:17])), (53, " ".join(prose(77, 40).split()[5:18])), (54, "x " * 40), (54, passage), (55, prose(3, 4000) + " " + passage)]
    return docs, items


def test_contamination_matches_brute_force_either_way(spark):
    docs, items = contaminated_docs()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for most in (decontaminate.BROADCAST_ROWS, 0):
        got = decontaminate.contamination(frame(spark, docs), bench, broadcast_rows=most)
        rows = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect())
        assert rows == Counter(brute_contamination(docs, items))


def test_items_with_a_null_id_contaminate(spark):
    passage = prose(78, 40)
    bench = spark.createDataFrame([(None, passage), (1, prose(79, 20))], "item_id bigint, text string")
    docs = frame(spark, [(1, prose(5, 30) + " " + passage), (2, prose(6, 60))])
    for most in (decontaminate.BROADCAST_ROWS, 0):
        got = keyed(decontaminate.contamination(docs, bench, broadcast_rows=most))
        assert (got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (40, 0, True) and got[2]["n_hit"] == 0
        assert got[1]["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_contaminated_documents_go(spark):
    docs, items = contaminated_docs()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    kept = decontaminate.remove_contaminated(frame(spark, docs), bench)
    want = Counter(d for d, r in zip([i for i, _ in docs], brute_contamination(docs, items)) if not r[-1])
    assert Counter(r["doc_id"] for r in kept.collect()) == want and kept.columns == frame(spark, []).columns
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.remove_contaminated(frame(spark, docs), none).count() == len(docs)
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0
