import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hourloom.llm import compression_quality as cq
from hourloom.llm import license_scan, line_rules, token_counts
from hourloom.llm.queries import QUERIES, VOCABULARY
from hourloom.llm.text import held_out

from .cases import edges, frame, keyed, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def labelled(n=120):
    rng = random.Random(1)
    good = [" ".join(rng.choice(("the", "cat", "sat", "on", "a", "mat", "and", "slept")) for _ in range(60)) + "." for _ in range(n)]
    bad = [" ".join(rng.choice(("BUY!!", "NOW!!", "FREE!!", "$$$", "###", "|")) for _ in range(60)) for _ in range(n)]
    return [(i, t, y) for i, (t, y) in enumerate([(g, 1) for g in good] + [(b, 0) for b in bad])]


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame(labelled(), "doc_id bigint, text string, quality int")
    return cq.fit_compression_model(rows.drop("quality"), rows.drop("text"))


def test_quality_tells_classes_apart(spark, model):
    rows = [(1000 + i, t) for i, (_, t, _) in enumerate(labelled(20))]
    got = keyed(cq.score_quality(frame(spark, rows), model))
    assert all(got[1000 + i]["predicted"] == (i < 20) for i in range(40))


def test_quality_edges(spark, model):
    scored = cq.score_quality(frame(spark, edges()), model)
    rows = scored.collect()
    assert len(rows) == len(edges()) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    by = [r for r in rows if r["doc_id"] in (1, 2)]
    assert by[0]["score"] == by[1]["score"] and by[0]["size_difference"] == 0
    assert scored.where("doc_id = 6").select("score").distinct().count() == 1
    empty = frame(spark, [])
    assert cq.score_quality(empty, model).count() == 0
    assert cq.accepted(frame(spark, edges()), model).columns == frame(spark, []).columns


def test_quality_without_both_labels(spark):
    for rows in ([], [(1, "a b", 1)], [(1, None, 0), (2, "x", None), (None, "y", 1)]):
        given = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
        fitted = cq.fit_compression_model(given.drop("quality"), given.drop("text"))
        assert 0 < keyed(cq.score_quality(frame(spark, [(1, "text")]), fitted))[1]["score"] < 1


def test_quality_learns_from_whole_texts_and_once_per_id(spark, model):
    """What tells the classes apart stands behind 20,000 equal characters; repeated rows change nothing."""
    head = "plain opening words " * 1000
    rows = [(i, head + t * 3, y) for i, t, y in labelled(30)]
    given = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    fitted = cq.fit_compression_model(given.drop("quality"), given.drop("text"))
    again = cq.fit_compression_model(given.drop("quality").unionAll(given.drop("quality")), given.drop("text").unionAll(given.drop("text")))
    assert fitted == again
    got = keyed(cq.score_quality(frame(spark, [(1000 + i, t) for i, t, _ in labelled(10)]), fitted))
    assert all((got[1000 + i]["score"] > 0.5) == (i < 10) for i in range(20))


def test_quality_query_on_held_out_rows(spark):
    got = keyed(QUERIES["op1_quality_classifier"](spark, SF))
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    out = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in out) >= 0.9 * len(out)


def test_held_out_of_null(spark):
    assert spark.range(1).select(held_out("id", 4), F.lit(None).cast("bigint").alias("n")).select(held_out("n", 7)).first()[0] is False


def brute_counts(text):
    words = WORD.findall(text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(hit)


def test_line_rules_base_columns(spark):
    rows = [(i, t) for i, (_, t) in enumerate(edges())]
    rows += [(100, "a b c a b c\na b c\na b c\n\n x"), (101, "q #1 | <b> é"), (102, "\n".join(["same line here"] * 4))]
    got = keyed(line_rules.line_rules(frame(spark, rows)))
    for i, text in rows:
        r = got[i]
        want = brute_counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_line_rules_query_matches_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = keyed(QUERIES["op3_line_rules"](spark, "/root/testdata/sf0.001"))
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        assert tuple(got[i])[1:6] == brute_counts(text)


def test_line_rules_remove_lines_then_documents(spark):
    clean = "\n".join(prose(k, 30) + "." for k in range(4))
    dirty = "Home | News | Sport | Login |\n" + clean
    lost = clean + "\n" + "\n".join("BUY!! NOW!! CHEAP!! TODAY!!" for _ in range(60))
    got = keyed(line_rules.line_rules(frame(spark, [(1, clean), (2, dirty), (3, lost)])))
    assert got[1]["kept"] and got[1]["cleaned"] == clean and got[1]["failed_lines"] == {}
    assert got[2]["kept"] and got[2]["cleaned"] == clean and got[2]["failed_lines"] == {"navigation": 1}
    assert not got[3]["kept"] and got[3]["failed_lines"] == {"shouting": 60}
    assert line_rules.failed_rule(b"Please accept cookies to go on") == "boilerplate"
    assert line_rules.failed_rule(b"is " * 20) == "repetition"
    assert line_rules.failed_rule(b"what*** is### this$$$") == "symbols"
    assert line_rules.failed_rule(b"It cost 5 $ and 3 % of it, said R&D.") is None


@pytest.mark.parametrize("separator", ["|", ">", ">>", "\u00bb", "\u00b7", "\u203a"])
def test_every_separator_makes_navigation(separator):
    assert line_rules.failed_rule(f" {separator} ".join(("Home", "Products", "Shoes")).encode()) == "navigation"
    assert line_rules.failed_rule(f"Home {separator} Shoes".encode()) != "navigation"


@pytest.fixture(scope="module")
def licences(spark):
    return license_scan.fit_license_model(frame(spark, [(i, prose(i, 40)) for i in range(60)]))


def test_license_families(spark, licences):
    rows = [(1, prose(1, 30) + "\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3."),
            (3, "The permission of the license was copyright of nobody in particular"), (4, "Licensed under CC BY-NC 4.0."), (5, prose(2, 80))]
    got = keyed(license_scan.scan_licenses(frame(spark, rows), licences))
    assert got[1]["families"] == ["mit"] and got[1]["findings"][0]["paragraph"] == 1
    assert got[2]["families"] == ["apache-2.0", "gpl"]
    assert got[3]["families"] == [] and got[3]["findings"][0]["family"] == "unknown"
    assert got[4]["families"] == ["cc-by-nc"]
    assert got[5]["findings"] == []


def test_license_wrapped_and_compound(spark, licences):
    bsd = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted "
           "provided that the following conditions\nare met:")
    rows = [(1, prose(1, 30) + "\n\n" + bsd), (2, "# SPDX-License-Identifier: Apache-2.0\nimport os"), (3, "// SPDX-License-Identifier: MIT"),
            (4, "The code is MIT-licensed"), (5, "see GPLv3"), (6, prose(3, 12) + "\n" + prose(4, 12))]
    got = keyed(license_scan.scan_licenses(frame(spark, rows), licences))
    assert got[1]["families"] == ["bsd"] and got[1]["n_paragraphs"] == 4 and [f["paragraph"] for f in got[1]["findings"]] == [1]
    assert got[2]["families"] == ["apache-2.0"] and got[3]["families"] == ["mit"]
    assert len(got[4]["findings"]) == len(got[5]["findings"]) == 1 and got[6]["findings"] == []


@pytest.mark.parametrize("line, family", [
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "lgpl"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "agpl"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "unknown"),
    ("Licensed under the Apache License, Version 1.1.", "apache-1.1"),
    ("Licensed under the Apache License, Version 1.0.", "unknown"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("Released under the ISC License.", "isc"),
    ("Released under CC0 1.0.", "cc0"),
    ("Released under the Unlicense.", "unlicense"),
    ("This is not released under the MIT License.", "unknown"),
    ("It was never licensed under the Apache License, Version 2.0.", "unknown"),
    ("SPDX-License-Identifier: LGPL-3.0-only", "lgpl"),
])
def test_license_relatives_and_denials(licences, line, family):
    _, hits = licences.findings(line.encode())
    assert [h[1] for h in hits] == [family]


def test_license_sample_is_bounded_and_the_same_for_copies(spark):
    rows = [(i, prose(i, 20)) for i in range(300)]
    once = license_scan.fit_license_model(frame(spark, rows), sample=400)
    again = license_scan.fit_license_model(frame(spark, rows), sample=400)
    assert (once.weights == again.weights).all() and once.temperature == again.temperature
    assert license_scan.fit_license_model(frame(spark, [])).findings(b"Released under the MIT License.")[1][0][1] == "mit"


def test_license_edges(spark, licences):
    rows = license_scan.scan_licenses(frame(spark, edges()), licences).collect()
    assert len(rows) == len(edges()) and all(r["n_paragraphs"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert license_scan.scan_licenses(frame(spark, []), licences).count() == 0


def test_license_query_finds_stated_lines(spark):
    got = keyed(QUERIES["op2_license_scan"](spark, SF))
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc"}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert got[r["doc_id"]]["families"] == ",".join(sorted({f for line, f in lines.items() if line in r["text"].split("\n")}))


SCORES = {b"a": -1.0, b"b": -1.5, b"ab": -1.8, b"abc": -9.0, b"c": -2.0, b" a": -1.2, b" ": -0.7, b"bc": -2.2}


def brute_tokens(token):
    best = [(0.0, 0)] + [(-1e9, 0)] * len(token)
    for end in range(1, len(token) + 1):
        for start in range(end):
            s = SCORES.get(token[start:end], (min(SCORES.values()) - 10.0) if end - start == 1 else None)
            if s is not None and best[start][0] + s > best[end][0]:
                best[end] = (best[start][0] + s, best[start][1] + 1)
    return best[-1][1]


def test_token_counts_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abc z\n") for _ in range(rng.randrange(60)))) for i in range(80)]
    got = keyed(token_counts.token_counts(frame(spark, rows), SCORES))
    for i, text in rows:
        parts = token_counts.PRE_TOKEN.findall(text.encode())
        assert b"".join(parts) == text.encode()
        assert (got[i]["n_pretokens"], got[i]["n_tokens"]) == (len(parts), sum(map(brute_tokens, parts)))


def test_token_counts_edges(spark):
    scores = token_counts.zipf_scores(token_counts.read_ranks(VOCABULARY))
    counted = token_counts.token_counts(frame(spark, edges()), scores)
    rows = counted.collect()
    assert len(rows) == len(edges()) and all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (1, 2))
    assert all(r["n_tokens"] >= r["n_pretokens"] for r in rows)
    assert token_counts.token_counts(frame(spark, []), scores).count() == 0
