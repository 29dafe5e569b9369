import base64
import hashlib
import io
import math
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hourloom.llm import poisson_mix, warc_zip
from hourloom.llm.text import written
from hourloom.session import scratch

from .cases import edges, frame


def chi_square(counts, n, mean):
    """Against Poisson, cells of an expected count below 5 pooled; (statistic, cells)."""
    total, rest_n, rest_p, p, cells = 0.0, n, 1.0, math.exp(-mean), 0
    for k in range(60):
        if n * p >= 5:
            total += (counts.get(k, 0) - n * p) ** 2 / (n * p)
            rest_n, rest_p, cells = rest_n - counts.get(k, 0), rest_p - p, cells + 1
        p *= mean / (k + 1)
    if n * rest_p > 1:
        total += (rest_n - n * rest_p) ** 2 / (n * rest_p)
        cells += 1
    return total, cells


@pytest.mark.parametrize("mean", [0.5, 1.0, 2.0, 3.7, 40.0, 800.0])
def test_draws_follow_the_distribution(spark, mean):
    n = 3000 if mean > 100 else 20_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    drawn = rows.select(poisson_mix.poisson_draw(F.lit(mean), poisson_mix.row_text("s", "doc_id", "text", F.lit(1))).alias("k"))
    counts = {r["k"]: r["count"] for r in drawn.groupBy("k").count().collect()}
    if mean > 100:
        got = [k for k, c in counts.items() for _ in range(c)]
        assert abs(sum(got) / n - mean) < 4 * (mean / n) ** 0.5 and 0.85 < sum((k - mean) ** 2 for k in got) / n / mean < 1.15
    else:
        statistic, cells = chi_square(counts, n, mean)
        assert statistic < cells + 4 * (2 * cells) ** 0.5 + 4


def test_null_and_repeated_rows_draw_for_themselves(spark):
    rows = [(None, f"text {i}") for i in range(1500)] + [(7, "same")] * 1500 + [(None, None)] * 1500 + [(i, "t") for i in range(10, 1510)]
    mixed = poisson_mix.mix_sources(frame(spark, rows), {"src0": 1.0}, total=6000.0)
    n = {r["k"]: (r["n"], r["keys"]) for r in mixed.groupBy(F.when(F.col("text").isNull(), "none").when(F.col("doc_id").isNull(), "null")
         .when(F.col("doc_id") == 7, "same").otherwise("own").alias("k")).agg(F.count("*").alias("n"), F.countDistinct("mix_key").alias("keys")).collect()}
    assert all(abs(n[k][0] - 1500) < 160 and n[k][0] == n[k][1] for k in ("none", "null", "same", "own"))
    # Each row's number of copies is Poisson: about 1 / e of those with an id of their own have none.
    assert abs(mixed.where("doc_id IS NULL AND text IS NOT NULL").select("text").distinct().count() - 1500 * (1 - math.exp(-1))) < 100


def test_mix_query_equals_sql_with_nulls_and_repeats(spark, tmp_path):
    import duckdb

    rows = [(k % 90 if k % 7 else None, ("x" * (k % 5)) if k % 11 else None, (None, "src0", "src5", "news")[k % 4]) for k in range(1200)]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    from hourloom.llm.queries import ORACLES, QUERIES
    want = con.execute(ORACLES["op5_mix_sources"]).fetchall()
    got = [tuple(r) for r in QUERIES["op5_mix_sources"](spark, str(tmp_path)).collect()]
    assert len(got) > 500 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_pipeline_mixing_leaves_documents_out_by_chance(spark):
    docs = frame(spark, [(i, "t", f"src{i % 4}") for i in range(4000)])
    got = {r["source"]: r["n"] for r in corpus_pipeline.mix(spark, docs, "").groupBy("source").agg(F.countDistinct("doc_id").alias("n")).collect()}
    for source, mean in (("src0", 16 / 11), ("src1", 12 / 11)):
        assert abs(got[source] - 1000 * (1 - math.exp(-mean))) < 75


def test_mix_reaches_target_shares(spark):
    docs = frame(spark, [(i, "t", "a" if i % 3 else "b") for i in range(6000)])
    mixed = poisson_mix.mix_sources(docs, {"a": 1.0, "b": 1.0}, total=8000)
    shares = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(shares["a"] - 4000) < 200 and abs(shares["b"] - 4000) < 260
    assert mixed.groupBy("doc_id", "copy_no").count().where("count > 1").isEmpty()
    again = poisson_mix.mix_sources(docs.repartition(7), {"a": 1.0, "b": 1.0}, total=8000)
    assert sorted(r["mix_key"] for r in mixed.collect()) == sorted(r["mix_key"] for r in again.collect())


def test_mixing_keeps_sources_that_are_not_named(spark):
    docs = frame(spark, [(i, "t", (None, "news", "src0")[i % 3]) for i in range(3000)])
    shares = {r["source"]: r["count"] for r in corpus_pipeline.mix(spark, docs, "").groupBy("source").count().collect()}
    assert abs(shares[None] - 500) < 120 and abs(shares["news"] - 500) < 120 and abs(shares["src0"] - 2000) < 250
    none = poisson_mix.mix_sources(docs, {"news": 0.0}, other=1.0)
    assert none.columns == [*docs.columns, *poisson_mix.ADDED] and {r["source"] for r in none.select("source").collect()} == {None, "src0"}


def test_mix_edges(spark):
    docs = frame(spark, [(*r, None if k % 2 else "src0") for k, r in enumerate(edges())])
    mixed = poisson_mix.mix_sources(docs, {"src0": 1.0, "absent": 3.0})
    assert mixed.where("source IS NULL").isEmpty() and set(mixed.columns) == set(docs.columns) | set(poisson_mix.ADDED)
    assert not poisson_mix.mix_sources(docs, {None: 1.0}).where("source IS NULL").isEmpty()
    assert poisson_mix.mix_sources(frame(spark, []), {"src0": 1.0}).count() == 0
    clashing = docs.withColumns({c: F.lit(1) for c in ("_mix_mean", "_mix_source", "_Mix_Text", "_mix_occurrence", "_key_of", "_times", "_key")})
    again = poisson_mix.mix_sources(clashing, {"src0": 1.0, "absent": 3.0})
    assert again.columns == [*clashing.columns, *poisson_mix.ADDED] and again.count() == mixed.count()
    with pytest.raises(ValueError):
        poisson_mix.mix_sources(docs.withColumn("copy_no", F.lit(1)), {"src0": 1.0})


def read_back(spark, pages, packages=3, **options):
    listed = written(warc_zip.write_packages(pages, scratch(spark, "warc"), packages=packages, **options), "warc-list")
    return listed, warc_zip.read_packages(spark, listed, records_per_job=3)


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 50_000, "<p>b</p>", "<p>a</p>", None]
    pages = spark.createDataFrame([(i, None if i == 5 else f"http://x/{i}\r\nbad", h, 9) for i, h in enumerate(html)],
                                  "page_id bigint, url string, html string, payload int")
    listed, records = read_back(spark, pages)
    got = {r["page_id"]: r for r in records.collect()}
    assert len(got) == len(html) == listed.agg(F.sum("records")).first()[0]
    for i, h in enumerate(html):
        body = (h or "").encode()
        first = min(k for k, x in enumerate(html) if (x or "") == (h or ""))
        r = got[i]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode() and r["payload_bytes"] == len(body)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i else ("revisit", first))
        assert r["payload"] is None if first != i else bytes(r["payload"]) == body
    for path in (r["path"] for r in listed.collect()):
        with zipfile.ZipFile(path.removeprefix("file:")) as package:
            assert package.testzip() is None and all(m.compress_type == zipfile.ZIP_STORED for m in package.infolist())


def test_warc_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "b" * 40), (4, "u", "b" * 40), (None, "u", "c")], "page_id bigint, url string, html string")
    _, records = read_back(spark, pages, min_revisit_bytes=10)
    assert {r["page_id"]: r["refers_to"] for r in records.collect()} == {1: None, 2: None, 3: None, 4: 3}
    assert read_back(spark, pages.where("page_id > 99"))[1].count() == 0


def test_zip64_directory():
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w", zipfile.ZIP_STORED) as package:
        package.writestr("a.txt", b"first")
        package.writestr("é.bin", b"second")
        package.writestr(zipfile.ZipInfo("deflated"), b"x" * 99, zipfile.ZIP_DEFLATED)
        package.comment = b"a comment with PK in it"
    data = plain.getvalue()

    def content(raw):
        source = io.BytesIO(raw)
        return {n: raw[a:a + s] for n, (a, s) in warc_zip.stored_members(source).items()}

    assert content(data) == {"a.txt": b"first", "é.bin": b"second"}
    end = data.rfind(b"PK\x05\x06")
    count, length, offset = struct.unpack_from("<HII", data, end + 10)
    directory = bytearray(data[offset:offset + length])
    # The first entry's sizes and offset move to a ZIP64 extra field.
    name, extra = struct.unpack_from("<HH", directory, 28)
    full, where = struct.unpack_from("<I", directory, 24)[0], struct.unpack_from("<I", directory, 42)[0]
    struct.pack_into("<II", directory, 20, 0xFFFFFFFF, 0xFFFFFFFF)
    struct.pack_into("<I", directory, 42, 0xFFFFFFFF)
    wide = struct.pack("<HHQQQ", 1, 24, full, full, where)
    struct.pack_into("<H", directory, 30, extra + len(wide))
    directory[46 + name + extra:46 + name + extra] = wide
    record = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, len(directory), offset)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, offset + len(directory), 1)
    last = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert content(data[:offset] + bytes(directory) + record + locator + last) == {"a.txt": b"first", "é.bin": b"second"}
    with pytest.raises(ValueError):
        content(data[:end])
