"""Mixing sources to target weights by Poisson replication.

The mean repetition of a source is its target share of the output over what it holds; every
document draws its number of copies from the Poisson distribution of that mean, by inversion at a
uniform value hashed from seed, id, text and the document's number among rows equal in both;
copies are exploded and shuffled globally.

All built-in expressions. The hash decides, so a retried task repeats its draw. Rows that repeat
are told apart by a count of their keys: rows equal in every column are collapsed with their number
(map-side) and exploded again, so that a hot repeated row gathers nowhere.

Defined results: sources without a weight (null included, unless weighted as None) have the
weight ``other``, and no copies if that is not given; null ids and texts hash as ''. Each of
several rows equal in id and text draws for itself. Empty input gives empty output. Rows keep all
their columns; a clashing name among the added ones is an error before any work, other names
never clash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import unused, written

ADDED = ("copy_no", "mix_key")
# Larger means are drawn as a sum of draws, as exp(-mean) must not vanish.
LARGEST_MEAN = 500.0


def row_text(seed: str, id_col: str, text_col: str, occurrence: Column) -> Column:
    """What the draws of a row are hashed from."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws(":", F.lit(seed), blank(id_col), F.md5(blank(text_col).cast("binary")), occurrence.cast("string"))


def uniform(text: Column) -> Column:
    """In [0, 1): the first 48 bits of the md5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def poisson_count(mean: Column, u: Column) -> Column:
    """Smallest k whose cumulative probability is above u: the Poisson distribution of the mean, inverted.

    As many terms as leave less than the resolution of u."""
    terms = F.ceil(mean + F.sqrt(mean) * 12 + 20).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), terms),
        F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("n")),
        lambda s, k: F.struct((s.p * mean / k).alias("p"), (s.cdf + s.p * mean / k).alias("cdf"),
                              (s.n + F.when(s.cdf <= u, 1).otherwise(0)).alias("n")),
        lambda s: s.n)


def poisson_draw(mean: Column, text: Column) -> Column:
    """A Poisson value of any mean, hashed from ``text``: one inversion up to ``LARGEST_MEAN``, beyond it
    the sum of independent ones."""
    parts = F.ceil(mean / LARGEST_MEAN).cast("int")
    more = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, k: n + poisson_count(mean / parts, uniform(F.concat(text, F.lit(":part:"), k.cast("string")))))
    return F.when(mean <= LARGEST_MEAN, poisson_count(mean, uniform(text))).otherwise(more)


def with_occurrence(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """Add the number, from 1, of each row among those equal in id and text.

    Only hashed keys are counted; where none repeats, which is usual, no row moves."""
    key = F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in (id_col, text_col)])
    repeats = written(df.groupBy(key.alias("_key")).count().where("count > 1").select("_key"), "mix-repeats")
    if repeats.isEmpty():
        return df.withColumn(name, F.lit(1))
    at, n = unused("_key_of", df.columns), unused("_times", df.columns)
    keyed = df.withColumn(at, key)
    single = keyed.join(repeats.hint("merge"), keyed[at] == repeats["_key"], "left_anti").withColumn(name, F.lit(1))
    alike = keyed.join(repeats.hint("merge"), keyed[at] == repeats["_key"], "left_semi").groupBy(*keyed.columns).agg(F.count("*").alias(n))
    order = [f.name for f in df.schema if f.dataType.typeName() != "map"]
    before = F.sum(n).over(Window.partitionBy(at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    first = F.coalesce(before, F.lit(0)) + 1
    numbered = alike.withColumn(name, first).withColumn(name, F.explode(F.sequence(F.col(name), F.col(name) + F.col(n) - 1)))
    return single.select(*df.columns, name).unionByName(numbered.select(*df.columns, F.col(name).cast("int").alias(name)))


# Sources whose means may be broadcast.
BROADCAST_SOURCES = 10_000


def source_means(df: DataFrame, weights: Mapping[str | None, float], total: float | None, source_col: str, other: float | None) -> DataFrame:
    """(_mix_source, _mix_mean): mean copies per row of each source with a weight above 0.

    The same source may hold a third of all rows: only its count is gathered, combined map-side.
    """
    weight = F.lit(None if other is None else float(other)).cast("double")
    for source, value in weights.items():
        weight = F.when(F.col(source_col).eqNullSafe(F.lit(source)), F.lit(float(value))).otherwise(weight)
    have = df.groupBy(source_col).agg(F.count("*").alias("_mix_n")).withColumn("_mix_weight", weight).where("_mix_weight IS NOT NULL")
    rows, share, sources = have.agg(F.sum("_mix_n"), F.sum("_mix_weight"), F.count("*")).first()
    wanted = float((rows or 0) if total is None else total)
    means = have.where("_mix_weight > 0").select(
        F.col(source_col).alias("_mix_source"), (F.lit(wanted) * F.col("_mix_weight") / F.lit(share or 1.0) / F.col("_mix_n")).alias("_mix_mean"))
    return F.broadcast(means) if sources <= BROADCAST_SOURCES else means


def mix_sources(df: DataFrame, weights: Mapping[str | None, float], *, total: float | None = None, seed: str = "mix", id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source", other: float | None = None) -> DataFrame:
    """``df``'s columns plus copy_no (from 1) and mix_key (the global order), in shuffled order.

    ``weights`` are target shares of the output rows, ``total`` their expected number (default:
    as many as the weighted sources hold). ``other`` is the weight of each source that ``weights``
    does not name, null included.
    """
    if clash := set(ADDED) & set(df.columns):
        raise ValueError(f"rename {sorted(clash)} first")
    source, mean, occurrence, text, copies = (unused(c, df.columns) for c in ("_mix_source", "_mix_mean", "_mix_occurrence", "_mix_text", "_mix_copies"))
    means = source_means(df, weights, total, source_col, other).toDF(source, mean)
    rows = with_occurrence(df, id_col, text_col, occurrence)
    weighted = rows.join(means, F.col(source_col).eqNullSafe(F.col(source))).withColumn(text, row_text(seed, id_col, text_col, F.col(occurrence)))
    drawn = weighted.withColumn(copies, poisson_draw(F.col(mean), F.col(text))).where(F.col(copies) > 0)
    exploded = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col(copies))))
    keyed = exploded.withColumn("mix_key", F.substring(F.md5(F.concat(F.col(text), F.lit(":"), F.col("copy_no").cast("string")).cast("binary")), 1, 16))
    return shuffled(keyed.select(*df.columns, *ADDED))


def shuffled(df: DataFrame) -> DataFrame:
    """Global shuffle: hash partitions of the random key, each in key order. One exchange, even by design."""
    return df.repartition(F.col("mix_key")).sortWithinPartitions("mix_key")


def mix_sql(weights: Mapping[str, float], other: float, seed: str = "mix") -> str:
    """The same rows in DuckDB SQL (named sources as text, means up to ``LARGEST_MEAN``), for checking."""
    values = ", ".join(f"('{k}', {float(v)!r}::DOUBLE)" for k, v in weights.items())
    return f"""
WITH w(source, weight) AS (VALUES {values}),
have AS (SELECT d.source, coalesce(any_value(w.weight), {float(other)!r}::DOUBLE) AS weight, count(*) AS n
         FROM documents d LEFT JOIN w ON w.source = d.source GROUP BY d.source),
m AS (SELECT source, (SELECT sum(n) FROM have)::DOUBLE * weight / (SELECT sum(weight) FROM have) / n AS mean FROM have WHERE weight > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY lang NULLS FIRST, source NULLS FIRST, n_chars NULLS FIRST) AS occurrence FROM documents),
r AS (SELECT o.*, mean, concat_ws(':', '{seed}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')), occurrence::VARCHAR) AS mark
      FROM o JOIN m ON o.source IS NOT DISTINCT FROM m.source),
u AS (SELECT *, ('0x' || substr(md5(mark), 1, 12))::BIGINT::DOUBLE / {float(1 << 48)!r} AS u FROM r),
k AS (SELECT *, list_reduce(
        list_concat([[exp(-mean), exp(-mean), 0.0]], list_transform(range(1, ceil(mean + sqrt(mean) * 12 + 20)::BIGINT + 1), lambda x: [x::DOUBLE])),
        lambda s, x: [s[1] * mean / x[1], s[2] + s[1] * mean / x[1], s[3] + CASE WHEN s[2] <= u THEN 1 ELSE 0 END])[3]::INT AS copies FROM u),
e AS (SELECT *, unnest(generate_series(1, copies)) AS copy_no FROM k WHERE copies > 0)
SELECT doc_id, text, lang, source, n_chars, copy_no::INT AS copy_no, substr(md5(mark || ':' || copy_no), 1, 16) AS mix_key
FROM e"""
