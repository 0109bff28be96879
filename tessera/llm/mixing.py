"""Sources brought to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import query
from tessera.llm.common import given, saved

SEED = 17
#: Largest mean of one Poisson draw; a larger rate is the sum of several draws, so exp(-mean) stays far from zero.
DRAW_MEAN = 32.0
#: Rate tables of at most so many sources (about 60 bytes and a short array each) are broadcast; larger ones are joined.
BROADCAST_SOURCES = 2000

#: Terms of the distribution function that matter for a mean: beyond them less than 2**-52 is left.
TERMS = "cast(ceil(mean + 10 * sqrt(mean) + 20) as int)"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest of ``parts``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, total: int | None) -> DataFrame:
    """``source``, ``draws`` and ``cdf`` per source: how many draws, and the distribution function of each."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.sqrt(F.col("n").cast("double"))
    else:
        chosen = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
        weight = F.coalesce(chosen[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    counts = saved(counts.withColumn("w", weight), "mix-rates")
    rows, mass, n_sources = counts.agg(F.sum("n"), F.sum("w"), F.count(F.lit(1))).first()
    wanted = float(total if total is not None else rows or 0)
    rate = F.lit(wanted) * F.col("w") / F.lit(float(mass or 1.0) or 1.0) / F.col("n")
    out = counts.select("source", rate.alias("rate"))
    out = out.withColumn("draws", F.greatest(F.ceil(F.col("rate") / DRAW_MEAN), F.lit(1)).cast("int"))
    out = out.withColumn("mean", F.col("rate") / F.col("draws"))
    out = out.select("source", "draws", F.expr(f"""
        aggregate(sequence(1, {TERMS}), named_struct('p', exp(-mean), 'c', array(exp(-mean))),
          (a, i) -> named_struct('p', a.p * mean / i, 'c', concat(a.c, array(element_at(a.c, -1) + a.p * mean / i))),
          a -> a.c)""").alias("cdf"))
    out = saved(out, "mix-cdf")
    return F.broadcast(out) if n_sources <= BROADCAST_SOURCES else out


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED,
        id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Each row of ``docs`` as often as a Poisson draw says, in an order that mixes all sources.

    A source's mean repetition rate is ``total * weight / rows of the source`` (weights are shares of their sum;
    ``total`` defaults to the number of rows, ``weights`` to the square root of each source's size). The draw inverts
    the distribution function at a number hashed from (seed, id, draw), so it is the same on every run and machine.
    Adds ``mix_copy`` (1, 2, ...) and ``mix_key`` (a digest of seed, id and copy); rows are dealt over partitions and
    sorted by that key, which no source or document dominates.

    NULL source: a source of its own. A source that ``weights`` lacks: weight 0. NULL id: hashed as an empty string.
    Rows with one id share their draws. Other columns go along; own ``mix_copy``/``mix_key`` columns are replaced.
    Empty table: no rows.
    """
    docs = docs.drop("mix_copy", "mix_key")
    table = rates(docs, source_col, weights, total).select(
        F.col("source").alias("_mix_source"), F.col("draws").alias("_mix_draws"), F.col("cdf").alias("_mix_cdf"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    one = docs.join(table, docs[source_col].eqNullSafe(F.col("_mix_source")))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("_mix_draws")), F.lit(0),
        lambda acc, j: acc + F.size(F.filter("_mix_cdf", lambda c: c <= uniform(F.lit(str(seed)), key, j.cast("string")))))
    one = one.withColumn("_mix_n", drawn).where("_mix_n > 0")
    out = one.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_mix_n"))).alias("mix_copy"))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                              F.col("mix_copy").cast("string")))
    return out.withColumn("mix_key", order).repartition("mix_key").sortWithinPartitions("mix_key")


@query("op7_mixing", f"""
WITH RECURSIVE s AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM s)::DOUBLE * w / (SELECT sum(w) FROM s) / n AS rate FROM s),
m AS (SELECT source, greatest(ceil(rate / {DRAW_MEAN}), 1)::INT AS draws, rate / greatest(ceil(rate / {DRAW_MEAN}), 1) AS mean FROM r),
c AS (
  SELECT source, draws, mean, 0 AS i, exp(-mean) AS p, exp(-mean) AS cum FROM m
  UNION ALL
  SELECT source, draws, mean, i + 1, p * mean / (i + 1), cum + p * mean / (i + 1) FROM c
  WHERE i < ceil(mean + 10 * sqrt(mean) + 20)
),
f AS (SELECT source, draws, list(cum ORDER BY i) AS cdf FROM c GROUP BY source, draws),
k AS (
  SELECT d.*, list_sum(list_transform(range(1, draws + 1), lambda j: len(list_filter(cdf, lambda x: x <=
    ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT / 4503599627370496.0)))) AS copies
  FROM documents d JOIN f ON d.source IS NOT DISTINCT FROM f.source
),
e AS (SELECT *, unnest(range(1, copies::BIGINT + 1)) AS mix_copy FROM k WHERE copies > 0)
SELECT doc_id, source, text, mix_copy::INT AS mix_copy,
  md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, '') || ':' || mix_copy) AS mix_key
FROM e
""")
def op7_mixing(spark, sf_dir):
    return mix(given(spark, sf_dir, "documents")).select("doc_id", "source", "text", "mix_copy", "mix_key")
