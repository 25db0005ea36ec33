"""Mixing sources to target weights by Poisson replication.

A source's target weight over its share of the documents is its rate: the mean
number of times each of its documents is to occur.  A hash of the document's
id is a uniform number, the Poisson distribution with that mean is inverted at
it, and the document is repeated that often, possibly not at all.  The copies
are shuffled globally by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.llm.common import fresh, stored

#: Without given weights a source of n documents weighs n to this power:
#: 1 leaves the mix as it is, 0 makes all sources equal.
TEMPERATURE = 0.5
SEED = 20
#: Largest mean that is inverted at once; a larger one is a sum of Poisson
#: numbers of equal means below it, each from a hash of its own.
MOST_MEAN = 32.0


def uniform(key: str, seed: int, part: str = "0") -> str:
    """SQL: a number between 0 and 1 (both excluded) from the MD5 of a key."""
    digits = f"substring(md5(concat_ws('|', coalesce(cast({key} as string), ''), '{seed}', {part})), 1, 13)"
    return f"(cast(conv({digits}, 16, 10) as bigint) + 0.5D) / 4503599627370496D"


def cumulative(mean: str) -> str:
    """SQL: the distribution function at 0, 1, ... of a Poisson number, up to
    where what is left is nothing in double precision."""
    last = f"cast(ceil({mean} + 12 * sqrt({mean}) + 20) as int)"
    start = f"named_struct('p', exp(-{mean}), 'c', array(exp(-{mean})))"
    step = f"(a, k) -> named_struct('p', a.p * {mean} / k, 'c', concat(a.c, array(element_at(a.c, -1) + a.p * {mean} / k)))"
    return f"aggregate(sequence(1, {last}), {start}, {step}).c"


def rates(docs: DataFrame, source: str, weights: DataFrame | None, total: float | None, temperature: float) -> DataFrame:
    """(source, n, rate): one row per source that occurs.

    ``weights`` is (source, weight), weight not negative; sources it doesn't
    name weigh nothing.  ``total`` documents are to be expected, as many as
    there are unless given.
    """
    counts = docs.groupBy(F.col(source).alias("of_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        named = weights.select(F.col(weights.columns[0]).alias("w_source"), F.col(weights.columns[1]).cast("double").alias("weight"))
        weighed = counts.join(named, F.col("of_source").eqNullSafe(F.col("w_source")), "left").select("of_source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = weighed.agg(F.sum("weight").alias("w"), F.sum("n").alias("all")).first()
    wanted = float(total if total is not None else sums["all"] or 0)
    share = wanted / sums["w"] if sums["w"] else 0.0
    return weighed.select("of_source", "n", (F.col("weight") * F.lit(share) / F.col("n")).alias("rate"))


def replicate(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    weights: DataFrame | None = None,
    total: float | None = None,
    temperature: float = TEMPERATURE,
    seed: int = SEED,
    copy: str | None = "copy",
    text: str = "text",
) -> DataFrame:
    """The mix: rows of ``docs``, each as often as its number says, in a global
    random order, with the number of the copy (from 0) in column ``copy``.

    A null source is a source.  Rows that repeat an id get the same number
    each; rows without an id go by their ``text``, if there is such a column.
    Where ``docs`` has a column named like ``copy``, that stays and the new one
    has underscores before its name.  An empty table gives an empty one.
    """
    told = rates(docs, source, weights, total, temperature)
    parts = F.greatest(F.ceil(F.col("rate") / MOST_MEAN), F.lit(1)).cast("int")
    told = told.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts")).withColumn("cdf", F.expr(cumulative("mean")))
    # a table of known size: broadcast if small, else joined with skew split
    of, number, cdf, nth, where = fresh(docs, "of_source", "parts", "cdf", "copy_number", "shuffle_key")
    told = stored(told.select("of_source", "parts", "cdf"), "rates").withColumnsRenamed({"of_source": of, "parts": number, "cdf": cdf})
    joined = docs.join(told, F.col(source).eqNullSafe(F.col(of)))
    key_of = f"coalesce(cast(`{doc_id}` as string), md5(cast(`{text}` as string)))" if text in docs.columns else f"`{doc_id}`"
    draw = f"size(filter({cdf}, c -> c <= {uniform(key_of, seed, 'cast(i as string)')}))"
    n = F.expr(f"aggregate(sequence(0, {number} - 1), 0, (s, i) -> s + {draw})")
    joined = joined.withColumn(nth, n).where(F.col(nth) > 0).drop(of, number, cdf)
    copies = joined.withColumn(nth, F.explode(F.sequence(F.lit(0), F.col(nth) - 1)))
    key: Column = F.xxhash64(F.col(doc_id), F.col(nth), F.xxhash64(F.col(source)), F.lit(seed), *[F.col(c) for c in (text,) if c in docs.columns])
    copies = copies.withColumn(where, key)
    out = copies.repartition(F.col(where)).sortWithinPartitions(where).drop(where)
    return out.drop(nth) if copy is None else out.withColumnRenamed(nth, *fresh(docs, copy))


def oracle(documents: str = "documents", seed: int = SEED, temperature: float = TEMPERATURE) -> str:
    """DuckDB SQL of :func:`replicate` without weights, for means that are
    inverted at once."""
    return f"""
with recursive n as (select source, count(*) as n from {documents} group by source),
w as (select source, n, pow(n::double, {float(temperature)}) as weight from n),
r as (select source, weight * ((select sum(n) from w)::double / (select sum(weight) from w)) / n as rate from w),
c(source, rate, k, p, cdf) as (select source, rate, 0, exp(-rate), exp(-rate) from r
  union all select source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) from c where k < ceil(rate + 12 * sqrt(rate) + 20)),
l as (select source, list(cdf order by k) as cdfs from c group by source),
d as (select d.*, len(list_filter(l.cdfs, lambda x: x <= (('0x' || substr(md5(coalesce(d.doc_id::varchar, md5(d.text), '') || '|{seed}|0'), 1, 13))::bigint + 0.5::double) / 4503599627370496::double)) as times
  from {documents} d join l on d.source is not distinct from l.source)
select * exclude (times), unnest(range(times))::int as copy from d"""
