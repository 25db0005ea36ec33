"""Embedding near-duplicates through a pivot-permutation index.

Each distinct vector is described by its nearest pivots (reference vectors),
in order.  An inverted list holds, per block and pivot triple, the vectors
that have those three among their nearest; to be in one list is to share at
least three pivots.  The number of shared pivots of a pair orders and filters
the candidates, and their cosine in double precision decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.llm.common import drop, stored
from querylens.llm.components import connected_components

#: Least cosine of a link.
COSINE = 0.98
#: Vectors sampled (by their hash, expected number) to choose pivots from, and
#: the pivots of a dimension.  This bounds what the driver and each task hold.
SAMPLE, PIVOTS = 2048, 512
#: Longs that hold a set of pivots.
WORDS = PIVOTS // 64
#: Nearest pivots that describe a vector, and pivots that a pair must share.
NEAREST, SHARED = 8, 3
#: Pivots are farther apart than linked vectors can be (0.36 and 0.2, as
#: the crow flies): closer ones would part them.
PIVOT_COSINE = 0.935
SEED = 3


def choose_pivots(dimension: int, sample: list[list[float]]) -> np.ndarray:
    """:data:`PIVOTS` unit vectors.

    From the sample each is the one that is farthest from those before it, so
    that vectors which lie close together, as in a narrow cone, are told apart as
    well.  Where the sample is too small or too narrow, random directions fill up.
    """
    out = []
    if sample:
        units = np.asarray(sample, dtype=np.float64)
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        at, nearest = 0, np.full(len(units), -np.inf)
        while len(out) < PIVOTS and nearest[at] < PIVOT_COSINE:
            out.append(units[at])
            nearest = np.maximum(nearest, units @ units[at])
            at = int(np.argmin(nearest))
    if len(out) < PIVOTS:
        more = np.random.default_rng(SEED).normal(size=(PIVOTS - len(out), dimension))
        out += list(more / np.linalg.norm(more, axis=1, keepdims=True))
    return np.stack(out)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The indices of the nearest pivots, nearest first (ties: the lower index)."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :NEAREST]


def _described(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = batch.column(1).to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(i)
            for n, rows in by_size.items():
                if n not in pivots:  # a dimension of which no vector was sampled
                    pivots[n] = choose_pivots(n, [])
                ranks = nearest_pivots(np.array([vectors[i] for i in rows], dtype=np.float64), pivots[n])
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(list(ranks.astype(np.int32)), kind)], names=["node", "permutation"])

    return run


def _lists() -> F.Column:
    """All sets of :data:`SHARED` of the sorted nearest pivots, as one long each."""
    return F.array(*[F.expr(" | ".join(f"shiftleft(cast(near[{i}] as long), {20 * at})" for at, i in enumerate(c))) for c in combinations(range(NEAREST), SHARED)])


def _word(i: int) -> str:
    """SQL: the pivots 64 i to 64 i + 63 of ``near`` as bits."""
    return f"aggregate(near, 0L, (s, p) -> s | if(p div 64 = {i}, shiftleft(1L, p % 64), 0L))"


def _mask(i: int) -> str:
    """SQL: the bits of word i up to the last pivot of ``list``."""
    last = f"cast(shiftright(list, {20 * (SHARED - 1)}) as int)"
    return f"case when {last} >= {64 * i + 63} then -1L when {last} < {64 * i} then 0L else shiftrightunsigned(-1L, {64 * i + 63} - {last}) end"


def linked_pairs(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links ``(a, b, shared, cosine)``, a < b, as a written table, between the rows of ``nodes``:
    (node, block, vector: an array of floats or doubles), no vector null, zero or
    non-finite.

    Only rows with equal blocks and equally many dimensions are compared.
    """
    n = nodes.count()
    hashed = F.xxhash64("vector", F.lit("pivots"))
    chosen = nodes.where(F.pmod(hashed, F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30)))
    by_size: dict[int, list] = {}
    for r in sorted(chosen.select(hashed.alias("h"), "vector").distinct().collect(), key=lambda r: (r.h, r.vector)):
        by_size.setdefault(len(r.vector), []).append(r.vector)
    pivots = {n: choose_pivots(n, sample) for n, sample in by_size.items()}
    told = nodes.select("node", "vector").mapInArrow(_described(pivots), "node long, permutation array<int>")
    sized = nodes.select(F.col("node").alias("id"), "block", F.size("vector").alias("n"))
    told = told.join(sized, F.col("node") == F.col("id")).withColumn("near", F.array_sort("permutation"))
    told = told.withColumns({f"w{i}": F.expr(_word(i)) for i in range(WORDS)})
    words = [f"w{i}" for i in range(WORDS)]
    lists = stored(told.select("node", *words, "block", "n", F.explode(_lists()).alias("list")), "pivot-lists")
    left = lists.select(F.col("node").alias("a"), *words, "block", "n", "list")
    right = lists.select(*[F.col(c).alias(f"{c}_b") for c in ("node", *words, "block", "n", "list")]).withColumnRenamed("node_b", "b")
    # a pair meets in every list it shares; only that of its first three pivots
    # admits it: up to the last of them it shares three
    upto = " + ".join(f"bit_count(w{i} & w{i}_b & {_mask(i)})" for i in range(WORDS))
    met = f"block = block_b and n = n_b and list = list_b and a < b and {upto} = {SHARED}"
    shared = " + ".join(f"bit_count(w{i} & w{i}_b)" for i in range(WORDS))
    met = left.join(right.hint("merge"), F.expr(met)).select("a", "b", F.expr(shared).alias("shared"))
    vectors = nodes.select("node", "vector")
    pairs = met.join(vectors.withColumnsRenamed({"node": "a", "vector": "x"}), "a").join(vectors.withColumnsRenamed({"node": "b", "vector": "y"}), "b")
    dot = lambda p, q: f"aggregate(zip_with({p}, {q}, (s, t) -> cast(s as double) * t), 0d, (s, t) -> s + t)"
    # one square root, so that a vector and its copies have cosine 1 exactly
    pairs = pairs.withColumn("cosine", F.expr(f"{dot('x', 'y')} / sqrt({dot('x', 'x')} * {dot('y', 'y')})"))
    out = stored(pairs.where(F.col("cosine") >= cosine).select("a", "b", "shared", "cosine"), "vector-links")
    drop(lists)
    return out


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Rows are compared only if their labels are equal and not null.  A vector
    that is null, empty, zero or holds null or non-finite components links
    with nothing, and neither does one of another dimension.  Equal vectors of
    a label are one node with a weight: all its rows link with each other and
    with the rows of linked nodes, without being expanded into pairs.  Rows
    that repeat an id count as rows; a row with a null id is counted as a link
    of others, gets the least id it reaches, and is not kept.
    """
    kind = vectors.schema[embedding].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # floats stay as short as they are
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("block"), F.col(embedding).cast(kind).alias("vector"))
    sound = "block is not null and vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < 1e150) and exists(vector, x -> abs(x) > 1e-150)"
    rows = rows.withColumn("sound", F.coalesce(F.expr(sound), F.lit(False)))
    # 0.0 and -0.0 are one
    zero = F.lit(0).cast(kind[6:-1])
    rows = rows.withColumn("vector", F.when(F.col("sound"), F.transform("vector", lambda x: x + zero)))
    grouped = rows.where("sound").groupBy("block", "vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    # a node's number is written once
    grouped = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "vectors")
    links = linked_pairs(grouped.select("node", "block", "vector"), cosine)
    ends = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    sizes = grouped.select(F.col("node").alias("v"), F.col("n").alias("n_v"))
    degree = ends.join(sizes, "v").groupBy("u").agg(F.sum("n_v").alias("n_other"))
    found = connected_components(links, "a", "b")
    parts = stored(grouped.select("node", "least").join(found, "node"), "parts")
    # written first, so that a component of any size meets its least id evenly
    least = stored(parts.groupBy(F.col("component").alias("of")).agg(F.min("least").alias("of_component")), "least")
    linked = parts.join(least, F.col("component") == F.col("of")).select(F.col("node").alias("p_node"), "of_component")
    nodes = grouped.join(degree, F.col("node") == F.col("u"), "left").join(linked, F.col("node") == F.col("p_node"), "left")
    nodes = nodes.select(
        F.col("block").alias("g_block"),
        F.col("vector").alias("g_vector"),
        (F.col("n") - 1 + F.coalesce("n_other", F.lit(0))).alias("g_links"),
        F.coalesce("of_component", "least").alias("g_component"),
    )
    nodes = stored(nodes, "vector-nodes")
    for done in (grouped, links, found, parts, least):
        drop(done)
    same = (F.xxhash64("vector") == F.xxhash64("g_vector")) & (F.col("block") == F.col("g_block")) & (F.col("vector") == F.col("g_vector"))
    out = rows.join(nodes, same, "left")
    out = out.select("vec_id", F.coalesce("g_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("g_component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def oracle(embeddings: str = "embeddings", cosine: float = COSINE) -> str:
    """DuckDB SQL of :func:`near_vectors`, by all pairs, for unique ids."""
    dot = lambda x, y: f"list_dot_product({x}, {y})"
    return f"""
with recursive v as (select vec_id, label, embedding::double[] as e from {embeddings}),
s as (select * from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select x.vec_id as a, y.vec_id as b from s x join s y on x.label = y.label and x.vec_id < y.vec_id and len(x.e) = len(y.e)
  where {dot('x.e', 'y.e')} / sqrt({dot('x.e', 'x.e')} * {dot('y.e', 'y.e')}) >= {cosine}),
l as (select a, b from p union all select b, a from p),
r(node, reached) as (select vec_id, vec_id from v union select r.node, l.b from r join l on r.reached = l.a),
c as (select node, min(reached) as component_id from r group by node),
n as (select a, count(*) as n_links from l group by a)
select v.vec_id, coalesce(n.n_links, 0)::bigint as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join c on c.node = v.vec_id left join n on n.a = v.vec_id"""
