"""SimHash near-duplicates by similarity: Golay keys propose, sets decide.

Two texts are linked if their sets of five-word shingles have a Jaccard
similarity of at least 0.8; equal sets are one node.  Links are looked for in
rounds, each between what the rounds before it left apart, so that a dense group
of near copies isn't paired within itself:

1. fingerprints of the shingles at most four bits apart, found through their
   Golay keys (:mod:`querylens.llm.simhash`);
2. and on, the exact way for the rest, since four of 64 bits are few and texts
   that similar can be a dozen bits apart: prefix filtering.  Under any one order
   of all shingles, sets that similar share one of the first
   ``n - ceil(0.8 n) + 1`` shingles of either.  Of the nodes of such a shingle
   each is first compared with the next in size, then, while very many pairs are
   apart, with a few drawn ones, which joins the stragglers of a group, and last
   all that are still apart with each other, so no link between components is
   missed.

Each round verifies its pairs on the whole sets.  The order of shingles is by how
often one is in a sample of the texts, then by its hash, so that passages common
to many documents come last.  The sample decides the cost, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.llm import simhash
from querylens.llm.common import drop, fresh, release_memory, slices, small_batches, stored
from querylens.llm.components import connected_components

#: Words of a shingle; linked sets are at least NUMERATOR / DENOMINATOR alike.
WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5
#: One of so many distinct texts is sampled for the order, and shingles of the
#: sample that are ordered by their number; bounds the driver, not the links.
SAMPLED, ORDERED = 64, 100_000
#: While the keys have more than MANY pairs a row that are apart, nodes are
#: compared with up to SOME others each, until that leaves more than SPARED of
#: the pairs.  These decide the cost, not the links: all that are left follow.
MANY, SOME, SPARED = 2, 8, 0.9
#: The fewest bits of a sketch (a power of two); it has two or more a shingle.
BITS = 512


def hashes_of(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's shingles, in order; none for a blank text.

    Words as in :func:`querylens.llm.simhash.fingerprint`; fewer than a
    shingle's make one shingle.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(found) - words + 1)
    return np.fromiter((digest(b" ".join(found[i : i + words]), simhash.SEED) for i in range(n)), dtype=np.uint64, count=n)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(hashes_of(text).view(np.int64))


def node_of(found: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(found.tobytes()), dtype=np.uint64).view(np.int64))


def prefix(found: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of a set in the order, as many as a similar set can't all lack."""
    keep = len(found) - -(-NUMERATOR * len(found) // DENOMINATOR) + 1 if len(found) else 0
    if len(often):
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        rank = np.where(often[at] == found, counts[at], 0)
        return found[np.lexsort((found, rank))[:keep]]
    return found[:keep]


def sketch(found: np.ndarray) -> bytes:
    """For each bit whether the shingles that fall to it are odd in number."""
    bits = max(BITS, 1 << (2 * len(found)).bit_length())
    odd = np.bincount((found.view(np.uint64) & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """At least so many shingles are in one of two sets only, by their sketches;
    the longer one is folded, as its bits would fall in a shorter one."""
    x, y = sorted((np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()))], names=["key"])


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur repeatedly in a sample of texts, sorted, and counts."""
    texts = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).dropDuplicates()
    counts = texts.mapInArrow(_exploded, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # a written table, so that what each task offers meets in a task
    most = stored(counts.orderBy(F.desc("n"), "key").limit(ORDERED), "common")
    rows = sorted((r.key, r.n) for r in most.collect())
    drop(most)
    return np.array([k for k, _ in rows], dtype=np.int64), np.array([n for _, n in rows], dtype=np.int64)


def _described(often: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            all_of = [hashes_of(t.as_py()) for t in batch.column(2)]
            sets = [np.unique(x.view(np.int64)) for x in all_of]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([node_of(s) for s in sets], pa.int64()),
                pa.array(np.array([simhash.majority(x) for x in all_of], dtype=np.uint64).view(np.int64), pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([prefix(s, often, counts) for s in sets], pa.list_(pa.int64())),
                pa.array([sketch(s) for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "node", "fp", "size", "prefix", "sketch"])
        release_memory()

    return run


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches don't rule them out: of two sets 0.8 alike a ninth of
    their shingles can differ."""
    for batch in batches:
        x, y, sizes = (batch.column(i).to_pylist() for i in (2, 3, 4))
        near = [(NUMERATOR + DENOMINATOR) * apart(a, b) <= (DENOMINATOR - NUMERATOR) * n for a, b, n in zip(x, y, sizes)]
        yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known, told = (None, None), []
        for a, x, y in zip(*(batch.column(i) for i in (0, 2, 3))):
            if known[0] != a.as_py():
                known = (a.as_py(), shingles(x.as_py()))
            told.append(similar(known[1], shingles(y.as_py())))
        yield batch.select([0, 1]).filter(pa.array(told, pa.bool_()))
    release_memory()


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs of nodes ``(a, b)`` that are similar, as a table."""
    one, two = (nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    alike = f"{DENOMINATOR} * least(size_a, size_b) >= {NUMERATOR} * greatest(size_a, size_b)"
    told = pairs.distinct().join(one, "a").join(two, "b").where(alike)
    told = told.select("a", "b", "sketch_a", "sketch_b", (F.col("size_a") + F.col("size_b")).alias("sizes"))
    pairs = stored(told.mapInArrow(_plausible, "a long, b long"), "pairs")
    named = pairs.select(F.col("a").alias("named")).unionAll(pairs.select("b")).distinct().join(nodes, F.col("named") == F.col("node")).select("named", "least")
    named = stored(named.select("named", "least.doc_id", "least.h").withColumnsRenamed({"doc_id": "least_id", "h": "least_h"}), "named")
    # a node's text is that of its least row
    texts = docs.join(named, F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("h") == F.col("least_h")))
    texts = stored(texts.select("named", "text").dropDuplicates(["named"]), "texts")
    one, two = (texts.select(F.col("named").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    out = stored(pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long"), "links")
    for done in (pairs, named, texts):
        drop(done)
    return out


def _ordered(a: Column | str, b: Column | str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _parts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(of, part)`` of every node, by the links found so far, as a table."""
    found = connected_components(links, "a", "b")
    out = stored(nodes.select(F.col("node").alias("of")).join(found, F.col("of") == F.col("node"), "left").select("of", F.coalesce("component", "of").alias("part")), "parts")
    drop(found)
    return out


def golay_links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The first round: similar nodes among those whose fingerprints are near, as
    a table.  Neighbours are compared first, then what that leaves apart."""
    same = Window.partitionBy("fp").orderBy("size", "node")
    chained = nodes.select("node", F.lag("node").over(same).alias("before")).where("before is not null").select(*_ordered("before", "node"))
    faces = stored(nodes.groupBy("fp").agg(F.min("node").alias("face")), "faces")
    of = lambda c: faces.select(F.col("fp").alias(c), F.col("face").alias(f"face_{c}"))
    named = lambda df: df.join(of("a"), "a").join(of("b"), "b").select(*_ordered("face_a", "face_b"))
    close = _links(chained.unionAll(named(simhash.neighbours(faces))), nodes, docs)
    parts = _parts(nodes, close)
    seated = faces.join(parts, F.col("face") == F.col("of")).select("fp", "part")
    rest = _links(named(simhash.near_fingerprints(seated).select("a", "b")), nodes, docs)
    out = stored(close.unionAll(rest), "golay-links")
    for done in (faces, close, parts, rest):
        drop(done)
    return out


def _shares(side: str, other: str) -> str:
    """SQL: two sets can be similar, by their sizes and by how much comes after
    the first shingle in common on both sides."""
    x, y = (f"size{side}", f"place{side}"), (f"size{other}", f"place{other}")
    return (
        f"{DENOMINATOR} * least({x[0]}, {y[0]}) >= {NUMERATOR} * greatest({x[0]}, {y[0]}) and "
        f"{NUMERATOR + DENOMINATOR} * least({x[0]} - {x[1]}, {y[0]} - {y[1]}) >= {NUMERATOR} * ({x[0]} + {y[0]})"
    )


def _one_each(seated: DataFrame) -> DataFrame:
    """Of the nodes of a key each and the next in size; of the nodes that one
    meets so, the one that it shares most keys with (the others can wait)."""
    order = Window.partitionBy("key").orderBy("size", "node")
    before = [F.lag(c).over(order).alias(f"{c}_before") for c in ("node", "size", "part")]
    met = seated.select("node", "size", "part", *before).where(f"part_before <> part and {DENOMINATOR} * size_before >= {NUMERATOR} * size")
    often = met.groupBy("node", "node_before").agg(F.count("*").alias("n"))
    return often.groupBy("node").agg(F.max_by("node_before", F.struct("n", "node_before")).alias("with")).select(*_ordered("node", "with"))


def _some_each(across: DataFrame, turn: int) -> DataFrame:
    """Of the nodes of a key each and the few before it in an order drawn for the
    key and the turn, if they are apart; of a node's pairs :data:`SOME`.  What
    comes late in the prefix has too little after it to meet a set as large."""
    early = across.where(f"{NUMERATOR + DENOMINATOR} * (size - place) >= {2 * NUMERATOR} * size").withColumn("drawn", F.xxhash64("node", "key", F.lit(turn)))
    few = Window.partitionBy("key").orderBy("drawn", "node").rowsBetween(-SOME, -1)
    met = early.withColumn("few", F.collect_list(F.struct("node", "size", "place", "part")).over(few)).withColumn("b", F.explode("few"))
    met = met.select("node", "size", "place", "part", *[F.col(f"b.{c}").alias(f"{c}_before") for c in ("node", "size", "place", "part")])
    met = met.where(f"part_before <> part and {_shares('', '_before')}").select(*_ordered("node", "node_before")).distinct()
    ends = met.select("a", "b", F.explode(F.array("a", "b")).alias("end")).withColumn("drawn", F.xxhash64("a", "b", F.lit(turn)))
    nth = F.row_number().over(Window.partitionBy("end").orderBy("drawn", "a", "b"))
    return ends.withColumn("nth", nth).where(f"nth <= {SOME}").select("a", "b").distinct()


def _all_apart(across: DataFrame) -> DataFrame:
    """All nodes of a key that are apart."""
    a, b = (across.select(*[F.col(c).alias(f"{c}_{side}") for c in ("node", "size", "place", "key", "part")]) for side in "ab")
    near = f"key_a = key_b and node_a < node_b and part_a <> part_b and {_shares('_a', '_b')}"
    return a.join(b.hint("merge"), F.expr(near)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _across(seated: DataFrame) -> DataFrame:
    """The rows of keys that aren't within one part, as a table; the others have
    nothing left to link."""
    seated = stored(seated, "part-keys")
    apart = seated.groupBy(F.col("key").alias("across")).agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    out = stored(seated.join(apart.select("across"), F.col("key") == F.col("across"), "left_semi"), "across")
    drop(seated)
    return out


def _still_apart(across: DataFrame) -> tuple[int, float]:
    """(rows, pairs of rows of a key that are apart)."""
    of_part = across.groupBy("key", "part").agg(F.count("*").alias("m"))
    of_key = of_part.groupBy("key").agg(F.sum("m").alias("n"), F.sum(F.col("m").cast("double") * F.col("m")).alias("own"))
    return tuple(of_key.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n").cast("double") * F.col("n") - F.col("own")) / 2), F.lit(0.0))).first())


def prefix_links(keys: DataFrame, nodes: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """The rounds after the first: ``links`` and those that they lack between
    components, as a table; ``keys`` (node, size, place, key) of the prefixes."""
    turn, last, before = 0, False, float("inf")
    while not last:
        parts = _parts(nodes, links)
        seated = keys.join(parts, F.col("node") == F.col("of")).select("node", "size", "place", "key", "part")
        across = None
        if not turn:
            pairs = _one_each(seated)
        else:
            across = _across(seated)
            n, pairs_left = _still_apart(across)
            # some more first, as long as that spares many of the pairs
            last = pairs_left <= MANY * n or pairs_left > SPARED * before
            before = pairs_left
            pairs = _all_apart(across) if last else _some_each(across, turn)
        found = _links(pairs, nodes, docs)
        more = stored(links.unionAll(found), "all-links")
        for done in (parts, found, links, across):
            if done is not None:
                drop(done)
        links, turn = more, turn + 1
    return links


def _nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of the rows (doc_id, h, node), the nodes (node, fp, size, sketch,
    least: the least row) and the keys that two nodes or more share."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, h long, node long, fp long, size long, prefix array<long>, sketch binary"
    rows = docs.select("doc_id", "h", "text").mapInArrow(_described(*common_shingles(docs)), schema)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "shingles")
    facts = [F.first(c).alias(c) for c in ("fp", "size", "sketch")]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "h")).alias("least")
    nodes = stored(rows.groupBy("node").agg(least, *facts, F.min("row").alias("first_row"), F.count("*").alias("n")), "nodes")
    # copies have their keys once
    copied = nodes.where("n > 1").select(F.col("node").alias("copied"), "first_row")
    single = rows.select("node", "row", "size", "prefix").join(copied, F.col("node") == F.col("copied"), "left").where("first_row is null or first_row = row")
    keys = single.select("node", "size", F.posexplode("prefix").alias("place", "key"))
    shared = F.count("*").over(Window.partitionBy("key"))
    keys = stored(keys.withColumn("n", shared).where("n > 1").drop("n"), "keys")
    return rows, nodes, keys


def _component_table(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, ``(of, part)`` of every node)."""
    with small_batches(docs.sparkSession):
        rows, nodes, keys = _nodes(docs)
        links = prefix_links(keys, nodes, docs, golay_links(nodes, docs))
        parts = _parts(nodes, links)
    drop(keys)
    drop(links)
    return rows, nodes, parts


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.withColumn("h", F.xxhash64("text"))


def _least(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """The least row of each component: the smallest id, then the least hash of
    a text; rows without an id only if there are no others."""
    whole = nodes.select("node", "least").join(parts, F.col("node") == F.col("of"))
    return whole.groupBy(F.col("part").alias("component")).agg(F.min("least").alias("least"))


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, node, component_id)`` for every row of ``docs``, as a table.

    node is a hash of the set of shingles, equal sets being one node (null,
    empty and blank texts have the empty set); component_id is the smallest id
    that can be reached over similar nodes, null where none of them has one.
    Rows that repeat come out as often as they went in; other columns don't
    matter; an empty table gives an empty one.
    """
    rows, nodes, parts = _component_table(_keyed(docs, doc_id, text))
    least = stored(_least(nodes, parts), "least")
    ids = stored(parts.join(least, F.col("part") == F.col("component")).select("of", F.col("least.doc_id").alias("component_id")), "components")
    out = stored(rows.select("doc_id", "node").join(ids, F.col("node") == F.col("of")).select("doc_id", "node", "component_id"), "members")
    for done in (rows, nodes, parts, least, ids):
        drop(done)
    return out


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component.

    It is that of the smallest id; of equal ids, the least hash of a text; of
    rows that repeat both, any one.  A row without an id stays only if no row of
    its component has one.  All blank texts are one component.  Columns stay as
    they are; an empty table gives an empty one.
    """
    rows, nodes, parts = _component_table(_keyed(docs, doc_id, text))
    keep = stored(_least(nodes, parts).select(F.col("least.doc_id").alias("id"), F.col("least.h").alias("h")), "kept")
    for done in (rows, nodes, parts):
        drop(done)
    return simhash.rows_of(docs, keep, doc_id, text)
