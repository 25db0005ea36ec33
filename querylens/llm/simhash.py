"""SimHash near-duplicates found through Golay-code fuzzy hashing.

The 64 fingerprint bits are cut into three segments of 22, 21 and 21 bits,
each a word of the perfect binary Golay code (23 bits, the rest zero).  Every
23-bit word is within three bits of exactly one codeword, hence two words one
bit apart are linked by "the codeword of the one is among the codewords of
the other's one-bit neighbourhood", and two words at most two bits apart have
such a codeword in common.  A word has one or six of these fuzzy keys.

Pigeonhole, for at most four differing bits over three segments, the errors
sorted: the two least are (0|1, 0|1), or the pattern is (0, 2, 2).

* family *near*, for each pair of segments: one side gives (fuzzy keys of the
  first) x (codeword of the second), the other (codeword of the first) x
  (fuzzy keys of the second).  Both within one bit means exactly one match.
* family *far*, for each segment: its bits as they are, and the fuzzy keys of
  one of the others.

So each fingerprint gives about 65 keys and no bucket is capped.  The join
verifies the distance, and admits a pair only in the one family its error
pattern names, so that a pair of near fingerprints comes out once or twice
and not once for every key in common.

A group of near copies has very many such pairs.  So that they aren't all
made, neighbours are linked first: of the fingerprints that agree but for one
segment, each and the next in order, if they are near.  That is three links a
fingerprint at most and joins what is dense; the keys then look for links
between what it left apart, which is all that components need.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querylens.llm.common import drop, fresh, release_memory, stored
from querylens.llm.components import connected_components

#: Bits by which linked fingerprints may differ.
DISTANCE = 4
#: Words of a shingle.
WORDS = 4
#: Seed of XXH64.
SEED = 42
#: (lowest bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator of the (23, 12, 7) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Hashes unpacked to bits at once; bounds memory for very long texts.
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a whole text; null, empty or blank: zero.

    A-Z are lower-cased and words are runs of anything but ASCII white space.
    A bit is one if it is set in over half of the hashes of all shingles
    (repeats count); fewer words than a shingle make one shingle.
    """
    if not text:
        return 0
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    n, digest = max(1, len(found) - words + 1), xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(b" ".join(found[i : i + words]), seed) for i in range(n)), dtype=np.uint64, count=n))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of some 64-bit hashes; zero without any."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``docs`` with the fingerprint as 16 lower-case hex digits in column ``out``."""

    @F.arrow_udf("string")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([f"{fingerprint(t.as_py(), words, seed):016x}" for t in texts], pa.string())

    return docs.withColumn(out, simhash(F.col(text).cast("string")))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits, and the error pattern
    of each of the 2048 syndromes, all derived from the generator."""

    def remainder(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for bit in range(22, 10, -1):
            words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
        return words

    low, high = remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12)
    one = 1 << np.arange(23)
    two = one[:, None] | one[None, :]
    errors = np.unique(np.concatenate([[0], (two[:, :, None] | one).ravel()]))
    leaders = np.zeros(1 << 11, dtype=np.int64)
    leaders[remainder(errors)] = errors
    return low, high, leaders


def codewords(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    low, high, leaders = _tables()
    return (words ^ leaders[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def fuzzy_keys(words: np.ndarray, bits: int) -> np.ndarray:
    """For each word the codeword indices of its one-bit neighbourhood, -1
    where one repeats: ``len(words) x 6`` is enough, since there are 1 or 6."""
    near = codewords(words[:, None] ^ np.concatenate([[0], 1 << np.arange(bits)])[None, :])
    near.sort(axis=1)
    new = np.concatenate([np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
    out = np.full((len(near), 6), -1, dtype=np.int64)
    row, col = np.nonzero(new)
    out[row, (np.cumsum(new, axis=1) - 1)[row, col]] = near[row, col]
    return out


#: Segment pairs of family *near* by family number; of *far*: (as is, fuzzy).
NEAR = ((0, 1), (0, 2), (1, 2))
FAR = ((0, 1), (1, 0), (2, 0))


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, side, key) of all keys of unsigned 64-bit fingerprints.

    Side 0 is matched with side 1.  A key holds its family in the top bits.
    """
    seg = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    code = [codewords(s) for s in seg]
    fuzzy = [fuzzy_keys(s, n) for s, (_, n) in zip(seg, SEGMENTS)]
    rows, sides, keys = [], [], []

    def add(side: int, family: int, spread: np.ndarray, key: np.ndarray) -> None:
        row, col = np.nonzero(spread >= 0)
        rows.append(row)
        sides.append(np.full(len(row), side, dtype=np.int8))
        keys.append(np.int64(family) << 56 | key[row] << 16 | spread[row, col])

    for family, (i, j) in enumerate(NEAR):
        # the codeword first, then which segment it is of, then the fuzzy key
        for side, (a, b) in enumerate(((i, j), (j, i))):
            row, col = np.nonzero(fuzzy[a] >= 0)
            spread, exact = fuzzy[a][row, col], code[b][row]
            first, second = (spread, exact) if side == 0 else (exact, spread)
            rows.append(row)
            sides.append(np.full(len(row), side, dtype=np.int8))
            keys.append(np.int64(family) << 56 | first << 16 | second)
    for family, (i, j) in enumerate(FAR, start=len(NEAR)):
        for side in (0, 1):
            add(side, family, fuzzy[j], seg[i])
    return np.concatenate(rows), np.concatenate(sides), np.concatenate(keys)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, groups = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for at in range(0, len(fps), 20_000):
            part, group = fps[at : at + 20_000], groups[at : at + 20_000]
            row, side, key = golay_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(group[row]), pa.array(side), pa.array(key)], names=["fp", "part", "side", "key"])
    release_memory()


def _family(xor: str) -> str:
    """SQL: the one family that admits a pair with this difference."""
    e0, e1, e2 = (f"bit_count(shiftrightunsigned({xor}, {at}) & {(1 << n) - 1}L)" for at, n in SEGMENTS)
    return (
        f"case when {e0} <= 1 and {e1} <= 1 then 0 when {e0} <= 1 and {e2} <= 1 then 1 when {e1} <= 1 and {e2} <= 1 then 2 "
        f"when {e0} = 0 then 3 when {e1} = 0 then 4 else 5 end"
    )


def neighbours(fps: DataFrame) -> DataFrame:
    """Some of the links ``(a, b)`` between the distinct fingerprints in column
    ``fp``: of those that differ in one segment only, each with the one before.

    At most 2^22 fingerprints can agree in the other segments, however many
    copies there are, so a window's partition is bounded.
    """
    others = [((1 << 64) - 1) ^ (((1 << n) - 1) << at) for at, n in SEGMENTS]
    signed = [m - (1 << 64) if m >> 63 else m for m in others]
    keys = F.array(*[F.struct(F.lit(i).alias("segment"), F.col("fp").bitwiseAND(F.lit(m)).alias("rest")) for i, m in enumerate(signed)])
    rows = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.segment", "k.rest")
    before = F.lag("fp").over(Window.partitionBy("segment", "rest").orderBy("fp"))
    return rows.select(before.alias("a"), F.col("fp").alias("b")).where(f"bit_count(a ^ b) <= {DISTANCE}")


def near_fingerprints(fps: DataFrame) -> DataFrame:
    """Links ``(a, b, part_a, part_b)`` between the distinct signed 64-bit
    fingerprints in column ``fp`` that differ in 1 to :data:`DISTANCE` bits and
    whose ``part`` (a long) isn't the same; complete."""
    # batches are of longs here, so many rows make a small one; _keys cuts them
    keys = fps.select("fp", "part").mapInArrow(_keys, "fp long, part long, side byte, key long")
    left = keys.where("side = 0").select(F.col("fp").alias("a"), F.col("part").alias("part_a"), "key")
    right = keys.where("side = 1").select(F.col("fp").alias("b"), F.col("part").alias("part_b"), F.col("key").alias("key_b"))
    close = F.expr(
        f"key = key_b and a < b and part_a <> part_b and bit_count(a ^ b) <= {DISTANCE} and shiftright(key, 56) = {_family('(a ^ b)')}"
    )
    return left.join(right.hint("merge"), close).select("a", "b", "part_a", "part_b")


def _members(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Tables of the rows (doc_id, h, fingerprint, fp) and of the fingerprints
    (node_fp, component, least: the component's least row)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = fingerprints(docs.withColumn("h", F.xxhash64("text")), "text").select("doc_id", "h", "fingerprint")
    rows = stored(rows.withColumn("fp", F.expr("cast(conv(fingerprint, 16, -10) as long)")), "fingerprints")
    own = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "h"))
    nodes = stored(rows.groupBy("fp").agg(own.alias("least")), "nodes")
    close = stored(neighbours(nodes.select("fp")), "close")
    parts = connected_components(close, "a", "b")
    nodes_in = stored(nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("part")), "dense-nodes")
    links = stored(near_fingerprints(nodes_in).select("part_a", "part_b").distinct(), "near")
    joined = connected_components(links, "part_a", "part_b")
    whole = nodes_in.join(joined, F.col("part") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "part").alias("component"))
    whole = stored(whole, "whole")
    # written first, so that a component of any size meets its least row evenly
    least = stored(whole.groupBy(F.col("component").alias("of")).agg(F.min("least").alias("least")), "least")
    found = whole.select("fp", "component").join(least, F.col("component") == F.col("of")).select(F.col("fp").alias("node_fp"), "component", "least")
    found = stored(found, "components")
    for done in (nodes, close, parts, nodes_in, links, joined, whole, least):
        drop(done)
    return rows, found


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    component_id is the smallest id that can be reached over fingerprints at
    most :data:`DISTANCE` bits apart, the row's own included.  Null, empty and
    blank texts have fingerprint zero and are linked like any other; equal
    fingerprints are one node, so copies are never paired with each other.
    Rows that repeat come out as often as they went in; a row whose id is null
    gets the smallest id of its component, or null if there is none (such
    components all read null).  Other
    columns of ``docs`` don't matter; an empty table gives an empty one.
    """
    rows, found = _members(docs, doc_id, text)
    ids = found.select("node_fp", F.col("least.doc_id").alias("component_id"))
    return rows.join(ids, F.col("fp") == F.col("node_fp")).select("doc_id", "fingerprint", "component_id")


def rows_of(docs: DataFrame, keep: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that the table ``keep`` names by id and hash of the
    text (``id``, ``h``), one of each."""
    own, hashed, id_ = fresh(docs, "own_hash", "keep_hash", "keep_id")
    named = keep.select(F.col("id").alias(id_), F.col("h").alias(hashed))
    docs_in = docs.withColumn(own, F.xxhash64(F.col(text).cast("string")))
    found = docs_in.join(named, F.col(doc_id).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hashed)), "left_semi")
    return found.dropDuplicates([doc_id, own]).drop(own)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near fingerprints.

    It is that of the smallest id; of equal ids, the least hash of a text; of
    rows that repeat both, any one.  A row without an id stays only if no row of
    its component has one.  Columns stay as they are; an empty table gives an
    empty one.
    """
    rows, found = _members(docs, doc_id, text)
    least = found.groupBy("component").agg(F.first("least").alias("least"))
    keep = stored(least.select(F.col("least.doc_id").alias("id"), F.col("least.h").alias("h")), "kept")
    drop(rows)
    drop(found)
    return rows_of(docs, keep, doc_id, text)
