"""Masked pseudo-likelihood: a bidirectional window network scores documents.

Words become numbers: the most frequent ones of the whole corpus have their
own, the others share some by their ending.  A network trained in numpy
predicts each word from the two before and the two after it (never itself);
the sum of the log-probabilities of all words of a document is its score.
A word that shares its number has, besides, its share of all occurrences of that
number in the corpus: the counts of all words are a table that grows with it.

The network: embeddings of the window, one hidden layer, and a softmax in three
steps (a class of words, a subclass, the word) whose biases start at the corpus'
frequencies.  Documents are dealt by hash into shards of about as many
words each, so that neither the layout of the table nor the cluster shows in a
score.  In each round a copy is trained on every window of every document of
each shard, and the copies are averaged with their numbers of windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.llm.common import drop, release_memory, slices, stored

#: The softmax goes in steps: so many classes, subclasses of each and numbers of
#: each of those.  The numbers of shared endings are the last ones, and number 0
#: stands beyond a document's edges.
STEPS, ENDINGS = (16, 16, 64), 511
SIZE = STEPS[0] * STEPS[1] * STEPS[2]
#: Words on each side, numbers of an embedding, hidden units.
SIDE, DIMENSION, HIDDEN = 2, 16, 32
#: Windows of a step of descent, and its rate (Adagrad).
ROUNDS, BATCH, RATE, SEED = 1, 1 << 13, 0.8, 7
#: Words of a shard, expected: what a task that trains holds, two bytes each.
SHARD_WORDS = 2_000_000
#: What the softmaxes are fed lies between this and its negative, so that no
#: exponential overflows.
MOST = np.float32(60)
#: Words scored at once.
BLOCK = 1 << 14
#: Pieces that parameters are averaged in, and copies summed by one task.
PIECES, TOGETHER = 8, 64
#: Logarithms of shares are summed as whole numbers of this, in any order.
UNIT = 1e-9


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, where each text's begin and end); ASCII lower case."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    bounds = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full).as_py():  # white space at an end leaves empty strings
        flags = full.to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(flags)])[bounds - bounds[0]]
        return words.filter(full), bounds
    return words, bounds - bounds[0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pc.value_counts(split_words(batch.column(0))[0])
        yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts").cast(pa.int64())], names=["word", "n"])
    release_memory()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` of all words of all documents."""
    return docs.select(F.col(text).cast("string")).mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """The most frequent words of all documents, by falling count (ties:
    alphabetical), which have the numbers from 1 on; and how often each number
    that isn't shared occurs."""
    wanted = SIZE - 1 - ENDINGS
    # the power of two that enough words are above, so that few rows are sorted
    least, above = 1, 0
    for r in sorted(counts.groupBy(F.floor(F.log2("n")).alias("power")).count().collect(), reverse=True):
        above += r["count"]
        if above >= wanted:
            least = 1 << r.power
            break
    most = stored(counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(wanted), "vocabulary")
    rows = sorted(most.collect(), key=lambda r: (-r.n, r.word))
    drop(most)
    often = np.zeros(SIZE)
    often[1 : len(rows) + 1] = [r.n for r in rows]
    return [r.word for r in rows], often


def ending_number(ending: str) -> int:
    """The number that words with the same last two characters share."""
    return SIZE - ENDINGS + zlib.crc32(ending.encode("utf-8", "replace")) % ENDINGS


class Numbering:
    """Numbers of words, and what stands for a word that shares its number: 64
    bits of its hash."""

    def __init__(self, vocabulary: list[str]):
        self.own = pa.array(vocabulary, pa.large_string())

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number, key or 0) of each of some distinct words."""
        words = words.cast(pa.large_string())
        found = pc.index_in(words, value_set=self.own)
        numbers = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        keys = np.zeros(len(words), dtype=np.int64)
        if found.null_count:
            rare = words.filter(found.is_null())
            ends = pc.utf8_slice_codeunits(rare, -2).dictionary_encode()
            shared = np.array([ending_number(e) for e in ends.dictionary.to_pylist()])
            numbers[numbers == 0] = shared[ends.indices.to_numpy(zero_copy_only=False)]
            raw = rare.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
            keys[numbers >= SIZE - ENDINGS] = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), dtype=np.uint64, count=len(raw)).view(np.int64)
        return numbers, keys


def _encoded(vocabulary: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbering = Numbering(vocabulary)
        for batch in batches:
            words, bounds = split_words(batch.column(1))
            coded = words.dictionary_encode()
            numbers, keys = numbering(coded.dictionary)
            at = coded.indices.to_numpy(zero_copy_only=False)
            flat, keys = numbers.astype("<u2")[at], keys[at]
            sharing = flat >= SIZE - ENDINGS
            ends = np.concatenate([[0], np.cumsum(sharing)])[bounds]
            data = pa.array([flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
            shared = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[sharing], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), data, shared], names=["doc_id", "ids", "shared"])
        release_memory()

    return run


def _rare(vocabulary: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbering = Numbering(vocabulary)
        for batch in batches:
            numbers, keys = numbering(batch.column(0))
            found = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(numbers, pa.int32()), batch.column(1)], names=["word", "number", "n"])
            yield found.filter(pa.array(numbers >= SIZE - ENDINGS))

    return run


def rare_words(counts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``(word, number, n)`` of the words that share a number, by their keys."""
    return counts.mapInArrow(_rare(vocabulary), "word long, number int, n long").groupBy("word", "number").agg(F.sum("n").alias("n"))


def word_terms(ids: DataFrame, rare: DataFrame, totals: dict[int, int]) -> DataFrame:
    """``(term_row, term)``: of each row the sum, over its words that share a
    number, of the logarithm of the word's share of the number's occurrences."""
    total = F.create_map(*[F.lit(x) for number, n in totals.items() for x in (number, float(n))]) if totals else F.create_map(F.lit(0), F.lit(1.0))
    share = F.round(F.log(F.col("n") / total[F.col("number")]) / UNIT).cast("long")
    shares = rare.select(F.col("word").alias("of"), share.alias("share"))
    words = ids.select(F.col("row").alias("term_row"), F.explode("shared").alias("word"))
    parts = words.join(shares, F.col("word") == F.col("of")).groupBy("term_row").agg(F.sum("share").alias("term"))
    return parts.select("term_row", (F.col("term") * UNIT).alias("term"))


@dataclass
class Network:
    """Parameters, as views of one flat vector.  The last hidden unit is the
    constant 1, so that its weights are the biases of what comes after it."""

    flat: np.ndarray

    SHAPES = {
        "emb": (SIZE, DIMENSION),
        "w1": (2 * SIDE * DIMENSION, HIDDEN),
        "b1": (HIDDEN,),
        "step0": (1, HIDDEN, STEPS[0]),
        "step1": (STEPS[0], HIDDEN, STEPS[1]),
        "step2": (STEPS[0] * STEPS[1], HIDDEN, STEPS[2]),
    }

    def __post_init__(self):
        at = 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.SHAPES.values())

    @classmethod
    def start(cls, often: np.ndarray | None = None) -> Network:
        """Random weights; biases by how often each number occurs, if given."""
        out = cls(np.zeros(cls.size(), dtype=np.float32))
        random = np.random.default_rng(SEED)
        for name, scale in (("emb", 0.3), ("w1", 0.2), ("step0", 0.1), ("step1", 0.1), ("step2", 0.1)):
            part = getattr(out, name)
            part[...] = random.normal(0, scale, part.shape)
        out.w1[:, -1], out.b1[-1] = 0, 1
        each = np.ones(SIZE) if often is None else often + 0.1
        for k in reversed(range(len(STEPS))):
            logs = np.log(each.reshape(-1, STEPS[k]))
            getattr(out, f"step{k}")[:, -1] = logs - logs.mean(axis=1, keepdims=True)
            each = each.reshape(-1, STEPS[k]).sum(axis=1)
        return out

    def tables(self) -> np.ndarray:
        """What each number adds to the hidden layer at each place."""
        return np.stack([self.emb @ w for w in self.w1.reshape(2 * SIDE, DIMENSION, HIDDEN)])


OFFSETS = [*range(-SIDE, 0), *range(1, SIDE + 1)]


def padded(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents in a row with edges between: (numbers, places of the words,
    document of each word)."""
    edge = np.zeros(SIDE, dtype=np.uint16)
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    row = np.concatenate([edge, *[y for x in ids for y in (x, edge)]]).astype(np.uint16, copy=False)
    doc = np.repeat(np.arange(len(ids)), sizes)
    return row, np.arange(int(sizes.sum())) + SIDE * (doc + 1), doc


def _groups(target: np.ndarray) -> list[tuple[str, np.ndarray, list[tuple[int, slice]]]]:
    """For each step of sorted targets: (its parameters, the choice of each, the
    groups that choose alike and their places)."""
    out, below = [], SIZE
    for k, n in enumerate(STEPS):
        group, below = target // below, below // n
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        ends = [*starts[1:].tolist(), len(group)]
        out.append((f"step{k}", target // below % n, [(g, slice(a, b)) for g, a, b in zip(group[starts].tolist(), starts.tolist(), ends)]))
    return out


def _exponentials(x: np.ndarray) -> np.ndarray:
    """Of what a softmax is fed, which is kept within :data:`MOST`."""
    x = x.astype(np.float32, copy=False)
    np.clip(x, -MOST, MOST, out=x)
    return np.exp(x, out=x)


def _fed(net: Network, name: str, hidden: np.ndarray, groups: list[tuple[int, slice]]) -> np.ndarray:
    """What the softmax of a step is fed."""
    weights = getattr(net, name)
    out = np.empty((len(hidden), weights.shape[2]), dtype=hidden.dtype)
    for g, own in groups:
        np.dot(hidden[own], weights[g], out=out[own])
    return out


def log_probabilities(net: Network, row: np.ndarray, places: np.ndarray, tables: np.ndarray | None = None) -> np.ndarray:
    """The log-probability of the word at each place, given its window."""
    if not len(places):
        return np.zeros(0)
    tables = net.tables() if tables is None else tables
    order = np.argsort(row[places], kind="stable")
    places = places[order]
    target = row[places].astype(np.int64)
    hidden = np.take(tables[0], row[places + OFFSETS[0]], axis=0)
    for j, o in enumerate(OFFSETS[1:], start=1):
        hidden += np.take(tables[j], row[places + o], axis=0)
    hidden += net.b1
    np.maximum(hidden, 0, out=hidden)
    found = np.zeros(len(target))
    for name, choice, groups in _groups(target):
        fed = _fed(net, name, hidden, groups)
        found += np.clip(fed[np.arange(len(target)), choice], -MOST, MOST) - np.log(_exponentials(fed).sum(axis=1, dtype=np.float64))
    out = np.empty(len(target))
    out[order] = found
    return out


class Trainer:
    """Adagrad on batches of windows, in place."""

    def __init__(self, net: Network, rate: float = RATE):
        self.net, self.rate = net, np.float32(rate)
        self.past = Network(np.full(Network.size(), 1e-2, dtype=np.float32))
        self.gradients = Network(np.zeros(Network.size(), dtype=np.float32))
        self.scratch = Network(np.zeros(Network.size(), dtype=np.float32))

    def _down(self, name: str, gradient: np.ndarray) -> None:
        # in place, as fresh arrays of this size cost more than the sums; a
        # gradient of zero changes nothing
        sums, roots = getattr(self.past, name), getattr(self.scratch, name)
        gradient *= np.float32(1 / BATCH)
        np.multiply(gradient, gradient, out=roots)
        sums += roots
        np.sqrt(sums, out=roots)
        gradient /= roots
        gradient *= self.rate
        getattr(self.net, name)[...] -= gradient

    def step(self, row: np.ndarray, places: np.ndarray) -> None:
        net, n = self.net, len(places)
        # by target, so that what chooses alike is a slice
        places = places[np.argsort(row[places], kind="stable")]
        target = row[places].astype(np.int64)
        window = row[places[:, None] + OFFSETS]
        inputs = np.take(net.emb, window, axis=0).reshape(n, -1)
        hidden = inputs @ net.w1
        hidden += net.b1
        np.maximum(hidden, 0, out=hidden)
        back, part = np.zeros_like(hidden), np.empty_like(hidden)
        for name, choice, groups in _groups(target):
            # what the softmax gives too much to each, and to the target too little
            miss = _exponentials(_fed(net, name, hidden, groups))
            miss *= 1 / (miss @ np.ones((miss.shape[1], 1), dtype=miss.dtype))
            miss[np.arange(n), choice] -= 1
            weights, gradient = getattr(net, name), getattr(self.gradients, name)
            gradient[...] = 0
            for g, own in groups:
                np.dot(miss[own], weights[g].T, out=part[own])
                np.dot(hidden[own].T, miss[own], out=gradient[g])
            back += part
            self._down(name, gradient)
        back *= hidden > 0
        back[:, -1] = 0
        down = net.w1 @ back.T
        self._down("w1", inputs.T @ back)
        self._down("b1", back.sum(axis=0))
        # a number's gradient is summed over the places of a window, in doubles
        met, gradient = np.ascontiguousarray(window.T).ravel(), self.gradients.emb
        places_by_unit = down.reshape(2 * SIDE, DIMENSION, n)
        for unit in range(DIMENSION):
            gradient[:, unit] = np.bincount(met, weights=places_by_unit[:, unit].ravel(), minlength=SIZE)
        self._down("emb", gradient)


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="<u2") for x in column]


def _trained(start: bytes, turn: int):
    def run(table: pa.Table) -> pa.Table:
        net = Network(np.frombuffer(start, dtype=np.float32).copy())
        # the same order in whatever order the rows come
        ids = [np.frombuffer(x, dtype="<u2") for x in sorted(table.column("ids").to_pylist())]
        row, places, _ = padded(ids)
        np.random.default_rng(SEED + turn).shuffle(places)
        trainer = Trainer(net)
        for at in range(0, len(places), BATCH):
            trainer.step(row, places[at : at + BATCH])
        parts, shard = np.array_split(net.flat, PIECES), table.column("shard")[0].as_py()
        columns = {
            "piece": pa.array(range(PIECES), pa.int32()),
            "shard": pa.array([shard] * PIECES, pa.int64()),
            "n": pa.array([len(places)] * PIECES, pa.int64()),
            "total": pa.array([p.tobytes() for p in parts], pa.binary()),
        }
        return pa.table(columns)

    return run


def _averaged(table: pa.Table) -> pa.Table:
    """The average of copies of one piece, weighed by their windows, in the
    order of their shards."""
    order, whole, n = np.argsort(table.column("shard").to_numpy()), None, 0
    for at in order.tolist():
        part, own = np.frombuffer(table.column("total")[at].as_py(), dtype=np.float32), table.column("n")[at].as_py()
        n += own
        whole = part.astype(np.float64) * own if whole is None else whole + part.astype(np.float64) * own
    least = int(order[0])
    columns = {
        "piece": table.column("piece").slice(0, 1),
        "shard": table.column("shard").slice(least, 1),
        "n": pa.array([n], pa.int64()),
        "total": pa.array([(whole / n).astype(np.float32).tobytes()], pa.binary()),
    }
    return pa.table(columns)


def train(ids: DataFrame, words: int, often: np.ndarray | None = None) -> Network:
    """A network trained on column ``ids`` (numbers as bytes) of all rows, of so
    many words in all.  Rows are dealt to shards by column ``deal``."""
    net, schema = Network.start(often), "piece int, shard long, n long, total binary"
    shards = max(1, -(-words // SHARD_WORDS))
    dealt = ids.where(F.octet_length("ids") > 0).select(F.pmod("deal", F.lit(shards)).alias("shard"), "ids")
    for turn in range(ROUNDS):
        copies = stored(dealt.groupBy("shard").applyInArrow(_trained(net.flat.tobytes(), turn), schema), "copies")
        groups, sums = shards, copies
        while groups > 1:  # a tree of averages, so that no task gets all copies
            groups = -(-groups // TOGETHER)
            grouped = sums.groupBy("piece", F.expr(f"shard div {TOGETHER}").alias("of")).applyInArrow(_averaged, schema)
            sums = grouped.withColumn("shard", F.expr(f"shard div {TOGETHER}"))
        rows = sorted(sums.collect(), key=lambda r: r.piece)
        drop(copies)
        if rows:
            net = Network(np.concatenate([np.frombuffer(bytes(r.total), dtype=np.float32) for r in rows]))
    return net


def _scored(params: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # in doubles, so that a word's neighbours in a batch don't show in six decimals
        net = Network(np.frombuffer(params, dtype=np.float32).astype(np.float64))
        tables = net.tables()
        for batch in slices(batches):
            ids = _ids(batch.column(2))
            row, places, doc = padded(ids)
            total = np.zeros(len(ids))
            for at in range(0, len(places), BLOCK):
                part = slice(at, at + BLOCK)
                total += np.bincount(doc[part], weights=log_probabilities(net, row, places[part], tables), minlength=len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array(total)], names=["doc_id", "row", "n_words", "number_term"])
        release_memory()

    return run


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, log_probability, mean_log_probability)`` per row.

    A text that is null, empty or blank has no words, log-probability 0 and a
    null mean.  Equal texts score the same; a null id stays null; repeated rows
    are scored each; further columns don't matter; an empty table gives an
    empty one.  Scores don't depend on partitions or batches (rows without an id
    are dealt to shards by their place, so that many of them can't meet in one;
    they alone could).
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = stored(word_counts(docs), "word-counts")
    words = counts.agg(F.sum("n")).first()[0] or 0
    own, often = vocabulary(counts)
    rare = stored(rare_words(counts, own), "rare-words")
    totals = {r.number: r.n for r in rare.groupBy("number").agg(F.sum("n").alias("n")).collect()}
    for number, n in totals.items():
        often[number] = n
    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = docs.mapInArrow(_encoded(own), f"doc_id {kind}, ids binary, shared array<long>").withColumn("row", F.monotonically_increasing_id())
    deal = F.xxhash64("doc_id", "ids", F.when(F.col("doc_id").isNull(), F.col("row")))
    ids = stored(coded.withColumn("deal", deal), "word-numbers")
    net = train(ids, words, often)
    terms = word_terms(ids, rare, totals)
    scored = ids.select("doc_id", "row", "ids").mapInArrow(_scored(net.flat.tobytes()), f"doc_id {kind}, row long, n_words long, number_term double")
    out = scored.join(terms, F.col("row") == F.col("term_row"), "left")
    out = out.select("doc_id", "n_words", F.expr("round(number_term + coalesce(term, 0), 6)").alias("log_probability"))
    drop(counts)
    return out.withColumn("mean_log_probability", F.expr("if(n_words = 0, null, log_probability / n_words)"))
