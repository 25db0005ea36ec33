"""The corpus pipeline stage by stage, and as a whole against brute force."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from querylens.llm import langid, similar, simhash
from querylens.llm.common import stored, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The result of each stage, written and read again."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, SF, "documents"), {"documents": table(spark, SF, "documents")}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = out[name] = spark.read.parquet(str(folder / name))
    return out


def test_columns_stay(stages):
    names = list(stages)
    for name in names[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_language_stage_drops_what_it_rejects(stages):
    told = {r.doc_id: r for r in langid.identify(stages["documents"]).collect()}
    kept = {r.doc_id for r in stages["language_id"].collect()}
    assert kept == {i for i, r in told.items() if not r.rejected}
    assert len(kept) > 0.9 * len(told)


def brute_kept(rows):
    """(id, text) of the row that stays of each component, by all pairs of the
    sets of five-word shingles."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_shingle = {}
    for i, own in enumerate(sets):
        for x in own or {None}:
            by_shingle.setdefault(x, []).append(i)
    for i, own in enumerate(sets):
        for j in {j for x in own or {None} for j in by_shingle[x] if j < i}:
            if 5 * len(own & sets[j]) >= 4 * len(own | sets[j]):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    signed = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) if t is not None else 42
    hashed = lambda t: signed(t) - (1 << 64) if signed(t) >> 63 else signed(t)
    return sorted((rows[min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashed(rows[i][1])))] for g in groups.values()), key=str)


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages["language_id"].collect()]
    assert sorted(((r.doc_id, r.text) for r in stages["near_dedup"].collect()), key=str) == brute_kept(rows)


def test_repeated_and_missing_ids_lose_no_text(spark):
    """What stays is a row, not an id: ids repeat over different texts, some are
    null, some rows repeat whole."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    rows = [(2, "one two three four five six seven"), (5, "one two three four five six seven"), (5, "a b c d e f g"), (5, "a b c d e f g")]
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 200]))]
        for _ in range(rng.choice([1, 3, 8])):
            near = list(base)
            for _ in range(rng.choice([0, 1, 4])):
                near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((rng.choice([None, *range(12)]), " ".join(near)))
    rows += [(None, None), (None, ""), (3, " "), (None, "only without an id here now"), (None, "only without an id here now")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(c) for c in ("h", "node", "keep_id", "own_hash", "part", "row")})
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == brute_kept(rows)


def test_components_of_similar_texts(spark):
    rows = [(4, "a b c d e f g h i j k l"), (9, "a b c d e f g h i j k l"), (1, None), (3, "\t"), (None, "A b c d e f g h i j k L"), (None, "else")]
    found = similar.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=str) == sorted([(4, 4), (9, 4), (1, 1), (3, 1), (None, 4), (None, None)], key=str)
    assert similar.similar_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(4)
    for n in (1, 3, 40, 300, 2000):
        a = np.unique(rng.integers(-(2**62), 2**62, n))
        for gone in (0, 1, n // 20, n // 5):
            b = np.unique(np.concatenate([a[gone:], rng.integers(-(2**62), 2**62, gone // 8)]))
            assert similar.apart(similar.sketch(a), similar.sketch(b)) <= len(np.setxor1d(a, b))


def test_masks_and_mix(stages):
    before = {r.doc_id: r.text for r in stages["near_dedup"].collect()}
    masked = {r.doc_id: r for r in stages["personal_data"].collect()}
    assert masked.keys() == before.keys() and all(r.n_chars == len(r.text) for r in masked.values() if r.text != before[r.doc_id])
    assert not any("@mail" in r.text for r in masked.values())
    mixed = stages["mixing"].collect()
    assert {r.doc_id for r in mixed} <= masked.keys() and all(r.text == masked[r.doc_id].text for r in mixed)
    assert 0.6 * len(masked) < len(mixed) < 1.4 * len(masked)


def test_all_tokens_are_packed(stages):
    from tokenizers import Tokenizer

    from querylens.llm.queries import vocabulary_path

    tok = Tokenizer.from_file(vocabulary_path())
    want = []
    for r in stages["mixing"].collect():
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 1]
        want += [(r.doc_id, k, len(ids[a : a + 4096]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a : a + 4096]))) for k, a in enumerate(range(0, len(ids), 4096))]
    got = stages["packing"].collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == sorted(want)
    sequences = stages["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n <= 4096 for r in sequences) and len(sequences) <= 1.01 * sum(r.n for r in sequences) / 4096 + 1


def test_run_is_the_stages_in_a_row(spark, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(corpus_pipeline.run(spark, SF).select(key).collect()) == sorted(stages["packing"].select(key).collect())


def test_odd_documents_pass(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, None, None, None, None), (3, "some words", "en", "s", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("copy", F.lit("own"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 4


def test_near_copies_go_by_similarity(spark):
    """Of texts at least 0.8 alike on five words one stays, however many bits
    of a fingerprint differ; less alike ones stay."""
    rng = random.Random(4)
    words, texts = [f"w{i}" for i in range(3000)], []
    for _ in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([4, 12, 60, 300]))]
        for edits in (0, 0, 1, 2, 5, 9):
            near = list(text)
            for _ in range(edits):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == sorted({find(i) for i in range(len(texts))})
    old = simhash.drop_near_duplicates(docs).count()
    assert old > len(kept)  # four bits are fewer


def test_stragglers_of_a_group_join_it_before_all_are_compared(spark, monkeypatch):
    """300 nodes in a chain, 100 apart, all with one key; a third of all pairs are similar."""
    compared, alike = [], lambda a, b: (7 * a + 3 * b) % 10 < 3

    def links(pairs, nodes, docs):
        found = [tuple(r) for r in pairs.distinct().collect()]
        compared.extend(found)
        return stored(spark.createDataFrame([p for p in found if alike(*p)], "a long, b long").coalesce(1), "test-links")

    monkeypatch.setattr(similar, "_links", links)
    keys = spark.range(400).selectExpr("id as node", "100L as size", "0 as place", "1L as key").coalesce(1)
    chain = stored(spark.range(299).selectExpr("id as a", "id + 1 as b").coalesce(1), "test-chain")
    found = similar.prefix_links(keys, keys.select("node"), keys, chain)
    parts = {r.of: r.part for r in similar._parts(keys.select("node"), found).collect()}
    assert all(parts[a] == parts[b] for a in range(400) for b in range(a + 1, 400) if alike(a, b))
    assert len(set(compared)) < 12_000
