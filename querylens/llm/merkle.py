"""Merkle-tree fingerprints of documents, by DataFrame functions alone.

A text is cut, without losing a character, into sections (after a blank
line), paragraphs (after a line's end) and sentences (after ``.``, ``!`` or
``?`` and a space).  Leaves are the hashes of sentences; each paragraph is the
hash of its leaves, each section that of its paragraphs and the root that of
the sections, every level with a mark of its own.

The fingerprint is the tree, written out: ``root|section(paragraph(leaf leaf)
paragraph(leaf))section(...)``, hashes cut to 16 digits below the root.  Equal
roots mean equal texts; where roots differ, the branches that differ locate
the edit (:func:`differing_sections`), and the leaves in common tell how alike
two texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.llm.common import fresh, stored

# The places to cut at, of zero width, so that nothing is lost.
SECTION, PARAGRAPH, SENTENCE = r"(?<=\n\n)(?!\n)", r"(?<=\n)", r"(?<=[.!?]\x20)"
#: Hex digits of the hashes below the root.
DIGITS = 16
#: Bytes of text that a task gets, expected, and the most ranges that are cut: the
#: driver and each task hold an id of every range.  Beyond, ranges are larger.
PART_BYTES, MOST_PARTS = 32 << 20, 50_000


def _regexp(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def leaves(text: str) -> str:
    """SQL: sections of paragraphs of leaf hashes."""
    leaf = f"l -> substring(sha2(concat('l', l), 256), 1, {DIGITS})"
    paragraph = f"p -> transform(split(p, {_regexp(SENTENCE)}), {leaf})"
    return f"transform(split({text}, {_regexp(SECTION)}), s -> transform(split(s, {_regexp(PARAGRAPH)}), {paragraph}))"


def _written(tree: str) -> str:
    """SQL: each section as written in the fingerprint."""
    below = f"substring(sha2(concat('p', array_join(p, '')), 256), 1, {DIGITS})"
    paragraphs = f"array_join(transform(s, p -> concat({below}, '(', array_join(p, ' '), ')')), '')"
    hashes = f"array_join(transform(s, p -> {below}), '')"
    return f"transform({tree}, s -> concat(substring(sha2(concat('s', {hashes}), 256), 1, {DIGITS}), '(', {paragraphs}, ')'))"


def _fingerprint(sections: str) -> str:
    """SQL: the fingerprint, given the written sections."""
    return f"concat(sha2(concat('d', array_join(transform({sections}, s -> substring(s, 1, {DIGITS})), '')), 256), '|', array_join({sections}, ''))"


def with_fingerprint(docs: DataFrame, text: str, out: str, leaves_out: str) -> DataFrame:
    """``docs`` with the fingerprint of a text that isn't null, and its leaves."""
    tree, sections = fresh(docs, "tree", "sections")
    docs = docs.withColumn(tree, F.expr(leaves(f"`{text}`"))).withColumn(sections, F.expr(_written(tree)))
    return docs.withColumns({out: F.expr(_fingerprint(sections)), leaves_out: F.flatten(F.flatten(F.col(tree)))}).drop(tree, sections)


def likeness(a: str, b: str) -> Column:
    """How alike two arrays of leaves are: the share of the distinct leaves of
    both that they have in common (Dice), from 0 to 1; 1 for equal ones."""
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))


def differing_sections(a: str, b: str) -> Column:
    """The indices of the sections at which two fingerprints part; empty if the
    roots are equal."""
    cut = lambda f: f"split(substring({f}, 66), '(?<=[)][)])(?=.)')"
    longest = f"greatest(size({cut(a)}), size({cut(b)}))"
    differs = f"i -> not (get({cut(a)}, i) <=> get({cut(b)}, i))"
    return F.expr(f"if(substring({a}, 1, 64) = substring({b}, 1, 64), cast(array() as array<int>), filter(sequence(0, {longest} - 1), {differs}))")


def _range_number(cuts: list[int]) -> Column:
    """How many of the descending ``cuts`` doc_id is below, in two steps of the
    square root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[at : at + step] for at in range(0, len(cuts), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    whole = F.size(F.filter(longs([g[-1] for g in groups]), lambda c: F.col("doc_id") < c))
    part = F.get(F.array(*[longs(g) for g in groups]), whole)
    # the last group may be a short one
    return F.least(whole * step + F.coalesce(F.size(F.filter(part, lambda c: F.col("doc_id") < c)), F.lit(0)), F.lit(len(cuts)))


def _share(key: str) -> Column:
    """A hash in hex digits as a number from 0 to 1, by its first seven."""
    return F.conv(F.substring(key, 1, 7), 16, 10).cast("double") / float(16**7)


def _dealt(docs: DataFrame, parts: int, rows: int) -> DataFrame:
    """``docs`` (doc_id, text) by ranges of the id, numbered in column ``part``
    from the highest ids down, with a copy of each part's first rows in the
    part before it (``guest``), so that each row's next one is in its part.
    ``tie`` orders equal ids, and ``times`` is how many equal rows one stands for.

    Ranges are cut at quantiles of the ids.  An id that has more rows than a
    part should (a null one, say) is a range of its own and cut further by the
    hashes of its texts; of those, rows whose texts are equal as well are one row.
    Only a few values per range reach the driver.
    """
    spark, most = docs.sparkSession, max(1, rows // parts)
    kind = "doc_id long, text string"
    # at most as many ids as parts are hot
    hot = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 2 * most).collect()
    split = {r.doc_id: -(-r.n // most) for r in hot}
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0]
    cuts = sorted({*(cuts or []), *(x for i in split if i is not None for x in (i, i + 1))}, reverse=True)
    docs = docs.withColumn("tie", F.md5("text"))
    if split:
        listed = F.col("doc_id").isin([i for i in split if i is not None])
        is_hot = F.coalesce(listed, F.lit(False)) | (F.col("doc_id").isNull() if None in split else F.lit(False))
        equal = docs.where(is_hot).groupBy("doc_id", "tie").agg(F.count("*").alias("times")).where(F.col("times") > most)
        equal = stored(equal.withColumnsRenamed({"doc_id": "equal_id", "tie": "equal_tie"}), "equal")
        same = F.col("doc_id").eqNullSafe(F.col("equal_id")) & (F.col("tie") == F.col("equal_tie"))
        told = docs.withColumn("hot", is_hot).join(equal, F.col("hot") & same, "left").drop("equal_id", "equal_tie", "hot")
        single = told.where("times is null").withColumn("times", F.lit(1).cast("long"))
        several = told.where("times is not null").groupBy("doc_id", "tie", "times").agg(F.first("text").alias("text"))
        docs = single.unionByName(several)
    else:
        docs = docs.withColumn("times", F.lit(1).cast("long"))
    # ranges from the highest ids down, null ids in the last one; each has as
    # many parts as its id is split into
    def of_id(i):
        return len(cuts) + 1 if i is None else sum(c > i for c in cuts)

    wide = {of_id(i): n for i, n in split.items()}
    firsts, at = [], 0
    for k in range(len(cuts) + 2):
        firsts.append(at)
        at += wide.get(k, 1)
    seats_of = spark.createDataFrame([(k, firsts[k], wide.get(k, 1)) for k in range(len(firsts))], "of_range int, first_part int, wide int")
    number = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(_range_number(cuts)).cast("int")
    docs = docs.withColumn("range", number).join(F.broadcast(seats_of), F.col("range") == F.col("of_range"))  # one row per range
    within = F.when(F.col("wide") > 1, F.col("wide") - 1 - F.floor(_share("tie") * F.col("wide"))).otherwise(F.lit(0))
    docs = docs.withColumn("part", (F.col("first_part") + within).cast("int"))
    # a part's first rows are those of its highest id, of a split id the highest hash
    place = F.when(F.col("wide") > 1, F.col("tie")).otherwise(F.lit(""))
    heads = docs.select("part", F.struct("doc_id", place.alias("place")).alias("head")).groupBy("part").agg(F.max("head").alias("head"))
    found = sorted((r.part, r["head"].doc_id, r["head"].place) for r in heads.collect())
    hosts = [(id_, place, found[k - 1][0]) for k, (_, id_, place) in enumerate(found)]  # the first part follows the last
    hosts = spark.createDataFrame(hosts, "first_id long, first_place string, host int")
    seated = docs.join(F.broadcast(hosts), F.col("doc_id").eqNullSafe(F.col("first_id")) & (place == F.col("first_place")), "left")  # one row per part
    home = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    away = F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))
    seats = F.when(F.col("host").isNull(), F.array(home)).otherwise(F.array(home, away))
    return seated.select("doc_id", "text", "tie", "times", F.explode(seats).alias("seat")).select("doc_id", "text", "tie", "times", "seat.part", "seat.guest")


def edit_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Each document's fingerprint, and that of an edited text: the last half
    (floor) of the code points replaced by the first as many, or all, of the
    next document in descending order of ids (after the last: the first).

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, edited_sections)``, one row per row; the last is how
    many sections differ between a text and its edited text.  Null texts are
    empty.  Null ids come last, equal ids go by the MD5 of the text, descending;
    a single document is its own next.  Other columns don't matter.  An empty
    table gives an empty one.

    ``parts`` ranges of ids (one for each :data:`PART_BYTES` of text, and one for
    each core at least, unless given) are dealt out with their texts, once.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    whole = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = parts or max(docs.sparkSession.sparkContext.defaultParallelism, min(MOST_PARTS, -(-(whole.bytes or 0) // PART_BYTES)))
    # dealt first and hashed then, so that hashes aren't shuffled
    dealt = _dealt(docs, parts, whole.rows)
    dealt = with_fingerprint(dealt.repartition(parts, "part"), "text", "fingerprint", "leaves")
    own = Window.partitionBy("part").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    dealt = dealt.withColumns({"next_text": F.lead("text").over(own), "next_leaves": F.lead("leaves").over(own)}).where("not guest")
    # of equal rows that one stands for, all but the last are followed by their like
    last = F.struct(F.lit(1).cast("long").alias("times"), F.col("next_text").alias("next_text"), F.col("next_leaves").alias("next_leaves"))
    like = F.struct((F.col("times") - 1).alias("times"), F.col("text").alias("next_text"), F.col("leaves").alias("next_leaves"))
    dealt = dealt.withColumn("follow", F.explode(F.when(F.col("times") > 1, F.array(last, like)).otherwise(F.array(last))))
    dealt = dealt.withColumns({c: F.col(f"follow.{c}") for c in ("times", "next_text", "next_leaves")}).drop("follow")
    dealt = dealt.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - half), F.col("next_text").substr(F.lit(1), half))
    dealt = with_fingerprint(dealt.withColumn("edited", edited), "edited", "edited_fingerprint", "edited_leaves")
    out = dealt.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("leaves", "edited_leaves").alias("near_edited"),
        likeness("leaves", "next_leaves").alias("near_next"),
        F.size(differing_sections("fingerprint", "edited_fingerprint")).cast("long").alias("edited_sections"),
        "times",
    )
    return out.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("time", "times")


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL of :func:`edit_fingerprints`."""
    cut = lambda t, p: f"string_split(regexp_replace({t}, '{p}', '\\1' || chr(1), 'g'), chr(1))"
    short = lambda mark, x: f"substr(sha256('{mark}' || {x}), 1, {DIGITS})"
    tree = lambda t: (
        f"list_transform({cut(t, chr(40) + chr(92) + 'n' + chr(92) + 'n+)')}, lambda s: list_transform({cut('s', chr(40) + chr(92) + 'n)')}, "
        f"lambda p: list_transform({cut('p', '([.!?] )')}, lambda l: {short('l', 'l')})))"
    )
    below = short("p", "array_to_string(p, '')")
    sections = lambda t: (
        f"list_transform({t}, lambda s: {short('s', f'array_to_string(list_transform(s, lambda p: {below}), {chr(39) * 2})')} || '(' || "
        f"array_to_string(list_transform(s, lambda p: {below} || '(' || array_to_string(p, ' ') || ')'), '') || ')')"
    )
    root = lambda s: f"sha256('d' || array_to_string(list_transform({s}, lambda s: substr(s, 1, {DIGITS})), '')) || '|' || array_to_string({s}, '')"
    alike = lambda a, b: f"2 * len(list_intersect({a}, {b})) / (len(list_distinct({a})) + len(list_distinct({b})))"
    return f"""
with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from {documents}),
w as (select *, coalesce(lead(text) over o, first_value(text) over o) as next_text from d
      window o as (order by doc_id desc nulls last, md5(text) desc rows between unbounded preceding and unbounded following)),
e as (select *, substr(text, 1, n - n // 2) || substr(next_text, 1, n // 2) as edited from w),
t as (select *, {tree('text')} as t0, {tree('edited')} as t1, flatten(flatten({tree('next_text')})) as l2 from e),
s as (select *, {sections('t0')} as s0, {sections('t1')} as s1, flatten(flatten(t0)) as l0, flatten(flatten(t1)) as l1 from t)
select doc_id, n::bigint as n_chars, sha256(edited) as edited_sha256, {root('s0')} as fingerprint, {root('s1')} as edited_fingerprint,
{alike('l0', 'l1')} as near_edited, {alike('l0', 'l2')} as near_next,
len(list_filter(range(greatest(len(s0), len(s1))), lambda i: s0[i + 1] is distinct from s1[i + 1])) as edited_sections
from s"""
