"""Language identification by compression.

One Zstandard raw-content dictionary per language, of excerpts of its labelled
texts.  A text is encoded, in blocks, with each of them; the language whose
dictionary makes it smallest wins, and a narrow margin rejects the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.llm.common import fresh

#: Rows sampled per language (expected; by hash of the id) and characters of
#: an excerpt: the bounds of what the driver reads to fit the dictionaries.
SAMPLE_ROWS, EXCERPT = 1000, 400
#: Bytes of a dictionary, and of the blocks a text is encoded in (so that the
#: dictionary stays in reach for the whole of a long text).
DICTIONARY, BLOCK = 1 << 17, 4096
#: The levels that each block is encoded at; their sizes are added up, since one
#: size in whole bytes is coarse for a short text.
LEVELS = (3, 6)
#: Least share by which the best must beat the second.
MARGIN = 0.002
#: The answer for a text without letters.
UNKNOWN = "und"

NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalised(text: str | None) -> bytes:
    """Lower-cased letters; whatever stands around them is one space.  Empty if
    there are none."""
    found = NOT_LETTERS.sub(" ", f" {text or ''} ".lower())
    # other signs that words are made of, such as fractions, are no letters
    return found.encode("utf-8", "replace") if any(map(str.isalpha, found)) else b""


@dataclass(frozen=True)
class Model:
    """Languages, most frequent first, and the dictionary of each."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]

    def compressors(self) -> list[list[zstandard.ZstdCompressor]]:
        """Those of each language, one for each level."""
        out = []
        for content in self.dictionaries:
            out.append([])
            for level in LEVELS:
                made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                made.precompute_compress(level=level)
                out[-1].append(zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def classify(text: str | None, languages: tuple[str, ...], compressors: list) -> tuple[str, float]:
    """(language, share by which its encoding is smaller than the second's).

    Ties go to the more frequent language, at margin 0.  Without letters, or
    without any language, it is (und, 0).  A single language is sure of all.
    """
    data = normalised(text)
    if not data or not languages:
        return UNKNOWN, 0.0
    blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
    sizes = [sum(len(c.compress(b)) for c in own for b in blocks) for own in compressors]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    second = min((s for i, s in enumerate(sizes) if i != best), default=None)
    return languages[best], 1.0 if second is None else (second - sizes[best]) / second


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Dictionaries of the languages of ``labelled`` (rows with a null language,
    or whose text has no letter, teach nothing).

    Counts cover all rows and read no text; the excerpts are of about
    :data:`SAMPLE_ROWS` rows per language, chosen by a hash of the id, each at
    a place that the hash names.  Of equal excerpts one counts.
    """
    labelled = labelled.where(F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang)).count().collect()}
    if not counts:
        return Model((), ())
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, SAMPLE_ROWS / n))])
    hashed = F.xxhash64(F.col(doc_id), F.lit("langid"))
    chosen = labelled.where(F.pmod(hashed, F.lit(1 << 30)) < share[F.col(lang)] * (1 << 30))
    start = F.pmod(hashed, F.greatest(F.length(text) - EXCERPT, F.lit(1))) + 1
    rows = chosen.select(F.col(lang).alias("lang"), hashed.alias("h"), F.col(text).substr(start, F.lit(EXCERPT)).alias("t")).collect()
    found: dict[str, dict[bytes, None]] = {}
    for r in sorted(rows, key=lambda r: (r.h is None, r.h, r.t or "")):
        found.setdefault(r.lang, {})[normalised(r.t)] = None
    ranked = sorted(found, key=lambda x: (-counts[x], x))
    made = {x: b" ".join(e for e in found[x] if e)[:DICTIONARY] for x in ranked}
    ranked = [x for x in ranked if len(made[x]) >= 8]
    return Model(tuple(ranked), tuple(made[x] for x in ranked))


def predict(docs: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with two more columns: language and margin (0 to 1) of each whole
    text.  A text whose margin is under :data:`MARGIN` is one to reject."""
    told, = fresh(docs, "told")

    @F.arrow_udf("struct<lang:string,score:double>")
    def told_by(texts: pa.Array) -> pa.Array:
        if not hasattr(model, "_ready"):
            object.__setattr__(model, "_ready", model.compressors())
        found = [classify(t.as_py(), model.languages, model._ready) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["lang", "score"])

    docs = docs.withColumn(told, told_by(F.col(text).cast("string")))
    return docs.withColumns({lang_out: F.col(told)["lang"], score_out: F.col(told)["score"]}).drop(told)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document is of the fifth that nothing is learned from; false
    for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` for every row, by
    dictionaries of the rows that aren't held out (and whose id isn't null).

    lang_pred is ``und`` if the text is null or has no letter, or if no row
    teaches anything.  Rows that repeat are predicted each; an empty table
    gives an empty one.
    """
    model = fit(docs.where(F.col(doc_id).isNotNull() & ~held_out(doc_id)), doc_id, text, lang)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = predict(docs, model, "text").withColumn("held_out", held_out("doc_id"))
    return out.select("doc_id", "held_out", "lang_pred", "score", (F.col("score") < MARGIN).alias("rejected"))


def drop_unidentified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without those whose language is unknown or too close to call.

    Null texts and those without a letter go, and so do all where no row teaches
    anything.  A single language is sure of all others.  Ties are too close to
    call.  Rows that repeat are judged each; columns stay as they are; an empty
    table gives an empty one.
    """
    model = fit(docs.where(F.col(doc_id).isNotNull() & ~held_out(doc_id)), doc_id, text, lang)
    pred, score = fresh(docs, "lang_pred", "score")
    return predict(docs, model, text, pred, score).where((F.col(pred) != UNKNOWN) & (F.col(score) >= MARGIN)).drop(pred, score)
