"""Personal data in texts, by DataFrame functions alone.

Regular expressions propose spans, validators (Luhn, mod-97, ranges, digit
counts) confirm them, and context words on either side raise a span's score.
The patterns are the given ones with possessive loops and explicit starts, so
that they match the same spans but take linear time and constant stack.

The places of matches come from the pieces between them: Spark returns the
matches and the pieces, and their lengths add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.llm.common import fresh

# The patterns of each kind, in the order of the result.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])",
}
#: Kinds whose confirmed matches always stay.
BASE = ("email", "ip", "card", "phone")
#: Hundredths: what a confirmed match scores, and what a context word adds.
SCORES = {"email": 90, "ip": 60, "card": 85, "phone": 60, "iban": 75, "ssn": 30, "secret": 30}
CONTEXT_SCORE = 25
#: Least score of the kinds that the method adds.
LEAST = 50
#: Characters before a span, and after it, that are searched for context words.
NEARBY = 40
CONTEXT = {
    "email": "mail|contact|write",
    "ip": r"\bip\b|address|server|host",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": r"ssn|social security",
    "secret": "token|secret|key|password|bearer",
}
#: A text without this can't hold the kind.
NEEDED = {"email": "@", "phone": "+", "ssn": "-", "ip": "."}
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: A span.
SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint,score:int>"
#: Elements of an array whose running sums or maxima are taken at once.
RUN = 64
#: SQL: the sum, or the largest, of an array of numbers; of an empty one 0.
FOLDS = {"sum": "aggregate({0}, 0L, (p, q) -> p + q)", "max": "coalesce(array_max({0}), 0L)"}
JOINS = {"sum": "{0} + {1}", "max": "greatest({0}, {1})"}


def _run_folds(values: str, fold: str) -> str:
    """SQL: the sum (or maximum) of each run of an array."""
    return f"transform(sequence(0, (size({values}) - 1) div {RUN}), r -> {FOLDS[fold].format(f'slice({values}, cast(r as int) * {RUN} + 1, {RUN})')})"


def _folds_before(runs: str, fold: str) -> str:
    """SQL: the sum (or maximum) of the runs before each run."""
    return f"transform({runs}, (x, r) -> {FOLDS[fold].format(f'slice({runs}, 1, r)')})"


def _running(values: str, before: str, fold: str) -> str:
    """SQL: the sums (or maxima) of the first 1, 2, ... elements, from those of
    the runs, so that a text with n matches costs n x run and not n x n steps."""
    own = FOLDS[fold].format(f"slice({values}, r * {RUN} + 1, i)")
    inner = f"transform(sequence(1, least({RUN}, size({values}) - r * {RUN})), i -> {JOINS[fold].format('b', own)})"
    return f"flatten(transform({before}, (b, r) -> {inner}))"


def luhn(digits: str) -> str:
    """SQL: whether a string of digits passes Luhn's check."""
    digit = f"cast(substring(reverse({digits}), i + 1, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + if(i % 2 = 0, {digit}, 2 * {digit} - if({digit} > 4, 9, 0))) % 10 = 0"


def mod97(text: str) -> str:
    """SQL: whether an IBAN without spaces, its first four characters moved to
    the end and letters read as 10 to 35, leaves 1 modulo 97."""
    moved = f"concat(substring({text}, 5), substring({text}, 1, 4))"
    code = f"ascii(substring({moved}, i, 1))"
    return f"aggregate(sequence(1, length({text})), 0, (s, i) -> if({code} < 58, s * 10 + {code} - 48, s * 100 + {code} - 55) % 97) = 1"


def _confirmed(kind: str, hit: str) -> str:
    """SQL: whether a match passes the validator of its kind."""
    digits = f"regexp_replace({hit}, '[^0-9]', '')"
    if kind == "ip":
        return f"{hit} rlike '^{OCTET}([.]{OCTET}){{3}}$'"
    if kind == "card":
        return f"length({digits}) between 14 and 19 and {luhn(digits)}"
    if kind == "phone":
        return f"length({digits}) between 10 and 15"
    if kind == "iban":
        bare = f"replace({hit}, ' ', '')"
        return f"length({bare}) between 15 and 34 and {mod97(bare)}"
    return "true"


def _spans(kind: str, hits: str, pieces: str, starts: str) -> str:
    """SQL: the confirmed spans of one kind, as (start, kind's rank, kind, end, score)."""
    rank = list(PATTERNS).index(kind)
    # the text around a match, as far as the next one of its kind
    before, after = f"right({pieces}[i], {NEARBY})", f"left({pieces}[i + 1], {NEARBY})"
    nearby = f"lower(concat({before}, '|', {after})) rlike '{CONTEXT[kind]}'".replace("\\", "\\\\")
    score = f"{SCORES[kind]} + if({nearby}, {CONTEXT_SCORE}, 0)"
    least = 0 if kind in BASE else LEAST
    begin = f"{starts}[i]"
    made = (
        f"named_struct('start', {begin}, 'rank', {rank}, 'kind', '{kind}', 'end', {begin} + length(h), "
        f"'score', case when {_confirmed(kind, 'h')} then {score} else -1 end)"
    )
    return f"filter(transform({hits}, (h, i) -> {made}), s -> s.score >= {least})"


def with_spans(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with the array of all spans in column ``out``, sorted by start and
    then by kind.  Places count code points from 0; ends are exclusive."""
    parts = ("hits", "pieces", "steps", "runs", "before", "starts", "spans")
    names = {k: dict(zip(parts, fresh(docs, *(f"{p}_{k}" for p in parts)))) for k in PATTERNS}
    whole, = fresh(docs, "whole_text")
    docs = docs.withColumn(whole, F.coalesce(F.col(text).cast("string"), F.lit("")))
    # one step after the other, so that no lambda computes an array anew
    stages: dict[str, dict[str, Column]] = {p: {} for p in parts}
    for kind, pattern in PATTERNS.items():
        n = names[kind]
        some = lambda sql, of, n=n: F.expr(f"if(size({n['hits']}) = 0, cast(array() as array<{of}>), {sql})")
        hits = F.regexp_extract_all(F.col(whole), F.lit(pattern), F.lit(0))
        if kind in NEEDED:
            hits = F.when(F.contains(F.col(whole), F.lit(NEEDED[kind])), hits).otherwise(F.expr("cast(array() as array<string>)"))
        pieces = F.when(F.size(n["hits"]) > 0, F.split(F.col(whole), pattern))
        steps = f"transform({n['hits']}, (h, i) -> length({n['pieces']}[i]) + if(i = 0, 0, length({n['hits']}[i - 1])))"
        made = (
            hits,
            pieces,
            some(steps, "int"),
            some(_run_folds(n["steps"], "sum"), "bigint"),
            some(_folds_before(n["runs"], "sum"), "bigint"),
            some(_running(n["steps"], n["before"], "sum"), "bigint"),
            some(_spans(kind, n["hits"], n["pieces"], n["starts"]), SPAN),
        )
        for p, column in zip(parts, made):
            stages[p][n[p]] = column
    for p in parts:
        docs = docs.withColumns(stages[p])
    merged = F.array_sort(F.concat(*[F.col(names[k]["spans"]) for k in PATTERNS]))
    return docs.withColumn(out, merged).drop(whole, *[c for k in PATTERNS for c in names[k].values()])


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores,
    n_spans)`` for every row; spans is ``kind:start:end`` joined by commas, scores
    their hundredths.

    A null text is empty.  Repeated rows and null ids are rows like others;
    further columns don't matter; an empty table gives an empty one.
    """
    docs = with_spans(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "found")
    text_of = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"cast(size(filter(found, s -> s.kind = '{k}')) as bigint) as n_{k}") for k in BASE]
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    scores = F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",")
    return docs.select("doc_id", *counts, F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("found")).alias("spans"), scores.alias("scores"), F.size("found").cast("long").alias("n_spans"))


#: Characters of the blocks a text with spans is cut into, to be rebuilt from.
MASK_BLOCK = 1024


def mask_personal_data(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets, of
    overlapping spans by the first one's, and ``n_chars`` (if there is such a
    column) counted anew where the text changed.  Rows (repeated ones and those
    without an id too), other columns and texts without spans, null ones among
    them, stay as they are; an empty table gives an empty one."""
    found, ends, runs, before, tops, firsts, merged, blocks, masked = fresh(docs, "found", "ends", "runs", "before", "tops", "firsts", "merged", "blocks", "masked")
    columns = docs.columns
    docs = with_spans(docs, text, found)
    some = lambda sql, of: F.expr(f"if(size({found}) = 0, cast(array() as array<{of}>), {sql})")
    # a span begins a mask of its own if none before it reaches so far; how far
    # those before reach is a running maximum
    reached = f"if(get({firsts}, k + 1) is null, element_at({tops}, -1), {tops}[{firsts}[k + 1] - 1])"
    steps = (
        (ends, some(f"transform({found}, s -> s.end)", "bigint")),
        (runs, some(_run_folds(ends, "max"), "bigint")),
        (before, some(_folds_before(runs, "max"), "bigint")),
        (tops, some(_running(ends, before, "max"), "bigint")),
        (firsts, some(f"filter(sequence(0, size({found}) - 1), i -> i = 0 or {found}[i].start >= {tops}[i - 1])", "int")),
        (merged, some(f"transform({firsts}, (f, k) -> named_struct('start', {found}[f].start, 'end', {reached}, 'kind', {found}[f].kind))", "struct<start:bigint,end:bigint,kind:string>")),
    )
    for name, step in steps:
        docs = docs.withColumn(name, step)
    cut = F.when(F.size(found) > 0, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{MASK_BLOCK}}}"), F.lit(0)))
    part = lambda p, q: f"substring(array_join(slice({blocks}, cast(({p}) div {MASK_BLOCK} as int) + 1, cast(({q}) div {MASK_BLOCK} - ({p}) div {MASK_BLOCK} as int) + 1), ''), cast(({p}) % {MASK_BLOCK} as int) + 1, cast(({q}) - ({p}) as int))"
    since = f"if(i = 0, 0L, {merged}[i - 1].end)"
    last = f"element_at({merged}, -1).end"
    rebuilt = (
        f"concat(array_join(transform({merged}, (s, i) -> concat({part(since, 's.start')}, '[', upper(s.kind), ']')), ''), "
        f"{part(last, f'cast(length({text}) as bigint)')})"
    )
    docs = docs.withColumn(blocks, cut)
    docs = docs.withColumn(masked, F.when(F.size(found) > 0, F.expr(rebuilt)).otherwise(F.col(text)))
    out = []
    for c in columns:
        if c == text:
            out.append(F.col(masked).alias(text))
        elif c == n_chars:
            out.append(F.when(F.size(found) > 0, F.length(masked).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return docs.select(out)
