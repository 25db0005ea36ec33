"""URL verdicts by DataFrame functions alone: rules first, and for the rest a
logistic regression on hashed character n-grams of host and path.

The model is fitted on a small labelled table of URLs on the driver and its
weights are whole millionths, so a score is an exact sum of integers and the
same in any order.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.llm.common import fresh

#: Hash buckets of the n-grams, and the lengths of an n-gram.
BUCKETS, GRAMS = 1024, (3, 4)
#: Most labelled URLs a model is fitted on: the table is held on the driver.
MOST_LABELLED = 10_000
ROUNDS, RATE, DECAY = 300, 0.5, 1e-3
MILLION = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The given rules, as (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

# The labelled URLs, one list for each verdict.
BLOCKED = """
http://spam-farm.example.com/en/12 https://www.spam-farm.example.net/fr/404 http://cheap-pills.example.org/en/9 https://www.cheap-pills.example.com/de/77.html
http://casino-win.example.net/es/5 https://m.casino-win.example.org/en/31/ http://free-bets.example.com/en/640 https://blog.free-bets.example.net/fr/18
http://ads-track.example.org/en/202 https://m.ads-track.example.com/es/3#top http://casino.example.net/slots/1 https://online-casino.example.org/win/big
http://pills-online.example.com/buy/cheap http://cheap-meds.example.net/pills/55 https://spam.example.org/farm/1 http://linkfarm.example.com/spam/99
http://bets.example.net/free/3 https://sports-bets.example.com/odds/44 http://tracker.example.org/ads/click https://ads.example.net/track/8
http://adserver.example.com/track?id=5 http://win-prizes.example.org/free/777 https://poker-win.example.net/play/6 http://xxx-cams.example.com/live/2
http://payday-loans.example.org/apply/1 https://fast-loans.example.net/cash/20 http://clickbait.example.com/wow/9 http://malware-site.example.org/download/1
https://phishing-login.example.net/bank/verify http://warez-crack.example.com/keygen/3 https://replica-watches.example.org/cheap/12 http://adult-video.example.net/xxx/8
"""
ALLOWED = """
http://www.example.com/en/12 https://blog.example.net/fr/404 http://m.example.org/en/9 https://thered.example.com/de/77.html
http://therin.example.net/es/5 https://m.tiontion.example.org/en/31/ http://ththan.example.com/en/640 https://blog.ththble.example.net/fr/18
http://tionble.example.org/en/202 https://m.therou.example.com/es/3#top http://news.example.net/world/1 https://wiki.example.org/article/big
http://docs.example.com/guide/start http://library.example.net/books/55 https://school.example.org/class/1 http://museum.example.com/tours/99
http://weather.example.net/today/3 https://science.example.com/papers/44 http://forum.example.org/topic/click https://photos.example.net/album/8
http://recipes.example.com/soup?id=5 http://history.example.org/rome/777 https://garden.example.net/plants/6 http://music.example.com/live/2
http://city-council.example.org/apply/1 https://travel.example.net/trains/20 http://stories.example.com/short/9 http://software.example.org/download/1
https://credit-union.example.net/bank/login http://university.example.com/courses/3 https://health.example.org/advice/12 http://film.example.net/review/8
http://www.ththat.example.net/en/671 https://thwh.example.org/en/960 http://blog.thernt.example.com/fr/369 https://www.eron.example.net/de/853/
http://www.ththed.example.org/es/533 http://blog.ththly.example.net/en/728 https://m.thering.example.com/en/825 https://blog.therha.example.com/en/474
"""


def labelled_urls() -> list[tuple[str, int]]:
    """The built-in labelled table: (url, 1 to block or 0 to allow)."""
    return [(u, 1) for u in BLOCKED.split()] + [(u, 0) for u in ALLOWED.split()]


def host_and_path(url: str | None) -> tuple[str, str]:
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (found[1].translate(str.maketrans(UPPER, LOWER)), found[2]) if found else ("", "")


def _marked(host: str, path: str) -> str:
    return f"^{host}|{path}$"


def buckets(host: str, path: str) -> list[int]:
    """The bucket of each n-gram of a marked host and path, repeats included."""
    text = _marked(host, path)
    return [int(hashlib.md5(text[i : i + n].encode()).hexdigest()[:7], 16) % BUCKETS for n in GRAMS for i in range(len(text) - n + 1)]


@dataclass(frozen=True)
class Model:
    """Weights of the buckets and the bias, in millionths."""

    weights: tuple[int, ...]
    bias: int


def fit(labelled: Sequence[tuple[str, int]]) -> Model:
    """Logistic regression by gradient descent with weight decay; features are
    the counts of the n-grams, so that scores are whole numbers of millionths."""
    if len(labelled) > MOST_LABELLED:
        raise ValueError(f"at most {MOST_LABELLED} labelled URLs, not {len(labelled)}")
    rows: list[tuple[dict[int, float], int]] = []
    for url, y in labelled:
        counts: dict[int, float] = {}
        for b in buckets(*host_and_path(url)):
            counts[b] = counts.get(b, 0) + 1
        rows.append((counts, y))
    w, bias = [0.0] * BUCKETS, 0.0
    for _ in range(ROUNDS):
        step, shift = [0.0] * BUCKETS, 0.0
        for counts, y in rows:
            error = 1 / (1 + math.exp(-max(-60.0, min(60.0, bias + sum(w[b] * n for b, n in counts.items()))))) - y
            shift += error
            for b, n in counts.items():
                step[b] += error * n
        n = max(1, len(rows))
        w = [x - RATE * (g / n + DECAY * x) for x, g in zip(w, step)]
        bias -= RATE * shift / n
    return Model(tuple(round(x * MILLION) for x in w), round(bias * MILLION))


def _parts(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def _rule(host: str, path: str, rules: Sequence[tuple[str, str, str]], value) -> Column:
    """``value`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the last set is tried first
        of, start = rule[1], rule[2]
        fits = ((F.col(host) == of) | F.col(host).endswith(f".{of}")) & F.col(path).startswith(start)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def judge(pages: DataFrame, model: Model, rules: Sequence[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` for every row.

    The verdict is that of the longest rule that fits host (or a parent of it)
    and path, else block if the model's score (millionths, bias included; the
    log-odds of block) is above zero.  A null url, or one without ``://``, has
    an empty host and path.  Repeated rows are judged each, a null id stays
    null; further columns don't matter; an empty table gives an empty one.
    """
    host, path = _parts(F.col(url))
    pages = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    marked, = fresh(pages, "marked")
    pages = pages.withColumn(marked, F.concat(F.lit("^"), "host", F.lit("|"), "path", F.lit("$")))
    weights = F.array(*[F.lit(w) for w in model.weights]).cast("array<int>")
    grams = "concat(" + ", ".join(f"if(length({marked}) < {n}, cast(array() as array<string>), transform(sequence(1, length({marked}) - {n - 1}), i -> substring({marked}, i, {n})))" for n in GRAMS) + ")"
    pages = pages.withColumn("grams", F.expr(grams)).withColumn("weights", weights)
    bucket = f"cast(conv(substring(md5(g), 1, 7), 16, 10) as int) % {BUCKETS}"
    score = F.expr(f"aggregate(grams, {model.bias}L, (s, g) -> s + weights[{bucket}])")
    pages = pages.withColumn("score", score)
    rule = _rule("host", "path", rules, lambda r: r[1] + r[2])
    ruled = _rule("host", "path", rules, lambda r: r[0])
    verdict = F.coalesce(ruled, F.when(F.col("score") > 0, "block").otherwise("allow"))
    return pages.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")


def oracle(model: Model, rules: Sequence[tuple[str, str, str]] = RULES, pages: str = "pages") -> str:
    """DuckDB SQL of :func:`judge`."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    case = lambda value: "case " + " ".join(f"when (host = '{r[1]}' or ends_with(host, '.{r[1]}')) and starts_with(path, '{r[2]}') then '{value(r)}'" for r in ordered) + " end"
    grams = " || ".join(f"list_transform(range(1, greatest(length(m) - {n - 2}, 1)), lambda i: substr(m, i, {n}))" for n in GRAMS)
    listed = ", ".join(map(str, model.weights))
    bucket = f"('0x' || substr(md5(g), 1, 7))::bigint % {BUCKETS}"
    return f"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from {pages}),
m as (select *, '^' || host || '|' || path || '$' as m from p),
w as (select [{listed}] as weights),
s as (select page_id, host, path, ({model.bias} + coalesce(list_sum(list_transform({grams}, lambda g: weights[({bucket}) + 1])), 0))::bigint as score from m, w)
select page_id, host, path, {case(lambda r: r[1] + r[2])} as rule,
coalesce({case(lambda r: r[0])}, case when score > 0 then 'block' else 'allow' end) as verdict, score from s"""
