"""URL filters: host and path rules first, then a logistic regression on hashed character n-grams.

Everything on the way from a url column to a verdict is DataFrame functions.  Only the fit of the
weights runs as plain Python on the driver, over a labelled table of at most MAX_LABELLED urls.

A rule is a host and a path; it fits the host and its subdomains where the url's path starts with
the rule's path, and the longest rule, host and path together, wins (ties: block before allow).
Urls without a rule get the regression's verdict.

Edge cases: a null url or one without `://` has an empty host and path, fits no rule and is judged
by the intercept alone; repeated urls are judged alike; with no rules every url is judged by the
regression; an empty labelled table gives weights of zero and the verdict allow.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

# The labelled urls that the regression is trained on (1: block).
LABELLED = [
    ("https://docs.example.org/guide/start.html", 0), ("https://www.example.org/en/science/physics", 0),
    ("http://news.example.org/2024/05/city-council", 0), ("https://library.example.edu/catalog/item/82", 0),
    ("https://wiki.example.org/de/Physik", 0), ("https://blog.example.net/en/gardening-in-spring", 0),
    ("https://m.example.org/en/weather/", 0), ("http://research.example.edu/papers/17.html", 0),
    ("https://example.net/de/geschichte/mittelalter", 0), ("https://www.example.net/en/recipes/soup", 0),
    ("https://forum.example.org/thread/1234?page=2", 0), ("https://example.org/es/cultura/libros", 0),
    ("https://archive.example.org/fr/litterature", 0), ("https://code.example.org/projects/parser", 0),
    ("https://museum.example.org/en/exhibits", 0), ("https://health.example.org/advice/sleep.html", 0),
    ("https://school.example.edu/de/mathematik", 0), ("https://example.net/en/travel/alps", 0),
    ("https://data.example.org/en/census/2020", 0), ("https://example.org/en/31337.html", 0),
    ("http://free-casino.example.net/win/jackpot", 1), ("https://xxx.example.net/adult/videos", 1),
    ("http://cheap-pills.example.biz/buy/now", 1), ("https://ads.example.net/click?id=33", 1),
    ("http://track.example.net/pixel/ref", 1), ("https://poker-bonus.example.biz/slots", 1),
    ("http://warez.example.net/crack/keygen", 1), ("https://login-verify.example.biz/account/update", 1),
    ("http://hot-singles.example.net/dating/xxx", 1), ("https://casino.example.org/bonus/free-spins", 1),
    ("http://torrent.example.net/download/cracked", 1), ("https://spam.example.biz/offer/win-prize", 1),
    ("http://adult.example.org/xxx/gallery", 1), ("https://replica-watches.example.biz/buy/cheap", 1),
    ("http://ads.example.org/banner/pop", 1), ("https://lottery.example.biz/prize/claim", 1),
    ("http://payday-loans.example.biz/apply/now", 1), ("https://betting.example.net/odds/bonus", 1),
    ("http://clickbait.example.biz/ads/shock", 1), ("https://pills.example.org/order/cheap", 1),
]

BUCKETS = 1024
GRAMS = (2, 3)
MAX_LABELLED = 10_000
#: Rules up to this number become one CASE; more of them are joined by host.
MAX_CASES = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


# ----------------------------------------------------------------------------------------------
# Rules


def _in_order(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r))


def with_rule(urls: DataFrame, rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> DataFrame:
    """urls with `rule` (host and path of the longest that fits, else null) and `rule_verdict`.

    The frame needs a column `__row` that tells its rows apart if there are over MAX_CASES rules.
    """
    if len(rules) > MAX_CASES:
        return _joined_rules(urls, rules, host, path)

    def first(of) -> Column:
        out: Column | None = None
        for r in _in_order(rules):
            fits = ((F.col(host) == r[0]) | F.col(host).endswith("." + r[0])) & F.col(path).startswith(r[1])
            out = F.when(fits, of(r)) if out is None else out.when(fits, of(r))
        return F.lit(None).cast("string") if out is None else out

    return urls.withColumns({"rule": first(lambda r: r[0] + r[1]), "rule_verdict": first(lambda r: r[2])})


def _joined_rules(urls: DataFrame, rules: list[tuple[str, str, str]], host: str, path: str) -> DataFrame:
    """Each url meets the rules of its host and of the hosts above it; the longest fitting one is kept."""
    spark = urls.sparkSession
    ranked = [(h, p, v, i) for i, (h, p, v) in enumerate(_in_order(rules))]
    table = spark.createDataFrame(ranked, "__suffix string, __start string, __verdict string, __rank int")
    labels = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = (
        urls.select("__row", F.col(path).alias("__path"), F.explode(suffixes).alias("__suffix"))
        .join(table, "__suffix")
        .filter(F.col("__path").startswith(F.col("__start")))
        .groupBy("__row")
        .agg(F.min(F.struct("__rank", F.concat("__suffix", "__start").alias("rule"), F.col("__verdict"))).alias("__best"))
    )
    best = found.select("__row", F.col("__best.rule").alias("rule"), F.col("__best.__verdict").alias("rule_verdict"))
    return urls.join(best, "__row", "left")


# ----------------------------------------------------------------------------------------------
# Regression


def bucket(codes: list[int], salt: int) -> int:
    """The bucket of an n-gram, from its characters' code points; column_buckets() states the same."""
    out = salt
    for c in codes:
        out = out * 131 + c
    return out % BUCKETS


def _salt(part: int, n: int) -> int:
    return 17 * part + n


def features(host: str, path: str) -> dict[int, float]:
    """Bucket -> n-grams' share, of a host and a path."""
    found: dict[int, float] = {}
    total = 0
    for part, text in enumerate((host, path)):
        for n in GRAMS:
            for i in range(len(text) - n + 1):
                b = bucket([ord(c) for c in text[i : i + n]], _salt(part, n))
                found[b] = found.get(b, 0.0) + 1.0
                total += 1
    return {b: c / math.sqrt(total) for b, c in found.items()}


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[cut:]
    end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:cut].translate(str.maketrans(_UPPER, _LOWER)), tail[:end]


def fit(labelled: list[tuple[str, int]] = LABELLED, epochs: int = 300, rate: float = 0.5, decay: float = 0.002) -> list[float]:
    """BUCKETS weights and, last, the intercept, by full gradient descent from zero."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"the labelled table holds {len(labelled)} urls; at most {MAX_LABELLED} are fitted on the driver")
    rows = [(features(*split_url(url)), y) for url, y in labelled]
    w = [0.0] * (BUCKETS + 1)
    for _ in range(epochs if rows else 0):
        step: dict[int, float] = {}
        for x, y in rows:
            z = w[BUCKETS] + sum(w[b] * v for b, v in x.items())
            err = 1.0 / (1.0 + math.exp(-z)) - y
            step[BUCKETS] = step.get(BUCKETS, 0.0) + err
            for b, v in x.items():
                step[b] = step.get(b, 0.0) + err * v
        w = [v * (1.0 - rate * decay) for v in w[:BUCKETS]] + [w[BUCKETS]]
        for b, g in step.items():
            w[b] -= rate * g / len(rows)
    return [round(v, 6) for v in w]


def _gram_weights(text: Column, part: int, n: int, weights: Column) -> Column:
    """The summed weights of a text's n-grams."""
    code = lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("long")

    def weight(i: Column) -> Column:
        h = reduce(lambda acc, k: acc * 131 + code(i + k), range(n), F.lit(_salt(part, n)).cast("long"))
        return F.element_at(weights, (h % BUCKETS + 1).cast("int"))

    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(F.transform(starts, weight), F.lit(0.0), lambda a, x: a + x)


def regression_score(host: Column, path: Column, weights: list[float]) -> Column:
    """The probability that a url is to be blocked."""
    table = F.array(*map(F.lit, weights[:BUCKETS]))
    texts = (host, path)
    total = reduce(lambda a, b: a + b, [F.greatest(F.length(t) - n + 1, F.lit(0)) for t in texts for n in GRAMS])
    sums = reduce(lambda a, b: a + b, [_gram_weights(t, part, n, table) for part, t in enumerate(texts) for n in GRAMS])
    z = F.lit(weights[BUCKETS]) + sums / F.sqrt(F.greatest(total, F.lit(1)).cast("double"))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def judge(
    pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str, str]] = RULES,
    labelled: list[tuple[str, int]] = LABELLED,
) -> DataFrame:
    """pages with host, path, rule, verdict and, where no rule fits, the regression's score."""
    made = ("host", "path", "rule", "verdict", "score")
    weights = fit(labelled)
    urls = pages.select(
        *[F.col(f"`{c}`") for c in pages.columns if c not in made or c == url_col],
        host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"),
    )
    if len(rules) > MAX_CASES:
        urls = urls.withColumn("__row", F.uuid(F.lit(7)))
    ruled = with_rule(urls, rules)
    score = F.when(F.col("rule").isNull(), F.round(regression_score(F.col("host"), F.col("path"), weights), 6))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return ruled.withColumn("score", score).withColumn("verdict", verdict).drop("rule_verdict", "__row")


# ----------------------------------------------------------------------------------------------
# The same in SQL


def sql(table: str = "pages", rules: list[tuple[str, str, str]] = RULES, labelled: list[tuple[str, int]] = LABELLED) -> str:
    """The query op7 in DuckDB's SQL; the fitted weights stand in it as a list."""
    weights = fit(labelled)
    fits = lambda r: f"(host = '{r[0]}' OR suffix(host, '.{r[0]}')) AND starts_with(path, '{r[1]}')"
    ordered = _in_order(rules)
    rule = " ".join(f"WHEN {fits(r)} THEN '{r[0]}{r[1]}'" for r in ordered)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r[2]}'" for r in ordered)

    def grams(text: str, part: int, n: int) -> str:
        h = str(_salt(part, n))
        for k in range(n):
            h = f"({h} * 131 + ascii({text}[i + {k}]))"
        return f"coalesce(list_sum(list_transform(range(1, length({text}) - {n - 2}), lambda i: w[{h} % {BUCKETS} + 1])), 0)"

    sums = " + ".join(grams(t, part, n) for part, t in enumerate(("host", "path")) for n in GRAMS)
    total = " + ".join(f"greatest(length({t}) - {n - 1}, 0)" for t in ("host", "path") for n in GRAMS)
    return f"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
    {weights[:BUCKETS]}::DOUBLE[] AS w
  FROM {table}
), r AS (
  SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS rule_verdict,
    round(1 / (1 + exp(-({weights[BUCKETS]} + ({sums}) / sqrt(greatest({total}, 1))))), 6) AS p
  FROM u
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN p > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM r
"""
