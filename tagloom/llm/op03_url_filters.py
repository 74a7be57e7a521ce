"""URL filter: fixed rules first, else empirical-Bayes host reputation.

Labelled page outcomes are counted per host. The bad share of a host is shrunk
towards its registered domain's, that towards its public suffix's, that
towards the overall one, each as a beta-binomial posterior whose prior weight
is estimated from the spread between siblings. A host is blocked where the
lower bound of its posterior exceeds the cut-off. Columns and SQL only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import query, table
from tagloom.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SECOND_LEVEL = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")  # public suffixes of two labels
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
CUT, Z = 0.5, 1.645  # blocked if the bad share exceeds CUT with 95 % posterior probability
WEIGHTS = (1.0, 1000.0)  # bounds of an estimated prior weight


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def registered(host: Column) -> tuple[Column, Column]:
    """(registered domain, public suffix); a host of one label or of digits
    is its own domain without suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(bare, "[.]")
    two = F.concat_ws(".", F.slice(labels, -2, 2))
    size = F.when(two.isin(*SECOND_LEVEL), 2).otherwise(1)
    alone = (F.size(labels) < 2) | bare.rlike("^[0-9.]+$") | (F.size(labels) <= size)
    domain = F.concat_ws(".", F.slice(labels, -(size + 1), size + 1))
    suffix = F.when(size == 2, two).otherwise(F.element_at(labels, -1))
    return F.when(alone, host).otherwise(domain), F.when(alone, F.lit("")).otherwise(suffix)


def prior_weight(groups: DataFrame, mean: float) -> float:
    """Moment estimate of how much the siblings' common prior weighs, from
    (n, bad) rows."""
    p = F.col("bad") / F.col("n")
    s = groups.filter("n > 0").agg(
        F.sum(F.col("n") * (p - mean) * (p - mean)).alias("s"), F.sum("n").alias("n"),
        F.sum((F.col("n") * F.col("n")).cast("double")).alias("nn"), F.count(F.lit(1)).alias("k")).first()
    v = mean * (1 - mean)
    if s["k"] < 2 or v == 0:
        return WEIGHTS[1]
    below = v * (s["n"] - s["nn"] / s["n"] - (s["k"] - 1))
    rho = (s["s"] - (s["k"] - 1) * v) / below if below > 0 else 0.0
    return min(max(1 / rho - 1, WEIGHTS[0]), WEIGHTS[1]) if rho > 0 else WEIGHTS[1]


def reputations(hosts: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, bad, posterior, bound) for every host of ``hosts`` (page_id,
    host), from ``outcomes`` (page_id, bad 0/1). Without outcomes, hosts get
    the even prior's half."""
    known = outcomes.filter(F.col("bad").isin(0, 1)).groupBy("page_id").agg(F.max("bad").cast("bigint").alias("bad"))
    marked = hosts.join(known, "page_id", "left")
    domain, suffix = registered(F.col("host"))
    counts = marked.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    counts = materialize(counts.withColumns({"domain": domain, "suffix": suffix}), "host-counts")
    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    every = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = every["bad"] / every["n"] if every["n"] else 0.5
    weights = [prior_weight(x, mean) for x in (suffixes, domains, counts)]
    top = materialize(suffixes.select("suffix", ((F.col("bad") + weights[0] * mean) / (F.col("n") + weights[0])).alias("up")), "suffix-shares")
    middle = domains.join(top, "suffix").select("domain", ((F.col("bad") + weights[1] * F.col("up")) / (F.col("n") + weights[1])).alias("up"))
    middle = materialize(middle, "domain-shares")
    a, b = F.col("bad") + weights[2] * F.col("up"), F.col("n") - F.col("bad") + weights[2] * (1 - F.col("up"))
    out = counts.join(middle, "domain").select("host", "n", "bad", a.alias("a"), b.alias("b")).withColumn("posterior", F.col("a") / (F.col("a") + F.col("b")))
    sd = F.sqrt(F.col("posterior") * (1 - F.col("posterior")) / (F.col("a") + F.col("b") + 1))
    return out.select("host", "n", "bad", "posterior", (F.col("posterior") - z * sd).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, cut: float = CUT, z: float = Z) -> DataFrame:
    """(page_id, host, path, rule, verdict, posterior, bound) for every row of
    ``pages`` (page_id, url).

    Null urls and urls without ``://`` have empty host and path and share one
    reputation; so do all rows of a host. A page without outcome, and a null
    page_id, take no part in the counts. Repeated rows get a row each; other
    columns are ignored; an empty table gives no rows.
    """
    cut_up = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scores = materialize(reputations(cut_up.select("page_id", "host"), outcomes, z), "host-reputations")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("bound") > cut, "block").otherwise("allow")
    return cut_up.join(scores, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "posterior", "bound")


def _weight(name: str, source: str) -> str:
    return f"""{name} AS (SELECT CASE WHEN k < 2 OR v = 0 OR below <= 0 OR s - (k - 1) * v <= 0 THEN 1000.0
    ELSE least(greatest(1 / ((s - (k - 1) * v) / below) - 1, 1.0), 1000.0) END AS w
  FROM (SELECT *, v * (n - nn / n - (k - 1)) AS below FROM
    (SELECT sum(n * (bad / n - m) * (bad / n - m)) AS s, sum(n) AS n, sum(CAST(n * n AS DOUBLE)) AS nn, count(*) AS k, max(m * (1 - m)) AS v
     FROM (SELECT CAST(n AS DOUBLE) AS n, bad FROM {source} WHERE n > 0), m)))"""


ORACLE = f"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
h AS (SELECT host, CAST(count(bad) AS BIGINT) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS bad,
        regexp_extract(host, '([^.]*[.][^.]*)$', 1) AS domain, regexp_extract(host, '([^.]*)$', 1) AS suffix FROM p LEFT JOIN o USING (page_id) GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
m AS (SELECT sum(bad) / sum(n) AS m FROM s),
{_weight("ws", "s")}, {_weight("wd", "d")}, {_weight("wh", "h")},
us AS (SELECT suffix, (bad + w * m) / (n + w) AS up FROM s, ws, m),
ud AS (SELECT domain, (bad + w * up) / (n + w) AS up FROM d JOIN us USING (suffix), wd),
q AS (SELECT host, bad + w * up AS a, n - bad + w * (1 - up) AS b FROM h JOIN ud USING (domain), wh),
r AS (SELECT host, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM q),
x AS (SELECT page_id, host, path, bound, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p JOIN r USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM x"""


@query("op3_host_reputation_filter", oracle=ORACLE)
def op3_host_reputation_filter(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return judge(table(spark, folder, "pages").select("page_id", "url"), outcomes).select("page_id", "host", "path", "rule", "verdict")
