"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes are summed per host. Beta-binomial priors pass down from all pages to the
public suffix, to the registered domain, to the host; how strongly each level is drawn to the one above
is estimated from the outcomes by the method of moments. A host is blocked if the lower posterior
bound of its rate of bad pages is above a limit, so a few bad pages don't condemn a host, while an
unlabelled host inherits what is known of its domain. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import scratch, written

#: Without a table of public suffixes, a country's code of two letters with one of these labels before it is one suffix
#: (co.uk, gov.br, com.sg); any other suffix is the last label.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "go", "gv", "id", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch", "web")
#: Verdicts of hosts are broadcast up to this number (about 100 bytes each), else joined by a salted shuffle.
BROADCAST_HOSTS = 200_000
SALTS = 32
#: Up to this number rules are part of the expression, beyond it they are joined.
INLINE_RULES = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Limits:
    """Block if the posterior rate of bad pages is above `most_bad` with about the one-sided level of `z`."""

    most_bad: float = 0.5
    z: float = 1.645
    least_rho: float = 0.001
    most_rho: float = 0.5


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The name or address in a host part: without user and password, port, and a dot at the end."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(bare, r"\.$", "")


def _is_address(name: Column) -> Column:
    return F.regexp_like(name, F.lit(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$|^\["))


def suffix_of(name: Column) -> Column:
    """The public suffix by rule; '(address)' for an address."""
    second = "|".join(SECOND_LEVEL)
    two = F.regexp_extract(name, rf"(?:^|\.)((?:{second})\.[a-z]{{2}})$", 1)
    return F.when(_is_address(name), "(address)").when(two != "", two).otherwise(F.substring_index(name, ".", -1))


def domain_of(name: Column, suffix: Column) -> Column:
    """The registered domain: the suffix and the label before it; the name itself if that is no longer, or an address."""
    labels = F.size(F.split(suffix, r"\.")) + 1
    return F.when(_is_address(name), name).otherwise(F.array_join(F.reverse(F.slice(F.reverse(F.split(name, r"\.")), F.lit(1), labels)), "."))


def with_levels(names: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds suffix and domain to the rows (name, ...), whose names are distinct.

    `suffixes` (one column, suffix) is a table of public suffixes of any number of labels: the longest that a
    name ends with counts, and the rule only for names without one.
    """
    rows = names.withColumn("suffix", suffix_of(F.col("name")))
    if suffixes is not None:
        labels = F.split("name", r"\.")
        tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        known = suffixes.select(F.lower("suffix").alias("tail")).distinct()
        ends = names.where(~_is_address(F.col("name"))).select("name", F.explode(tails).alias("tail")).join(known, "tail")
        longest = ends.groupBy("name").agg(F.max_by("tail", F.length("tail")).alias("listed"))
        rows = rows.join(longest, "name", "left").withColumn("suffix", F.coalesce("listed", "suffix")).drop("listed")
    return rows.withColumn("domain", domain_of(F.col("name"), F.col("suffix")))


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def with_rules(rows: DataFrame, rules: list[tuple[str, str]], key: str) -> DataFrame:
    """Adds rule and rule_verdict: the longest rule whose host and path fit, else nulls. `key` names a unique column.

    Of rules of equal length the first by name wins; of equal rules, block.
    """
    ranked = sorted(set(rules), key=lambda r: (-len(r[0]), r[0], r[1] != "block"))
    if len(ranked) <= INLINE_RULES:
        rule = verdict = F.lit(None).cast("string")
        for text, what in reversed(ranked):
            host, path = _split(text)
            fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
            rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
        return rows.withColumns({"rule": rule, "rule_verdict": verdict})
    spark = rows.sparkSession
    listed = spark.createDataFrame([(*_split(t), t, v, i) for i, (t, v) in enumerate(ranked)], "rule_host string, rule_path string, rule string, rule_verdict string, place long")
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = rows.select(key, "path", F.explode(tails).alias("rule_host")).join(listed, "rule_host").where(F.startswith("path", "rule_path"))
    best = hits.groupBy(key).agg(F.min(F.struct("place", "rule", "rule_verdict")).alias("best")).select(key, "best.rule", "best.rule_verdict")
    return rows.join(best, key, "left")


def _digamma(x: Column) -> Column:
    y = x + 6
    return F.log(y) - 0.5 / y - 1 / (12 * y * y) - sum((1 / (x + k) for k in range(1, 6)), 1 / x)


def _trigamma(x: Column) -> Column:
    y = x + 6
    return 1 / y + 0.5 / (y * y) + 1 / (6 * y * y * y) + sum((1 / ((x + k) * (x + k)) for k in range(1, 6)), 1 / (x * x))


def lower_bound(a: Column, b: Column, z: float) -> Column:
    """A lower bound of a Beta(a, b) rate: z deviations below the mean of its logit, on the scale of rates."""
    logit = _digamma(a) - _digamma(b) - z * F.sqrt(_trigamma(a) + _trigamma(b))
    return 1 / (1 + F.exp(-logit))


def _rho(units: DataFrame, limits: Limits) -> float:
    """How much units (n, bad) differ beyond chance from their parents' rates (mean), by moments."""
    chance = F.col("mean") * (1 - F.col("mean"))
    r = units.where("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), F.lit(2.0))).alias("s"), F.sum(chance).alias("a"), F.sum(chance * (F.col("n") - 1)).alias("b")).first()
    rho = (r.s - r.a) / r.b if r.b else limits.least_rho
    return min(limits.most_rho, max(limits.least_rho, rho))


def host_posteriors(hosts: DataFrame, outcomes: DataFrame, limits: Limits = Limits(), suffixes: DataFrame | None = None) -> DataFrame:
    """host, n_labelled, n_bad, posterior_mean, posterior_low for every row of `hosts` (one column, host).

    `outcomes` has host and bad (0 or 1, null rows don't count). Hosts that differ by port or user only are one. Without
    any outcome every rate is 0.5 at the weakest strength. A few numbers a level reach the driver, never rows of hosts.
    """
    hosts = hosts.select("host").distinct().withColumn("name", name_of(F.col("host")))
    levels = with_levels(hosts.select("name").distinct(), suffixes)
    seen = outcomes.where("bad IS NOT NULL").groupBy(name_of(F.col("host")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    seen = written(with_levels(seen, suffixes), "host-outcomes")
    total = seen.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    everywhere = (total.bad + 0.5) / (total.n + 1) if total.n else 0.5

    suffixes = seen.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("mean", F.lit(everywhere))
    m = 1 / _rho(suffixes, limits) - 1
    suffixes = suffixes.select("suffix", ((F.col("bad") + m * F.col("mean")) / (F.col("n") + m)).alias("suffix_rate"))

    domains = seen.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix").withColumn("mean", F.col("suffix_rate"))
    m = 1 / _rho(domains, limits) - 1
    domains = domains.select("domain", ((F.col("bad") + m * F.col("mean")) / (F.col("n") + m)).alias("domain_rate"))

    m = 1 / _rho(seen.join(domains, "domain").withColumn("mean", F.col("domain_rate")), limits) - 1
    rows = hosts.join(levels, "name").join(seen.select("name", "n", "bad"), "name", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    prior = F.coalesce("domain_rate", "suffix_rate", F.lit(everywhere))  # inside (0, 1), as the first one is
    n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
    a, b = bad + m * prior, n - bad + m * (1 - prior)
    rows = rows.select("host", n.alias("n_labelled"), bad.alias("n_bad"), a.alias("a"), b.alias("b"))
    return rows.select("host", "n_labelled", "n_bad", (F.col("a") / (F.col("a") + F.col("b"))).alias("posterior_mean"), lower_bound(F.col("a"), F.col("b"), limits.z).alias("posterior_low"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = (), id_col: str = "page_id", url_col: str = "url", limits: Limits = Limits(), suffixes: DataFrame | None = None) -> DataFrame:
    """One row per page: its id, host, path, rule, verdict (allow or block), posterior_mean, posterior_low.

    `outcomes` has url and bad. A rule's verdict stands; without a rule the host's reputation decides.
    A null URL, or one without ://, has the host '' and the path '', and '' is judged like any host.
    Rows with equal ids are judged one by one; other columns are not read. An empty table gives no rows.
    """
    rows = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if len(set(rules)) > INLINE_RULES:
        rows = written(rows.withColumn("row_key", F.concat(F.spark_partition_id().cast("string"), F.lit(":"), F.monotonically_increasing_id().cast("string"))), "url-rows")
    with scratch(pages.sparkSession) as keep:
        judged = host_posteriors(rows.select("host"), outcomes.select(host_of(F.col("url")).alias("host"), "bad"), limits, suffixes)
        judged = keep(written(judged.select("host", "posterior_mean", "posterior_low"), "host-reputation"))
    rows = with_rules(rows, list(rules), "row_key")
    if judged.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        rows = rows.join(F.broadcast(judged), "host", "left")
    else:
        salted = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(id_col, "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    by_host = F.when(F.col("posterior_low") > limits.most_bad, "block").otherwise("allow")
    return rows.select(id_col, "host", "path", "rule", F.coalesce("rule_verdict", by_host).alias("verdict"), "posterior_mean", "posterior_low")


#: Rules of the registered query.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and bad of the pages that `labels` has by number: of low quality, or toxic."""
    return pages.select("page_id", "url").join(labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")), "page_id").select("url", "bad")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    rows = judge_urls(pages, labelled_outcomes(pages, labels), RULES)
    return rows.withColumns({c: F.round(c, 9) for c in ("posterior_mean", "posterior_low")})


def _oracle() -> str:
    """The registered query in SQL: the rules, then the three levels one after the other."""
    sum_up = "sum(n * power(bad / n - mean, 2)) AS s, sum(mean * (1 - mean)) AS a, sum(mean * (1 - mean) * (n - 1)) AS b"
    rho = "least(0.5, greatest(0.001, coalesce((s - a) / nullif(b, 0), 0.001)))"
    second = "|".join(SECOND_LEVEL)
    address = r"regexp_matches(name, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^\[')"
    psi = lambda x: f"(ln({x} + 6) - 0.5 / ({x} + 6) - 1 / (12 * ({x} + 6) * ({x} + 6)) - (1 / {x} + 1 / ({x} + 1) + 1 / ({x} + 2) + 1 / ({x} + 3) + 1 / ({x} + 4) + 1 / ({x} + 5)))"
    psi1 = lambda x: f"(1 / ({x} + 6) + 0.5 / (({x} + 6) * ({x} + 6)) + 1 / (6 * ({x} + 6) * ({x} + 6) * ({x} + 6)) + (1 / ({x} * {x}) + 1 / (({x} + 1) * ({x} + 1)) + 1 / (({x} + 2) * ({x} + 2)) + 1 / (({x} + 3) * ({x} + 3)) + 1 / (({x} + 4) * ({x} + 4)) + 1 / (({x} + 5) * ({x} + 5))))"
    ranked = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    rules = ", ".join(f"({i}, '{t}', '{_split(t)[0]}', '{_split(t)[1]}', '{v}')" for i, (t, v) in enumerate(ranked))
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
h AS (SELECT DISTINCT host, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS name FROM p),
t AS (SELECT name, CASE WHEN {address} THEN '(address)' WHEN regexp_extract(name, '(^|\.)(({second})\.[a-z][a-z])$', 2) <> '' THEN regexp_extract(name, '(^|\.)(({second})\.[a-z][a-z])$', 2) ELSE string_split(name, '.')[-1] END AS suffix FROM (SELECT DISTINCT name FROM h)),
v AS (SELECT name, suffix, CASE WHEN {address} THEN name ELSE array_to_string(string_split(name, '.')[-(len(string_split(suffix, '.')) + 1):], '.') END AS domain FROM t),
o AS (SELECT name, count(*) AS n, CAST(sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS bad FROM p JOIN labels ON doc_id = page_id JOIN h USING (host) WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY name),
e AS (SELECT o.*, suffix, domain FROM o JOIN v USING (name)),
g AS (SELECT coalesce((sum(bad) + 0.5) / (sum(n) + 1), 0.5) AS everywhere FROM e),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(everywhere) AS mean FROM e, g GROUP BY suffix),
s1 AS (SELECT 1 / {rho} - 1 AS m FROM (SELECT {sum_up} FROM s0)),
s2 AS (SELECT suffix, (bad + m * mean) / (n + m) AS suffix_rate FROM s0, s1),
d0 AS (SELECT domain, e.suffix, sum(n) AS n, sum(bad) AS bad, any_value(suffix_rate) AS mean FROM e JOIN s2 USING (suffix) GROUP BY domain, e.suffix),
d1 AS (SELECT 1 / {rho} - 1 AS m FROM (SELECT {sum_up} FROM d0)),
d2 AS (SELECT domain, (bad + m * mean) / (n + m) AS domain_rate FROM d0, d1),
h1 AS (SELECT 1 / {rho} - 1 AS m FROM (SELECT {sum_up} FROM (SELECT e.*, domain_rate AS mean FROM e JOIN d2 USING (domain)))),
q AS (SELECT h.host, coalesce(bad, 0) + m * coalesce(domain_rate, suffix_rate, everywhere) AS a, coalesce(n, 0) - coalesce(bad, 0) + m * (1 - coalesce(domain_rate, suffix_rate, everywhere)) AS b
      FROM h JOIN v USING (name) LEFT JOIN o USING (name) LEFT JOIN d2 USING (domain) LEFT JOIN s2 USING (suffix), h1, g),
w AS (SELECT host, a / (a + b) AS posterior_mean, 1 / (1 + exp(-({psi("a")} - {psi("b")} - 1.645 * sqrt({psi1("a")} + {psi1("b")})))) AS posterior_low FROM q),
r(place, rule, rule_host, rule_path, verdict) AS (VALUES {rules}),
f AS (SELECT p.page_id, p.host, p.path, arg_min(r.rule, place) AS rule, arg_min(r.verdict, place) AS rule_verdict FROM p LEFT JOIN r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN posterior_low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(posterior_mean, 9) AS posterior_mean, round(posterior_low, 9) AS posterior_low FROM f JOIN w USING (host)
"""


ORACLE = _oracle()
