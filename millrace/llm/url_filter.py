"""URL filtering: stated host and path rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix.  A suffix is the host's last
label, or its last two where a country's label follows a general one (co.uk); the domain has one label more.  Each level's bad rate is shrunk towards its parent's by a beta prior whose mean is the parent's
posterior mean and whose strength is fitted by moments over all units of the level: all pages -> suffix -> domain ->
host.  A host is blocked when the lower bound of its posterior (mean - BOUND standard deviations) is above LIMIT; a host
without outcomes is judged by what its registered domain, or else its suffix, predicts for a new host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

BOUND, LIMIT = 1.645, 0.35
#: Blocked hosts that are broadcast at most; beyond, pages and hosts meet by host, and AQE splits a hot one.
BROADCAST = 500_000
#: General labels under which countries (labels of two letters) let domains be registered.
SECOND = ("ac", "co", "com", "edu", "go", "gob", "gov", "gv", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Prior strength where moments tell none, and its limits.
STRENGTH, LEAST, MOST = 10.0, 1.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits (text), and its action; nulls where none does.  Of equally long ones, the first."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: len(r[1]))[::1]:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        text, action = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(act)).otherwise(action)
    return text, action


def _shrunk(units: DataFrame, parent: DataFrame | None, key: str, above: str | None) -> DataFrame:
    """Adds the posterior (a, b) of each unit and the level's strength; the strength is fitted over all units in one pass of sums."""
    if parent is None:
        joined = units.withColumn("_m", F.lit(None).cast("double"))
    else:
        joined = units.join(parent.select(F.col(above), (F.col("a") / (F.col("a") + F.col("b"))).alias("_m")), above, "left")
    n, x = F.col("n").cast("double"), F.col("bad").cast("double")
    sums = joined.agg(F.sum(x).alias("x"), F.sum(n).alias("n"), F.sum(F.when(n > 1, n)).alias("n2"), F.sum(F.when(n > 1, n * F.pow(x / n, 2))).alias("q"), F.sum(F.when(n > 1, x)).alias("x2"), F.count(F.when(n > 1, 1)).alias("k")).first()
    rate = (sums["x"] or 0.0) / sums["n"] if sums["n"] else 0.5
    strength = STRENGTH
    if sums["n2"] and sums["k"] > 1:
        m = sums["x2"] / sums["n2"]
        noise, spread = m * (1 - m), max(0.0, sums["q"] / sums["n2"] - m * m)
        size = sums["n2"] / sums["k"]
        between = spread - noise / size
        strength = min(MOST, max(LEAST, noise / between - 1)) if between > 0 and noise > 0 else MOST
    mean = F.coalesce(F.col("_m"), F.lit(rate))
    mean = F.least(F.greatest(mean, F.lit(1e-6)), F.lit(1 - 1e-6))
    return joined.withColumn("a", mean * strength + x).withColumn("b", (1 - mean) * strength + n - x).withColumn("strength", F.lit(strength)).drop("_m")


def _bound(below: tuple[Column, ...] = ()) -> Column:
    """mean - BOUND standard deviations of (a, b), or of a new unit under it, with the strengths of the levels ``below`` it."""
    a, b = F.col("a"), F.col("b")
    mean, var = a / (a + b), a * b / ((a + b) * (a + b) * (a + b + 1))
    for strength in below:
        var = var + (mean * (1 - mean) - var) / (strength + 1)
    return mean - BOUND * F.sqrt(var)


def _levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without its port; a number address is its own domain, and a bare suffix too."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    labels = F.split(name, "[.]")
    last, before = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    k = F.when((F.length(last) == 2) & before.isin(*SECOND), 2).otherwise(1)
    join = lambda n: F.array_join(F.slice(labels, -F.least(n, F.size(labels)), F.size(labels)), ".")
    number = F.rlike(name, F.lit(r"^[0-9.]+$"))
    return F.when(number, name).otherwise(join(k + 1)), F.when(number, F.lit("")).otherwise(join(k))


def reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The levels' posteriors from ``outcomes`` (host, bad boolean); rows with nulls or an empty host are left out.

    host, n, a, b, bound for each host; domain, bound and suffix, bound for a new host under each domain and suffix.
    With no row at all the results are empty.
    """
    rows = outcomes.where(F.col("bad").isNotNull() & (F.col("host") != ""))
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    domain, suffix = _levels(F.col("host"))
    hosts = base.save(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = _shrunk(suffixes, None, "suffix", None)
    middle = _shrunk(domains, top, "domain", "suffix")
    final = _shrunk(hosts, middle, "host", "domain")
    of = lambda level: level.agg(F.first("strength").alias("s")).first()["s"] or STRENGTH
    under_host, under_domain = F.lit(of(final)), F.lit(of(middle))
    return (
        final.select("host", "n", "a", "b", _bound().alias("bound")),
        middle.select("domain", _bound((under_host,)).alias("bound")),
        top.select("suffix", _bound((under_domain, under_host)).alias("bound")),
    )


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url; others are ignored).

    A null url has an empty host and path, no rule, and is allowed; so are hosts of a suffix without outcomes.  Repeated
    rows are judged alike; of equally long rules the first holds.  An empty table gives no rows.
    """
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    text, action = rule_of(F.col("host"), F.col("path"), rules)
    split = split.withColumn("rule", text).withColumn("_act", action)
    by_host, by_domain, by_suffix = reputation(outcomes)
    domain, suffix = _levels(F.col("host"))
    seen = split.where(F.col("host") != "").select("host").distinct().withColumn("domain", domain).withColumn("suffix", suffix)
    seen = seen.join(by_host.select("host", F.col("bound").alias("_h")), "host", "left").join(by_domain.withColumnRenamed("bound", "_d"), "domain", "left").join(by_suffix.withColumnRenamed("bound", "_s"), "suffix", "left")
    bad = base.save(seen.where(F.coalesce("_h", "_d", "_s") > limit).select("host", F.lit(True).alias("_bad")))
    verdict = F.coalesce(F.col("_act"), F.when(F.col("_bad"), F.lit("block")).otherwise(F.lit("allow")))
    return split.join(F.broadcast(bad) if bad.count() <= BROADCAST else bad, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a label of the page's number with quality 0 or toxic 1 is bad."""
    pages, labels = base.table(spark, sf_dir, "pages").select("page_id", "url"), base.table(spark, sf_dir, "labels")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = pages.join(labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), "page_id").select(host_of(F.col("url")).alias("host"), "bad")
    return judge(pages, outcomes)


def _level(name: str, units: str, key: str, parent: str, above: str) -> str:
    mean = "coalesce(p.m, s.x / s.n)" if parent else "s.x / s.n"
    join = f"LEFT JOIN {parent} p ON p.{above} = u.{above}" if parent else ""
    return f"""{name}_s AS (
    SELECT sum(bad)::DOUBLE AS x, sum(n)::DOUBLE AS n, sum(n) FILTER (WHERE n > 1)::DOUBLE AS n2, sum(n * (bad / n) ** 2) FILTER (WHERE n > 1) AS q, sum(bad) FILTER (WHERE n > 1)::DOUBLE AS x2, count(*) FILTER (WHERE n > 1) AS k FROM {units}
), {name}_k AS (
    SELECT *, CASE WHEN n2 IS NULL OR k <= 1 THEN {STRENGTH} WHEN b > 0 AND v > 0 THEN least({MOST}, greatest({LEAST}, v / b - 1)) ELSE {MOST} END AS strength
    FROM (SELECT *, x2 / n2 * (1 - x2 / n2) AS v, greatest(0, q / n2 - (x2 / n2) ** 2) - x2 / n2 * (1 - x2 / n2) / (n2 / k) AS b FROM {name}_s)
), {name} AS (
    SELECT *, a / (a + b) AS m FROM (
        SELECT u.*, least(greatest({mean}, 1e-6), 1 - 1e-6) * s.strength + u.bad AS a, (1 - least(greatest({mean}, 1e-6), 1 - 1e-6)) * s.strength + u.n - u.bad AS b
        FROM {units} u CROSS JOIN {name}_k s {join})
)"""


_CASES = " ".join(
    f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{act} {name}/{rest}'"
    for act, name, rest in sorted(((a, *r.split("/", 1)) for a, r in RULES), key=lambda x: -len(x[1] + x[2]))
)

ORACLE_SQL = rf"""
WITH u AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), outcomes AS (
    SELECT host, quality = 0 OR toxic = 1 AS bad FROM split JOIN labels ON doc_id = page_id WHERE host <> '' AND (quality = 0 OR toxic = 1) IS NOT NULL
), named AS (
    SELECT host, CASE WHEN number THEN name ELSE array_to_string(labels[-(k + 1):], '.') END AS domain, CASE WHEN number THEN '' ELSE array_to_string(labels[-k:], '.') END AS suffix
    FROM (SELECT *, CASE WHEN len(labels[-1]) = 2 AND labels[-2] IN {SECOND} THEN 2 ELSE 1 END AS k, regexp_matches(name, '^[0-9.]+$') AS number
          FROM (SELECT *, string_split(name, '.') AS labels FROM (SELECT DISTINCT host, regexp_replace(host, ':[0-9]*$', '') AS name FROM split WHERE host <> '')))
), hosts AS (
    SELECT host, domain, suffix, count(*)::DOUBLE AS n, count(*) FILTER (WHERE bad)::DOUBLE AS bad FROM outcomes JOIN named USING (host) GROUP BY ALL
), domains AS (
    SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix
), suffixes AS (
    SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix
), {_level("l1", "suffixes", "suffix", "", "")}, {_level("l2", "domains", "domain", "l1", "suffix")}, {_level("l3", "hosts", "host", "l2", "domain")},
bounds AS (
    SELECT n.host, l3.a AS a3, l3.b AS b3, l2.m AS m2, l2.m * (1 - l2.m) / (l2.a + l2.b + 1) AS v2, l1.m AS m1, l1.m * (1 - l1.m) / (l1.a + l1.b + 1) AS v1, l2_k.strength AS s2, l3_k.strength AS s3
    FROM named n CROSS JOIN l2_k CROSS JOIN l3_k LEFT JOIN l3 ON l3.host = n.host LEFT JOIN l2 ON l2.domain = n.domain LEFT JOIN l1 ON l1.suffix = n.suffix
), bad AS (
    SELECT host FROM (SELECT *, v1 + (m1 * (1 - m1) - v1) / (s2 + 1) AS w1 FROM bounds)
    WHERE coalesce(a3 / (a3 + b3) - {BOUND} * sqrt(a3 * b3 / ((a3 + b3) * (a3 + b3) * (a3 + b3 + 1))), m2 - {BOUND} * sqrt(v2 + (m2 * (1 - m2) - v2) / (s3 + 1)), m1 - {BOUND} * sqrt(w1 + (m1 * (1 - m1) - w1) / (s3 + 1))) > {LIMIT}
), judged AS (
    SELECT page_id, host, path, CASE {_CASES} END AS fit FROM split
)
SELECT page_id, j.host, path, split_part(fit, ' ', 2) AS rule, coalesce(split_part(fit, ' ', 1), CASE WHEN bad.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM judged j LEFT JOIN bad ON bad.host = j.host
"""
