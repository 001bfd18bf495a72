"""URL filters by rules and by empirical-Bayes host reputation, with DataFrame functions only.

Labelled page outcomes are counted by host, without port and user. A host's rate has a beta prior around its registered
domain's, that one around its suffix's, that one around the overall rate; how strongly each level holds to the one above comes from the
data, by the method of moments for beta-binomial counts. A page passes if a lower bound of its host's posterior rate
reaches a threshold. Rules come first; the longest that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import Scratch, fold, small

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
Z, LEAST_RATE = 1.64, 0.75
HOSTS = 1_000_000
#: Labels that form a public suffix with a country's two letters, as in co.uk: a rule of thumb, not the whole public list.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "govt", "gv", "id", "mil", "ne", "net", "nom", "or", "org", "sch")
TWO = rf"(?:^|\.)(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$"
ADDRESS = r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*\])$"


def host_of(url: Column) -> Column:
    return fold(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; of equally long ones the first given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def name_of(host: Column) -> Column:
    """The host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(?::[0-9]*)?$", "")


def suffix_of(name: Column) -> Column:
    """The last label, or the last two where they are a country's second level; one suffix for all addresses."""
    return F.when(name.rlike(ADDRESS), "(address)").when(name.rlike(TWO), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def domain_of(name: Column) -> Column:
    """The suffix and one label more; an address is its own domain."""
    return F.when(name.rlike(ADDRESS), name).when(name.rlike(TWO), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def strength(groups: DataFrame) -> float:
    """Prior strength from groups (n, k, mu): the correlation rho that explains the spread of k / n about mu beyond
    the binomial one, as 1 / rho - 1 pseudo-counts. One row comes to the driver."""
    v = F.col("mu") * (1 - F.col("mu"))
    row = groups.where("n > 0").agg(F.sum(F.col("n") * (F.col("k") / F.col("n") - F.col("mu")) * (F.col("k") / F.col("n") - F.col("mu"))).alias("s"), F.sum(v).alias("v"), F.sum(v * (F.col("n") - 1)).alias("w")).first()
    rho = (row["s"] - row["v"]) / row["w"] if row["w"] else 0.5
    return 1 / min(max(rho, 0.001), 0.9) - 1


def host_rates(pages: DataFrame, outcomes: DataFrame, scratch: Scratch) -> DataFrame:
    """pages (page_id, name), outcomes (page_id, good) -> name, n, k, a, b: posterior beta of every host in pages."""
    good = outcomes.where("page_id is not null and good is not null").groupBy(F.col("page_id").alias("gid")).agg(F.max(F.col("good").cast("int")).alias("good"))
    seen = pages.join(good, pages.page_id == good.gid, "left")
    hosts = scratch.keep(seen.groupBy("name").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("k")), "hosts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    name, level, above = F.col("name"), None, None
    for own, up in ((suffix_of(name), F.lit("")), (domain_of(name), suffix_of(name)), (name, domain_of(name))):
        rows = hosts.groupBy(own.alias("at"), up.alias("up")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        if above is None:
            rows = rows.withColumn("mu", F.lit((total["k"] + 1) / (total["n"] + 2)))
        else:
            rows = rows.join(small(above, HOSTS), F.col("up") == F.col("above")).drop("above")
        rows = scratch.keep(rows, "level")
        c = strength(rows)
        level = rows.withColumns({"a": F.col("k") + c * F.col("mu"), "b": F.col("n") - F.col("k") + c * (1 - F.col("mu"))})
        above = level.select(F.col("at").alias("above"), (F.col("a") / (F.col("a") + F.col("b"))).alias("mu"))
    return level.select(F.col("at").alias("name"), "n", "k", "a", "b")


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, least_rate: float = LEAST_RATE, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, host_labels, host_good for each row of pages (page_id, url).

    outcomes (page_id, good 0 or 1); of several for a page the greatest counts, null ones don't. A url that is null or
    has no :// has empty host and path and shares the reputation of its like. Hosts without outcomes have their
    domain's rate, domains and suffixes alike; without any outcomes the rate is one half. Repeated rows are judged
    alike and counted each. A port or user doesn't make another host for the reputation; addresses have no domain above
    them but all addresses. Other columns are ignored."""
    scratch = Scratch(pages.sparkSession, "reputation")
    url = F.col("url").cast("string")
    pages = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rates = scratch.keep(host_rates(pages.select("page_id", name_of(F.col("host")).alias("name")), outcomes, scratch), "rates")
    mean = F.col("a") / (F.col("a") + F.col("b"))
    bound = mean - z * F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    rates = rates.select(F.col("name").alias("rname"), F.col("n").alias("host_labels"), F.col("k").alias("host_good"), F.when(bound >= least_rate, "allow").otherwise("block").alias("own"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = pages.join(small(rates, HOSTS), name_of(F.col("host")) == F.col("rname"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("own")).alias("verdict"), "host_labels", "host_good")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
g AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
q AS (SELECT page_id, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(?::[0-9]*)?$', '') AS name FROM p),
h AS (SELECT name AS host, CASE WHEN regexp_matches(name, '{address}') THEN name ELSE regexp_extract(name, CASE WHEN regexp_matches(name, '{two}') THEN '(?:[^.]*\.)?[^.]*\.[^.]*$' ELSE '(?:[^.]*\.)?[^.]*$' END) END AS dom,
      CASE WHEN regexp_matches(name, '{address}') THEN '(address)' ELSE regexp_extract(name, CASE WHEN regexp_matches(name, '{two}') THEN '[^.]*\.[^.]*$' ELSE '[^.]*$' END) END AS suf, count(good) AS n, coalesce(sum(good), 0) AS k
      FROM q LEFT JOIN g ON q.page_id = g.doc_id GROUP BY 1, 2, 3),
t AS (SELECT (sum(k) + 1) / (sum(n) + 2)::DOUBLE AS mu FROM h),
s0 AS (SELECT suf, sum(n) AS n, sum(k) AS k, any_value(t.mu) AS mu FROM h, t GROUP BY suf),
sc AS (SELECT 1 / least(greatest(coalesce((sum(n * (k / n - mu) * (k / n - mu)) - sum(mu * (1 - mu))) / nullif(sum(mu * (1 - mu) * (n - 1)), 0), 0.5), 0.001), 0.9) - 1 AS c FROM s0 WHERE n > 0),
s1 AS (SELECT suf, (k + c * mu) / (n + c) AS mean FROM s0, sc),
d0 AS (SELECT h.dom, h.suf, sum(n) AS n, sum(k) AS k, any_value(mean) AS mu FROM h JOIN s1 USING (suf) GROUP BY 1, 2),
dc AS (SELECT 1 / least(greatest(coalesce((sum(n * (k / n - mu) * (k / n - mu)) - sum(mu * (1 - mu))) / nullif(sum(mu * (1 - mu) * (n - 1)), 0), 0.5), 0.001), 0.9) - 1 AS c FROM d0 WHERE n > 0),
d1 AS (SELECT dom, (k + c * mu) / (n + c) AS mean FROM d0, dc),
h0 AS (SELECT host, n, k, mean AS mu FROM h JOIN d1 USING (dom)),
hc AS (SELECT 1 / least(greatest(coalesce((sum(n * (k / n - mu) * (k / n - mu)) - sum(mu * (1 - mu))) / nullif(sum(mu * (1 - mu) * (n - 1)), 0), 0.5), 0.001), 0.9) - 1 AS c FROM h0 WHERE n > 0),
h1 AS (SELECT host, n, k, (k + c * mu) / (n + c) AS m, n + c AS w FROM h0, hc),
v AS (SELECT host AS hname, n, k, CASE WHEN m - {z} * sqrt(m * (1 - m) / (w + 1)) >= {least} THEN 'allow' ELSE 'block' END AS own FROM h1),
r AS (SELECT p.*, v.own, CAST(v.n AS BIGINT) AS host_labels, CAST(v.k AS BIGINT) AS host_good, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p JOIN v ON hname = regexp_replace(regexp_replace(p.host, '^.*@', ''), '\.?(?::[0-9]*)?$', ''))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE own END AS verdict, host_labels, host_good FROM r
""".replace("{address}", ADDRESS).replace("{two}", TWO).replace("{z}", str(Z)).replace("{least}", str(LEAST_RATE))
