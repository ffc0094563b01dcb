"""URL filters: explicit rules first, then an empirical-Bayes reputation of the host. Built-in expressions only."""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.sized import small_left_join
from panelcast.session import cut_lineage

#: (verdict, host/path) in the order of the contract.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: A host passes if this many posterior deviations below its mean still reach MIN_GOOD.
Z, MIN_GOOD = 1.645, 0.5
#: Bounds of the between-group correlation; a prior weighs (1 - rho) / rho pages.
RHO = (0.001, 0.5)

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null url or one without ``://``. Only A-Z are lower-cased."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), ascii_uppercase, ascii_lowercase), F.regexp_extract(url, URL, 2)


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, equal lengths in alphabetical order; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def reputation(hosts: DataFrame, rho: tuple[float, float] = RHO) -> DataFrame:
    """(host, mean, sd) of the good share of each host, shrunk from suffix to registered domain to host.

    ``hosts`` has host, n (labelled pages) and k (good ones); hosts without labels get their domain's
    belief. The suffix is the last label of a host, the registered domain its last two. At each level
    a group's beta prior is centred on its parent's posterior mean; its weight comes from the moments
    of the beta-binomial over all groups of the level. Everything is summed per host before.
    """
    named = hosts.select("host", "n", "k", F.element_at(F.split("host", r"\."), -1).alias("suffix"), F.substring_index("host", ".", -2).alias("domain"))

    def weight(groups: DataFrame) -> DataFrame:
        """One row: the weight of the prior, from groups (n, k, m: parent's mean)."""
        var = F.col("m") * (1 - F.col("m"))
        sums = groups.where("n > 0").agg(
            F.sum(F.pow(F.col("k") - F.col("n") * F.col("m"), F.lit(2.0)) / F.col("n")).alias("s"), F.sum(var).alias("v"), F.sum(var * (F.col("n") - 1)).alias("w")
        )
        raw = F.when(F.col("w") > 0, (F.col("s") - F.col("v")) / F.col("w")).otherwise(F.lit(rho[0]))
        r = F.least(F.lit(rho[1]), F.greatest(F.lit(rho[0]), raw))
        return sums.select(((1 - r) / r).alias("prior"))

    def shrink(groups: DataFrame) -> DataFrame:
        return groups.join(F.broadcast(weight(groups)), F.lit(True)).withColumn("mean", (F.col("k") + F.col("prior") * F.col("m")) / (F.col("n") + F.col("prior")))

    root = named.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m"))
    suffixes = shrink(named.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(F.broadcast(root), F.lit(True)))
    domains = named.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(suffixes.select("suffix", F.col("mean").alias("m")), "suffix")
    domains = cut_lineage(shrink(domains))
    own = shrink(named.join(domains.select("domain", F.col("mean").alias("m")), "domain"))
    a, b = F.col("k") + F.col("prior") * F.col("m"), F.col("n") - F.col("k") + F.col("prior") * (1 - F.col("m"))
    return own.select("host", "mean", F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd"))


def judge(
    pages: DataFrame, labelled: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, z: float = Z, min_good: float = MIN_GOOD
) -> DataFrame:
    """``pages`` with host, path, rule, verdict, good_mean and good_bound.

    ``labelled`` has url and good (0/1), one row for each labelled page. Pages that no rule fits are
    allowed if the lower posterior bound of their host's good share reaches ``min_good``. Null and
    repeated urls are judged like any other; clashing column names are replaced.
    """
    host, path = split_url(F.col(url_col))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "good_mean", "good_bound")]
    own = [f"c{k}" for k in range(len(kept))]  # no name of a page's column can clash with those used here
    rows = pages.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(kept, own, strict=True)), host.alias("host"), path.alias("path"))
    seen = labelled.select(split_url(F.col("url"))[0].alias("host"), F.lit(1).alias("n"), F.col("good").alias("k"))
    counts = seen.unionByName(rows.select("host", F.lit(0).alias("n"), F.lit(0).alias("k"))).groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    known = cut_lineage(reputation(cut_lineage(counts))).select(F.col("host").alias("_host"), "mean", "sd")
    bound = F.col("mean") - z * F.col("sd")
    return small_left_join(rows, known, F.col("host") == F.col("_host")).select(
        *(F.col(o).alias(c) for c, o in zip(kept, own, strict=True)),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(bound >= min_good, "allow").otherwise("block")).alias("verdict"),
        F.col("mean").alias("good_mean"),
        bound.alias("good_bound"),
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, good): pages whose path names a labelled document; good means quality without toxicity, judged by its worst label."""
    outcome = labels.groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"))
    number = F.regexp_extract(split_url(F.col("url"))[1], r"([0-9]{1,18})", 1)
    return pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).join(outcome, "doc_id").select("url", "good")


def check_sql(z: float = Z, min_good: float = MIN_GOOD, rho: tuple[float, float] = RHO) -> str:
    """The registered query in SQL."""
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)

    def shrink(name: str, groups: str) -> str:
        return f"""
{name}0 as ({groups}),
{name}w as (select case when sum(case when n > 0 then m * (1 - m) * (n - 1) end) > 0
  then (sum(case when n > 0 then pow(k - n * m, 2) / n end) - sum(case when n > 0 then m * (1 - m) end)) / sum(case when n > 0 then m * (1 - m) * (n - 1) end) else {rho[0]} end as raw from {name}0),
{name} as (select g.*, (1 - r) / r as prior, (k + (1 - r) / r * m) / (n + (1 - r) / r) as mean from {name}0 g, (select least({rho[1]}, greatest({rho[0]}, raw)) as r from {name}w))"""

    return f"""
with u as (select page_id, url, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{ascii_uppercase}', '{ascii_lowercase}') as host,
  regexp_extract(coalesce(url, ''), '{URL}', 2) as path from pages),
rules(said, rule, rhost, rpath) as (values {rules}),
fit as (select page_id, rule, said, row_number() over (partition by page_id order by length(rule) desc, rule) as i from u join rules
  on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)),
outcome as (select doc_id, min(case when quality = 1 and coalesce(toxic, 0) = 0 then 1 else 0 end) as good from labels group by doc_id),
num as (select host, try_cast(nullif(regexp_extract(path, '([0-9]{{1,18}})', 1), '') as bigint) as doc_id from u),
seen as (select host, 1 as n, good as k from num join outcome using (doc_id) union all select host, 0, 0 from u),
h as (select host, sum(n) as n, sum(k) as k, string_split(host, '.')[-1] as suffix, array_to_string(string_split(host, '.')[-2:], '.') as domain from seen group by host),
root as (select (sum(k) + 1) / (sum(n) + 2) as m from h),
{shrink("s", "select suffix, sum(n) as n, sum(k) as k, any_value(m) as m from h, root group by suffix").strip()},
{shrink("d", "select h.suffix, domain, sum(h.n) as n, sum(h.k) as k, any_value(s.mean) as m from h join s on h.suffix = s.suffix group by h.suffix, domain").strip()},
{shrink("o", "select h.host, h.n, h.k, d.mean as m from h join d on h.domain = d.domain").strip()},
p as (select host, mean, k + prior * m as a, n - k + prior * (1 - m) as b from o)
select u.page_id, u.host, u.path, fit.rule, coalesce(fit.said, case when mean - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= {min_good} then 'allow' else 'block' end) as verdict
from u join p on u.host = p.host left join fit on fit.page_id = u.page_id and i = 1"""
