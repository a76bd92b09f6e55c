"""URL filters: rules by longest match, then trust and distrust over the link graph.

Hosts most of whose pages an allow rule fits are trusted, hosts most of whose pages a
block rule fits are blocked. Personalised PageRank spreads trust from the trusted along
links and distrust from the blocked against them; a host with more distrust than
trust is blocked. All Column code; tables by host, never by page, are iterated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
DAMPING = 0.85
#: Iterations go on until the mass that is still moving, of 1, is less than this.
REST = 1e-6
BROADCAST_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^<>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Host of a url, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules=RULES) -> DataFrame:
    """rule, rule_host, rule_path, action."""
    rows = [(r, r.partition("/")[0], "/" + r.partition("/")[2], a) for a, r in rules]
    return spark.createDataFrame(rows, "rule string, rule_host string, rule_path string, action string")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: those of the host and of all its parents, longest first."""
    parts = F.split("host", r"\.")
    up = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("rule_host"))
    got = up.join(rules, "rule_host").groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.length("rule")).alias("n"), "rule", "rule_path", "action"))).alias("rules"))
    return hosts.join(got.withColumnRenamed("host", "_h"), F.col("host") == F.col("_h"), "left").drop("_h")


def first_fit(path: Column) -> Column:
    """The first of a row's rules whose path the url's path starts with; null if none."""
    return F.get(F.filter("rules", lambda r: F.startswith(path, r["rule_path"])), F.lit(0))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rest: float = REST) -> DataFrame:
    """host, rank: personalised PageRank over edges(src, dst, n) from seeds(host, mass).

    Masses are scaled to sum to 1; what ends in hosts without links returns to the seeds. The rank is the
    series of the mass after 0, 1, 2, ... damped steps, scaled to sum to 1 (what returns to the seeds
    only scales it). Steps go on until the moving mass is below ``rest``, which damping
    ensures: after 85 steps at the most for the defaults, however long the graph's chains are.
    """
    all_mass = seeds.agg(F.sum("mass")).first()[0] or 0.0
    seeds = seeds.filter("mass > 0").select("host", (F.col("mass") / (all_mass or 1.0)).alias("rank"))
    if not all_mass or edges.limit(1).count() == 0:
        return seeds
    out = edges.groupBy("src").agg(F.sum("n").alias("_all"))
    prob = stored(edges.join(out, "src").select("src", "dst", (damping * F.col("n") / F.col("_all")).alias("p")), "links")
    moving = stored(seeds.select("host", "rank", F.lit(0).alias("step")), "mass")
    steps, left = [moving], 1.0
    while left >= rest:
        flow = prob.join(moving, prob["src"] == moving["host"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("rank"))
        moving = stored(flow.select(F.col("dst").alias("host"), "rank", F.lit(len(steps)).alias("step")), "mass")
        left = moving.agg(F.sum("rank")).first()[0] or 0.0
        steps.append(moving)
    rank = stored(reduce(DataFrame.unionAll, steps).groupBy("host").agg(F.sum("rank").alias("rank")), "rank")
    total = rank.agg(F.sum("rank")).first()[0]
    return rank.select("host", (F.col("rank") / total).alias("rank"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, summed before they are shuffled."""
    d = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    d = d.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).filter("src <> dst and src <> ''")
    return d.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    verdict is the rule's action where one fits, else block if the page's host has more distrust
    than trust, else allow (also for hosts nothing is known of, and for urls without host). Null
    html has no links. Repeated rows come again and count again; an empty table gives no rows; columns other
    than page_id, url and html are ignored. Pages are read whole, in time linear in their length.
    """
    spark = pages.sparkSession
    d = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = stored(host_rules(d.select("host").distinct(), F.broadcast(rule_table(spark, rules))), "hosts")
    size = hosts.agg(F.coalesce(F.sum(F.length("host") + 200 * (1 + F.coalesce(F.size("rules"), F.lit(0)))), F.lit(0))).first()[0]
    small = (lambda x: F.broadcast(x)) if size <= BROADCAST_BYTES else (lambda x: x)
    by_host = small(hosts.select(F.col("host").alias("_h"), "rules"))
    fit = d.join(by_host, F.col("host") == F.col("_h")).select("page_id", "host", "path", first_fit(F.col("path")).alias("r"))
    seen = stored(fit.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("r.action") == "block").alias("bad"), F.count_if(F.col("r.action") == "allow").alias("good")), "seen")
    edges = stored(host_edges(pages), "edges")
    trust = spread(edges, seen.filter("host <> '' and 2 * good > n").select("host", F.lit(1.0).alias("mass"))).select(F.col("host").alias("_t"), F.col("rank").alias("trust"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread(back, seen.filter("host <> '' and 2 * bad > n").select("host", F.lit(1.0).alias("mass"))).select(F.col("host").alias("_x"), F.col("rank").alias("distrust"))
    known = hosts.join(trust, F.col("host") == F.col("_t"), "left").join(distrust, F.col("host") == F.col("_x"), "left")
    known = stored(known.select(F.col("host").alias("_h"), "rules", (F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0))).alias("bad")), "known")
    out = d.join(small(known), F.col("host") == F.col("_h")).withColumn("r", first_fit(F.col("path")))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.action", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def sql(rules=RULES) -> str:
    """judge for DuckDB, from the same constants; a hundred steps of propagation leave less than 1e-7 of the mass."""
    upper, lower = _UPPER, _LOWER
    rest = "case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end"
    rows = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{a}')" for a, r in rules)
    link = LINK.replace("'", "''")

    def ranks(name: str, src: str, dst: str, seed: str) -> str:
        return f"""
{name}s as (select host from seen where host <> '' and 2 * {seed} > n),
{name}p as (select {src} a, {dst} b, {DAMPING} * n / sum(n) over (partition by {src}) p from edges),
{name}w as (select 0 step, host, 1.0::double / (select count(*) from {name}s) mass from {name}s
  union all select * from (select step + 1 step, b host, sum(p * mass) mass from {name}w join {name}p on a = host where step < 100 group by step, b)),
{name} as (select host, sum(mass) / (select sum(mass) from {name}w) mass from {name}w group by host)"""
    return f"""
with recursive rules as (select * from (values {rows}) v(rule, rule_host, rule_path, action)),
u as (select page_id, html, coalesce(translate(regexp_extract({rest}, '^[^/?#]*'), '{upper}', '{lower}'), '') host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') path from pages),
h as (select distinct host, path from u),
f as (select host, path, arg_max(rule, length(rule)) rule, arg_max(action, length(rule)) action from h join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by host, path),
seen as (select u.host, count(*) n, count(*) filter (action = 'block') bad, count(*) filter (action = 'allow') good from u left join f using (host, path) group by u.host),
l as (select host src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{upper}', '{lower}') dst from u),
edges as (select src, dst, count(*)::double n from l where src <> dst and src <> '' group by src, dst),{ranks('trust', 'src', 'dst', 'good')},{ranks('distrust', 'dst', 'src', 'bad')}
select u.page_id, u.host, u.path, f.rule, coalesce(f.action, case when coalesce(distrust.mass, 0) > coalesce(trust.mass, 0) then 'block' else 'allow' end) verdict
from u left join f on f.host = u.host and f.path = u.path left join trust on trust.host = u.host left join distrust on distrust.host = u.host
"""
