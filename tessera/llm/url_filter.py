"""URLs judged by rules and, where none fits, by trust and distrust that spread over links between hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import query
from tessera.llm.common import LOWER, UPPER, ascii_lower, given, saved

#: Fixed values of the query: verdict and (host, path) of each rule.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

DAMPING = 0.85
ROUNDS = 20
#: Ranks are written every so many rounds; the plan between two writes holds that many joins.
ROUNDS_A_WRITE = 5
#: Rule lists up to this length are one CASE expression; longer ones are joined by host.
INLINE_RULES = 200
#: At most so many blocked hosts (names of up to about 250 bytes) are broadcast; more are joined under salted keys.
BROADCAST_HOSTS = 20_000
SALTS = 32
#: No host name of DNS is longer, so longer ones have no kin.
MAX_NAME = 253

WHITE = r"\x09-\x0D\x20"
COMMENT = r"(?s)<!--.*?-->"
SCRIPT = r"(?is)<(?:script|style)\b.*?</(?:script|style)[^>]*>"
LINK = rf"(?i)<a[{WHITE}][^>]*?href[{WHITE}]*=[{WHITE}]*[\"']?[{WHITE}]*(?:https?:)?//([^/?#\"'>{WHITE}]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lowered) and path of a URL; both empty for NULL or without ``://``."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def parents(host: Column, least: int) -> Column:
    """The domains above ``host`` that keep at least ``least`` labels, nearest first."""
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(2), F.size(labels) - (least - 1)),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    none = F.array().cast("array<string>")
    return F.when((F.size(labels) > least) & (F.length(host) <= MAX_NAME), above).otherwise(none)


def _split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def with_rules(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``urls`` with ``rule`` and ``ruled`` (its verdict): the longest rule that fits ``host`` and ``path``, else NULL.

    Equal lengths: the smaller rule text. A rule given twice counts with its first verdict.
    """
    first: dict[str, str] = {}
    for verdict, rule in rules:
        first.setdefault(rule, verdict)
    ordered = sorted(first, key=lambda r: (-len(r), r))
    if not ordered:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "ruled": F.lit(None).cast("string")})
    if len(ordered) <= INLINE_RULES:
        chosen = ruled = F
        for rule in ordered:
            host, path = _split_rule(rule)
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            chosen, ruled = chosen.when(fits, F.lit(rule)), ruled.when(fits, F.lit(first[rule]))
        return urls.withColumns({"rule": chosen, "ruled": ruled})
    table = urls.sparkSession.createDataFrame(
        [(*_split_rule(r), r, first[r]) for r in ordered], "domain string, under string, rule string, verdict string")
    hosts = urls.select("host").distinct()
    domains = hosts.select("host", F.explode(F.concat(F.array("host"), parents(F.col("host"), 1))).alias("domain"))
    known = domains.join(table, "domain").groupBy("host").agg(F.sort_array(F.collect_list(
        F.struct((-F.length("rule")).alias("order"), "rule", "under", "verdict"))).alias("own"))
    best = F.get(F.filter("own", lambda r: F.col("path").startswith(r["under"])), F.lit(0))
    return urls.join(known, "host", "left").withColumns({"rule": best["rule"], "ruled": best["verdict"]}).drop("own")


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Columns ``src``, ``dst``, ``w``: pages of ``src`` that link to ``dst``; kin of one domain count as one link each way.

    ``pages`` has ``host`` and ``html``, ``hosts`` has ``host``. Links are ``a href`` outside comments and scripts that
    name another host. A host's kin is the nearest domain above it that is a host of a page or a link itself.
    """
    markup = F.regexp_replace(F.regexp_replace("html", COMMENT, " "), SCRIPT, " ")
    found = F.array_distinct(F.transform(F.regexp_extract_all(markup, F.lit(LINK), F.lit(1)), ascii_lower))
    linked = pages.where("html IS NOT NULL AND host <> ''").select("host", F.explode(found).alias("dst"))
    linked = linked.where("host <> dst").groupBy(F.col("host").alias("src"), "dst").agg(F.count(F.lit(1)).alias("w"))
    linked = saved(linked, "links")
    named = hosts.where("host <> ''").select("host").union(linked.select("dst")).distinct()
    above = named.select(F.col("host").alias("below"), F.explode(parents(F.col("host"), 2)).alias("host"))
    kin = above.join(named, "host").groupBy("below").agg(F.max_by("host", F.length("host")).alias("host"))
    one = F.lit(1).cast("long").alias("w")
    both = kin.select(F.col("below").alias("src"), F.col("host").alias("dst"), one).union(
        kin.select(F.col("host").alias("src"), F.col("below").alias("dst"), one))
    return saved(linked.union(both).groupBy("src", "dst").agg(F.sum("w").alias("w")), "host-edges")


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Columns ``host``, ``trust``, ``distrust`` of every host that either reaches.

    Two personalised PageRanks of ``rounds`` steps in one table: trust starts at ``seeds.trust`` and follows the edges,
    distrust starts at ``seeds.distrust`` and runs against them, so a host that links to blocked ones is distrusted.
    What reaches a host without an edge onwards ends there. A host's rank is summed before the shuffle, and a hub's
    edges are split by skew handling. No edges: the seeds alone.
    """
    ways = edges.select(F.lit(0).alias("kind"), F.col("src").alias("at"), F.col("dst").alias("host"), "w").union(
        edges.select(F.lit(1).alias("kind"), F.col("dst").alias("at"), F.col("src").alias("host"), "w"))
    total = ways.groupBy("kind", "at").agg(F.sum("w").alias("total"))
    flows = saved(ways.join(total, ["kind", "at"]).select(
        "kind", "at", "host", (F.col("w") / F.col("total") * damping).alias("share")), "flows")
    start = seeds.select(F.lit(0).alias("kind"), "host", F.col("trust").alias("rank")).union(
        seeds.select(F.lit(1).alias("kind"), "host", F.col("distrust").alias("rank"))).where("rank > 0")
    start = saved(start.withColumn("rank", F.col("rank") * (1 - damping)), "rank-seeds")
    ranks = start
    if flows.limit(1).count():
        for step in range(1, rounds + 1):
            moved = flows.join(ranks.withColumnRenamed("host", "at"), ["kind", "at"]).select(
                "kind", "host", (F.col("rank") * F.col("share")).alias("rank"))
            ranks = start.union(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
            if step % ROUNDS_A_WRITE == 0 or step == rounds:
                ranks = saved(ranks, "ranks")
    return ranks.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("rank"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("rank"))), F.lit(0.0)).alias("distrust"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id",
               url_col: str = "url", html_col: str = "html", ratio: float = 1.0) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict`` of every row, and ``decided``: by ``rule``, ``graph`` or ``default``.

    A rule (verdict, ``host/path``) fits its host and all subdomains if the path starts with the rule's; the longest
    wins. Rows without a rule get their host's verdict: a host starts with the share of its rows that rules allow as
    trust, and that they block as distrust; both spread over the links between hosts (:func:`spread`). It is blocked if
    its distrust is above ``ratio`` times its trust (both to nine places) and else allowed. Hosts that neither reaches
    are allowed by default.

    NULL url, or one without ``://``: empty host and path, no links, allowed by default. NULL html: no links. NULL and
    repeated ids: one result a row. Empty table: no rows. Other columns are not looked at. Very long html is searched
    whole. A host with a third of all rows is counted before the shuffle, and meets the short list of blocked hosts by
    broadcast or, if that is long, under salted keys.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    ruled = with_rules(urls, rules)
    hosts = ruled.where("host <> ''").groupBy("host").agg(
        F.avg((F.coalesce("ruled", F.lit("")) == "allow").cast("double")).alias("trust"),
        F.avg((F.coalesce("ruled", F.lit("")) == "block").cast("double")).alias("distrust"))
    hosts = saved(hosts, "hosts")
    edges = host_edges(pages.select(host.alias("host"), F.col(html_col).alias("html")), hosts)
    ranks = saved(spread(edges, hosts), "host-ranks")
    judged = ranks.where("trust > 0 OR distrust > 0").select(
        "host", (F.round("distrust", 9) > F.round(F.col("trust") * ratio, 9)).alias("bad"))
    judged = saved(judged, "judged-hosts")
    if judged.count() <= BROADCAST_HOSTS:
        out = ruled.join(F.broadcast(judged), "host", "left")
    else:
        salted = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int")
        out = ruled.withColumn("salt", salt).join(salted, ["host", "salt"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")))
    decided = F.when(F.col("ruled").isNotNull(), F.lit("rule")).when(F.col("bad").isNotNull(), F.lit("graph"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"),
                      F.coalesce(decided, F.lit("default")).alias("decided"))


def _sql() -> str:
    def case(value):
        arms = []
        for verdict, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
            host, path = _split_rule(rule)
            arms.append(f"WHEN (host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{path}') THEN '{value(verdict, rule)}'")
        return f"CASE {' '.join(arms)} END"

    link = LINK.replace("'", "''")
    rounds = "".join(f""",
r{i} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (
  SELECT * FROM start UNION ALL SELECT f.kind, f.host, r.rank * f.share FROM flows f JOIN r{i - 1} r ON r.kind = f.kind AND r.host = f.src)
  GROUP BY kind, host)""" for i in range(1, ROUNDS + 1))
    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS MATERIALIZED (SELECT *, {case(lambda v, r: r)} AS rule, {case(lambda v, r: v)} AS ruled FROM s),
hosts AS MATERIALIZED (SELECT host, avg((coalesce(ruled, '') = 'allow')::INT) AS trust, avg((coalesce(ruled, '') = 'block')::INT) AS distrust
  FROM j WHERE host <> '' GROUP BY host),
l AS (SELECT host, unnest(list_distinct(list_transform(regexp_extract_all(
  regexp_replace(regexp_replace(html, '{COMMENT}', ' ', 'g'), '{SCRIPT}', ' ', 'g'), '{link}', 1),
  lambda x: translate(x, '{UPPER}', '{LOWER}')))) AS dst FROM j WHERE host <> ''),
links AS (SELECT host AS src, dst, count(*) AS w FROM l WHERE host <> dst GROUP BY ALL),
named AS (SELECT host FROM hosts UNION SELECT dst FROM links),
above AS (SELECT host AS below, unnest(list_transform(range(2, len(string_split(host, '.'))),
  lambda i: array_to_string(list_slice(string_split(host, '.'), i, 1000), '.'))) AS host FROM named WHERE length(host) <= {MAX_NAME}),
kin AS (SELECT below, arg_max(a.host, length(a.host)) AS host FROM above a JOIN named USING (host) GROUP BY below),
edges AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM links UNION ALL SELECT below, host, 1 FROM kin
  UNION ALL SELECT host, below, 1 FROM kin) GROUP BY src, dst),
ways AS (SELECT 0 AS kind, src, dst AS host, w FROM edges UNION ALL SELECT 1, dst, src, w FROM edges),
flows AS MATERIALIZED (SELECT kind, src, host, w / sum(w) OVER (PARTITION BY kind, src) * {DAMPING} AS share FROM ways),
start AS MATERIALIZED (SELECT 0 AS kind, host, trust * {1 - DAMPING} AS rank FROM hosts WHERE trust > 0
  UNION ALL SELECT 1, host, distrust * {1 - DAMPING} FROM hosts WHERE distrust > 0),
r0 AS (SELECT * FROM start){rounds},
judged AS (SELECT host, coalesce(sum(rank) FILTER (kind = 0), 0) AS trust, coalesce(sum(rank) FILTER (kind = 1), 0) AS distrust
  FROM r{ROUNDS} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN round(distrust, 9) > round(trust, 9) THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN ruled IS NOT NULL THEN 'rule' WHEN trust > 0 OR distrust > 0 THEN 'graph' ELSE 'default' END AS decided
FROM j LEFT JOIN judged ON j.host = judged.host
"""


@query("op12_url_filter", _sql())
def op12_url_filter(spark, sf_dir):
    return judge_urls(given(spark, sf_dir, "pages"))
