"""URL filters: host and path rules, and trust that spreads over the graph of hosts.

Everything is a DataFrame expression. Where no rule fits a page, its host's standing decides: personalised PageRank from
the hosts that allow rules name along links, against distrust from blocked hosts along reversed links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm.common import column_or_null, durable

# The rules of the contract, as (host, path, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
DAMPING = 0.85
#: Rounds go on until what is still to be spread is at most this share of all.
TOLERANCE = 1e-4
#: Rounds whose results are summed together.
GATHERED = 8
#: A host is blocked where its share of distrust is above this.
THRESHOLD = 0.5
#: Hosts below this number are broadcast to the pages (under 32 MB); above it the join is shuffled and salted.
BROADCAST_HOSTS = 200_000
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lower-cased; else empty."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; else empty."""
    cut = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    return F.when(F.instr(cut, "/") > 0, F.substr(cut, F.instr(cut, "/"))).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    """The url after its first ``://``; empty where it has none."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))


def _fitting(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as (rule, verdict), or null. The rules are a short literal list, longest first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between hosts, with the number of links: (src, dst, n).

    Absolute and protocol-relative ``href`` values name the host they link to; relative ones stay on the page's own
    host and are no edge. Links are counted within each task before the shuffle, so a hot host costs one row a task.
    """
    link = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]+)"""), F.lit(1)))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    found = pages.where("html is not null").select("host", link.alias("link")).select(F.col("host").alias("src"), host_of(full).alias("dst"))
    return found.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Trust and distrust of each host that any reaches: (host, trust, distrust).

    ``seeds`` has (host, trusted, blocked) weights. Trust is personalised PageRank from the trusted weights along links,
    distrust the same from the blocked ones along reversed links (a host that links to a blocked one is suspect). Each
    sums to its seeds' weights. What reaches a host without further links goes back to the seeds in proportion; the result
    is then the series of what the links pass on, scaled to the seeds' sum, so a round only has to pass on the last
    round's. Both kinds are propagated in the same jobs; each round is written out, which bounds the lineage.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("out_n"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("in_n"))
    forward = edges.join(out, "src").select(F.lit("trust").alias("link_kind"), F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("out_n")).alias("w"))
    back = edges.join(into, "dst").select(F.lit("distrust").alias("link_kind"), F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("n") / F.col("in_n")).alias("w"))
    links = durable(forward.unionByName(back))
    at_seed = seeds.select(
        "host", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(name).cast("double").alias("score")) for kind, name in (("trust", "trusted"), ("distrust", "blocked"))])).alias("s"),
    ).select("host", "s.kind", "s.score").where("score > 0")
    state = total = at_seed = durable(at_seed)
    mass = {r["kind"]: r["m"] for r in at_seed.groupBy("kind").agg(F.sum("score").alias("m")).collect()}  # two rows
    to_spread, gathered = (dict(mass), 0) if mass and not links.isEmpty() else ({}, 0)
    while any(m > tolerance * (1 - damping) * mass[k] for k, m in to_spread.items()):
        sent = state.join(links, (F.col("host") == F.col("a")) & (F.col("kind") == F.col("link_kind")))
        sent = sent.select(F.col("b").alias("host"), "kind", (F.col("w") * F.col("score") * damping).alias("score"))
        state = durable(sent.groupBy("host", "kind").agg(F.sum("score").alias("score")))
        to_spread = {r["kind"]: r["m"] for r in state.groupBy("kind").agg(F.sum("score").alias("m")).collect()}
        total, gathered = total.unionByName(state), gathered + 1
        if gathered % GATHERED == 0:
            total = durable(total.groupBy("host", "kind").agg(F.sum("score").alias("score")))
    reached = total.groupBy("kind").agg(F.sum("score").alias("all"))
    given = at_seed.groupBy("kind").agg(F.sum("score").alias("given"))
    scaled = total.join(F.broadcast(reached), "kind").join(F.broadcast(given), "kind").withColumn("score", F.col("score") * F.col("given") / F.col("all"))
    return scaled.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"),
    )


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD,
    damping: float = DAMPING, tolerance: float = TOLERANCE, broadcast_hosts: int = BROADCAST_HOSTS,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``distrust`` of every page.

    The longest rule that fits decides. Else the host's share of distrust does. A host is a trusted seed by the share of
    its pages that an allow rule names, and a blocked one by the share that a block rule names, so that large hosts weigh
    no more than small ones; other hosts start with neither. Both are spread over the links of ``html``, and a page is
    blocked where distrust / (distrust + trust + share of the host's pages without a rule) is above ``threshold``: without
    links that is the share of its blocked pages, and a host without a rule has to receive as much distrust as one wholly
    blocked host holds, over and above its trust. A null url, or one without ``://``, has an empty host and path, fits no
    rule and is allowed. Repeated rows stay; other columns are left behind; a table without ``html`` has no links.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), column_or_null(pages, "html", "string"))
    rows = rows.withColumns({"host": F.coalesce(host_of(F.col("url")), F.lit("")), "path": F.coalesce(path_of(F.col("url")), F.lit(""))})
    rows = rows.withColumn("fit", _fitting(F.col("host"), F.col("path"), rules))
    given = lambda verdict: F.count_if(F.col("fit.verdict") == verdict) / F.count("*")
    seeds = durable(rows.where("host <> ''").groupBy("host").agg(given("allow").alias("trusted"), given("block").alias("blocked")))
    scores = spread(host_edges(rows), seeds, damping, tolerance)
    share = seeds.join(scores, "host").select("host", F.try_divide("distrust", F.col("distrust") + F.col("trust") + 1 - F.col("trusted") - F.col("blocked")).alias("distrust"))
    share = durable(share)
    judged = rows.select("page_id", "host", "path", "fit")
    if share.count() <= broadcast_hosts:
        joined = judged.join(F.broadcast(share), "host", "left")
    else:
        salted = share.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = judged.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    verdict = F.coalesce("fit.verdict", F.when(F.col("distrust") > threshold, F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "distrust")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every page's url judged."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
