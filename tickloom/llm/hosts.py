"""URL filtering by rules and by propagation over the links between hosts, in DataFrame functions alone.

Rules name a host and a path. What they say of pages makes seeds: a host's trust is the number of its pages that
rules allow, its distrust the number they block. Trust flows along links (personalised PageRank from the trusted
hosts), distrust against them (to hosts that link to blocked ones). A page that no rule fits is judged by its host:
blocked if distrust has more than a set share of both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?is)<a\s[^>]*?\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]*)"""
DAMPING, CLOSE, SHARE = 0.85, 1e-9, 0.5
BLOCK = 8              # rounds in one job
DIGITS = 6             # of the share that decides


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rule_table(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a table: domain, rule_path, said, rule."""
    return pages.sparkSession.createDataFrame(
        [(h, p, v, h + p) for h, p, v in rules], "domain string, rule_path string, said string, rule string")


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """`pages` (host, path, others) with rule and said, of the longest rule that fits the host, or one above it, and
    the path's beginning; null where none does. Of equally long rules the smaller text counts, of repeated ones `block`.

    Rules meet each distinct host once; the pages get the few that fit their host.
    """
    hosts = pages.select("host").distinct().withColumn("domain", F.explode(suffixes(F.col("host"))))
    offers = (hosts.join(rules, "domain").groupBy("host")
              .agg(F.collect_set(F.struct((-F.length("rule")).alias("short"), "rule", (F.col("said") != "block").alias("mild"),
                                          "rule_path", "said")).alias("offers")))
    fits = F.array_min(F.filter("offers", lambda o: F.startswith(F.col("path"), o["rule_path"])))
    return (pages.join(offers, "host", "left").withColumn("best", fits)
            .withColumn("rule", F.col("best.rule")).withColumn("said", F.col("best.said")).drop("best", "offers"))


def host_links(pages: DataFrame) -> DataFrame:
    """(host, to, n): the number of links from pages of a host to another host."""
    to = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))
    links = pages.where("host <> ''").select("host", to.alias("to")).withColumn("to", F.translate("to", UPPER, LOWER))
    return links.where("`to` <> '' and `to` <> host").groupBy("host", "to").agg(F.count("*").alias("n"))


def arcs_between(links: DataFrame) -> DataFrame:
    """(host, to, ahead, back, keep) from links (host, to, n): what part of a host's trust and distrust goes where in a
    round. Trust follows links, distrust goes back. A row from each host to itself keeps what the host has gathered."""
    out = links.groupBy("host").agg(F.sum("n").alias("all"))
    into = links.groupBy("to").agg(F.sum("n").alias("all"))
    none = F.lit(0.0)
    ahead = links.join(out, "host").select("host", "to", (F.col("n") / F.col("all")).alias("ahead"), none.alias("back"), none.alias("keep"))
    back = links.join(into, "to").select(F.col("to").alias("host"), F.col("host").alias("to"), none.alias("ahead"),
                                         (F.col("n") / F.col("all")).alias("back"), none.alias("keep"))
    return ahead.union(back)


def ends_of(kind: str, rates: dict) -> tuple[Column, Column]:
    """The least and the greatest that a host's score can come to, from how the last two blocks of rounds compare.

    Rounds are linear and add nothing negative: where each host gained at most r and at least s times in the last block
    what it gained in the one before, it will in all later ones, and r / (1 - r) and s / (1 - s) of it are still to come.
    """
    most, least = rates[f"{kind}_most"] or 0.0, rates[f"{kind}_least"] or 0.0
    left = lambda rate: F.col(f"{kind}_score") + F.col(f"{kind}_gained") * F.lit(rate / (1 - rate))          # noqa: E731
    return left(min(least, most)), left(most)


def blocked_share(trust: Column, distrust: Column) -> Column:
    """In relation, since scores shrink as tables grow; null where there is neither."""
    both = trust + distrust
    return F.when(both > 0, F.round(distrust / both, DIGITS))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, close: float = CLOSE, share: float = SHARE) -> DataFrame:
    """(host, trust, distrust) from seeds (host, allowed, blocked: page counts) and links (host, to, n).

    Every judged page weighs the same, whatever the verdict. A round passes on only what the round before brought, by one
    join with the arcs and one sum per host, with partial sums before the shuffle. `BLOCK` rounds make one job: its arcs
    are shuffled once, its scores, a row per host, written to the shared folder. Blocks end when no host's verdict for
    `share` can change any more (`ends_of`), or when no score moves by more than `close` of itself. Scores are then the
    least that they can come to.
    """
    links = saved(links)
    total = float(seeds.agg(F.sum(F.col("allowed") + F.col("blocked"))).first()[0] or 1) or 1.0
    columns = {"trust": ("allowed", "ahead"), "distrust": ("blocked", "back")}
    everyone = seeds.select("host", "allowed", "blocked")
    for end in ("host", "to"):
        everyone = everyone.unionByName(links.select(F.col(end).alias("host"), F.lit(0).alias("allowed"), F.lit(0).alias("blocked")))
    start = everyone.groupBy("host").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    for kind, (count, _) in columns.items():
        first = (1 - damping) * F.col(count) / total
        start = start.withColumns({f"{kind}_step": first, f"{kind}_score": first, f"{kind}_gained": F.lit(0.0)})
    now = saved(start.drop("allowed", "blocked"))
    if links.isEmpty():                                                          # nothing flows
        return now.select("host", *[F.col(f"{kind}_score").alias(kind) for kind in columns])
    alone = now.select("host", F.col("host").alias("to"), F.lit(0.0).alias("ahead"), F.lit(0.0).alias("back"), F.lit(1.0).alias("keep"))
    arcs = saved(arcs_between(links).union(alone))
    while True:
        now = now.select("host", *[f"{kind}_{x}" for kind in columns for x in ("step", "score")],
                         *[F.col(f"{kind}_gained").alias(f"{kind}_was") for kind in columns],
                         *[F.lit(0.0).alias(f"{kind}_gained") for kind in columns])
        for _ in range(BLOCK):
            sums = []
            for kind, (_, flow) in columns.items():
                sums.append((damping * F.sum(F.col(f"{kind}_step") * F.col(flow))).alias(f"{kind}_step"))
                sums += [F.sum(F.col(f"{kind}_{x}") * F.col("keep")).alias(f"{kind}_{x}") for x in ("score", "was", "gained")]
            now = now.join(arcs, "host").groupBy(F.col("to").alias("host")).agg(*sums)
            for kind in columns:
                now = now.withColumns({f"{kind}_{x}": F.col(f"{kind}_{x}") + F.col(f"{kind}_step") for x in ("score", "gained")})
        now = saved(now)
        asked = []
        for kind in columns:
            gained, was = F.col(f"{kind}_gained"), F.col(f"{kind}_was")
            asked += [F.max(F.when(gained > 0, F.when(was > 0, gained / was).otherwise(float("inf")))).alias(f"{kind}_most"),
                      F.min(F.when(was > 0, gained / was)).alias(f"{kind}_least"),
                      F.max(gained > close * F.col(f"{kind}_score")).alias(f"{kind}_moves")]
        rates = now.agg(*asked).first().asDict()
        if not any(rates[f"{kind}_moves"] for kind in columns):
            return now.select("host", *[F.col(f"{kind}_score").alias(kind) for kind in columns])
        if all((rates[f"{kind}_most"] or 0.0) < 1 for kind in columns):
            (trust, more_trust), (distrust, more_distrust) = (ends_of(kind, rates) for kind in columns)
            mild, hard = blocked_share(more_trust, distrust) > share, blocked_share(trust, more_distrust) > share
            if now.where(~mild.eqNullSafe(hard)).isEmpty():
                return now.select("host", trust.alias("trust"), distrust.alias("distrust"))


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id: str = "page_id", share: float = SHARE) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) per page: a rule's verdict, else the host's.

    A host is blocked if distrust is more than `share` of its trust and distrust; hosts that neither reaches, and
    pages without a host (null url, or one without `://`), are allowed. Null html has no links. Repeated rows each
    get their row. Other columns are not used.
    """
    parsed = pages.select(F.col(id).alias("id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "html")
    ruled = saved(with_rules(parsed.drop("html"), rule_table(pages, rules)))
    count = lambda verdict: F.sum(F.when(F.col("said") == verdict, 1).otherwise(0))                     # noqa: E731
    seeds = ruled.where("host <> ''").groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked"))
    scores = propagate(saved(seeds), host_links(parsed), share=share)
    own = F.when(blocked_share(F.col("trust"), F.col("distrust")) > share, "block").otherwise("allow")
    return ruled.join(scores, "host", "left").select(
        F.col("id").alias(id), "host", "path", "rule", F.coalesce("said", own).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
