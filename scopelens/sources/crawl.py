"""Crawl operators over stored pages: links, breadth-first frontiers, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def harvest_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, href) of every link, fragments cut off, empty ones left out."""
    links = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.withColumn("href", F.split_part("href", F.lit("#"), F.lit(1))).where("href <> ''")


def absolute(href: str, base: str):
    """An href against the URL of its page."""
    h, b = F.col(href), F.col(base)
    root = F.regexp_extract(b, "^([a-z]+://[^/]+)", 1)
    folder = F.regexp_replace(b, "[^/]*$", "")
    return F.when(h.rlike("^[a-z]+://"), h).when(h.startswith("/"), F.concat(root, h)).otherwise(F.concat(folder, h))


def host_of(url: str) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/]+)", 1)


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, allow, pattern, weight): the rules of robots files (host, body) for an agent.

    User-agent lines that follow each other open a group; the agent obeys all groups that name a part of its name,
    or else those for ``*``. A path may hold ``*`` and end in ``$``; an empty one rules nothing. Comments, unknown
    fields and lines before the first group don't count.
    """
    line = F.trim(F.split_part(F.col("line"), F.lit("#"), F.lit(1)))
    lines = robots.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "line"))
    lines = lines.select("host", "pos", F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1)))).alias("field"), F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).alias("value"))
    lines = lines.where(F.col("field").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("host").orderBy("pos")
    named = F.col("field") == "user-agent"
    opens = named & ~F.coalesce(F.lag(named).over(w), F.lit(False))
    grouped = lines.withColumn("opens", opens).withColumn("group", F.sum(F.col("opens").cast("int")).over(w)).where("group > 0")
    mine = F.lower(F.lit(agent)).contains(F.lower("value")) & (F.col("value") != "") & (F.col("value") != "*")
    agents = grouped.where(named).select("host", "group", mine.alias("mine"), (F.col("value") == "*").alias("any")).where(F.col("mine") | F.col("any"))
    best = agents.withColumn("named", F.max("mine").over(Window.partitionBy("host"))).where(F.col("mine") == F.col("named")).select("host", "group").distinct()
    rules = grouped.where(~named & (F.col("value") != "")).join(best, ["host", "group"])
    literal = F.regexp_replace("value", r"([\\.+?^()\[\]{}|])", r"\\$1")
    return rules.select("host", (F.col("field") == "allow").alias("allow"), F.concat(F.lit("^"), F.replace(literal, F.lit("*"), F.lit(".*"))).alias("pattern"), F.length("value").alias("weight")).distinct()


def permitted(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``urls`` (url) that the rules allow: of those that match a path the longest counts, of equal ones the one that allows."""
    path = F.regexp_replace("url", "^[a-z]+://[^/?]*", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    asked = urls.select("url").distinct().select("url", host_of("url").alias("host"), path.alias("path"))
    met = asked.join(rules, "host").where(F.regexp_like("path", F.col("pattern")))
    barred = met.groupBy("url").agg(F.max(F.struct("weight", "allow"))["allow"].alias("allow")).where(~F.col("allow"))
    return urls.join(barred.select("url"), "url", "left_anti")


def crawl(pages: DataFrame, seeds: DataFrame, depth: int, rules: DataFrame | None = None) -> DataFrame:
    """(url, depth): pages that same-host links reach from the seeds (url), each at its least depth, where ``rules`` permit.

    Every level joins the frontier with all links and drops what was seen; levels are few and given.
    """
    links = harvest_links(pages).select(F.col("url").alias("src"), absolute("href", "url").alias("url")).where(host_of("src") == host_of("url")).distinct()
    links = links if rules is None else permitted(links, rules)
    seen = seeds.select("url", F.lit(0).alias("depth"))
    front = seen
    for level in range(1, depth + 1):
        found = front.select(F.col("url").alias("src")).join(links, "src").select("url").distinct()
        front = found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(level))
        seen = seen.unionByName(front)
    return seen


def by_priority(urls: DataFrame, skip: str, first: str, most: int) -> DataFrame:
    """The ``most`` URLs to fetch next (url, arrival): preferred, then others, then those to skip."""
    u = F.lower("url")
    return urls.withColumn("priority", F.when(u.rlike(skip), 2).when(u.rlike(first), 0).otherwise(1)).orderBy("priority", "arrival", "url").limit(most)
