"""Queries on sources and sinks, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import doubles
from ..sources import crawl, files
from .registry import Tables, query


@query("SELECT vec_id, i - 1 AS term, embedding[i]::DOUBLE AS w FROM embeddings, generate_series(1, 64) AS g(i) WHERE embedding[i] <> 0")
def sparse_rows(t: Tables) -> DataFrame:
    s = files.to_sparse(t.embeddings.withColumn("v", doubles("embedding")), "vec_id", "v")
    return files.sparse_long(s, "vec_id").select("vec_id", F.col("term").cast("bigint").alias("term"), "w")


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id, 9 FROM labels WHERE toxic = 1")
def upsert_rows(t: Tables) -> DataFrame:
    new = t.labels.where("toxic = 1").select("doc_id", F.lit(9).alias("quality"))
    return files.upsert(t.labels.select("doc_id", "quality"), new, ["doc_id"])


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id FROM (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT (SELECT 500 - count(*) FROM labels))")
def judged_corpus_cap(t: Tables) -> DataFrame:
    """All judged documents, filled up to 500."""
    return files.cap_corpus(t.documents.select("doc_id"), t.labels, "doc_id", 500)


@query("SELECT page_id, url, CASE WHEN regexp_matches(lower(url), 'login|cart') THEN 2 WHEN regexp_matches(lower(url), 'index|[02468]$') THEN 0 ELSE 1 END AS priority FROM pages ORDER BY priority, page_id, url LIMIT 100")
def crawl_frontier(t: Tables) -> DataFrame:
    """The next 100 pages to fetch, by priority and arrival."""
    u = t.pages.select("page_id", "url", F.col("page_id").alias("arrival"))
    return crawl.by_priority(u, "login|cart", "index|[02468]$", 100).select("page_id", "url", "priority")


_HOST = "regexp_extract({}, '^[a-z]+://([^/]+)', 1)"
_PATH = "regexp_replace(url, '^[a-z]+://[^/?]*', '')"


@query(
    f"""WITH RECURSIVE p AS (SELECT url, split_part(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)), '#', 1) AS href FROM pages),
a AS (SELECT DISTINCT url AS src, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) || href ELSE regexp_replace(url, '[^/]*$', '') || href END AS url FROM p WHERE href <> ''),
l AS (SELECT src, url, CASE WHEN length({_HOST.format('url')}) % 2 = 0 THEN starts_with({_PATH}, '/th') AND NOT starts_with({_PATH}, '/the') AND NOT (ends_with({_PATH}, 'n') AND length({_PATH}) > 4) OR ({_PATH} LIKE '/i%t' AND NOT starts_with({_PATH}, '/the'))
  ELSE starts_with({_PATH}, '/d') AND NOT starts_with({_PATH}, '/de') END AS barred FROM a WHERE {_HOST.format('src')} = {_HOST.format('url')}),
c AS (SELECT DISTINCT url, 0 AS depth FROM pages UNION SELECT l.url, depth + 1 FROM c JOIN l ON l.src = c.url WHERE depth < 2 AND NOT barred)
SELECT url, min(depth)::INT AS depth FROM c GROUP BY url"""
)
def crawl_bfs(t: Tables) -> DataFrame:
    """Pages that same-host links reach within two steps of the stored ones, where their hosts' robots files let the crawler.

    The files are stand-ins: hosts with names of even length have a group for this crawler.
    """
    general = "# all others\nUser-agent: *\nDisallow: /d\nAllow: /de\n"
    own = "User-Agent: other\nUser-agent: Scope # this one\nDisallow: /th\nallow: /the\nAllow: /th*n$\nDisallow: /i*t$\nCrawl-delay: 3\n\n"
    hosts = t.pages.select(crawl.host_of("url").alias("host")).distinct()
    robots = hosts.select("host", F.when(F.length("host") % 2 == 0, own + general).otherwise(general).alias("body"))
    return crawl.crawl(t.pages, t.pages.select("url").distinct(), 2, crawl.robots_rules(robots, "ScopeLens/1.0"))


@query("SELECT doc_id AS id, md5(text) AS text_md5 FROM documents")
def chunk_text_export(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), F.md5("text").alias("text_md5"))
