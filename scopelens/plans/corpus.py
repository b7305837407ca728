"""Queries on documents, pages and conversations: segmentation, ids, scopes, filters, crawling, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, tables
from ..functions import text as tx
from ..functions.rules import TOPICS
from ..operators import chunking
from ..operators.sampling import by_hash, capped_by_hash, draw_key
from ..operators.scopes import disjunctive, in_scope
from ..sources.crawl import harvest_links
from .registry import Tables, query

L = lambda c: F.col(c).cast("bigint")


@query(
    r"""WITH p AS (SELECT doc_id, string_split(text, '. ') AS s FROM documents), g AS (SELECT doc_id, i AS part, array_to_string(s[i * 3 + 1 : i * 3 + 3], '. ') AS chunk FROM p, LATERAL (SELECT unnest(generate_series(0, (len(s) - 1) // 3)) AS i))
SELECT doc_id, part, md5(chunk) AS chunk_md5, length(chunk) AS chars FROM g WHERE length(trim(chunk)) >= 50"""
)
def three_sentence_chunks(t: Tables) -> DataFrame:
    return chunking.sentence_groups(t.documents, "doc_id", "text").select("doc_id", L("part").alias("part"), F.md5("chunk").alias("chunk_md5"), F.length("chunk").cast("bigint").alias("chars"))


@query(
    r"""WITH p AS (SELECT doc_id, string_split(text, '. ') AS s FROM documents), g AS (SELECT doc_id, i AS part, array_to_string(s[i * 3 + 1 : i * 3 + 3], '. ') AS chunk FROM p, LATERAL (SELECT unnest(generate_series(0, (len(s) - 1) // 3)) AS i))
SELECT doc_id, part, md5(chunk) AS chunk_md5, length(chunk) AS chars FROM g WHERE length(trim(chunk)) >= 50"""
)
def chunks_by_table_function(t: Tables) -> DataFrame:
    """The same groups from a table function that SQL calls for each document."""
    tables.register(t.spark)
    t.spread("documents").select("doc_id", "text").createOrReplaceTempView("chunked_documents")
    got = t.spark.sql("SELECT d.doc_id, c.part, c.chunk FROM chunked_documents d, LATERAL sentence_groups(d.text, 3, 50) c")
    return got.select("doc_id", "part", F.md5("chunk").alias("chunk_md5"), F.length("chunk").cast("bigint").alias("chars"))


@query(
    r"""WITH s AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
f AS (SELECT doc_id, text, list_reduce(list_transform(s, lambda x: {'chunks': []::VARCHAR[], 'cur': x}), lambda a, x: CASE WHEN length(a.cur) + length(x.cur) > 800 AND a.cur <> '' THEN {'chunks': list_append(a.chunks, a.cur), 'cur': x.cur} ELSE {'chunks': a.chunks, 'cur': CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || ' ' || x.cur END} END, {'chunks': []::VARCHAR[], 'cur': ''}) AS r FROM s),
c AS (SELECT doc_id, CASE WHEN length(text) <= 800 THEN [text] WHEN r.cur <> '' THEN list_append(r.chunks, r.cur) ELSE r.chunks END AS cs FROM f), x AS (SELECT doc_id, unnest(cs) AS chunk, generate_subscripts(cs, 1) - 1 AS part FROM c)
SELECT doc_id, part, md5(chunk) AS chunk_md5 FROM x"""
)
def sentence_pack_chunks(t: Tables) -> DataFrame:
    chunks = t.documents.select("doc_id", F.posexplode(tx.pack_sentences(F.col("text"))).alias("part", "chunk"))
    return chunks.select("doc_id", L("part").alias("part"), F.md5("chunk").alias("chunk_md5"))


@query()
def recursive_chunks(t: Tables) -> DataFrame:
    return chunking.recursive_chunks(t.documents, "doc_id", "text").select("doc_id", "part", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5"))


@query(
    r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ci FROM documents), k AS (SELECT *, nullif(regexp_extract(line, '^(Th[a-z]*) ', 1), '') AS h FROM p WHERE length(trim(line)) >= 40)
SELECT doc_id, ci, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ci ROWS UNBOUNDED PRECEDING), 'General') AS section FROM k"""
)
def section_carry_forward(t: Tables) -> DataFrame:
    """Lines of at least 40 characters; a line that opens with a word in Th- stands for a heading."""
    p = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ci", "line")).where(F.length(F.trim("line")) >= 40)
    h = F.nullif(F.regexp_extract("line", "^(Th[a-z]*) ", 1), F.lit(""))
    return p.select("doc_id", L("ci").alias("ci"), chunking.carry_forward(p, "doc_id", "ci", h).alias("section"))


@query(
    """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), o AS (SELECT doc_id, i AS page, list_sum(list_transform(ls[1:i], lambda x: length(x) + 1)) - 1 AS stop, coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0) AS start FROM s, LATERAL (SELECT unnest(generate_series(1, len(ls))) AS i)),
q AS (SELECT doc_id, off FROM s, (VALUES (0), (150), (1000), (1000000)) AS v(off)) SELECT q.doc_id, CAST(q.off AS BIGINT) AS char_offset, coalesce(min(o.page) FILTER (o.start <= q.off AND q.off <= o.stop), max(o.page)) AS page FROM q JOIN o USING (doc_id) GROUP BY q.doc_id, q.off"""
)
def page_lookup(t: Tables) -> DataFrame:
    """Lines stand for pages; offsets past the end fall on the last one."""
    lines = F.split("text", "\n")
    empty = F.expr("cast(array() as array<struct<start:int,end:int,page:int>>)")

    def add(s: Column, line: Column) -> Column:
        end = s["at"] + F.length(line)
        span = F.struct(s["at"].alias("start"), end.alias("end"), (F.size(s["spans"]) + 1).alias("page"))
        return F.struct((end + 1).alias("at"), F.concat(s["spans"], F.array(span)).alias("spans"))

    spans = t.documents.select("doc_id", F.aggregate(lines, F.struct(F.lit(0).alias("at"), empty.alias("spans")), add)["spans"].alias("spans"))
    asked = spans.withColumn("char_offset", F.explode(F.array(*[F.lit(x) for x in (0, 150, 1000, 1_000_000)])))
    return asked.select("doc_id", L("char_offset").alias("char_offset"), chunking.page_of(F.col("char_offset"), F.col("spans")).cast("bigint").alias("page"))


@query(
    """WITH m AS (SELECT conv_id, role, left(text, 400) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS j, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, md5(string_agg('U' || j || ' (' || role || '): ' || t, chr(10) ORDER BY j)) AS thread_md5, count(*) AS messages FROM m WHERE n >= 2 AND j <= 10 GROUP BY conv_id"""
)
def thread_assembly(t: Tables) -> DataFrame:
    """Threads of two or more messages, their first ten, each cut to 400 characters."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    first = t.conversations.withColumn("j", F.row_number().over(w)).where("j <= 10")
    msg = F.struct("j", F.substring("text", 1, 400).alias("t"), "role")
    g = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(msg)).alias("m")).where(F.size("m") >= 2)
    body = F.array_join(F.transform("m", lambda x: F.concat(F.lit("U"), x["j"].cast("string"), F.lit(" ("), x["role"], F.lit("): "), x["t"])), "\n")
    return g.select("conv_id", F.md5(body).alias("thread_md5"), F.size("m").cast("bigint").alias("messages"))


@query(
    """WITH o AS (SELECT item_id, string_split(text, ' ')[1:4] AS opts FROM benchmark) SELECT item_id, 'Subject: bench' || chr(10) || 'Question: ' || item_id || chr(10) || array_to_string(list_transform(opts, lambda x, i: '(' || chr(64 + i::INT) || ') ' || x), chr(10)) AS chunk, chr(65 + (item_id % 4)::INT) AS gold FROM o"""
)
def mcq_self_chunk(t: Tables) -> DataFrame:
    opts = F.slice(F.split("text", " "), 1, 4)
    lettered = F.transform(opts, lambda x, i: F.concat(F.lit("("), F.chr(65 + i), F.lit(") "), x))
    body = F.concat_ws("\n", F.lit("Subject: bench"), F.concat(F.lit("Question: "), F.col("item_id").cast("string")), F.array_join(lettered, "\n"))
    return t.benchmark.select("item_id", body.alias("chunk"), F.chr(65 + F.col("item_id") % 4).alias("gold"))


TITLE = "regexp_replace(split_part(text, '.', 1), '\\s+', ' ', 'g')"


def titled(t: Tables) -> DataFrame:
    """A document's text up to the first full stop stands for its title."""
    return t.documents.select("doc_id", "source", "lang", F.regexp_replace(F.split_part("text", F.lit("."), F.lit(1)), r"\s+", " ").alias("title"))


@query(f"SELECT doc_id, CASE WHEN i BETWEEN 'A' AND 'G' THEN 'A-G' WHEN i BETWEEN 'H' AND 'M' THEN 'H-M' WHEN i BETWEEN 'N' AND 'S' THEN 'N-S' WHEN i BETWEEN 'T' AND 'Z' THEN 'T-Z' ELSE 'other' END AS bucket FROM (SELECT doc_id, upper(left(trim({TITLE}), 1)) AS i FROM documents)")
def title_initial_bucket(t: Tables) -> DataFrame:
    return titled(t).select("doc_id", tx.title_bucket(F.col("title")).alias("bucket"))


@query(f"SELECT doc_id, array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower({TITLE}), '\\b(19|20)\\d{{2}}\\b|\\bfy\\s*\\d+\\b|\\brev(ision)?\\b|\\bupdated\\b|\\(.*?\\)|effective.*|[^a-z ]', ' ', 'g')), ' +'), lambda w: w NOT IN ('the', 'for', 'and', 'of')), ' ') AS stem FROM documents")
def title_stem(t: Tables) -> DataFrame:
    return titled(t).select("doc_id", tx.title_stem(F.col("title")).alias("stem"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(lower(trim({TITLE})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM documents")
def slugify(t: Tables) -> DataFrame:
    return titled(t).select("doc_id", tx.slug(F.col("title")).alias("slug"))


@query("SELECT doc_id, left(md5(text), 12) AS content_id, left(md5(source || text), 16) AS article_id, source || '::' || doc_id || '::' || lpad((doc_id % 7)::VARCHAR, 3, '0') AS chunk_id FROM documents")
def md5_ids(t: Tables) -> DataFrame:
    d = t.documents
    return d.select("doc_id", F.substring(F.md5("text"), 1, 12).alias("content_id"), F.substring(F.md5(F.concat("source", "text")), 1, 16).alias("article_id"), tx.composite_id(F.col("source"), F.col("doc_id").cast("string"), index=F.col("doc_id") % 7).alias("chunk_id"))


NAME = "regexp_replace(regexp_extract(url, '([^/?#]*)([?#].*)?$', 1), '[^A-Za-z0-9._-]+', '_', 'g')"


@query(f"WITH n AS (SELECT page_id, url, coalesce(nullif({NAME}, ''), 'file') AS name FROM pages), c AS (SELECT *, count(*) OVER (PARTITION BY name) AS k, row_number() OVER (PARTITION BY name ORDER BY page_id) AS r FROM n) SELECT page_id, CASE WHEN k > 1 AND r > 1 THEN name || '_' || left(md5(url), 8) ELSE name END AS filename FROM c")
def safe_filename(t: Tables) -> DataFrame:
    """The URL's last part in safe letters; later pages of the same name get a hash of their URL."""
    name = F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract("url", r"([^/?#]*)([?#].*)?$", 1), "[^A-Za-z0-9._-]+", "_"), F.lit("")), F.lit("file"))
    n = t.pages.select("page_id", "url", name.alias("name"))
    first = n.groupBy("name").agg(F.min("page_id").alias("first"))
    return n.join(first, "name").select("page_id", F.when(F.col("page_id") == F.col("first"), F.col("name")).otherwise(F.concat("name", F.lit("_"), F.substring(F.md5("url"), 1, 8))).alias("filename"))


@query("SELECT doc_id, upper(trim(regexp_replace(source, '\\s+', ' ', 'g'))) || '::' || upper(trim(regexp_replace(lang, '\\s+', ' ', 'g'))) AS label FROM documents")
def composite_label(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.compose_label(F.col("source"), F.col("lang")).alias("label"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/]+)', 1), ''), nullif(split_part(url, '/', 1), ''), 'unknown') AS domain FROM pages")
def coalesce_ladder(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.coalesce(F.nullif(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.lit("")), F.nullif(F.split_part("url", F.lit("/"), F.lit(1)), F.lit("")), F.lit("unknown")).alias("domain"))


@query("SELECT doc_id AS id, source AS collection, 'unknown' AS publisher, 0 AS page, n_chars FROM documents")
def default_fill_rename(t: Tables) -> DataFrame:
    d = t.documents.withColumnsRenamed({"doc_id": "id", "source": "collection"})
    return d.withColumns({"publisher": F.lit("unknown"), "page": F.lit(0)}).select("id", "collection", "publisher", "page", "n_chars")


def _topic_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '(?i){p}') THEN '{v}'" for p, v in TOPICS) + " ELSE 'general' END"


@query(f"SELECT doc_id, {_topic_sql('text')} AS topic FROM documents")
def keyword_taxonomy(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.first_match(F.col("text"), TOPICS, "general").alias("topic"))


@query(f"SELECT item_id, {_topic_sql('text')} AS route FROM benchmark")
def regex_route_first_match(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", tx.first_match(F.col("text"), TOPICS, "general").alias("route"))


@query(f"SELECT lang, count(*) AS n, round(avg((topic <> 'general')::INT), 6) AS hit_rate FROM (SELECT lang, {_topic_sql('text')} AS topic FROM documents) GROUP BY lang")
def regex_hit_rate(t: Tables) -> DataFrame:
    d = t.documents.select("lang", tx.first_match(F.col("text"), TOPICS, "general").alias("topic"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("topic") != "general").cast("int")), 6).alias("hit_rate"))


_PATH = "regexp_replace(regexp_replace({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*', '')"


def _contents_sql(hay: str, table: list) -> str:
    one = lambda keys: " OR ".join("contains({}, '{}')".format(hay, k.replace("'", "''")) for k in keys)
    return "CASE " + " ".join(f"WHEN {one(keys)} THEN '{label}'" for label, keys in table) + " END"


_PLAIN = "replace(replace(replace(lower({}), '_', ' '), '%20', ' '), '-', ' ')"
_CATS = [(label, [k.replace("-", " ") for k in keys]) for label, keys in rules.URL_CATEGORIES]


@query(f"SELECT page_id, coalesce({_contents_sql(_PLAIN.format(_PATH.format('url')), _CATS)}, {_contents_sql(_PLAIN.format('html'), _CATS)}, 'General') AS category FROM pages")
def url_taxonomy(t: Tables) -> DataFrame:
    """By the URL; failing that by the page, which stands for the page that linked it."""
    return t.pages.select("page_id", rules.url_category(F.col("url"), F.lit(""), F.concat(F.lit("x://h"), F.regexp_replace("html", "[?#]", ""))).alias("category"))


@query(f"SELECT doc_id, coalesce({_contents_sql('lower(source || chr(32) || chr(32) || text)', rules.SERIES)}, 'General') AS series FROM documents")
def series_normalised(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", rules.series(F.col("source"), F.col("text")).alias("series"))


@query("SELECT item_id, CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{v}'" for p, v in rules.ROUTES) + " ELSE 'global' END AS agent FROM benchmark")
def question_route(t: Tables) -> DataFrame:
    """Questions that no rule matches go to the whole corpus."""
    return t.benchmark.select("item_id", rules.by_pattern(F.col("text"), default="global").alias("agent"))


_ANY = lambda hay, keys: " OR ".join(f"contains({hay}, '{k}')" for k in keys)


@query(f"SELECT page_id, CASE WHEN {_ANY('lower(' + _PATH.format('url') + ')', rules.CRAWL_LAST)} THEN 2 WHEN {_ANY('lower(' + _PATH.format('url') + ')', rules.CRAWL_FIRST)} THEN 0 ELSE 1 END AS priority FROM pages")
def url_priority(t: Tables) -> DataFrame:
    return t.pages.select("page_id", rules.page_priority(F.col("url")).alias("priority"))


HREF = "hr AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)"


@query(f"WITH {HREF}, n AS (SELECT page_id, split_part(href, '#', 1) AS href FROM hr) SELECT page_id, href, count(*) AS n FROM n WHERE href <> '' GROUP BY page_id, href")
def link_harvest(t: Tables) -> DataFrame:
    return harvest_links(t.pages).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(f"WITH {HREF} SELECT page_id, count(*) FILTER (lower(split_part(href, '#', 1)) LIKE '%.pdf' OR contains(lower(split_part(href, '#', 1)), '.pdf?')) AS pdf_links, count(*) AS links FROM hr WHERE split_part(href, '#', 1) <> '' GROUP BY page_id")
def pdf_links(t: Tables) -> DataFrame:
    h = harvest_links(t.pages)
    return h.groupBy("page_id").agg(F.sum(rules.is_pdf(F.col("href")).cast("bigint")).alias("pdf_links"), F.count("*").alias("links"))


@query(f"WITH {HREF}, e AS (SELECT url AS src, split_part(href, '#', 1) AS dst FROM hr), x AS (SELECT count(*) AS links, count(DISTINCT dst) AS targets, count(*) FILTER (regexp_extract(dst, '^[a-z]+://([^/]+)', 1) IN ('', regexp_extract(src, '^[a-z]+://([^/]+)', 1))) AS same_host FROM e WHERE dst <> '') SELECT * FROM x")
def same_host_links(t: Tables) -> DataFrame:
    h = harvest_links(t.pages)
    host = lambda c: F.regexp_extract(c, "^[a-z]+://([^/]+)", 1)
    same = (host("href") == "") | (host("href") == host("url"))
    return h.agg(F.count("*").alias("links"), F.countDistinct("href").alias("targets"), F.sum(same.cast("bigint")).alias("same_host"))


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2', 'src3')")
def scope_mask(t: Tables) -> DataFrame:
    return t.documents.where(in_scope("source", ["src1", "src2", "src3"])).select("doc_id", "source")


@query("SELECT count(*) AS n FROM documents")
def scope_mask_unknown_agent(t: Tables) -> DataFrame:
    """An unknown scope admits every row."""
    return t.documents.where(in_scope("source", [])).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE (contains(text, 'License') OR contains(text, 'www') OR source = 'src4') AND lang = 'en' AND contains(source, 'src')")
def disjunctive_scope(t: Tables) -> DataFrame:
    """Alternatives ORed, then the optional conjuncts."""
    d = t.documents.where(disjunctive([("text", "contains", "License"), ("text", "contains", "www"), ("source", "=", "src4")]))
    return d.where((F.col("lang") == "en") & F.col("source").contains("src")).select("doc_id")


@query("SELECT lang, count(*) AS n FROM documents WHERE length(trim(text)) >= 200 AND source <> 'src0' AND lang NOT IN ('es') AND text IS NOT NULL GROUP BY lang")
def length_and_label_filters(t: Tables) -> DataFrame:
    """Minimum length, a catch-all source left out, labels excluded, nulls dropped."""
    d = t.documents.where((F.length(F.trim("text")) >= 200) & (F.col("source") != "src0") & ~F.col("lang").isin("es") & F.col("text").isNotNull())
    return d.groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE regexp_matches(event_type, '(?i)click|purchase') OR regexp_matches(props, '(?i)\"[a-z]+\": *1[0,}]')")
def regex_filter_fields(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type").rlike("(?i)click|purchase") | F.col("props").rlike('(?i)"[a-z]+": *1[0,}]')).select("event_id")


@query("SELECT shard, count(*) AS n, min(item_id) AS lowest FROM (SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) % 4 AS shard FROM benchmark) GROUP BY shard")
def modulo_shards(t: Tables) -> DataFrame:
    """Queries dealt to four shards by position: sorted ranges number their rows, offsets come from range counts."""
    from ..operators.aggregates import with_position

    s = with_position(t.benchmark.select("item_id"), "item_id").withColumn("shard", F.col("position") % 4)
    return s.groupBy("shard").agg(F.count("*").alias("n"), F.min("item_id").alias("lowest"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'english_agent' WHEN 'fr' THEN 'french_agent' ELSE 'general' END AS agent FROM documents")
def label_agent_map(t: Tables) -> DataFrame:
    agents = F.create_map(F.lit("en"), F.lit("english_agent"), F.lit("fr"), F.lit("french_agent"))
    return t.documents.select("doc_id", F.coalesce(F.try_element_at(agents, F.col("lang")), F.lit("general")).alias("agent"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_dedupe_first_wins(t: Tables) -> DataFrame:
    """One aggregate by fingerprint; copies meet as (fingerprint, smallest id), pre-aggregated by each task."""
    return t.documents.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1")
def exact_dedupe_last_wins(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5("text").alias("h")).agg(F.max("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('3:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 5")
def capped_per_group(t: Tables) -> DataFrame:
    return capped_by_hash(t.documents.select("source", "doc_id"), 5, "source", "doc_id", "3")


@query("WITH g AS (SELECT doc_id, abs(quality - toxic) AS gap FROM labels), a AS (SELECT doc_id FROM g ORDER BY gap DESC, doc_id LIMIT 20), b AS (SELECT doc_id FROM g WHERE doc_id NOT IN (SELECT doc_id FROM a) ORDER BY md5('9:' || doc_id), doc_id LIMIT 20) SELECT doc_id, 'gap' AS part FROM a UNION ALL SELECT doc_id, 'random' FROM b")
def half_targeted_sample(t: Tables) -> DataFrame:
    """The 20 largest gaps between two judges, and 20 others by hash."""
    g = t.labels.select("doc_id", F.abs(F.col("quality") - F.col("toxic")).alias("gap"))
    a = g.orderBy(F.desc("gap"), "doc_id").limit(20).select("doc_id")
    b = by_hash(g.select("doc_id").join(a, "doc_id", "left_anti"), 20, "doc_id", "9")
    return a.withColumn("part", F.lit("gap")).union(b.withColumn("part", F.lit("random")))


@query("WITH s AS (SELECT source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('5:' || doc_id), doc_id) AS n, lang FROM documents), c AS (SELECT lang, doc_id FROM s WHERE n <= 10 ORDER BY md5('6:' || doc_id), doc_id LIMIT 30) SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('alias:' || doc_id), doc_id) AS alias FROM c")
def stratified_cap_alias(t: Tables) -> DataFrame:
    """Ten rows per stratum, 30 in all, under aliases that a hash deals within each stratum."""
    c = by_hash(capped_by_hash(t.documents.select("lang", "doc_id"), 10, "lang", "doc_id", "5"), 30, "doc_id", "6")
    w = Window.partitionBy("lang").orderBy(draw_key("doc_id", "alias"), "doc_id")
    return c.withColumn("alias", F.row_number().over(w).cast("bigint"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def pivot_counts(t: Tables) -> DataFrame:
    p = t.documents.groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).count().fillna(0)
    return p.select("source", "en", "fr", "de", "es")


@query("SELECT source, count(*) AS docs, count(DISTINCT lang) AS langs, count(DISTINCT md5(text)) AS texts, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def source_summary(t: Tables) -> DataFrame:
    d = t.documents.select("source", "lang", "n_chars", F.md5("text").alias("h"))
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.countDistinct("lang").alias("langs"), F.countDistinct("h").alias("texts"), F.sum("n_chars").alias("chars"))


@query("SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS place FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def frequency_sorted_sources(t: Tables) -> DataFrame:
    n = t.documents.groupBy("source").agg(F.count("*").alias("n"))  # one row per source
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "source")).cast("bigint"))


@query("SELECT source, round(log10(count(*)), 6) AS log_n FROM documents GROUP BY source")
def log_category_sizes(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.round(F.log10(F.count("*")), 6).alias("log_n"))


CONTEXT = """SELECT lang, string_agg('[SOURCE ' || i || ': ' || source || ', ' || lang || ', ' || coalesce(n_chars::VARCHAR, 'n/a') || ']' || chr(10) || left(text, 60), chr(10) || '---' || chr(10) ORDER BY i) AS context FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents) WHERE i <= 5 GROUP BY lang"""


@query(CONTEXT)
def context_format(t: Tables) -> DataFrame:
    """A prompt's context: the first five documents of each language, numbered."""
    w = Window.partitionBy("lang").orderBy("doc_id")
    d = t.documents.withColumn("i", F.row_number().over(w)).where("i <= 5")
    head = F.concat(F.lit("[SOURCE "), F.col("i").cast("string"), F.lit(": "), "source", F.lit(", "), "lang", F.lit(", "), F.coalesce(F.col("n_chars").cast("string"), F.lit("n/a")), F.lit("]\n"), F.substring("text", 1, 60))
    g = d.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", head.alias("s")))).alias("x"))
    return g.select("lang", F.array_join(F.col("x.s"), "\n---\n").alias("context"))


@query("WITH d AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), n AS (SELECT source, count(*) AS n FROM d WHERE i <= 8 GROUP BY source) SELECT source, n, least(1200, greatest(300, 6000 // n)) AS per, count(*) FILTER (length(text) > least(1200, greatest(300, 6000 // n))) AS truncated, sum(length(left(text, least(1200, greatest(300, 6000 // n))::BIGINT)))::BIGINT AS chars FROM d JOIN n USING (source) WHERE i <= 8 GROUP BY source, n")
def source_budget(t: Tables) -> DataFrame:
    """At most eight texts of a source share a budget of 6000 characters, between 300 and 1200 each."""
    w = Window.partitionBy("source").orderBy("doc_id")
    d = t.documents.withColumn("i", F.row_number().over(w)).where("i <= 8")
    g = d.groupBy("source").agg(F.collect_list("text").alias("ts"), F.count("*").alias("n"))
    per = F.least(F.lit(1200), F.greatest(F.lit(300), F.floor(6000 / F.col("n")))).cast("bigint")
    g = g.withColumn("per", per)
    long = F.size(F.filter("ts", lambda x: F.length(x) > F.col("per"))).cast("bigint")
    chars = F.aggregate(F.transform("ts", lambda x: F.length(F.substring(x, F.lit(1), F.col("per").cast("int")))), F.lit(0), lambda s, x: s + x).cast("bigint")
    return g.select("source", "n", "per", long.alias("truncated"), chars.alias("chars"))


@query("SELECT doc_id, concat_ws(' ', nullif(trim(source), ''), nullif(trim(lang), ''), nullif(trim(left(text, 120)), '')) AS line, length(left(text, 2000)) AS kept FROM documents")
def safe_join_truncate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.safe_join(F.col("source"), F.col("lang"), F.substring("text", 1, 120)).alias("line"), F.length(F.substring("text", 1, 2000)).cast("bigint").alias("kept"))


@query("SELECT 'documents' AS kind, source AS name FROM documents WHERE source IN ('src1', 'src2') UNION ALL SELECT 'pages', left(url, 12) FROM pages")
def union_all_corpora(t: Tables) -> DataFrame:
    a = t.documents.where(F.col("source").isin("src1", "src2")).select(F.lit("documents").alias("kind"), F.col("source").alias("name"))
    return reduce(DataFrame.unionByName, [a, t.pages.select(F.lit("pages").alias("kind"), F.substring("url", 1, 12).alias("name"))])


@query("SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels WHERE toxic = 1")
def union_distinct(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'en'").select("doc_id").union(t.labels.where("toxic = 1").select("doc_id")).distinct()


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def difference_docs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("SELECT doc_id FROM documents WHERE lang = 'fr' INTERSECT SELECT doc_id FROM labels")
def intersection_docs(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'fr'").select("doc_id").intersect(t.labels.select("doc_id"))


@query("WITH w AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)), f AS (SELECT doc_id, x, min(i) AS i FROM w GROUP BY doc_id, x) SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS words FROM f GROUP BY doc_id")
def ordered_distinct(t: Tables) -> DataFrame:
    """Each text's words once, in the order of their first places."""
    return t.documents.select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@query("SELECT lang AS scope, 'search_' || lang AS tool, count(*) AS docs FROM documents GROUP BY lang")
def scope_catalog(t: Tables) -> DataFrame:
    """One tool per distinct scope."""
    return t.documents.groupBy(F.col("lang").alias("scope")).agg(F.count("*").alias("docs")).select("scope", F.concat(F.lit("search_"), tx.slug(F.col("scope"))).alias("tool"), "docs")


@query("SELECT doc_id, sha256(text) AS sha FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents WHERE octet_length(encode(text)) <= 20000) WHERE r = 1")
def download_sha_dedupe(t: Tables) -> DataFrame:
    """Payloads up to a size cap, one per sha-256."""
    d = t.documents.where(F.octet_length("text") <= 20000)
    return d.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "sha")


@query("SELECT d.doc_id, r.r_name AS region FROM documents d JOIN nation n ON n.n_nationkey = d.doc_id % 25 JOIN region r ON r.r_regionkey = n.n_regionkey")
def two_hop_path(t: Tables) -> DataFrame:
    """Document to nation to region, as two equi-joins; both dimension tables are of fixed size, which the planner sees."""
    d = t.documents.select("doc_id", (F.col("doc_id") % 25).alias("n_nationkey"))
    n = t.nation.select(F.col("n_nationkey").cast("bigint"), "n_regionkey")
    r = t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    return d.join(n, "n_nationkey").join(r, "n_regionkey").select("doc_id", "region")


@query("SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def keyset_page(t: Tables) -> DataFrame:
    """One page of a keyset scan; the filter reaches the Parquet reader."""
    return t.documents.where("doc_id > 100").orderBy("doc_id").limit(50).select("doc_id", "source")
