"""Queries on run logs and judgements: ``events`` as runs (query: user, system: event type, latency: value),
``labels`` as two judges of one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import statistics as st
from ..operators.joins import answered_by_all, average_present, system_pairs
from .registry import Tables, query


def runs(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("user_id").alias("query"), F.col("event_type").alias("system"), F.col("value").alias("latency"))


@query(
    """WITH r AS (SELECT event_type AS system, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT system, max(value) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, max(value) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95 FROM r GROUP BY system"""
)
def run_latency_summary(t: Tables) -> DataFrame:
    return ag.nearest_rank(runs(t), "system", "latency", {"p50": 0.5, "p95": 0.95})


@query("SELECT event_type AS system, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY event_type")
def latency_quartiles(t: Tables) -> DataFrame:
    q = runs(t).groupBy("system").agg(F.percentile("latency", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("system", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))])


POINTS = "pt AS (SELECT event_type || '/' || extract(hour FROM ts) AS system, avg(value) AS latency, count(*) AS gain FROM events GROUP BY ALL)"


@query(f"WITH {POINTS}, b AS (SELECT *, max(gain) OVER (ORDER BY round(latency, 9), gain DESC, system ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM pt) SELECT system, round(latency, 6) AS latency, gain FROM b WHERE best IS NULL OR gain > best")
def pareto_frontier(t: Tables) -> DataFrame:
    """Systems are event types by hour: a summary of bounded size."""
    p = t.events.groupBy(F.concat_ws("/", "event_type", F.hour("ts").cast("string")).alias("system")).agg(F.round(F.avg("value"), 9).alias("latency"), F.count("*").alias("gain"))
    return ag.pareto(p, "latency", "gain", "system").select("system", F.round("latency", 6).alias("latency"), "gain")


@query("SELECT event_type AS system, count(*) AS runs, round(avg(value), 6) AS mean_latency, round(avg(length(props)), 6) AS mean_chars, round(avg(ceil(length(props) / 4.0)), 6) AS mean_tokens FROM events GROUP BY event_type")
def efficiency_means(t: Tables) -> DataFrame:
    """Token counts by the proxy of four characters each."""
    e = t.events.groupBy(F.col("event_type").alias("system"))
    return e.agg(F.count("*").alias("runs"), F.round(F.avg("value"), 6).alias("mean_latency"), F.round(F.avg(F.length("props")), 6).alias("mean_chars"), F.round(F.avg(F.ceil(F.length("props") / 4.0)), 6).alias("mean_tokens"))


@query("SELECT source, round(avg(coalesce(toxic, 0)), 6) AS as_zero, round(avg(toxic), 6) AS skipped, round(stddev_samp(toxic), 6) AS sd FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def missing_zero_vs_skip(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", F.col("toxic").cast("double").alias("toxic")), "doc_id", "left")
    return j.groupBy("source").agg(F.round(ag.mean_missing("toxic", "zero"), 6).alias("as_zero"), F.round(ag.mean_missing("toxic", "skip"), 6).alias("skipped"), F.round(F.stddev_samp("toxic"), 6).alias("sd"))


@query("SELECT event_type AS system, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, starts_with(event_type, 'c') AS to_gold FROM events GROUP BY event_type")
def routing_distribution(t: Tables) -> DataFrame:
    n = runs(t).groupBy("system").agg(F.count("*").alias("n"))  # one row per system
    return n.select("system", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"), F.col("system").startswith("c").alias("to_gold"))


MEANS = "m AS (SELECT user_id AS query, event_type AS system, avg(value) AS v FROM events GROUP BY ALL)"
PAIRED = f"{MEANS}, pd AS (SELECT a.system AS a, b.system AS b, a.query, a.v - b.v AS d FROM m a JOIN m b ON a.query = b.query AND a.system < b.system)"


def means(t: Tables) -> DataFrame:
    return runs(t).groupBy("query", "system").agg(F.avg("latency").alias("v"))


def exact_means(t: Tables) -> DataFrame:
    """``means`` by sums that no order of rows changes, for values of up to 9 places; others, and infinite ones, are added as doubles."""
    whole = F.col("latency").try_cast("decimal(27,9)")
    fits = F.sum(F.when(F.col("latency").isNotNull() & ~F.coalesce(whole.cast("double") == F.col("latency"), F.lit(False)), 1).otherwise(0)) == 0
    mean = (F.sum(whole) / F.count("latency").cast("decimal(20,0)")).cast("decimal(38,20)").cast("double")
    return runs(t).groupBy("query", "system").agg(F.when(fits, mean).otherwise(F.avg("latency")).alias("v"))


def paired(t: Tables) -> DataFrame:
    """(a, b, query, d) for every pair of systems that answered a query."""
    return system_pairs(means(t), "query", "system", "v")


@query(f"WITH {PAIRED} SELECT a, b, count(*) AS n, round(avg(d), 6) AS delta FROM pd GROUP BY a, b HAVING count(*) >= 5")
def paired_deltas(t: Tables) -> DataFrame:
    return paired(t).groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("delta")).where("n >= 5")


@query(f"WITH {PAIRED} SELECT a, b, round(avg(d) / stddev_samp(d), 6) AS dz, count(*) FILTER (d > 0) AS better, count(*) FILTER (d < 0) AS worse, count(*) FILTER (d = 0) AS tied FROM pd GROUP BY a, b")
def effect_size_dz(t: Tables) -> DataFrame:
    """Two means are tied if they are equal as decimals: sums of doubles depend on the order of their rows."""
    n = lambda c: F.sum(c.cast("bigint"))
    d = F.col("d")
    return system_pairs(exact_means(t), "query", "system", "v").groupBy("a", "b").agg(F.round(F.avg(d) / F.stddev_samp(d), 6).alias("dz"), n(d > 0).alias("better"), n(d < 0).alias("worse"), n(d == 0).alias("tied"))


@query(f"WITH {PAIRED}, x AS (SELECT a, b, round(d, 9) AS d FROM pd WHERE round(d, 9) <> 0), r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2.0 AS rk FROM x) SELECT a, b, count(*) AS n, round(sum(rk) FILTER (d > 0), 6)::DOUBLE AS w_plus, round(sum(rk) FILTER (d < 0), 6)::DOUBLE AS w_minus FROM r GROUP BY a, b")
def wilcoxon_w(t: Tables) -> DataFrame:
    """Signed rank sums, zeros dropped. Ranks come from counts by distinct difference."""
    x = paired(t).select("a", "b", F.round("d", 9).alias("d")).where("d <> 0")
    c = x.groupBy("a", "b", F.abs("d").alias("m")).agg(F.count("*").alias("n"), F.sum((F.col("d") > 0).cast("bigint")).alias("plus"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("a", "b").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = c.withColumn("rank", before + (F.col("n") + 1) / 2.0)
    return r.groupBy("a", "b").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("plus") * F.col("rank")), 6).alias("w_plus"), F.round(F.sum((F.col("n") - F.col("plus")) * F.col("rank")), 6).alias("w_minus"))


@query("SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c FROM labels JOIN documents USING (doc_id) GROUP BY source")
def mcnemar_counts(t: Tables) -> DataFrame:
    j = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    n = lambda e: F.sum(F.expr(e).cast("bigint"))
    return j.groupBy("source").agg(n("quality = 1 AND toxic = 0").alias("b"), n("quality = 0 AND toxic = 1").alias("c"))


MCNEMAR = "SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c FROM labels JOIN documents USING (doc_id) GROUP BY source"


@query(f"WITH d AS ({MCNEMAR}) SELECT source, b, c, round(least(1.0, 2 * list_sum(list_transform(generate_series(0, least(b, c)), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))), 6) AS p FROM d")
def mcnemar_exact_p(t: Tables) -> DataFrame:
    """Exact two-sided p of each source's discordant pairs."""
    return mcnemar_counts(t).withColumn("p", F.round(st.mcnemar_p("b", "c"), 6))


P = "p AS (SELECT source, lang, round(avg(CASE WHEN contains(text, 'th') THEN 1.0 ELSE 0.0 END) * 0.05 + count(*) / 10000.0, 9)::DOUBLE AS p FROM documents GROUP BY ALL)"


@query(f"WITH {P}, w AS (SELECT *, p * (count(*) OVER (PARTITION BY lang) - row_number() OVER (PARTITION BY lang ORDER BY p, source) + 1) AS w FROM p) SELECT lang, source, p, round(least(1, max(w) OVER (PARTITION BY lang ORDER BY p, source ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM w")
def holm_adjust(t: Tables) -> DataFrame:
    p = t.documents.groupBy("source", "lang").agg(F.round(F.avg(F.contains("text", F.lit("th")).cast("double")) * 0.05 + F.count("*") / 10000.0, 9).alias("p"))
    return st.holm(p, "p", ["lang"], "source").select("lang", "source", "p", F.round("p_holm", 6).alias("p_holm"))


@query(f"WITH {PAIRED}, c AS (SELECT a, b, avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)) AS lo FROM pd GROUP BY a, b) SELECT a, b, round(lo, 6) AS ci_low, lo > -0.03 AS within_3, lo > -0.05 AS within_5 FROM c")
def noninferiority(t: Tables) -> DataFrame:
    low = F.avg("d") - 1.96 * F.stddev_samp("d") / F.sqrt(F.count("*"))
    return paired(t).groupBy("a", "b").agg(low.alias("lo")).select("a", "b", F.round("lo", 6).alias("ci_low"), (F.col("lo") > -0.03).alias("within_3"), (F.col("lo") > -0.05).alias("within_5"))


@query("SELECT l_returnflag AS flag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag")
def pearson_ols(t: Tables) -> DataFrame:
    y, x = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    return t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.round(F.corr(x, y), 6).alias("r"), F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2")
    )


TREND = "b AS (SELECT user_id AS query, date_trunc('day', ts) AS x, round(avg(value), 9) AS y FROM events GROUP BY ALL), k AS (SELECT query, rank() OVER (PARTITION BY query ORDER BY x) + (count(*) OVER (PARTITION BY query, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY query ORDER BY y) + (count(*) OVER (PARTITION BY query, y) - 1) / 2.0 AS ry FROM b)"


@query(f"WITH {TREND} SELECT query, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY query HAVING count(*) >= 3")
def spearman_trend(t: Tables) -> DataFrame:
    """Per query: Spearman's rho of its daily means against the day."""
    b = t.events.groupBy(F.col("user_id").alias("query"), F.date_trunc("day", "ts").alias("x")).agg(F.round(F.avg("value"), 9).alias("y"))
    k = b.select("query", st.average_rank("x", "query").alias("rx"), st.average_rank("y", "query").alias("ry"))
    return k.groupBy("query").agg(F.count("*").alias("n"), F.round(F.corr("rx", "ry"), 6).alias("rho")).where("n >= 3")


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS n11, count(*) FILTER (quality = 1 AND toxic = 0) AS n10, count(*) FILTER (quality = 0 AND toxic = 1) AS n01, count(*) FILTER (quality = 0 AND toxic = 0) AS n00, round(avg(quality) FILTER (toxic = 1), 6) AS given_1, round(avg(quality) FILTER (toxic = 0), 6) AS given_0 FROM labels")
def contingency_2x2(t: Tables) -> DataFrame:
    n = lambda q, x: F.count_if(F.expr(f"quality = {q} AND toxic = {x}"))  # 0 without labels
    given = lambda x: F.round(F.avg(F.when(F.col("toxic") == x, F.col("quality"))), 6)
    return t.labels.agg(n(1, 1).alias("n11"), n(1, 0).alias("n10"), n(0, 1).alias("n01"), n(0, 0).alias("n00"), given(1).alias("given_1"), given(0).alias("given_0"))


FISHER = """n AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS n11, count(*) FILTER (quality = 1 AND toxic = 0) AS n10, count(*) FILTER (quality = 0 AND toxic = 1) AS n01, count(*) FILTER (quality = 0 AND toxic = 0) AS n00 FROM labels),
x AS (SELECT *, n11 + n10 AS r1, n01 + n00 AS r2, n11 + n01 AS k FROM n), q AS (SELECT x.*, unnest(generate_series(greatest(0, k - r2), least(k, r1))) AS i FROM x),
p AS (SELECT *, exp(lgamma(r1 + 1) - lgamma(i + 1) - lgamma(r1 - i + 1) + lgamma(r2 + 1) - lgamma(k - i + 1) - lgamma(r2 - k + i + 1) - lgamma(r1 + r2 + 1) + lgamma(k + 1) + lgamma(r1 + r2 - k + 1)) AS p FROM q)"""


@query(f"WITH {FISHER} SELECT n11, n10, n01, n00, round(least(1.0, sum(p) FILTER (p <= here * (1 + 1e-7))), 6) AS p FROM (SELECT *, max(p) FILTER (i = n11) OVER () AS here FROM p) GROUP BY n11, n10, n01, n00")
def fisher_exact_p(t: Tables) -> DataFrame:
    return contingency_2x2(t).select("n11", "n10", "n01", "n00", F.round(st.fisher_p("n11", "n10", "n01", "n00"), 6).alias("p"))


RHO = f"{TREND}, rho AS (SELECT query, round(corr(rx, ry), 9) AS rho FROM k GROUP BY query HAVING count(*) >= 3 AND count(DISTINCT ry) > 1)"


@query(
    f"""WITH {RHO}, z AS (SELECT *, rank() OVER (ORDER BY abs(rho)) + (count(*) OVER (PARTITION BY abs(rho)) - 1) / 2.0 AS rk FROM rho WHERE rho <> 0),
w AS (SELECT coalesce(sum(rk) FILTER (rho > 0), 0)::DOUBLE AS w_plus, coalesce(sum(rk) FILTER (rho < 0), 0)::DOUBLE AS w_minus FROM z), s AS (SELECT regr_slope(y, ln(1 + date_diff('day', TIMESTAMP '2000-01-01', x))) AS slope FROM b)
SELECT count(*) AS queries, round(quantile_cont(rho, 0.5), 6) AS median_rho, round(avg((rho < 0)::INT), 6) AS negative, round(any_value(w_plus), 3) AS w_plus, round(any_value(w_minus), 3) AS w_minus, round(any_value(slope), 4) AS slope FROM rho, w, s"""
)
def trend_over_queries(t: Tables) -> DataFrame:
    """The trend test: per-query rhos, their median and sign, the signed rank sums, and the pooled slope on a log scale."""
    b = t.events.groupBy(F.col("user_id").alias("query"), F.date_trunc("day", "ts").alias("x")).agg(F.round(F.avg("value"), 9).alias("y"))
    k = b.select("query", st.average_rank("x", "query").alias("rx"), st.average_rank("y", "query").alias("ry"))
    rho = k.groupBy("query").agg(F.count("*").alias("n"), F.count_distinct("ry").alias("kinds"), F.round(F.corr("rx", "ry"), 9).alias("rho")).where("n >= 3 AND kinds > 1").select("query", "rho")
    c = rho.where("rho <> 0").groupBy(F.abs("rho").alias("m")).agg(F.count("*").alias("n"), F.sum((F.col("rho") > 0).cast("bigint")).alias("plus"))
    # Ranks come from counts by distinct size of rho: one row per distinct value.
    before = F.coalesce(F.sum("n").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = c.withColumn("rank", before + (F.col("n") + 1) / 2.0).agg(F.coalesce(F.sum(F.col("plus") * F.col("rank")), F.lit(0.0)).alias("p"), F.coalesce(F.sum((F.col("n") - F.col("plus")) * F.col("rank")), F.lit(0.0)).alias("m"))
    days = F.log(1 + F.datediff("x", F.lit("2000-01-01").cast("date")))
    s = b.agg(F.regr_slope(F.col("y"), days).alias("slope"))
    one = rho.agg(F.count("*").alias("queries"), F.round(F.percentile("rho", F.lit(0.5)), 6).alias("median_rho"), F.round(F.avg((F.col("rho") < 0).cast("int")), 6).alias("negative"))
    return one.crossJoin(w).crossJoin(s).select("queries", "median_rho", "negative", F.round("p", 3).alias("w_plus"), F.round("m", 3).alias("w_minus"), F.round("slope", 4).alias("slope"))


@query()
def permutation_p(t: Tables) -> DataFrame:
    """Sign-flip p-values of all system pairs over 2000 rounds: the share of rounds at least as far from 0."""
    d = paired(t)
    here = d.groupBy("a", "b").agg(F.avg("d").alias("mean"), F.count("*").alias("n"))
    j = st.resampled(d, ["a", "b"], "query", "d", 2000, "signs").join(here, ["a", "b"])
    return j.groupBy("a", "b").agg(F.max("n").alias("n"), F.avg((F.abs(F.col("s") / F.col("n")) >= F.abs("mean") - 1e-12).cast("double")).alias("p"))


@query()
def bootstrap_ci(t: Tables) -> DataFrame:
    """Percentile intervals of each pair's mean difference over 1000 Poisson bootstraps."""
    m = st.resampled(paired(t), ["a", "b"], "query", "d", 1000, "poisson").withColumn("m", F.col("s") / F.nullif("w", F.lit(0.0)))
    q = m.groupBy("a", "b").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return q.select("a", "b", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def resume_left_anti(t: Tables) -> DataFrame:
    """What is still to do: a row counts as done if it succeeded."""
    return t.documents.select("doc_id").join(t.labels.where("quality = 1"), "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def scope_semi_join(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels.where("toxic = 0"), "doc_id", "left_semi")


@query("SELECT user_id AS query, count(*) AS runs FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def all_systems_intersection(t: Tables) -> DataFrame:
    done = answered_by_all(runs(t), "query", "system")
    return runs(t).join(done, "query", "left_semi").groupBy("query").agg(F.count("*").alias("runs"))


@query("SELECT user_id AS query, event_type AS system, min_by(event_id, event_id) AS first_id, max_by(value, event_id) AS last_value FROM events GROUP BY ALL")
def first_and_last_wins(t: Tables) -> DataFrame:
    """One row per query and system: the first run's id and the last run's value."""
    return runs(t).groupBy("query", "system").agg(F.min("event_id").alias("first_id"), F.max_by("latency", "event_id").alias("last_value"))


@query("SELECT source, first(lang ORDER BY n DESC, lang) AS lang, max(n) AS n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def modal_label(t: Tables) -> DataFrame:
    return ag.modal(t.documents, "source", "lang")


@query("SELECT lang, first(source ORDER BY n DESC, source) AS source FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def plurality_map(t: Tables) -> DataFrame:
    return ag.modal(t.documents, "lang", "source").select("lang", "source")


@query("SELECT round(sum(m) / sum(s), 6)::DOUBLE AS purity FROM (SELECT source, max(n) AS m, sum(n) AS s FROM (SELECT source, lang, sum(n_chars) AS n FROM documents GROUP BY ALL) GROUP BY source)")
def cluster_purity(t: Tables) -> DataFrame:
    """Weighted by length: each cluster counts what its heaviest label weighs."""
    n = t.documents.groupBy("source", "lang").agg(F.sum("n_chars").alias("n"))
    c = n.groupBy("source").agg(F.max("n").alias("m"), F.sum("n").alias("s"))
    return c.agg(F.round(F.sum("m") / F.sum("s"), 6).alias("purity"))


@query(
    """WITH c AS (SELECT lang AS a, source AS b, count(*)::DOUBLE AS n FROM documents GROUP BY ALL), r AS (SELECT a, sum(n) AS n FROM c GROUP BY a), k AS (SELECT b, sum(n) AS n, max(n) AS most FROM c GROUP BY b), tt AS (SELECT sum(n) AS t FROM c),
h AS (SELECT (SELECT ln(t) - sum(n * ln(n)) / t FROM r, tt GROUP BY t) AS hr, (SELECT ln(t) - sum(n * ln(n)) / t FROM k, tt GROUP BY t) AS hk, (SELECT ln(t) - sum(n * ln(n)) / t FROM c, tt GROUP BY t) AS hc, (SELECT sum(n * (n - 1) / 2) FROM c) AS pc, (SELECT sum(n * (n - 1) / 2) FROM r) AS pr, (SELECT sum(n * (n - 1) / 2) FROM k) AS pk, (SELECT sum(most) FROM k) AS most, t FROM tt)
SELECT round(2 * (hr + hk - hc) / (hr + hk), 6) AS nmi, round((pc - pr * pk / (t * (t - 1) / 2)) / ((pr + pk) / 2 - pr * pk / (t * (t - 1) / 2)), 6) AS ari, round((hr + hk - hc) / hr, 6) AS homogeneity, round(most / t, 6) AS purity FROM h"""
)
def nmi_ari(t: Tables) -> DataFrame:
    c = t.documents.groupBy(F.col("lang").alias("a"), F.col("source").alias("b")).agg(F.count("*").alias("n"))
    return st.agreement(c)


@query(
    """WITH p AS (SELECT quality AS y, 1 - toxic AS z FROM labels), c AS (SELECT v.c, count(*) FILTER (y = c AND z = c) AS tp, count(*) FILTER (y <> c AND z = c) AS fp, count(*) FILTER (y = c AND z <> c) AS fn FROM p, (VALUES (0), (1)) AS v(c) GROUP BY v.c)
SELECT round(sum(tp)::DOUBLE / (SELECT count(*) FROM p), 6) AS accuracy, round(sum((tp + fn) * CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END) / sum(tp + fn), 6)::DOUBLE AS weighted_f1 FROM c"""
)
def weighted_f1(t: Tables) -> DataFrame:
    """Quality as the truth, the other judge's verdict as the prediction; from the 2 x 2 counts."""
    n = t.labels.groupBy(F.col("quality").alias("y"), (1 - F.col("toxic")).alias("z")).agg(F.count("*").alias("n"))
    per = n.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1)))).groupBy("c").agg(*[F.sum(F.when(F.expr(e), F.col("n")).otherwise(0)).alias(k) for k, e in (("tp", "y = c AND z = c"), ("fp", "y <> c AND z = c"), ("fn", "y = c AND z <> c"))])
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    support = F.col("tp") + F.col("fn")
    return per.agg(F.round(F.sum("tp") / F.sum(support), 6).alias("accuracy"), F.round(F.sum(support * f1) / F.sum(support), 6).alias("weighted_f1"))


ITER = "i AS (SELECT user_id AS query, event_id, round(value / (1 + value), 9) AS q, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events WHERE value >= 0), d AS (SELECT *, q - lag(q) OVER (PARTITION BY query ORDER BY step) AS dq FROM i)"


@query(f"WITH {ITER} SELECT query, step, round(dq, 6) AS dq, CASE WHEN q >= 0.85 THEN 'good' WHEN abs(round(dq, 9)) < 0.05 THEN 'flat' WHEN step >= 5 THEN 'steps' ELSE 'go on' END AS verdict FROM d")
def loop_termination(t: Tables) -> DataFrame:
    """A refinement loop's verdict after every step: quality reached, no more gain, or steps used up."""
    w = Window.partitionBy("query").orderBy("event_id")
    i = t.events.where("value >= 0").select(F.col("user_id").alias("query"), "event_id", F.round(F.col("value") / (1 + F.col("value")), 9).alias("q"))
    d = i.withColumn("step", F.row_number().over(w)).withColumn("dq", F.col("q") - F.lag("q").over(w))
    verdict = F.when(F.col("q") >= 0.85, "good").when(F.abs(F.round("dq", 9)) < 0.05, "flat").when(F.col("step") >= 5, "steps").otherwise("go on")
    return d.select("query", F.col("step").cast("bigint").alias("step"), F.round("dq", 6).alias("dq"), verdict.alias("verdict"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, (coalesce(a.x, b.x) + coalesce(b.x, a.x)) / 2.0 AS mean FROM (SELECT doc_id, quality::DOUBLE AS x FROM labels WHERE quality = 1) a FULL OUTER JOIN (SELECT doc_id, toxic::DOUBLE AS x FROM labels WHERE toxic = 0) b USING (doc_id)")
def full_outer_average(t: Tables) -> DataFrame:
    """Two annotators who each rated part of the rows; the mean of the ratings that exist."""
    a = t.labels.where("quality = 1").select("doc_id", F.col("quality").cast("double").alias("a"))
    b = t.labels.where("toxic = 0").select("doc_id", F.col("toxic").cast("double").alias("b"))
    return average_present(a, b, "doc_id").select("doc_id", "mean")


@query("WITH a AS (SELECT doc_id, quality AS x, 1 - toxic AS y FROM labels) SELECT count(*) AS n, round(corr(x, y), 6) AS r, round(avg((x = y)::INT), 6) AS exact FROM a")
def annotator_agreement(t: Tables) -> DataFrame:
    a = t.labels.select(F.col("quality").alias("x"), (1 - F.col("toxic")).alias("y"))
    return a.agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("r"), F.round(F.avg((F.col("x") == F.col("y")).cast("int")), 6).alias("exact"))


@query("SELECT source, round(avg(quality) FILTER (lang = 'en'), 6) AS en, round(avg(quality) FILTER (lang <> 'en'), 6) AS other, round(avg(quality) FILTER (lang = 'en') - avg(quality) FILTER (lang <> 'en'), 6) AS delta FROM labels JOIN documents USING (doc_id) GROUP BY source")
def pivot_paired(t: Tables) -> DataFrame:
    """Ratings joined with their key and pivoted by system; null where a side is missing."""
    j = t.labels.join(t.documents.select("doc_id", "source", F.when(F.col("lang") == "en", "en").otherwise("other").alias("system")), "doc_id")
    p = j.groupBy("source").pivot("system", ["en", "other"]).agg(F.avg("quality"))
    return p.select("source", F.round("en", 6).alias("en"), F.round("other", 6).alias("other"), F.round(F.col("en") - F.col("other"), 6).alias("delta"))


@query("WITH b AS (SELECT source, lang, avg(quality) AS x FROM labels JOIN documents USING (doc_id) GROUP BY ALL), r AS (SELECT source, lang, avg(1 - toxic) AS x FROM labels JOIN documents USING (doc_id) WHERE quality = 1 GROUP BY ALL) SELECT source, lang, round(b.x, 6) AS base, round(r.x, 6) AS rerank, round(r.x - b.x, 6) AS delta, coalesce(printf('%.2f', r.x), '---') AS cell FROM b LEFT JOIN r USING (source, lang)")
def left_join_deltas(t: Tables) -> DataFrame:
    j = t.labels.join(t.documents.select("doc_id", "source", "lang"), "doc_id")
    b = j.groupBy("source", "lang").agg(F.avg("quality").alias("b"))
    r = j.where("quality = 1").groupBy("source", "lang").agg(F.avg(1 - F.col("toxic")).alias("r"))
    cell = F.coalesce(F.format_string("%.2f", "r"), F.lit("---"))
    return b.join(r, ["source", "lang"], "left").select("source", "lang", F.round("b", 6).alias("base"), F.round("r", 6).alias("rerank"), F.round(F.col("r") - F.col("b"), 6).alias("delta"), F.when(F.col("r").isNull(), "---").otherwise(cell).alias("cell"))


@query("WITH a AS (SELECT user_id AS query, list(event_id ORDER BY event_id)[1:5] AS ids FROM events GROUP BY user_id), x AS (SELECT query, unnest(ids) AS doc, generate_subscripts(ids, 1) AS pos FROM a) SELECT query, string_agg(coalesce(d.text, '(missing)'), '|' ORDER BY pos) AS context FROM x LEFT JOIN documents d ON d.doc_id = x.doc * 3 GROUP BY query")
def ordered_context_join(t: Tables) -> DataFrame:
    """A run's list of ids to texts in the list's order; ids without a text read (missing)."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    x = t.events.select("user_id", "event_id").withColumn("pos", F.row_number().over(w)).where("pos <= 5")
    d = t.documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("s"))
    j = x.join(d, F.col("event_id") * 3 == F.col("_id"), "left")
    g = j.groupBy(F.col("user_id").alias("query")).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("s", F.lit("(missing)")).alias("s")))).alias("x"))
    return g.select("query", F.array_join(F.col("x.s"), "|").alias("context"))


@query("SELECT doc_id, i AS pos, coalesce(w[i], '(none)') AS word, coalesce(s[i], '(none)') AS sentence FROM (SELECT doc_id, string_split(text, ' ') AS w, string_split(text, '.') AS s FROM documents), LATERAL (SELECT unnest(generate_series(1, greatest(len(w), len(s)))) AS i)")
def ragged_zip(t: Tables) -> DataFrame:
    """Arrays of different lengths side by side, gaps filled."""
    d = t.documents.select("doc_id", F.split("text", " ").alias("w"), F.split("text", "[.]").alias("s"))
    z = d.select("doc_id", F.posexplode(F.arrays_zip("w", "s")).alias("i", "z"))
    return z.select("doc_id", (F.col("i") + 1).cast("bigint").alias("pos"), F.coalesce("z.w", F.lit("(none)")).alias("word"), F.coalesce("z.s", F.lit("(none)")).alias("sentence"))


@query("SELECT system, row_number() OVER (ORDER BY coalesce(list_position(['purchase', 'view', 'click'], system), 999), system) AS place FROM (SELECT DISTINCT event_type AS system FROM events)")
def custom_order_sort(t: Tables) -> DataFrame:
    """A given order first, unknown systems after it by name."""
    order = F.array(*[F.lit(x) for x in ("purchase", "view", "click")])
    s = runs(t).select("system").distinct()
    at = F.array_position(order, F.col("system"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.when(at == 0, 999).otherwise(at), "system")).cast("bigint"))


@query("SELECT event_type AS system, user_id AS query, rn AS place FROM (SELECT event_type, user_id, value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id DESC) AS rn FROM events) WHERE rn <= 4")
def per_key_cap_multi_sort(t: Tables) -> DataFrame:
    """Four runs per system, fastest first, later ones first among equals."""
    w = Window.partitionBy("system").orderBy("latency", F.desc("event_id"))
    return runs(t).withColumn("rn", F.row_number().over(w)).where("rn <= 4").select("system", "query", F.col("rn").cast("bigint").alias("place"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share FROM orders GROUP BY o_orderstatus, o_orderpriority")
def row_share(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("status")), 6))


@query("SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'good' END, d.lang) AS label, coalesce(l.quality = 1, false) AS moved FROM documents d LEFT JOIN labels l USING (doc_id)")
def relabel_keep_old(t: Tables) -> DataFrame:
    """A classifier's label where there is one, else the old one; which rows moved stays visible."""
    new = t.labels.select("doc_id", F.when(F.col("quality") == 1, "good").alias("new"), (F.col("quality") == 1).alias("moved"))
    return t.documents.select("doc_id", "lang").join(new, "doc_id", "left").select("doc_id", F.coalesce("new", "lang").alias("label"), F.coalesce("moved", F.lit(False)).alias("moved"))


@query("SELECT CASE WHEN source IN ('src1', 'src2') THEN 'manuals' WHEN source = 'src3' THEN 'plans' END AS category, count(*) AS n FROM documents WHERE source IN ('src1', 'src2', 'src3') GROUP BY ALL")
def category_map_drop_unmapped(t: Tables) -> DataFrame:
    s = F.col("source")
    c = F.when(s.isin("src1", "src2"), "manuals").when(s == "src3", "plans")
    return t.documents.select(c.alias("category")).dropna().groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, coalesce(l.quality + 2 * l.toxic, 0) AS grade FROM documents d LEFT JOIN labels l USING (doc_id)")
def qrels_grade_left(t: Tables) -> DataFrame:
    """Documents with their grade; unjudged ones have grade 0."""
    g = t.labels.select("doc_id", (F.col("quality") + 2 * F.col("toxic")).alias("g"))
    return t.documents.select("doc_id").join(g, "doc_id", "left").select("doc_id", F.coalesce("g", F.lit(0)).alias("grade"))


@query("WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents), b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS p FROM embeddings) SELECT doc_id, vec_id FROM a JOIN b USING (p)")
def positional_join(t: Tables) -> DataFrame:
    """Rows of two tables at the same place of their orders."""
    a = ag.with_position(t.documents.select("doc_id"), "doc_id")
    b = ag.with_position(t.embeddings.select("vec_id"), "vec_id")
    return a.join(b, "position").select("doc_id", "vec_id")


@query("SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(sqrt((1 - corr(l_quantity, l_extendedprice) ** 2) * regr_syy(l_extendedprice, l_quantity) / regr_sxx(l_extendedprice, l_quantity) / (count(*) - 2)), 4) AS se FROM lineitem")
def ols_standard_error(t: Tables) -> DataFrame:
    o = st.ols(t.lineitem, "l_quantity", "l_extendedprice")
    return o.select("n", F.round("slope", 4).alias("slope"), F.round("se", 4).alias("se"))


@query("SELECT o.o_orderkey, c.c_custkey, n.n_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_orderpriority LIKE '1%'")
def document_section_chunk_path(t: Tables) -> DataFrame:
    """A path of two equi-joins from the finest level up; the filter reaches the scan."""
    o = t.orders.where(F.col("o_orderpriority").startswith("1")).select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return o.join(c, "c_custkey").join(t.nation.select("n_nationkey", "n_name"), "n_nationkey").select("o_orderkey", "c_custkey", "n_name")
