"""Queries on inference: signed-rank p-values, the trend test in full, and power."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inference
from ..operators import statistics as st
from .registry import Tables, query
from .runlogs import PAIRED, RHO, paired

#: The two-sided p of a smaller rank sum w: exact counts of rank sets by a recursive product, else the normal tail.
_X = "least(6.0, abs(w - (n * (n + 1) / 4.0 - z * (z + 1) / 4.0)) / sqrt(2 * greatest(n * (n + 1) * (2 * n + 1) / 24.0 - z * (z + 1) * (2 * z + 1) / 24.0 - ties / 48.0, 1e-300)))"
_ERFC = f"greatest(0.0, 1 - 2 / sqrt(pi()) * exp(-x * x) * (x + list_sum(list_transform(generate_series(1, {inference.TERMS}), lambda k: CASE WHEN x > 0 THEN exp((2 * k + 1) * ln(x) + 2 * k * ln(2.0) + lgamma(k + 1) - lgamma(2 * k + 2)) ELSE 0 END))))"


def _p_sql(source: str, by: str, pratt: bool = False) -> str:
    """CTEs up to sp (by, n, w_plus, w_minus, p, exact) of the differences ``d`` of ``source``."""
    keys, real = f"{by}, " if by else "", "m > 0"
    part = f"PARTITION BY {by} " if by else ""
    return f"""sc AS (SELECT {keys}abs(d) AS m, count(*) AS k, count(*) FILTER (d > 0) AS plus FROM {source} {"" if pratt else "WHERE d <> 0"} GROUP BY {keys}abs(d)),
sr AS (SELECT *, coalesce(sum(k) OVER ({part}ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2.0 AS rk FROM sc),
sa AS (SELECT {keys}sum(k)::BIGINT AS n, coalesce(sum(plus * rk) FILTER ({real}), 0)::DOUBLE AS w_plus, coalesce(sum((k - plus) * rk) FILTER ({real}), 0)::DOUBLE AS w_minus, coalesce(sum(k) FILTER (m = 0), 0)::BIGINT AS z, coalesce(sum(k * k * k - k) FILTER ({real}), 0)::DOUBLE AS ties FROM sr {f"GROUP BY {by}" if by else ""}),
sw AS (SELECT *, least(w_plus, w_minus) AS w, n <= {inference.EXACT} AND ties = 0 AND z = 0 AS exact FROM sa),
gen(n, ways) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT n + 1, list_transform(generate_series(0, (n + 1) * (n + 2) // 2), lambda i: coalesce(ways[i + 1], 0) + CASE WHEN i > n THEN coalesce(ways[i - n], 0) ELSE 0 END) FROM gen WHERE n < {inference.EXACT}),
sx AS (SELECT *, {_X} AS x FROM sw),
sp AS (SELECT sx.*, CASE WHEN sx.n - z = 0 THEN 1.0 WHEN exact THEN least(1.0, 2 * list_sum(ways[1:w::INT + 1]) / pow(2.0, sx.n)) ELSE {_ERFC} END AS p FROM sx LEFT JOIN gen ON gen.n = sx.n)"""


@query(f"WITH RECURSIVE {PAIRED}, df AS (SELECT a, b, round(d, 9) AS d FROM pd), {_p_sql('df', 'a, b')} SELECT a, b, n, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, round(p, 6) AS p, exact FROM sp")
def wilcoxon_p(t: Tables) -> DataFrame:
    """Signed-rank tests of all system pairs, zeros dropped."""
    d = paired(t).select("a", "b", F.round("d", 9).alias("d"))
    s = inference.signed_rank(d, ["a", "b"], "d")
    return s.select("a", "b", "n", *[F.round(c, 6).alias(c) for c in ("w_plus", "w_minus", "p")], "exact")


SMALL = f"{PAIRED}, df AS (SELECT a, b, query % 7 AS g, round(d, 0) AS d FROM pd)"


@query(f"WITH RECURSIVE {SMALL}, {_p_sql('df', 'a, b, g', pratt=True)} SELECT a, b, g, n, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, round(p, 6) AS p, exact FROM sp")
def wilcoxon_p_pratt(t: Tables) -> DataFrame:
    """Tests within groups of queries, of rounded differences, so with ties and with zeros that are ranked first."""
    d = paired(t).select("a", "b", (F.col("query") % 7).alias("g"), F.round("d", 0).alias("d"))
    s = inference.signed_rank(d, ["a", "b", "g"], "d", zeros="pratt")
    return s.select("a", "b", "g", "n", *[F.round(c, 6).alias(c) for c in ("w_plus", "w_minus", "p")], "exact")


BOOTSTRAPS = 200
_COUNT = " + ".join(f"(u >= {p!r})::INT" for p in inference.POISSON)
_LOG = "ln(1 + date_diff('day', TIMESTAMP '2000-01-01', x))"


@query(
    f"""WITH RECURSIVE {RHO}, df AS (SELECT rho AS d FROM rho), {_p_sql('df', '')},
cs AS (SELECT query, count(*) AS n, sum(lx) AS sx, sum(y) AS sy, sum(lx * lx) AS sxx, sum(lx * y) AS sxy FROM (SELECT query, y, {_LOG} AS lx FROM b) GROUP BY query),
cw AS (SELECT cs.*, round, CASE WHEN round = 0 THEN 1.0 ELSE {_COUNT} END AS w FROM (SELECT cs.query, round, ('0x' || left(md5('trend:' || cs.query || ':' || round), 8))::BIGINT / 4294967296.0 AS u FROM cs, generate_series(0, {BOOTSTRAPS}) AS g(round)) JOIN cs USING (query)),
ca AS (SELECT round, sum(w * n) AS n, sum(w * sx) AS sx, sum(w * sy) AS sy, sum(w * sxx) AS sxx, sum(w * sxy) AS sxy FROM cw GROUP BY round),
sl AS (SELECT round, CASE WHEN n * sxx - sx * sx > 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) END AS slope FROM ca)
SELECT (SELECT count(*) FROM rho) AS queries, (SELECT round(quantile_cont(rho, 0.5), 6) FROM rho) AS median_rho, (SELECT round(p, 6) FROM sp) AS p, (SELECT round(slope, 2) FROM sl WHERE round = 0) AS slope,
round(quantile_cont(slope, 0.025) FILTER (round > 0), 2) AS ci_low, round(quantile_cont(slope, 0.975) FILTER (round > 0), 2) AS ci_high FROM sl"""
)
def trend_test(t: Tables) -> DataFrame:
    """The trend test in full: the signed-rank p of the per-query rhos, and a pooled slope with an interval over queries drawn again."""
    b = t.events.groupBy(F.col("user_id").alias("query"), F.date_trunc("day", "ts").alias("x")).agg(F.round(F.avg("value"), 9).alias("y"))
    k = b.select("query", st.average_rank("x", "query").alias("rx"), st.average_rank("y", "query").alias("ry"))
    rho = k.groupBy("query").agg(F.count("*").alias("n"), F.count_distinct("ry").alias("kinds"), F.round(F.corr("rx", "ry"), 9).alias("rho")).where("n >= 3 AND kinds > 1").select("query", "rho")
    p = inference.signed_rank(rho, [], "rho").select(F.round("p", 6).alias("p"))
    s = inference.cluster_slopes(b.withColumn("lx", F.log(1 + F.datediff("x", F.lit("2000-01-01").cast("date")))), "query", "lx", "y", BOOTSTRAPS, "trend")
    drawn = F.when(F.col("round") > 0, F.col("slope"))
    ci = s.agg(F.round(F.max(F.when(F.col("round") == 0, F.col("slope"))), 2).alias("slope"), F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    one = rho.agg(F.count("*").alias("queries"), F.round(F.percentile("rho", F.lit(0.5)), 6).alias("median_rho"))
    return one.crossJoin(p).crossJoin(ci).select("queries", "median_rho", "p", "slope", F.round(F.col("q")[0], 2).alias("ci_low"), F.round(F.col("q")[1], 2).alias("ci_high"))


@query()
def mcnemar_power(t: Tables) -> DataFrame:
    """Per language: the smallest drop of the share of good documents that paired tests of that size would find."""
    j = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    g = j.groupBy("lang").agg(F.count("*").alias("n"), F.avg("quality").alias("base")).where("n >= 5 AND base > 0.02")
    return g.join(inference.detectable_drop(g, "lang", 0.62), "lang").select("lang", "n", F.round("base", 6).alias("base"), "mde")
