"""Search queries over documents, parts and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subtide.operators import search as S
from subtide.plans.registry import query
from subtide.session import table

TERMS = ("thing", "estion", "und", "de")
_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_BM25 = f"""
t AS (SELECT doc_id, lang, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, lang, len(w)::DOUBLE AS dl, term, len(list_filter(w, lambda x: x = term))::DOUBLE AS tf
      FROM t, (SELECT unnest({list(TERMS)}) AS term)),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM t),
df AS (SELECT term, count(*) FILTER (tf > 0)::DOUBLE AS df FROM p GROUP BY term),
sc AS (SELECT doc_id, lang, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM p JOIN df USING (term), s GROUP BY doc_id, lang HAVING max(tf) > 0)
"""


@query("j01_search_bm25_topk", f"WITH {_BM25} SELECT doc_id, lang, round(score, 4) AS score FROM sc WHERE lang IN ('en', 'de') ORDER BY round(score, 4) DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = S.bm25(docs.select("doc_id", "lang", "text"), "doc_id", F.col("text"), TERMS).where(F.col("lang").isin("en", "de"))
    return S.top_k(scored.select("doc_id", "lang", F.round("score", 4).alias("score")), 20, tie="doc_id")


@query("b01_bm25_inverted_index_bulk", f"WITH {_BM25} SELECT 'q1' AS query_id, doc_id, round(score, 3) AS score FROM sc")
def bm25_bulk(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    wanted = spark.createDataFrame([("q1", t) for t in TERMS], "query_id string, term string")
    scored = S.bm25_bulk(S.postings(docs, "doc_id", F.col("text"), wanted), docs, "doc_id", F.col("text"), wanted)
    return scored.select("query_id", "doc_id", F.round("score", 3).alias("score"))


@query(
    "b01_postings",
    f"SELECT w AS term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) GROUP BY ALL) GROUP BY w",
)
def postings(spark: SparkSession, sf: str) -> DataFrame:
    index = S.postings(table(spark, sf, "documents"), "doc_id", F.col("text"))
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


_NEEDLE = "rdwdgt"
_FUZZY = f"""
WITH h AS (SELECT p_partkey, p_name, string_split(lower(p_name || ' ' || p_brand), '') AS c, lower(p_name || ' ' || p_brand) AS hay FROM part),
f AS (SELECT *, list_reduce(list_prepend({{m: 0, k: 0, s: 0, c: ''}}, list_transform(c, lambda x: {{m: 0, k: 0, s: 0, c: x}})),
  lambda a, x: CASE WHEN a.m >= {len(_NEEDLE)} THEN a
       WHEN x.c = substr('{_NEEDLE}', a.m + 1, 1) THEN {{m: a.m + 1, k: a.k + 1, s: a.s + 11 + a.k, c: x.c}}
       WHEN regexp_matches(x.c, '[\\s._\\-/\\[\\]()]') THEN {{m: a.m, k: 0, s: a.s, c: x.c}}
       ELSE {{m: a.m, k: greatest(0, a.k - 1), s: a.s, c: x.c}} END) AS e FROM h)
SELECT p_partkey, p_name, (CASE WHEN e.m < {len(_NEEDLE)} THEN -10000 + e.m
  ELSE e.s + CASE WHEN contains(hay, '{_NEEDLE}') THEN 100 ELSE 0 END - greatest(0, length(hay) - {len(_NEEDLE)}) // 20 END)::BIGINT AS score FROM f
"""


@query("j02_fuzzy_score", _FUZZY)
def fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    hay = S.haystack(F.col("p_name"), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", "p_name", S.fuzzy_score(hay, _NEEDLE).alias("score"))


@query("h05_fuzzy_rank_limit", f"SELECT p_partkey, p_name, score, row_number() OVER (ORDER BY score DESC, p_name, p_partkey) AS rank FROM ({_FUZZY}) QUALIFY rank <= 25")
def fuzzy_rank(spark: SparkSession, sf: str) -> DataFrame:
    top = fuzzy(spark, sf).orderBy(F.desc("score"), "p_name", "p_partkey").limit(25)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "p_name", "p_partkey")).cast("long"))


@query(
    "c02_weighted_text",
    "SELECT p_partkey, concat_ws(' ', p_name, p_name, p_name, p_brand, p_brand, p_type) AS search_text FROM part",
)
def weighted_text(spark: SparkSession, sf: str) -> DataFrame:
    text = S.weighted_text([(F.col("p_name"), 3), (F.col("p_brand"), 2), (F.col("p_type"), 1)])
    return table(spark, sf, "part").select("p_partkey", text.alias("search_text"))


@query(
    "f05_json_elements_text",
    """SELECT o_orderkey, o_orderstatus || ' ' || o_orderpriority AS synonyms FROM orders""",
)
def synonyms(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.to_json(F.array("o_orderstatus", "o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", S.synonyms_text(listed).alias("synonyms"))


@query("j03_haystack", "SELECT c_custkey, lower(concat_ws(' ', c_name, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END)) AS haystack FROM customer")
def haystack(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", S.haystack(F.col("c_name"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment"))).alias("haystack"))


@query("d01_format_set_filter", "SELECT p_type, count(*) AS n FROM part WHERE p_type IN ('STANDARD', 'SMALL', 'PROMO', 'ECONOMY') GROUP BY p_type")
def format_filter(spark: SparkSession, sf: str) -> DataFrame:
    from subtide.operators.crosswalk import in_list

    kept = table(spark, sf, "part").where(in_list(F.col("p_type"), ["STANDARD", "SMALL", "PROMO", "ECONOMY"]))
    return kept.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c15_reciprocal_rank",
    "SELECT o_orderkey, rank, round(1.0 / rank, 4) AS score FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5",
)
def reciprocal_rank(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    ranked = table(spark, sf, "orders").select("o_orderkey", rank.alias("rank")).where("rank <= 5")
    return ranked.withColumn("score", F.round(1 / F.col("rank"), 4))


@query("d10_membership_early_stop", "SELECT p_partkey, p_type FROM part WHERE p_type IN ('PROMO', 'SMALL') ORDER BY p_partkey LIMIT 15")
def early_stop(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.col("p_type").isin("PROMO", "SMALL")).orderBy("p_partkey").limit(15).select("p_partkey", "p_type")
