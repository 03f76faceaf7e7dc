"""Queries of article chunks, retrieval, local sentiment and prompt texts; the documents stand in for articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import metrics, retrieval, selection
from .forecasts import ORACLE_SQL as _FORECAST_SQL
from .panels import ORACLE_SQL as _PANEL_SQL
from .panels import _rounded, weekly_benchmark, weekly_returns
from .selections import TERMS

STOP = ["the", "and", "of", "to", "in", "that"]
LEXICON = {"the": 1.5, "and": -0.5, "data": 2.0, "un": -1.0, "la": 0.5}


def articles(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    i = F.col("doc_id")
    provider = F.when(i % 7 == 0, "SEC EDGAR").when(i % 7 == 1, "TED").otherwise("NewsAPI")
    title = F.when(i % 5 != 0, F.concat("source", F.lit("  News"))).otherwise(F.when(i % 10 == 0, "").otherwise(F.lit(None).cast("string")))
    return docs.select(
        i.alias("article_id"), F.upper("lang").alias("ticker"), title.alias("title"), F.col("text").alias("description"), F.when(i % 2 == 0, F.col("source")).alias("source"),
        provider.alias("provider"), F.lit(None).cast("string").alias("url"),
    )


def _first_passage(spark: SparkSession, d: str) -> str:
    first = spark.read.parquet(f"{d}/benchmark.parquet").orderBy("item_id").select("text").first()
    return first["text"] if first else ""


def t01_chunks(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.chunks_of(articles(spark, d))


def t02_indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten documents most like the first benchmark passage, with the language as symbol and without stop words."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), retrieval.indexed_text(F.upper("lang"), F.col("text")).alias("text"))
    return _rounded(retrieval.similar_chunks(chunks, _first_passage(spark, d), 10, STOP))


def t04_formatted_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The ten chunks most like the first benchmark passage as lines of a prompt, the most alike first."""
    chunks = retrieval.chunks_of(articles(spark, d))
    found = retrieval.similar_chunks(chunks.select("chunk_id", "text"), _first_passage(spark, d), 10)
    place = F.struct(-F.round("similarity", 9), "chunk_id")
    return retrieval.formatted_chunks(chunks.join(F.broadcast(found), "chunk_id").withColumn("place", place), "place")


def t05_sentiment_texts(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.sentiment_texts(articles(spark, d)).select("article_id", "text")


def t06_lexicon_sentiment(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("ticker"), F.coalesce("text", F.lit("")).alias("text"))
    return _rounded(selection.sentiment_summary(retrieval.lexicon_scores(docs, LEXICON), ["ticker"], 0.05))


def t10_methodology_queries(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    found = selection.vocabulary_matches(docs, TERMS).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("query")), "; ").alias("queries"))
    return found


def x03_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.length(fn.truncated(F.col("text"), 20)).alias("n"))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def x05_results_context(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.summarise(weekly_returns(spark, d), weekly_benchmark(spark, d))
    percent = lambda label, c: F.concat(F.lit(f"  {label}: "), fn.as_percent(F.col(c)))
    ratio = lambda label, c: F.concat(F.lit(f"  {label}: "), fn.as_ratio(F.col(c)))
    return m.select("asset", _lines(
        F.concat(F.col("asset"), F.lit(":")), percent("Annual return", "annual_return"), percent("Annual volatility", "annual_volatility"), ratio("Sharpe ratio", "sharpe_ratio"),
        ratio("Sortino ratio", "sortino_ratio"), percent("Max drawdown", "max_drawdown"), percent("95% VaR (period)", "var_95"), percent("95% CVaR (period)", "cvar_95"),
    ).alias("block"))


def x06_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The question and its context as one prompt, the context as data between tags."""
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    prompt = F.concat(F.lit("Answer from <portfolio_data> only.\n"), fn.wrapped("portfolio_data", fn.truncated(F.col("text"), 30)), F.lit("\nQuestion: "), F.col("item_id").cast("string"))
    return items.select("item_id", F.sha2(prompt, 256).alias("sha256"))


_ARTICLES = """art AS (SELECT doc_id AS article_id, upper(lang) AS ticker, CASE WHEN doc_id % 5 <> 0 THEN source || '  News' WHEN doc_id % 10 = 0 THEN '' END AS title,
  text AS description, CASE WHEN doc_id % 2 = 0 THEN source END AS source, CASE doc_id % 7 WHEN 0 THEN 'SEC EDGAR' WHEN 1 THEN 'TED' ELSE 'NewsAPI' END AS provider FROM documents
), chunks AS (SELECT article_id AS chunk_id, trim(title || '. ' || coalesce(description, '')) AS text, coalesce(source, 'unknown') AS source, provider, coalesce(ticker, '') AS ticker, '' AS url
  FROM art WHERE title <> '')"""
# the search of t03_tfidf_top over chunks, up to the products of each chunk and the query
_SEARCH = _FORECAST_SQL["t03_tfidf_top"].replace("doc_id AS chunk_id", "chunk_id").replace("FROM documents", "FROM chunks")
_FOUND = _SEARCH[_SEARCH.index("words AS") : _SEARCH.rindex(")\nSELECT chunk_id")]
_STOPS = ", ".join(f"'{w}'" for w in STOP)
_VALUES = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in LEXICON.items())
_M22 = _PANEL_SQL["m22_performance_summary"]
_M22 = _M22[: _M22.index("SELECT asset, n AS n_periods")]
_P = "printf('%.2f%%', round(100 * ({}), 2))"

ORACLE_SQL = {
    "t01_chunks": f"WITH {_ARTICLES} SELECT * FROM chunks",
    "t02_indexed_search": _FORECAST_SQL["t03_tfidf_top"].replace("lower(coalesce(text, ''))", "lower(coalesce(upper(lang), '') || ' ' || coalesce(text, ''))").replace("counts AS (SELECT chunk_id, term, count(*) AS n FROM words GROUP BY 1, 2", f"counts AS (SELECT chunk_id, term, count(*) AS n FROM words WHERE term NOT IN ({_STOPS}) GROUP BY 1, 2").replace("AS term) GROUP BY 1", f"AS term) WHERE term NOT IN ({_STOPS}) GROUP BY 1"),
    "t04_formatted_chunks": f"""WITH {_ARTICLES}, {_FOUND}
), found AS (SELECT chunk_id, round(dot / (norm * q_norm), 9) AS s FROM per, qn WHERE dot > 0 ORDER BY s DESC, chunk_id LIMIT 10)
SELECT string_agg('  - [' || provider || '/' || source || ', ' || ticker || '] ' || text, chr(10) ORDER BY s DESC, chunk_id) AS block FROM found JOIN chunks USING (chunk_id)""",
    "t05_sentiment_texts": f"""WITH {_ARTICLES}, news AS (SELECT *, lower(regexp_replace(trim(coalesce(title, '')), '\\s+', ' ', 'g')) AS k FROM art
  WHERE provider NOT IN ('SEC EDGAR', 'TED') AND (trim(coalesce(title, '')) <> '' OR trim(coalesce(description, '')) <> '')
), placed AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN k = '' THEN 'id' || article_id ELSE k END ORDER BY article_id) AS p FROM news)
SELECT article_id, trim(trim(coalesce(title, '')) || '. ' || trim(coalesce(description, ''))) AS text FROM placed WHERE p = 1""",
    "t06_lexicon_sentiment": f"""WITH s AS (SELECT source AS ticker, coalesce(list_sum(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+'), lambda w: CASE w {_VALUES} ELSE 0.0::DOUBLE END)), 0) AS t FROM documents),
c AS (SELECT ticker, t / sqrt(t * t + 15) AS s FROM s)
SELECT ticker, round(avg(s), 6) AS score, round(100 * avg(CASE WHEN s > 0.05 THEN 1.0::DOUBLE ELSE 0 END), 6) AS bullish_pct, round(100 * avg(CASE WHEN s < -0.05 THEN 1.0::DOUBLE ELSE 0 END), 6) AS bearish_pct,
  count(*) AS n_articles FROM c GROUP BY 1""",
    "t10_methodology_queries": r"""SELECT doc_id AS id, string_agg(DISTINCT query, '; ' ORDER BY query) AS queries FROM documents, (VALUES
  ('data quality', '(^|[^a-z0-9_])data([^a-z0-9_]|$)'), ('definite articles', '(^|[^a-z0-9_])the([^a-z0-9_]|$)'),
  ('software licenses', '(^|[^a-z0-9_])license([^a-z0-9_]|$)'), ('open licenses', '(^|[^a-z0-9_])cc by([^a-z0-9_]|$)')) t(query, p) WHERE regexp_matches(lower(text), p) GROUP BY 1""",
    "x03_token_budget": "SELECT item_id, CAST(CASE WHEN length(text) > 80 THEN 98 ELSE length(text) END AS INTEGER) AS n FROM benchmark",
    "x05_results_context": _M22 + f"""SELECT asset, concat_ws(chr(10), asset || ':', '  Annual return: ' || {_P.format('ann')}, '  Annual volatility: ' || {_P.format('sd * sqrt(52)')},
  '  Sharpe ratio: ' || printf('%.2f', round(sp * sqrt(52), 2)), '  Sortino ratio: ' || printf('%.2f', round(em / nullif(down, 0) * sqrt(52), 2)), '  Max drawdown: ' || {_P.format('mdd')},
  '  95% VaR (period): ' || {_P.format('var')}, '  95% CVaR (period): ' || {_P.format('cvar')}) AS block FROM o""",
    "x06_prompts": """SELECT item_id, sha256('Answer from <portfolio_data> only.' || chr(10) || '<portfolio_data>' || chr(10) || CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || chr(10) || '[...truncated...]' ELSE text END
  || chr(10) || '</portfolio_data>' || chr(10) || 'Question: ' || item_id) AS sha256 FROM benchmark""",
}
QUERIES = {k: globals()[k] for k in ORACLE_SQL}
