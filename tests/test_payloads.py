"""Parsers of provider payloads on small fixed answers, and what the service says of itself, against the rows that they must give."""

from __future__ import annotations

import json

import duckdb
import pytest
from oracle import rows_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import panel
from panelwright.plans.panels import _rounded
from panelwright.sources import payloads, stores

# ---------------------------------------------------------------- macro series


def _landed_observations(spark: SparkSession) -> DataFrame:
    def series(values: list[str], start: int = 2024 * 12) -> str:
        months = range(start, start - len(values), -1)
        return json.dumps({"observations": [{"date": f"{m // 12}-{m % 12 + 1:02d}-01", "value": v} for m, v in zip(months, values, strict=True)]})

    rows = [
        ("DGS3MO", series([".", "5.25", "5.20"])), ("DGS10", series(["4.10", "4.05"])), ("SAHMREALTIME", series(["0.43"])), ("UNRATE", series([".", ".", ".", ".", ".", "3.7"])),
        ("CPIAUCSL", series(["310", *["305"] * 11, "300", "299"])), ("INDPRO", series(["100"] * 12)), ("FEDFUNDS", "not json"),
    ]
    return spark.createDataFrame(rows, "series_id string, payload string")


def s15_latest_values(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(payloads.latest_value(payloads.observations(_landed_observations(spark))))


def s16_year_over_year(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(payloads.year_over_year(payloads.observations(_landed_observations(spark))))


def s17_macro_snapshot(spark: SparkSession, d: str) -> DataFrame:
    latest = {"three_month_yield": "DGS3MO", "ten_year_yield": "DGS10", "sahm_rule_indicator": "SAHMREALTIME", "unemployment_rate": "UNRATE", "fed_funds_rate": "FEDFUNDS"}
    return _rounded(payloads.macro_snapshot(payloads.observations(_landed_observations(spark)), latest, {"cpi_yoy_inflation": "CPIAUCSL", "industrial_production_yoy": "INDPRO"}))


# ---------------------------------------------------------------- fundamentals


def _finnhub(spark: SparkSession) -> DataFrame:
    rows = [
        ("AAA", json.dumps({"name": "Aa Inc", "marketCapitalization": 2500.5}), json.dumps({"metric": {"peBasicExclExtraTTM": 21.5, "beta": 1.2, "dividendYieldIndicatedAnnual": 0.5, "52WeekHigh": 200.0}})),
        ("BBB", json.dumps({"name": "Bb"}), "{}"),
    ]
    return payloads.finnhub_fundamentals(spark.createDataFrame(rows, "ticker string, profile string, metric string"))


def _twelve(spark: SparkSession) -> DataFrame:
    stats = {"meta": {"name": "Aa"}, "statistics": {"valuations_metrics": {"market_capitalization": 9e9}, "stock_price_summary": {"fifty_two_week_low": 100.0}}}
    rows = [("AAA", json.dumps(stats)), ("BBB", json.dumps({"code": 403, "message": "plan"}))]
    return payloads.twelve_data_fundamentals(spark.createDataFrame(rows, "ticker string, payload string"))


def _yfinance(spark: SparkSession) -> DataFrame:
    rows = [("AAA", json.dumps({"longName": "Other", "beta": 9.0})), ("BBB", json.dumps({"marketCap": 5e8, "trailingPE": 12.0, "dividendYield": 0.9}))]
    return payloads.yfinance_fundamentals(spark.createDataFrame(rows, "ticker string, payload string"))


def s10_finnhub_fundamentals(spark: SparkSession, d: str) -> DataFrame:
    return _finnhub(spark)


def s11_twelve_fundamentals(spark: SparkSession, d: str) -> DataFrame:
    return _twelve(spark)


def s12_yfinance_fundamentals(spark: SparkSession, d: str) -> DataFrame:
    return _yfinance(spark)


def s13_filled_fundamentals(spark: SparkSession, d: str) -> DataFrame:
    return payloads.filled_fundamentals(_finnhub(spark), _twelve(spark), _yfinance(spark))


# ---------------------------------------------------------------- articles

_T = "ticker string, payload string"


def _newsapi(spark: SparkSession) -> DataFrame:
    a = [{"title": "One", "description": None, "source": {"name": "Wire"}, "publishedAt": "2026-01-02T03:04:05Z", "url": "u1"}, {"title": "[Removed]"}, {"title": ""}, {"title": "Two"}]
    return payloads.newsapi(spark.createDataFrame([("AAA", json.dumps({"articles": a})), ("BBB", "{}")], _T))


def _finnhub_news(spark: SparkSession) -> DataFrame:
    a = [{"headline": "H1", "summary": "s", "source": "F", "datetime": 1767323045, "url": "u"}, {"headline": ""}, {"headline": "H2", "datetime": 0}, *[{"headline": f"H{i}"} for i in range(3, 9)]]
    return payloads.finnhub_news(spark.createDataFrame([("AAA", json.dumps(a)), ("BBB", '{"error": "bad symbol"}')], _T))


def _gdelt(spark: SparkSession) -> DataFrame:
    a = [{"title": "G1", "domain": "d.org", "seendate": "20260908T120000Z", "url": "u"}, {"title": "G2", "seendate": "yesterday"}, {"domain": "x"}]
    return payloads.gdelt(spark.createDataFrame([("AAA", json.dumps({"articles": a}))], _T))


def _google(spark: SparkSession) -> DataFrame:
    item = lambda inner: f"<item>{inner}</item>"
    xml = "<rss version='2.0'><channel>" + item("<title> R1 </title><link>l1</link><pubDate>Tue, 08 Sep 2026 12:00:00 GMT</pubDate><description>text</description><source>Paper</source>") + item("<title>R2</title><link>l2</link><pubDate>soon</pubDate>") + item("<title> </title>") + "</channel></rss>"
    return payloads.google_news(spark.createDataFrame([("AAA", xml)], _T))


def _ted(spark: SparkSession) -> DataFrame:
    n = [
        {"notice-title": {"deu": "Vertrag", "eng": "Contract"}, "buyer-name": {"deu": ["Stadt", "Land"]}, "buyer-country": ["DEU"], "publication-number": "12-2026", "publication-date": "2026-01-02"},
        {"notice-title": "Plain", "buyer-name": "Town"}, {"notice-title": ""}, {"notice-title": {"fra": "Marché"}},
    ]
    return payloads.ted_notices(spark.createDataFrame([("AAA", json.dumps({"notices": n}, ensure_ascii=False))], _T))


def _sec(spark: SparkSession) -> DataFrame:
    hit = lambda i, ciks, **more: {"_id": i, "_source": {"ciks": ciks, **more}}
    hits = [
        hit("0001-26-000001:a.htm", ["0000320193"], display_names=["Aa Inc (AAA)"], file_date="2026-01-02"), hit("0001-26-000001:b.htm", ["0000320193"], file_date="2026-01-02"),
        hit("0002-26-000009:c.htm", ["0000000777"], file_date="2026-01-03"), hit("0001-26-000002:d.htm", ["x", "0000320193"], display_names=[]), hit("", ["320193"], file_date="2026-01-05"),
    ]
    tickers = {"0": {"cik_str": 320193, "ticker": "AAA", "title": "Aa Inc."}, "1": {"cik_str": 777, "ticker": "CCC", "title": "Cc"}}
    landed = spark.createDataFrame([("AAA", "Aa", json.dumps({"hits": {"hits": hits}})), ("BBB", "Bb", json.dumps({"hits": {"hits": hits}}))], "ticker string, company string, payload string")
    return payloads.sec_filings(landed, payloads.cik_of_tickers(spark.createDataFrame([(json.dumps(tickers),)], "payload string")))


def s18_newsapi(spark: SparkSession, d: str) -> DataFrame:
    return _newsapi(spark)


def s19_finnhub_news(spark: SparkSession, d: str) -> DataFrame:
    return _finnhub_news(spark)


def s20_gdelt(spark: SparkSession, d: str) -> DataFrame:
    return _gdelt(spark)


def s21_google_news(spark: SparkSession, d: str) -> DataFrame:
    return _google(spark)


def s22_ted_notices(spark: SparkSession, d: str) -> DataFrame:
    return _ted(spark)


def s23_sec_filings(spark: SparkSession, d: str) -> DataFrame:
    return _sec(spark)


def u01_all_articles(spark: SparkSession, d: str) -> DataFrame:
    every = payloads.all_articles([_newsapi(spark), _finnhub_news(spark), _gdelt(spark), _google(spark), _ted(spark), _sec(spark)])
    return every.groupBy("ticker", "provider").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- sentiment and papers


def _aggregated(spark: SparkSession) -> DataFrame:
    rows = [("AAA", json.dumps({"sentiment": {"bullishPercent": 0.75, "bearishPercent": 0.25}, "buzz": {"articlesInLastWeek": 40}})), ("BBB", json.dumps({"sentiment": {"bullishPercent": 0, "bearishPercent": 0}})), ("CCC", "{}")]
    return payloads.finnhub_sentiment(spark.createDataFrame(rows, _T))


def _classified(spark: SparkSession) -> DataFrame:
    c = lambda p, n: [{"label": "positive", "score": p}, {"label": "negative", "score": n}, {"label": "neutral", "score": 0.1}]
    rows = [("BBB", c(0.75, 0.25)), ("BBB", [c(0.0, 0.5)]), ("BBB", []), ("BBB", {"error": "loading"}), ("BBB", [{"label": "other", "score": 1.0}])]
    return payloads.classified_sentiment(spark.createDataFrame([(t, json.dumps(x)) for t, x in rows], _T))


def t07_classified_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark)


def t08_aggregated_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return _aggregated(spark)


def t09_sentiment_cascade(spark: SparkSession, d: str) -> DataFrame:
    local = spark.createDataFrame([("AAA", "local", 50.0, 0.0, 0.2, 2), ("DDD", "local", 0.0, 0.0, 0.0, 1)], "ticker string, provider string, bullish_pct double, bearish_pct double, score double, n_articles long")
    return payloads.first_sentiment(_classified(spark), _aggregated(spark), local)


def _scholar(spark: SparkSession) -> DataFrame:
    p = [{"title": "Deep  Hedging", "authors": [{"name": x} for x in ("A", "B", "C", "D")], "year": 2019, "url": "s1", "citationCount": 5, "venue": "QF"}, {"title": "Alone", "authors": [], "url": "s2"}]
    return payloads.semantic_scholar(spark.createDataFrame([("q", json.dumps({"data": p}))], "query string, payload string"))


def _arxiv(spark: SparkSession) -> DataFrame:
    entry = lambda i, t, a: f"<entry><id>http://x/{i}</id><title>{t}</title><published>2020-05-0{i}T00:00:00Z</published>{a}</entry>"
    xml = "<feed>" + entry(1, "deep\n   hedging", "<author><name>A</name></author>") + entry(2, "Risk\n Parity", "<author><name>E</name></author><author><name>F</name></author>") + entry(3, "More", "<author><name>G</name></author>") + "</feed>"
    return payloads.arxiv(spark.createDataFrame([("q", xml)], "query string, payload string"))


def _flat(papers: DataFrame) -> DataFrame:
    return papers.withColumn("authors", F.array_join("authors", "|"))


def s24_semantic_scholar(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_scholar(spark))


def s25_arxiv(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_arxiv(spark))


def u06_merged_papers(spark: SparkSession, d: str) -> DataFrame:
    return _flat(payloads.merged_papers(_scholar(spark), _arxiv(spark), 3))


def t11_formatted_papers(spark: SparkSession, d: str) -> DataFrame:
    return payloads.formatted_papers(payloads.merged_papers(_scholar(spark), _arxiv(spark), 3))


def s31_synthetic_prices(spark: SparkSession, d: str) -> DataFrame:
    """Volatility and rows of made prices, to one digit."""
    r = panel.returns(stores.synthetic_prices(spark, 4, 3000)).filter("r is not null").groupBy("asset").agg(F.count("*").alias("n"), F.stddev_samp("r").alias("sd"))
    return r.select("asset", "n", F.round(F.col("sd") * 252**0.5, 1).alias("volatility"))


_ARTICLE = "(ticker, title, description, source, published_at, url, provider)"
_PAPER = "(query, \"at\", title, authors, year, url, citation_count, venue)"
_FUND = "(ticker, name, market_cap, trailing_pe, beta, dividend_yield, high_52w, low_52w, source)"
_D = "CAST(NULL AS DOUBLE)"
WANTED = {
    "s15_latest_values": "SELECT * FROM (VALUES ('DGS3MO', 0.0525::DOUBLE), ('DGS10', 0.041), ('SAHMREALTIME', 0.43), ('CPIAUCSL', 3.1), ('INDPRO', 1.0)) t(series_id, value)",
    "s16_year_over_year": "SELECT 'CPIAUCSL' AS series_id, round(310.0::DOUBLE / 300 - 1, 6) AS value",
    "s17_macro_snapshot": f"""SELECT 0.0525::DOUBLE AS three_month_yield, 0.041::DOUBLE AS ten_year_yield, 0.43::DOUBLE AS sahm_rule_indicator, {_D} AS unemployment_rate, {_D} AS fed_funds_rate,
  round(310.0::DOUBLE / 300 - 1, 6) AS cpi_yoy_inflation, {_D} AS industrial_production_yoy, round(0.041::DOUBLE - 0.0525, 6) AS term_spread_10y_3m""",
    "s10_finnhub_fundamentals": f"SELECT * FROM (VALUES ('AAA', 'Aa Inc', 2500500000.0::DOUBLE, 21.5::DOUBLE, 1.2::DOUBLE, 0.005::DOUBLE, 200.0::DOUBLE, {_D}, 'Finnhub'), ('BBB', 'Bb', NULL, NULL, NULL, NULL, NULL, NULL, 'Finnhub')) t{_FUND}",
    "s11_twelve_fundamentals": f"SELECT * FROM (VALUES ('AAA', 'Aa', 9000000000.0::DOUBLE, {_D}, {_D}, {_D}, {_D}, 100.0::DOUBLE, 'Twelve Data')) t{_FUND}",
    "s12_yfinance_fundamentals": f"SELECT * FROM (VALUES ('AAA', 'Other', {_D}, {_D}, 9.0::DOUBLE, {_D}, {_D}, {_D}, 'yfinance'), ('BBB', NULL, 500000000.0, 12.0, NULL, NULL, NULL, NULL, 'yfinance')) t{_FUND}",
    "s13_filled_fundamentals": f"SELECT * FROM (VALUES ('AAA', 'Aa Inc', 2500500000.0::DOUBLE, 21.5::DOUBLE, 1.2::DOUBLE, 0.005::DOUBLE, 200.0::DOUBLE, 100.0::DOUBLE, 'Finnhub + Twelve Data'), ('BBB', 'Bb', 500000000.0, 12.0, NULL, NULL, NULL, NULL, 'Finnhub + yfinance')) t{_FUND}",
    "s18_newsapi": f"SELECT * FROM (VALUES ('AAA', 'One', '', 'Wire', '2026-01-02T03:04:05Z', 'u1', 'NewsAPI'), ('AAA', 'Two', '', 'unknown', '', '', 'NewsAPI')) t{_ARTICLE}",
    "s19_finnhub_news": f"""SELECT * FROM (VALUES ('AAA', 'H1', 's', 'F', '2026-01-02T03:04:05+00:00', 'u', 'Finnhub'), ('AAA', 'H2', '', 'unknown', '', '', 'Finnhub'),
  ('AAA', 'H3', '', 'unknown', '', '', 'Finnhub'), ('AAA', 'H4', '', 'unknown', '', '', 'Finnhub')) t{_ARTICLE}""",
    "s20_gdelt": f"SELECT * FROM (VALUES ('AAA', 'G1', '', 'd.org', '2026-09-08T12:00:00+00:00', 'u', 'GDELT'), ('AAA', 'G2', '', 'unknown', '', '', 'GDELT')) t{_ARTICLE}",
    "s21_google_news": f"SELECT * FROM (VALUES ('AAA', 'R1', 'text', 'Paper', '2026-09-08T12:00:00+00:00', 'l1', 'Google News'), ('AAA', 'R2', '', 'unknown', 'soon', 'l2', 'Google News')) t{_ARTICLE}",
    "s22_ted_notices": f"""SELECT * FROM (VALUES ('AAA', 'Contract', 'Buyer: Stadt, Land (DEU)', 'TED (EU public procurement)', '2026-01-02', 'https://ted.europa.eu/en/notice/-/detail/12-2026', 'TED'),
  ('AAA', 'Plain', 'Buyer: Town', 'TED (EU public procurement)', '', 'https://ted.europa.eu/', 'TED'), ('AAA', 'Marché', '', 'TED (EU public procurement)', '', 'https://ted.europa.eu/', 'TED')) t{_ARTICLE}""",
    "s23_sec_filings": f"""SELECT * FROM (VALUES
  ('AAA', '8-K filing: Aa Inc (AAA)', 'Filed 2026-01-02', 'SEC EDGAR', '2026-01-02', 'https://www.sec.gov/Archives/edgar/data/320193/000126000001/0001-26-000001-index.htm', 'SEC EDGAR'),
  ('AAA', '8-K filing: Aa', 'Filed unknown date', 'SEC EDGAR', '', 'https://www.sec.gov/Archives/edgar/data/x/000126000002/0001-26-000002-index.htm', 'SEC EDGAR'),
  ('AAA', '8-K filing: Aa', 'Filed 2026-01-05', 'SEC EDGAR', '2026-01-05', 'https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK=320193', 'SEC EDGAR')) t{_ARTICLE}""",
    "u01_all_articles": "SELECT ticker, provider, n::BIGINT AS n FROM (VALUES ('AAA', 'NewsAPI', 2), ('AAA', 'Finnhub', 4), ('AAA', 'GDELT', 2), ('AAA', 'Google News', 2), ('AAA', 'TED', 3), ('AAA', 'SEC EDGAR', 3)) t(ticker, provider, n)",
    "t07_classified_sentiment": "SELECT 'BBB' AS ticker, 'FinBERT' AS provider, 50.0::DOUBLE AS bullish_pct, 50.0::DOUBLE AS bearish_pct, 0.0::DOUBLE AS score, 2::BIGINT AS n_articles",
    "t08_aggregated_sentiment": "SELECT 'AAA' AS ticker, 'Finnhub' AS provider, 75.0::DOUBLE AS bullish_pct, 25.0::DOUBLE AS bearish_pct, 0.5::DOUBLE AS score, 40::BIGINT AS n_articles",
    "t09_sentiment_cascade": """SELECT ticker, provider, u::DOUBLE AS bullish_pct, b::DOUBLE AS bearish_pct, s::DOUBLE AS score, n::BIGINT AS n_articles FROM (VALUES
  ('BBB', 'FinBERT', 50, 50, 0.0, 2), ('AAA', 'Finnhub', 75, 25, 0.5, 40), ('DDD', 'local', 0, 0, 0, 1)) t(ticker, provider, u, b, s, n)""",
    "s24_semantic_scholar": f"SELECT * FROM (VALUES ('q', 0, 'Deep  Hedging', 'A|B|C|D', 2019, 's1', 5::BIGINT, 'QF'), ('q', 1, 'Alone', '', NULL, 's2', NULL, '')) t{_PAPER}",
    "s25_arxiv": f"SELECT * FROM (VALUES ('q', 0, 'deep hedging', 'A', 2020, 'http://x/1', CAST(NULL AS BIGINT), 'arXiv'), ('q', 1, 'Risk Parity', 'E|F', 2020, 'http://x/2', NULL, 'arXiv'), ('q', 2, 'More', 'G', 2020, 'http://x/3', NULL, 'arXiv')) t{_PAPER}",
    "u06_merged_papers": """SELECT * FROM (VALUES ('q', 'Deep  Hedging', 'A|B|C|D', 2019, 's1', 5::BIGINT, 'QF', 1), ('q', 'Alone', '', NULL, 's2', NULL, '', 2),
  ('q', 'Risk Parity', 'E|F', 2020, 'http://x/2', NULL, 'arXiv', 3)) t(query, title, authors, year, url, citation_count, venue, place)""",
    "t11_formatted_papers": """SELECT 'q' AS query, '  - Deep  Hedging (2019) — A, B, C et al.. s1' || chr(10) || '  - Alone — unknown authors. s2' || chr(10) || '  - Risk Parity (2020) — E, F. http://x/2' AS block""",
    "s31_synthetic_prices": "SELECT printf('SYN%03d', i::INTEGER) AS asset, 2999::BIGINT AS n, 0.2::DOUBLE AS volatility FROM range(0, 4) t(i)",
}


@pytest.mark.parametrize("name", sorted(WANTED))
def test_parsed_answers(spark, name):
    df, want = globals()[name](spark, ""), duckdb.connect().execute(WANTED[name])
    names = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, want.fetchall())


def test_zipped_lines(spark, tmp_path):
    """Members of archives are read line by line; what is no archive isn't met."""
    rows = [("a", i, f"line {i}, ü") for i in range(25_000)] + [("b", 0, "")]
    stores.save_zip(spark.createDataFrame(rows, "file string, i long, line string"), f"{tmp_path}/zips")
    (tmp_path / "zips" / "notes.txt").write_text("no archive")
    got = payloads.zipped_lines(spark, f"{tmp_path}/zips")
    assert {(r.member[0], r.i, r.line) for r in got.collect()} == set(rows) and got.count() == len(rows)
