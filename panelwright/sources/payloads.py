"""Landed provider payloads as tables: JSON and XML texts in, rows of prices, articles, papers or fundamentals out.

Every parser takes a table of payload texts (one row for each answer of a provider, as it was landed) and is one projection with
``explode``; nothing is inferred from the data, and a payload that isn't what it should be gives no rows.
"""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import iso_of_compact, iso_of_rfc822, iso_utc, names_of, session_date
from ..operators.retrieval import normal_title

ARTICLE = ["ticker", "title", "description", "source", "published_at", "url", "provider"]


def _number(text: Column) -> Column:
    return text.try_cast("double")


def _text(value: Column, default: str = "") -> Column:
    return F.coalesce(value, F.lit(default))


# ---------------------------------------------------------------- prices


def yahoo_chart(landed: DataFrame) -> DataFrame:
    """Adjusted closes of ``landed(asset, payload)`` in chart form, by the exchange's own dates."""
    kind = "chart struct<result: array<struct<meta: struct<exchangeTimezoneName: string>, timestamp: array<bigint>, indicators: struct<adjclose: array<struct<adjclose: array<double>>>>>>>"
    first = F.get(F.from_json("payload", kind)["chart"]["result"], 0)
    rows = landed.select("asset", first["meta"]["exchangeTimezoneName"].alias("zone"), F.explode(F.arrays_zip(first["timestamp"].alias("t"), F.get(first["indicators"]["adjclose"], 0)["adjclose"].alias("p"))).alias("x"))
    return rows.select("asset", session_date(F.col("x.t"), F.col("zone")).alias("dt"), F.col("x.p").alias("price")).filter("dt is not null and price is not null")


def twelve_data(landed: DataFrame) -> DataFrame:
    """Prices of ``landed(asked, payload)``, a payload of one symbol or a map of symbols; ``asked`` is the array of symbols asked for.

    A single answer counts for the symbol that it names, or for the only one asked for. Adjusted closes go before closes.
    Errors and symbols without values give nothing.
    """
    entry = "struct<meta: struct<symbol: string>, values: array<map<string, string>>>"
    one, many = F.from_json("payload", f"meta struct<symbol: string>, values array<map<string, string>>, status string"), F.from_json("payload", f"map<string, {entry}>")
    single = one["values"].isNotNull() | one["meta"].isNotNull()
    symbol = F.when(F.array_contains("asked", one["meta"]["symbol"]), one["meta"]["symbol"]).when(F.size("asked") == 1, F.get("asked", 0))
    entries = F.when(single, F.array(F.struct(symbol.alias("asset"), one["values"].alias("values")))).otherwise(
        F.transform(F.map_entries(many), lambda e: F.struct(e["key"].alias("asset"), e["value"]["values"].alias("values")))
    )
    failed = F.coalesce(one["status"] == "error", F.lit(False))
    rows = landed.filter(~failed).select("asked", F.explode(entries).alias("e")).filter(F.array_contains("asked", F.col("e.asset")))
    value = rows.select(F.col("e.asset").alias("asset"), F.explode("e.values").alias("v"))
    price = F.coalesce(*(F.try_element_at("v", F.lit(k)) for k in ("adjusted_close", "adjusted close", "close")))
    return value.select("asset", F.to_date(F.try_element_at("v", F.lit("datetime"))).alias("dt"), _number(price).alias("price")).filter("price is not null")


def alpha_vantage(landed: DataFrame, start: str, end: str) -> DataFrame:
    """Adjusted closes between two dates of ``landed(asset, payload)``; a note or an error gives nothing."""
    series = F.from_json(F.get_json_object("payload", "$['Time Series (Daily)']"), "map<string, map<string, string>>")
    failed = F.coalesce(*(F.get_json_object("payload", f"$['{k}']") for k in ("Error Message", "Note", "Information")))
    rows = landed.filter(failed.isNull()).select("asset", F.explode(series).alias("d", "v"))
    out = rows.select("asset", F.to_date("d").alias("dt"), _number(F.try_element_at("v", F.lit("5. adjusted close"))).alias("price"))
    return out.filter(F.col("dt").between(F.lit(start), F.lit(end)) & F.col("price").isNotNull())


def tiingo(landed: DataFrame) -> DataFrame:
    """Adjusted closes of ``landed(asset, payload)``, a list of days."""
    rows = landed.select("asset", F.explode(F.from_json("payload", "array<struct<date: string, adjClose: double>>")).alias("x"))
    return rows.select("asset", F.to_date(F.substring("x.date", 1, 10)).alias("dt"), F.col("x.adjClose").alias("price")).filter("dt is not null and price is not null")


def first_source(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """All rows of the first of ``sources`` that has any, with its name in ``source``."""
    rows = [df.select("asset", "dt", "price", F.lit(i).alias("rank"), F.lit(name).alias("source")) for i, (name, df) in enumerate(sources)]
    every = reduce(DataFrame.unionByName, rows)
    best = every.agg(F.min("rank").alias("rank"))
    return every.join(F.broadcast(best), "rank").drop("rank")


def filled_by_asset(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Each asset's rows of the first of ``sources`` that has it, with that source's name; later ones fill missing assets only."""
    rows = [df.filter("price is not null").select("asset", "dt", "price", F.lit(i).alias("rank"), F.lit(name).alias("source")) for i, (name, df) in enumerate(sources)]
    every = reduce(DataFrame.unionByName, rows)
    best = every.groupBy("asset").agg(F.min("rank").alias("rank"))
    return every.join(best, ["asset", "rank"]).drop("rank")


def provenance(filled: DataFrame, first: str) -> DataFrame:
    """One row: ``first``, and each later source with the assets it filled."""
    named = filled.select("asset", "source").distinct().filter(F.col("source") != first)
    by = named.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("asset")), ", ").alias("assets"))
    label = F.array_join(F.array_sort(F.collect_list(F.concat("source", F.lit(" for "), "assets"))), "; ")
    return by.agg(F.when(label != "", F.concat(F.lit(f"{first} + "), label)).otherwise(F.lit(first)).alias("source"))


# ---------------------------------------------------------------- factors and macro series


def zipped_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, member, i, line)`` of the text files in the ZIP archives of ``folder``; an archive is opened in a task, a line at a time."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path", "content")

    def opened(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in tables:
            for path, content in zip(t["path"], t["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        with io.TextIOWrapper(archive.open(member), "utf-8", errors="replace") as text:
                            lines = enumerate(text)
                            while part := list(itertools.islice(lines, 10_000)):
                                yield pd.DataFrame({"file": path, "member": member, "i": [i for i, _ in part], "line": [x.rstrip("\r\n") for _, x in part]})

    return found.mapInPandas(opened, "file string, member string, i long, line string")


def factor_block(lines: DataFrame, columns: list[str]) -> DataFrame:
    """``(dt, *columns)`` as fractions: the first run of data lines of ``lines(i, line)``, which start with a date of 8 or 6 digits.

    Lines around it (titles, blanks, a second table) are left out. A file is a few thousand lines; its runs are found with one ordered window.
    """
    data = lines.filter(F.col("line").rlike(r"^\s*\d{6,8}\s*,")).withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("i")))
    first = data.join(F.broadcast(data.agg(F.min("run").alias("run"))), "run")
    part = F.split("line", ",")
    day = F.trim(F.get(part, 0))
    dt = F.coalesce(F.to_date(F.when(F.length(day) == 8, F.try_to_timestamp(day, F.lit("yyyyMMdd")))), F.to_date(F.try_to_timestamp(F.concat(day, F.lit("01")), F.lit("yyyyMMdd"))))
    values = [(_number(F.trim(F.get(part, k + 1))) / 100).alias(c) for k, c in enumerate(columns)]
    return first.select(dt.alias("dt"), *values).filter(F.coalesce(*(F.col(c) for c in columns)).isNotNull())


def observations(landed: DataFrame) -> DataFrame:
    """``(series_id, dt, value)`` of ``landed(series_id, payload)``; ``.`` and what is no number stay null."""
    rows = landed.select("series_id", F.explode(F.from_json("payload", "observations array<struct<date: string, value: string>>")["observations"]).alias("o"))
    return rows.select("series_id", F.to_date("o.date").alias("dt"), _number(F.col("o.value")).alias("value"))


def latest_value(obs: DataFrame, undivided: tuple[str, ...] = ("SAHMREALTIME",), recent: int = 5) -> DataFrame:
    """``(series_id, value)``: the last known of the ``recent`` last observations, as a fraction except for the ``undivided`` series."""
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("dt")))
    last = obs.withColumn("place", place).filter((F.col("place") <= recent) & F.col("value").isNotNull()).groupBy("series_id").agg(F.max_by("value", "dt").alias("value"))
    return last.select("series_id", (F.col("value") / F.when(F.col("series_id").isin(*undivided), 1.0).otherwise(100.0)).alias("value"))


def year_over_year(obs: DataFrame, recent: int = 15, least: int = 13, days: int = 20) -> DataFrame:
    """``(series_id, value)``: the last value over that of the latest observation within ``days`` of a year before, less 1.

    Only the ``recent`` last observations count, of which ``least`` must be known. A series has so few rows left that its pairs are
    made within one array.
    """
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("dt")))
    known = obs.withColumn("place", place).filter((F.col("place") <= recent) & F.col("value").isNotNull())
    by = known.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct((-F.unix_date("dt")).alias("o"), "dt", "value"))).alias("p"), F.count("*").alias("n"))
    last = F.get("p", 0)
    then = F.filter(F.slice("p", 2, recent), lambda x: F.abs(F.datediff(x["dt"], F.add_months(last["dt"], -12))) <= days)
    change = F.try_divide(last["value"], F.nullif(F.get(then, 0)["value"], F.lit(0.0))) - 1
    return by.filter((F.col("n") >= least) & F.get(then, 0).isNotNull()).select("series_id", change.alias("value")).filter("value is not null")


def macro_snapshot(obs: DataFrame, latest: dict[str, str], yearly: dict[str, str]) -> DataFrame:
    """One row with a column for each name of ``latest`` and ``yearly`` (name to series), null where a series is missing, and the term spread."""
    found = latest_value(obs).select("series_id", "value", F.lit("latest").alias("how")).unionByName(year_over_year(obs).select("series_id", "value", F.lit("yearly").alias("how")))
    pick = lambda how, series: F.max(F.when((F.col("how") == how) & (F.col("series_id") == series), F.col("value")))
    one = found.agg(*(pick("latest", s).alias(k) for k, s in latest.items()), *(pick("yearly", s).alias(k) for k, s in yearly.items()))
    return one.withColumn("term_spread_10y_3m", F.col("ten_year_yield") - F.col("three_month_yield"))


# ---------------------------------------------------------------- fundamentals

FUNDAMENTALS = ["name", "market_cap", "trailing_pe", "beta", "dividend_yield", "high_52w", "low_52w"]


def finnhub_fundamentals(landed: DataFrame) -> DataFrame:
    """``landed(ticker, profile, metric)``: capitalisation in millions, yield in percent."""
    p, m = F.from_json("profile", "name string, marketCapitalization double"), F.from_json("metric", "metric struct<peBasicExclExtraTTM: double, beta: double, dividendYieldIndicatedAnnual: double, `52WeekHigh`: double, `52WeekLow`: double>")["metric"]
    return landed.select(
        "ticker", p["name"].alias("name"), (p["marketCapitalization"] * 1e6).alias("market_cap"), m["peBasicExclExtraTTM"].alias("trailing_pe"), m["beta"].alias("beta"),
        (m["dividendYieldIndicatedAnnual"] / 100).alias("dividend_yield"), m["52WeekHigh"].alias("high_52w"), m["52WeekLow"].alias("low_52w"), F.lit("Finnhub").alias("source"),
    )


def twelve_data_fundamentals(landed: DataFrame) -> DataFrame:
    """``landed(ticker, payload)`` with nested statistics; an error code gives no row."""
    kind = (
        "code int, meta struct<name: string>, statistics struct<valuations_metrics: struct<market_capitalization: double, trailing_pe: double>, "
        "stock_price_summary: struct<beta: double, fifty_two_week_high: double, fifty_two_week_low: double>, dividends_and_splits: struct<forward_annual_dividend_yield: double>>"
    )
    x = F.from_json("payload", kind)
    s = x["statistics"]
    return landed.filter(x["code"].isNull()).select(
        "ticker", x["meta"]["name"].alias("name"), s["valuations_metrics"]["market_capitalization"].alias("market_cap"), s["valuations_metrics"]["trailing_pe"].alias("trailing_pe"),
        s["stock_price_summary"]["beta"].alias("beta"), s["dividends_and_splits"]["forward_annual_dividend_yield"].alias("dividend_yield"),
        s["stock_price_summary"]["fifty_two_week_high"].alias("high_52w"), s["stock_price_summary"]["fifty_two_week_low"].alias("low_52w"), F.lit("Twelve Data").alias("source"),
    )


def yfinance_fundamentals(landed: DataFrame) -> DataFrame:
    """``landed(ticker, payload)`` of flat fields; its dividend yield isn't used."""
    x = F.from_json("payload", "longName string, marketCap double, trailingPE double, beta double, fiftyTwoWeekHigh double, fiftyTwoWeekLow double")
    return landed.select(
        "ticker", x["longName"].alias("name"), x["marketCap"].alias("market_cap"), x["trailingPE"].alias("trailing_pe"), x["beta"].alias("beta"), F.lit(None).cast("double").alias("dividend_yield"),
        x["fiftyTwoWeekHigh"].alias("high_52w"), x["fiftyTwoWeekLow"].alias("low_52w"), F.lit("yfinance").alias("source"),
    )


def filled_fundamentals(first: DataFrame, *later: DataFrame) -> DataFrame:
    """``first`` with its missing fields taken from ``later`` in turn; a source that filled a field is added to ``source``."""
    out = first
    for df in later:
        other = df.select("ticker", *(F.col(c).alias(f"_{c}") for c in [*FUNDAMENTALS, "source"]))
        used = reduce(Column.__or__, (F.col(c).isNull() & F.col(f"_{c}").isNotNull() for c in FUNDAMENTALS))
        source = F.when(used, F.concat_ws(" + ", "source", "_source")).otherwise(F.col("source"))
        out = out.join(other, "ticker", "left").select("ticker", source.alias("source"), *(F.coalesce(c, f"_{c}").alias(c) for c in FUNDAMENTALS))
    return out


# ---------------------------------------------------------------- articles


def _articles(rows: DataFrame, provider: str, title: Column, description: Column, source: Column, at: Column, url: Column) -> DataFrame:
    out = rows.select("ticker", title.alias("title"), _text(description).alias("description"), _text(source, "unknown").alias("source"), _text(at).alias("published_at"), _text(url).alias("url"), F.lit(provider).alias("provider"))
    return out.filter(F.coalesce(F.col("title"), F.lit("")) != "")


def newsapi(landed: DataFrame) -> DataFrame:
    """Articles of ``landed(ticker, payload)``, without removed ones."""
    kind = "articles array<struct<title: string, description: string, source: struct<name: string>, publishedAt: string, url: string>>"
    rows = landed.select("ticker", F.explode(F.from_json("payload", kind)["articles"]).alias("a"))
    return _articles(rows, "NewsAPI", F.col("a.title"), F.col("a.description"), F.col("a.source.name"), F.col("a.publishedAt"), F.col("a.url")).filter("title <> '[Removed]'")


def finnhub_news(landed: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` articles of ``landed(ticker, payload)``, of these the ones with a headline."""
    kind = "array<struct<headline: string, summary: string, source: string, datetime: bigint, url: string>>"
    rows = landed.select("ticker", F.explode(F.slice(F.from_json("payload", kind), 1, most)).alias("a"))
    at = F.when(F.col("a.datetime") != 0, iso_utc(F.timestamp_seconds("a.datetime")))
    return _articles(rows, "Finnhub", F.col("a.headline"), F.col("a.summary"), F.col("a.source"), at, F.col("a.url"))


def gdelt(landed: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` headlines of ``landed(ticker, payload)``."""
    kind = "articles array<struct<title: string, domain: string, seendate: string, url: string>>"
    rows = landed.select("ticker", F.explode(F.slice(F.from_json("payload", kind)["articles"], 1, most)).alias("a"))
    return _articles(rows, "GDELT", F.col("a.title"), F.lit(""), F.col("a.domain"), iso_of_compact(F.col("a.seendate")), F.col("a.url"))


def google_news(landed: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` items of ``landed(ticker, payload)``, an RSS document."""
    kind = "channel struct<item: array<struct<title: string, link: string, pubDate: string, description: string, source: string>>>"
    rows = landed.select("ticker", F.explode(F.slice(F.from_xml("payload", F.lit(kind))["channel"]["item"], 1, most)).alias("a"))
    get = lambda c: F.trim(F.col(f"a.{c}"))
    return _articles(rows, "Google News", get("title"), get("description"), get("source"), iso_of_rfc822(get("pubDate")), get("link"))


def _language_text(raw: Column) -> Column:
    """A field that is a text, a list of texts or a map of these by language, English first."""
    as_map, as_lists = F.from_json(raw, "map<string, string>"), F.from_json(raw, "map<string, array<string>>")
    joined = lambda x: F.array_join(F.filter(x, lambda v: v != ""), ", ")
    first = lambda m: F.coalesce(F.try_element_at(m, F.lit("eng")), F.get(F.map_values(m), 0))
    inner = F.when(first(as_map).startswith("["), joined(first(as_lists))).otherwise(first(as_map))
    return F.when(raw.startswith("{"), inner).when(raw.startswith("["), joined(F.from_json(raw, "array<string>"))).otherwise(raw)


def ted_notices(landed: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` procurement notices of ``landed(ticker, payload)``; untitled ones go."""
    kind = "notices array<struct<`notice-title`: string, `buyer-name`: string, `buyer-country`: string, `publication-number`: string, `publication-date`: string>>"
    rows = landed.select("ticker", F.explode(F.slice(F.from_json("payload", kind)["notices"], 1, most)).alias("n"))
    title, buyer, country, number = (_language_text(F.col(f"n.`{c}`")) for c in ("notice-title", "buyer-name", "buyer-country", "publication-number"))
    about = F.when(_text(buyer) == "", "").when(_text(country) == "", F.concat(F.lit("Buyer: "), buyer)).otherwise(F.concat(F.lit("Buyer: "), buyer, F.lit(" ("), country, F.lit(")")))
    url = F.when(_text(number) == "", "https://ted.europa.eu/").otherwise(F.concat(F.lit("https://ted.europa.eu/en/notice/-/detail/"), number))
    return _articles(rows, "TED", title, about, F.lit("TED (EU public procurement)"), F.col("n.`publication-date`"), url)


def cik_of_tickers(payload: DataFrame) -> DataFrame:
    """``(ticker, cik)`` of a ``payload`` that maps numbers to companies."""
    rows = payload.select(F.explode(F.map_values(F.from_json("payload", "map<string, struct<cik_str: bigint, ticker: string, title: string>>"))).alias("c"))
    return rows.select(F.upper("c.ticker").alias("ticker"), F.col("c.cik_str").alias("cik")).filter("cik is not null").dropDuplicates(["ticker"])


def sec_filings(landed: DataFrame, ciks: DataFrame, form: str = "8-K", most: int = 3) -> DataFrame:
    """Filings of ``landed(ticker, company, payload)``: hits that name the ticker's own number, each accession once, the first ``most``.

    A ticker without a number has none.
    """
    kind = "hits struct<hits: array<struct<_id: string, _source: struct<ciks: array<string>, display_names: array<string>, file_date: string>>>>"
    hits = landed.select(F.upper("ticker").alias("key"), "ticker", "company", F.posexplode(F.from_json("payload", kind)["hits"]["hits"]).alias("at", "h"))
    own = hits.join(ciks.select(F.col("ticker").alias("key"), "cik"), "key")
    own = own.filter(F.array_contains(F.transform("h._source.ciks", lambda c: c.try_cast("bigint")), F.col("cik")))
    accession = F.get(F.split(F.coalesce("h._id", F.lit("")), ":"), 0)
    own = own.withColumn("accession", accession)
    again = F.row_number().over(Window.partitionBy("ticker", F.when(F.col("accession") == "", F.col("at").cast("string")).otherwise(F.col("accession"))).orderBy("at"))
    once = own.withColumn("again", again).filter("again = 1")
    kept = once.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy("at"))).filter(F.col("place") <= most)
    number = F.ltrim(F.get("h._source.ciks", 0), F.lit("0"))
    base = "https://www.sec.gov/"
    url = F.when((_text(number) != "") & (F.col("accession") != ""), F.concat(F.lit(f"{base}Archives/edgar/data/"), number, F.lit("/"), F.replace("accession", F.lit("-"), F.lit("")), F.lit("/"), "accession", F.lit("-index.htm")))
    url = url.when(_text(number) != "", F.concat(F.lit(f"{base}cgi-bin/browse-edgar?action=getcompany&CIK="), number)).otherwise(F.lit(f"{base}edgar/search/"))
    title = F.concat(F.lit(f"{form} filing: "), F.coalesce(F.get("h._source.display_names", 0), "company"))
    about = F.concat(F.lit("Filed "), _text(F.col("h._source.file_date"), "unknown date"))
    return _articles(kept, "SEC EDGAR", title, about, F.lit("SEC EDGAR"), F.col("h._source.file_date"), url)


def all_articles(parts: list[DataFrame]) -> DataFrame:
    """The articles of all providers in one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# ---------------------------------------------------------------- sentiment


def finnhub_sentiment(landed: DataFrame) -> DataFrame:
    """Aggregated sentiment of ``landed(ticker, payload)``; two zeros mean that nothing was scored."""
    x = F.from_json("payload", "sentiment struct<bullishPercent: double, bearishPercent: double>, buzz struct<articlesInLastWeek: bigint>")
    rows = landed.select("ticker", x["sentiment"]["bullishPercent"].alias("up"), x["sentiment"]["bearishPercent"].alias("down"), x["buzz"]["articlesInLastWeek"].alias("n_articles"))
    known = rows.filter("up is not null and down is not null and not (up = 0 and down = 0)")
    return known.select("ticker", F.lit("Finnhub").alias("provider"), (100 * F.col("up")).alias("bullish_pct"), (100 * F.col("down")).alias("bearish_pct"), (F.col("up") - F.col("down")).alias("score"), "n_articles")


def classified_sentiment(landed: DataFrame, band: float = 0.1) -> DataFrame:
    """Sentiment by ticker of ``landed(ticker, payload)``, a flat or nested list of class scores for each text; texts without a class don't count."""
    flat, nested = F.from_json("payload", "array<struct<label: string, score: double>>"), F.get(F.from_json("payload", "array<array<struct<label: string, score: double>>>"), 0)
    classes = F.filter(F.coalesce(F.when(F.exists(flat, lambda c: c["label"].isNotNull()), flat), nested), lambda c: c["label"].isNotNull())
    share = lambda label: F.aggregate(F.filter("classes", lambda c: c["label"] == label), F.lit(0.0), lambda a, c: a + F.coalesce(c["score"], F.lit(0.0)))
    rows = landed.select("ticker", classes.alias("classes")).filter(F.exists("classes", lambda c: c["label"].isin("positive", "negative")))
    s = F.col("score")
    return rows.select("ticker", (share("positive") - share("negative")).alias("score")).groupBy("ticker").agg(
        F.lit("FinBERT").alias("provider"), (100 * F.avg((s > band).cast("double"))).alias("bullish_pct"), (100 * F.avg((s < -band).cast("double"))).alias("bearish_pct"),
        F.avg(s).alias("score"), F.count("*").alias("n_articles"),
    )


def first_sentiment(*tiers: DataFrame) -> DataFrame:
    """For each ticker the sentiment of the first tier that has one."""
    rows = [df.withColumn("tier", F.lit(i)) for i, df in enumerate(tiers)]
    every = reduce(DataFrame.unionByName, rows)
    rest = [c for c in every.columns if c not in ("ticker", "tier")]
    return every.groupBy("ticker").agg(F.min_by(F.struct(*rest), "tier").alias("x")).select("ticker", "x.*")


# ---------------------------------------------------------------- papers


def semantic_scholar(landed: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` papers of ``landed(query, payload)``."""
    kind = "data array<struct<title: string, authors: array<struct<name: string>>, year: int, url: string, citationCount: bigint, venue: string>>"
    rows = landed.select("query", F.posexplode(F.slice(F.from_json("payload", kind)["data"], 1, most)).alias("at", "p")).filter("p.title <> ''")
    authors = F.filter(F.transform(F.coalesce("p.authors", F.array().cast("array<struct<name:string>>")), lambda a: a["name"]), lambda n: n.isNotNull() & (n != ""))
    return rows.select("query", "at", F.col("p.title").alias("title"), authors.alias("authors"), F.col("p.year").alias("year"), _text(F.col("p.url")).alias("url"), F.col("p.citationCount").alias("citation_count"), _text(F.col("p.venue")).alias("venue"))


def arxiv(landed: DataFrame) -> DataFrame:
    """Papers of ``landed(query, payload)``, an Atom document; white space of titles is collapsed, the year is that of publication."""
    kind = "entry array<struct<id: string, title: string, published: string, author: array<struct<name: string>>>>"
    rows = landed.select("query", F.posexplode(F.from_xml("payload", F.lit(kind))["entry"]).alias("at", "p"))
    title = F.trim(F.regexp_replace("p.title", r"\s+", " "))
    authors = F.filter(F.transform("p.author", lambda a: F.trim(a["name"])), lambda n: n != "")
    out = rows.select("query", "at", title.alias("title"), authors.alias("authors"), F.substring("p.published", 1, 4).try_cast("int").alias("year"), F.trim(_text(F.col("p.id"))).alias("url"), F.lit(None).cast("bigint").alias("citation_count"), F.lit("arXiv").alias("venue"))
    return out.filter("title <> ''")


def merged_papers(first: DataFrame, second: DataFrame, most: int = 3) -> DataFrame:
    """For each query the papers of ``first``, then those of ``second`` whose normal title isn't there yet, ``most`` in all.

    Papers of ``first`` all stay, also with equal titles.
    """
    one, two = first.withColumn("rank", F.lit(0)), second.withColumn("rank", F.lit(1))
    every = one.unionByName(two).withColumn("key", normal_title(F.col("title")))
    seen = F.row_number().over(Window.partitionBy("query", "key").orderBy("rank", "at"))
    once = every.withColumn("seen", seen).filter("rank = 0 or seen = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank", "at"))).filter(F.col("place") <= most).drop("seen", "key", "rank", "at")


def formatted_papers(papers: DataFrame) -> DataFrame:
    """``(query, block)``: a line for each paper in the order of ``place``, for a prompt."""
    year = F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.lit(""))
    who = F.when(F.size("authors") > 0, names_of(F.col("authors"))).otherwise("unknown authors")
    line = F.concat(F.lit("  - "), "title", year, F.lit(" — "), who, F.lit(". "), "url")
    lines = papers.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("x"))
    return lines.select("query", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("block"))
