"""Retrieval of text chunks by TF-IDF and the preparation of texts for scoring, as joins and aggregates.

Terms are runs of two or more letters, digits and underscores of the lower-cased text, without the stop words
given. The query counts as one more document of the index, as far as frequencies go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import written

TERM = r"[\p{L}\p{N}_]{2,}"
#: Chunks and queries of a task, if they have ``CELLS`` distinct terms each; fewer, if more.
CHUNKS, ASKED, CELLS = 65_536, 8_192, 256
#: Terms that are multiplied as matrices; queries multiplied together; products added up at once; chunks, or their terms, multiplied at once.
DENSE, TOGETHER, PRODUCTS, ROWS, HELD = 1_024, 256, 250_000, 2_048, 250_000
#: Terms that all tasks know.
FREQUENT = 65_536
#: Bytes of an Arrow batch, unless the session has a bound of its own.
BATCH_BYTES = 4 << 20
#: The share by which similarities in single precision may be wrong, with a thousandth of a norm's square left out.
SLACK = 1e-3


#: Providers whose items are no news (fixed values).
NO_NEWS = ("SEC EDGAR", "TED")


def chunk_text(title: Column, description: Column) -> Column:
    """``title. description`` without white space around it; null where the title is missing or empty."""
    return F.when(title != "", F.trim(F.concat(title, F.lit(". "), F.coalesce(description, F.lit("")))))


def chunks_of(articles: DataFrame) -> DataFrame:
    """``(chunk_id, text, source, provider, ticker, url)`` of titled ``articles(article_id, ticker, title, ...)``."""
    unknown = lambda c: F.coalesce(c, F.lit("unknown")).alias(c)
    plain = lambda c: F.coalesce(c, F.lit("")).alias(c)
    text = chunk_text(F.col("title"), F.col("description"))
    return articles.filter("title <> ''").select(F.col("article_id").alias("chunk_id"), text.alias("text"), unknown("source"), unknown("provider"), plain("ticker"), plain("url"))


def indexed_text(ticker: Column, text: Column) -> Column:
    """What is searched: the symbol in front of the text, as headlines name the company only."""
    return F.concat_ws(" ", F.coalesce(ticker, F.lit("")), text)


def formatted_chunks(chunks: DataFrame, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, block)``: a line for each chunk in the given order, for a prompt. A block is one string: give chunks that a search has found, by query."""
    line = F.concat(F.lit("  - ["), "provider", F.lit("/"), "source", F.lit(", "), "ticker", F.lit("] "), "text")
    lines = chunks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("x"))
    return lines.filter(F.size("x") > 0).select(*by, F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("block"))


def sentiment_texts(articles: DataFrame, order: str = "article_id") -> DataFrame:
    """``articles`` of news with the ``text`` that is scored: of equal titles the first, without items that have neither title nor description."""
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    news = articles.filter(~F.coalesce("provider", F.lit("")).isin(*NO_NEWS)).filter((trimmed("title") != "") | (trimmed("description") != ""))
    once = first_of_each_title(news, "title", order)
    return once.withColumn("text", F.trim(F.concat(trimmed("title"), F.lit(". "), trimmed("description"))))


def lexicon_scores(texts: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``texts`` with ``score``: the sum of its words' values s, as s / sqrt(s * s + 15); words without a value count 0.

    The lexicon is a parameter and becomes a map in the expression: no join.
    """
    values = F.create_map(*[F.lit(x) for k, v in sorted(lexicon.items()) for x in (k, float(v))])
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z']+"), F.lit(0))
    total = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(values, w), F.lit(0.0)))
    return texts.withColumn("total", total).withColumn("score", F.col("total") / F.sqrt(F.col("total") * F.col("total") + 15)).drop("total")


def normal_title(title: Column) -> Column:
    """A title for comparison: lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))


def first_of_each_title(rows: DataFrame, title: str, order: str) -> DataFrame:
    """Of rows with one normal title the first by ``order``; rows without a title all stay."""
    key = F.nullif(normal_title(F.coalesce(F.col(title), F.lit(""))), F.lit(""))
    place = F.row_number().over(Window.partitionBy(F.coalesce(key, F.concat(F.lit("\0"), F.col(order).cast("string")))).orderBy(order))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _one_row_each(chunks: DataFrame) -> DataFrame:
    """``chunks(chunk_id, text)`` with the texts of a repeated id in one row; only these are shuffled."""
    again = written(chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("chunk_id").alias("again")), "repeated")
    if again.isEmpty():
        return chunks
    same = F.col("chunk_id").eqNullSafe(F.col("again"))
    once = chunks.join(again, same, "left_anti")
    return once.unionByName(chunks.join(again, same, "left_semi").groupBy("chunk_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text")))


def term_counts(chunks: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """``(chunk_id, terms, counts)``: the distinct terms of each row of ``chunks(chunk_id, text)`` and how often it has them."""
    stops = pa.array(stop_words or [], pa.string())

    def tasks(batches):
        for batch in batches:
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            kept = ~pc.is_in(coded.dictionary, stops).to_numpy(zero_copy_only=False)
            code, size = coded.indices.to_numpy(), max(len(coded.dictionary), 1)
            cell, n = np.unique((row * size + code)[kept[code]], return_counts=True)
            ends = pa.array(np.searchsorted(cell, np.arange(len(lists) + 1) * size), pa.int32())
            own = coded.dictionary.take(pa.array(cell % size))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(ends, own), pa.ListArray.from_arrays(ends, pa.array(n, pa.int32()))], names=["chunk_id", "terms", "counts"]
            )

    cut = chunks.select("chunk_id", terms(F.coalesce("text", F.lit(""))).alias("terms"))
    return cut.mapInArrow(tasks, f"chunk_id {dict(chunks.dtypes)['chunk_id']}, terms array<string>, counts array<int>")


def _written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written, with the Arrow batches of its Python tasks bounded by bytes: rows hold whole texts' terms."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None or spark.sparkContext.getConf().get(name) is not None:
        return written(df, label)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        return written(df, label)
    finally:
        spark.conf.unset(name)


def _exploded(rows: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, term, n)`` of rows with arrays ``terms`` and ``counts``."""
    return rows.select(*keys, F.inline(F.arrays_zip("terms", "counts"))).withColumnRenamed("terms", "term").withColumnRenamed("counts", "n")


@dataclass(frozen=True)
class Index:
    """Written tables of a text collection: ``rows(chunk_id, terms, counts)`` and ``vocabulary(term, df, idf, term_id)``, and the number of documents with a query.

    What only some searches need is written when first asked for.
    """

    rows: DataFrame
    vocabulary: DataFrame
    total: int

    @cached_property
    def norms(self) -> DataFrame:
        """``(chunk_id, square)``"""
        weighted = _exploded(self.rows, "chunk_id").join(self.vocabulary.select("term", "idf"), "term")
        return _written(weighted.groupBy("chunk_id").agg(F.sum((F.col("n") * F.col("idf")) ** 2).alias("square")), "norms")

    @cached_property
    def frequent(self) -> DataFrame:
        """``(term, idf, place)``: the ``FREQUENT`` terms that most chunks hold, from place 0 on."""
        first = self.vocabulary.orderBy(F.desc("df"), "term").limit(FREQUENT).select("term", "idf")
        return written(first.coalesce(1).withColumn("place", F.monotonically_increasing_id()), "frequent")

    def coded(self) -> DataFrame:
        """``(chunk_id, ids, counts, square)``: the rows with the terms' ids, and the norms.

        Frequent terms, most of a row, are known to all tasks and stay in their row; only the others meet the vocabulary term by term.
        """
        known = self.frequent.toArrow()
        kind = dict(self.rows.dtypes)["chunk_id"]
        often = self.rows.mapInArrow(lambda batches: _coded(batches, known), f"chunk_id {kind}, ids array<bigint>, counts array<int>, square double")
        cells = _exploded(self.rows, "chunk_id").join(F.broadcast(self.frequent.select("term")), "term", "left_anti").join(self.vocabulary, "term")
        # a structure equals another with the same null in it
        rest = cells.groupBy(F.struct("chunk_id").alias("again")).agg(F.collect_list(F.struct(_seldom("term_id").alias("id"), "n")).alias("x"), F.sum((F.col("n") * F.col("idf")) ** 2).alias("more"))
        both = often.join(rest, F.struct("chunk_id") == F.col("again"), "left")
        ids, counts = F.coalesce("x.id", F.array().cast("array<bigint>")), F.coalesce("x.n", F.array().cast("array<int>"))
        both = both.select("chunk_id", F.concat("ids", ids).alias("ids"), F.concat("counts", counts).alias("counts"), (F.col("square") + F.coalesce("more", F.lit(0.0))).alias("square"))
        return both.filter("square > 0")


def _seldom(term_id: str) -> Column:
    """The id of a term that isn't frequent; a frequent one's is its place."""
    return F.col(term_id) + FREQUENT


def _coded(batches: Iterator[pa.RecordBatch], known: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows of terms with the ids of known terms, without the others, and the sum of their squared weights."""
    terms, idf = known["term"].combine_chunks(), known["idf"].to_numpy()
    for batch in batches:
        lists = batch["terms"]
        at = pc.index_in(pc.list_flatten(lists), value_set=terms)
        held = pc.is_valid(at)
        place, n = at.filter(held).to_numpy(), pc.list_flatten(batch["counts"]).filter(held)
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())[held.to_numpy(zero_copy_only=False)]
        ends = pa.array(np.searchsorted(row, np.arange(len(lists) + 1)), pa.int32())
        square = np.bincount(row, (n.to_numpy() * idf[place]) ** 2, len(lists))
        ids = pa.ListArray.from_arrays(ends, pa.array(place, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch["chunk_id"], ids, pa.ListArray.from_arrays(ends, n), pa.array(square, pa.float64())], names=["chunk_id", "ids", "counts", "square"])


def index_of(chunks: DataFrame, stop_words: list[str] | None = None) -> Index:
    """Texts are read and cut once, into a row each; a term's frequency, weights and the chunks' norms follow from these rows.

    Frequencies are summed before their shuffle. The vocabulary grows with the texts; it meets the terms of the rows term by term, where a term that
    most chunks hold is a skewed key with one row on the other side, which Spark splits.
    """
    rows = _written(term_counts(_one_row_each(chunks), stop_words), "terms")
    total = chunks.count() + 1
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((1 + F.lit(total)) / (1 + F.col("df"))) + 1
    return Index(rows, written(df.select("term", "df", idf.alias("idf"), F.monotonically_increasing_id().alias("term_id")), "vocabulary"), total)


def similar_chunks(chunks: DataFrame | Index, query: str | DataFrame, k: int, stop_words: list[str] | None = None) -> DataFrame:
    """``(query_id, chunk_id, similarity)``: for each row of ``query(query_id, text)`` the ``k`` chunks of ``chunks(chunk_id, text)``, or of
    their index, most like it, above 0; for a single text ``(chunk_id, similarity)``.

    Each query counts on its own as one more document. Ties (to nine digits) keep the order of the ids. A single text meets the chunks by
    term; many texts meet them by blocks (``_nearest``). A chunk's norm depends on the query only in the query's own terms, whose share is
    exchanged in the sum.
    """
    index = chunks if isinstance(chunks, Index) else index_of(chunks, stop_words)
    spark = index.rows.sparkSession
    single = isinstance(query, str)
    if single:
        query = spark.range(1).select(F.col("id").alias("query_id"), F.lit(query).alias("text"))
    asked = _exploded(term_counts(_one_row_each(query.select(F.col("query_id").alias("chunk_id"), "text")), stop_words), F.col("chunk_id").alias("query_id"))
    asked = asked.withColumnRenamed("n", "q")
    # with the query as a document its terms are in one document more
    idf = lambda seen: F.ln((1 + F.lit(index.total)) / (1 + seen)) + 1
    own = asked.join(index.vocabulary, "term", "left").select("query_id", "term", "term_id", "q", "df", idf(F.coalesce("df", F.lit(0)) + 1).alias("own"), idf(F.coalesce("df", F.lit(0))).alias("idf"))
    own = _written(own, "asked")
    order = [F.round("similarity", 9).desc(), "chunk_id"]
    if not single:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
        return _nearest(index, own, k).withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")
    q_norm = own.groupBy("query_id").agg(F.sqrt(F.sum((F.col("q") * F.col("own")) ** 2)).alias("q_norm"))
    pairs = _exploded(index.rows, "chunk_id").join(F.broadcast(own), "term").groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("n") * F.col("q") * F.col("own") ** 2).alias("dot"),
        F.sum(F.col("n") ** 2 * (F.col("own") ** 2 - F.col("idf") ** 2)).alias("more"),
    )
    norm = F.sqrt(F.col("square") + F.col("more")) * F.col("q_norm")
    scored = pairs.filter("dot > 0").join(index.norms, "chunk_id").join(q_norm, "query_id")
    return scored.select("chunk_id", F.try_divide(F.col("dot"), norm).alias("similarity")).orderBy(*order).limit(k)


def _nearest(index: Index, own: DataFrame, k: int) -> DataFrame:
    """``(query_id, chunk_id, similarity)``: for each query its ``k`` most similar chunks of each of some parts of the chunks, so of all.

    A task keeps a block of queries, compactly, and its part of the chunks passes by in batches; so its memory is bounded by the queries' terms (``ASKED``
    of ``CELLS``). A row goes to as many tasks as there are blocks of the other side. Which chunks can be among the ``k`` is told by similarities in
    single precision (``_multiplied``); these are scored exactly, and the best ``k`` so far are carried on.
    """
    n_chunks, c_cells = index.rows.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    n_asked, q_cells = own.agg(F.count_distinct("query_id"), F.count("*")).first()
    by, to = (max(1, -(-max(n, cells // CELLS) // most)) for n, cells, most in ((n_chunks, c_cells, CHUNKS), (n_asked, q_cells, ASKED)))
    cores = own.sparkSession.sparkContext.defaultParallelism
    by = max(by + -by % cores if n_chunks > CHUNKS else by, min(2 * cores, -(-n_chunks // 1_024)))  # all cores get as many parts
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kinds = {"query_id": dict(own.dtypes)["query_id"], "chunk_id": dict(index.rows.dtypes)["chunk_id"]}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    known = F.when(F.col("term_id").isNotNull(), F.struct(F.coalesce("place", _seldom("term_id")).alias("id"), "q", "df"))
    asked = own.join(F.broadcast(index.frequent.select("term", "place")), "term", "left").groupBy("query_id").agg(F.collect_list(known).alias("x"), (1 / F.sqrt(F.sum((F.col("q") * F.col("own")) ** 2))).alias("scale"))
    asked = asked.select(every(by).alias("a"), deal("query_id", to).alias("b"), F.lit(0).alias("side"), "query_id", none("chunk_id"), F.col("x.id").alias("ids"), F.col("x.q").alias("counts"), F.col("x.df").alias("dfs"), "scale")
    passed = index.coded().select(deal("chunk_id", by).alias("a"), every(to).alias("b"), F.lit(1).alias("side"), none("query_id"), "chunk_id", "ids", "counts", F.lit(None).cast("array<bigint>").alias("dfs"), (1 / F.sqrt("square")).alias("scale"))
    dealt = asked.unionByName(passed).withColumn("part", F.col("a") * to + F.col("b")).drop("a", "b")
    dealt = dealt.repartitionById(by * to, "part").sortWithinPartitions("part", "side")
    total, schema = index.total, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, similarity double"
    return _written(dealt.mapInArrow(lambda batches: _passed(batches, total, k), schema), "nearest")


def _passed(batches: Iterator[pa.RecordBatch], total: int, k: int) -> Iterator[pa.RecordBatch]:
    """Of each part, whose queries come first, ``(query_id, chunk_id, similarity)``: the ``k`` chunks most like each query. No more than a batch of chunks is held."""
    part, search, waiting, cells = None, None, [], 0
    for batch in _runs(batches, "part", "side"):
        if batch["part"][0].as_py() != part:
            if search:
                yield from search.found(waiting)
            part, search, waiting, cells = batch["part"][0].as_py(), None, [], 0
        if batch["side"][0].as_py() == 0:
            waiting.append(_weighted(batch, total))
            continue
        if search is None:
            if not waiting:  # chunks without queries
                continue
            search = _Search(_asked(waiting), k)
        for at in range(0, len(batch), ROWS):
            waiting.append(batch[at : at + ROWS])
            cells += pc.sum(pc.list_value_length(waiting[-1]["ids"])).as_py()
            if cells >= HELD or sum(map(len, waiting)) >= ROWS:
                search.meet(waiting)
                waiting, cells = [], 0
    if search:
        yield from search.found(waiting)


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut where a key changes; only neighbouring rows of a batch are compared, so a run may come in several."""
    for batch in batches:
        new = np.zeros(max(len(batch) - 1, 0), bool)
        for c in keys:
            new |= np.diff(batch[c].to_numpy()) != 0
        ends = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
        yield from (batch[i:j] for i, j in zip(ends, ends[1:]) if i < j)


class _Asked(NamedTuple):
    """Queries as cells, a query's terms one after the other, and their terms by id."""

    query_id: pa.Array
    first: np.ndarray  # a query's first cell
    term: np.ndarray  # a cell's term, by its place
    weight: np.ndarray  # a cell's scaled weight
    known: np.ndarray  # the terms' ids, ascending
    n: np.ndarray  # a term's cells
    change: np.ndarray  # what a query with the term adds to its squared weight, 0 if below a thousandth
    whole: np.ndarray  # the same, whatever it is


class _Block(NamedTuple):
    """Chunks as cells: the terms, by place, that some query has."""

    chunk_id: pa.ChunkedArray
    scale: np.ndarray
    row: np.ndarray
    term: np.ndarray
    count: np.ndarray


def _flat(rows: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    return pc.list_flatten(rows[column]).to_numpy()


def _piece(rows: pa.RecordBatch | pa.Table, weight: np.ndarray, change: np.ndarray, whole: np.ndarray) -> tuple:
    """Queries with their terms by place among these queries' own; all cells of a term share its changes."""
    size = pc.list_value_length(rows["ids"]).to_numpy()
    known, at, term = np.unique(_flat(rows, "ids"), return_index=True, return_inverse=True)
    return rows["query_id"], size, term.astype(np.int32), weight * np.repeat(rows["scale"].to_numpy(), size), known, change[at], whole[at]


def _weighted(rows: pa.RecordBatch, total: int) -> tuple:
    """A piece from the terms' counts and frequencies among ``total`` documents."""
    df = _flat(rows, "dfs")
    idf, own = (np.log((1 + total) / (1 + seen)) + 1 for seen in (df, df + 1))
    change = own**2 - idf**2
    return _piece(rows, _flat(rows, "counts") * own**2, np.where(change < -1e-3 * idf**2, change, 0.0), change)


def _asked(pieces: list[tuple]) -> _Asked:
    """Takes the pieces out of their list, so that no cell is held twice."""
    size, known = np.concatenate([x[1] for x in pieces]), np.unique(np.concatenate([x[4] for x in pieces]))
    ids = pa.concat_arrays([y for x in pieces for y in (x[0].chunks if isinstance(x[0], pa.ChunkedArray) else [x[0]])])
    first = np.concatenate([[0], np.cumsum(size)])
    term, weight, n, (change, whole) = np.empty(first[-1], np.int32), np.empty(first[-1]), np.zeros(len(known), np.int64), np.zeros((2, len(known)))
    at = 0
    while pieces:
        _, _, own, scaled, ids_of, change_of, whole_of = pieces.pop(0)
        place = np.searchsorted(known, ids_of)
        change[place], whole[place] = change_of, whole_of
        term[at : at + len(own)], weight[at : at + len(own)] = place[own], scaled
        n[place] += np.bincount(own, minlength=len(place))
        at += len(own)
    return _Asked(ids, first, term, weight, known, n, change, whole)


def _block(chunks: pa.Table, known: np.ndarray) -> _Block:
    row = np.repeat(np.arange(len(chunks)), pc.list_value_length(chunks["ids"]).to_numpy())
    ids = _flat(chunks, "ids")
    place = np.minimum(np.searchsorted(known, ids), max(len(known) - 1, 0))
    held = known[place] == ids if len(known) else np.zeros(len(ids), bool)
    return _Block(chunks["chunk_id"], chunks["scale"].to_numpy(), row[held], place[held], _flat(chunks, "counts")[held].astype(np.float64))


def _multiplied(chunks: pa.Table | _Block, asked: pa.Table | _Asked, k: int, floor: np.ndarray | None = None) -> pa.Table:
    """Of a block of chunks and one of queries, the pairs that can be among a query's ``k`` and reach its ``floor``: ``(q, c, query_id, chunk_id, low, high)``,
    by places and ids.

    Similarities in single precision, whose norms hold the query's share for the terms that it changes by more than a thousandth, are right to
    ``SLACK``; a chunk whose most is below the ``k``-th least of its query can't be among the ``k``. Products of the terms that most pairs share
    are one of matrices; those of the others are added up pair by pair.
    """
    if isinstance(asked, pa.Table):
        change = _flat(asked, "changes")
        asked = _asked([_piece(asked, _flat(asked, "counts"), change, change)])
    if isinstance(chunks, pa.Table):
        chunks = _block(chunks, asked.known)
    n, n_asked, n_known = len(chunks.scale), len(asked.query_id), len(asked.known)
    floor = np.zeros(n_asked) if floor is None else floor
    order = np.argsort(chunks.term, kind="stable")
    c_row, c_term = chunks.row[order], chunks.term[order]
    c_weight = (chunks.count[order] * chunks.scale[c_row]).astype(np.float32)
    met = np.bincount(c_term, minlength=n_known)
    start = np.concatenate([[0], np.cumsum(met)])

    dense = np.argpartition(-met * asked.n, DENSE)[:DENSE] if n_known > DENSE else np.arange(n_known)
    column = np.full(n_known, -1)
    column[dense] = np.arange(len(dense))
    common = column[c_term] >= 0
    matrix = np.zeros((len(dense), n), np.float32)
    matrix[column[c_term[common]], c_row[common]] = c_weight[common]

    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, n_asked, TOGETHER):
        end = min(at + TOGETHER, n_asked)
        own = slice(asked.first[at], asked.first[end])
        row, term = np.repeat(np.arange(end - at), np.diff(asked.first[at : end + 1])), asked.term[own]
        weight, change = asked.weight[own].astype(np.float32), asked.change[term].astype(np.float32)
        is_dense = column[term] >= 0
        some = np.zeros((end - at, len(dense)), np.float32)
        some[row[is_dense], column[term[is_dense]]] = weight[is_dense]
        total, less = some @ matrix, np.ones((end - at, n), np.float32)
        for into, factor, power, used in ((total, weight, 1, ~is_dense), (less, change, 2, change < 0)):
            used &= met[term] > 0
            r, t, f = row[used], term[used], factor[used]
            size = met[t]
            upto, i = np.cumsum(size), 0
            while i < len(r):  # some products at a time
                j = max(i + 1, int(np.searchsorted(upto, upto[i] - size[i] + PRODUCTS, "right")))
                which = np.repeat(np.arange(i, j), size[i:j])
                cell = np.arange(len(which)) - np.repeat(upto[i:j] - size[i:j] - upto[i] + size[i], size[i:j]) + start[t[which]]
                np.add.at(into.reshape(-1), r[which] * n + c_row[cell], f[which] * c_weight[cell] ** power)
                i = j
        total /= np.sqrt(np.maximum(less, 1e-6))
        least = floor[at:end] * (1 - 1e-6)
        if n > k and (least <= 0).any():
            least = np.maximum(least, np.partition(total, n - k, axis=1)[:, n - k] * (1 - SLACK))
        q, c = np.nonzero((total > 0) & (total >= (least / (1 + SLACK)).astype(np.float32)[:, None]))
        out.append((q + at, c, total[q, c]))
    q, c, like = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))
    like = like.astype(np.float64)
    return pa.table(
        [pa.array(q), pa.array(c), asked.query_id.take(pa.array(q)), chunks.chunk_id.take(pa.array(c)), pa.array(like * (1 - SLACK)), pa.array(like * (1 + SLACK))],
        names=["q", "c", "query_id", "chunk_id", "low", "high"],
    )


def _scored(chunks: _Block, asked: _Asked, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Similarities, in double precision, of pairs by places; a query's pairs stand together."""
    first = np.searchsorted(chunks.row, np.arange(len(chunks.scale) + 1))
    like, own = np.zeros(len(q)), np.zeros(len(asked.known))
    ends = [0, *(np.flatnonzero(np.diff(q)) + 1).tolist(), len(q)]
    for i, j in zip(ends, ends[1:]):
        if i == j:
            continue
        cells = slice(asked.first[q[i]], asked.first[q[i] + 1])
        own[asked.term[cells]] = asked.weight[cells]
        begin = first[c[i:j]]
        size = first[c[i:j] + 1] - begin
        upto = np.cumsum(size)
        cell = np.arange(upto[-1]) + np.repeat(begin - upto + size, size)
        weight = own[chunks.term[cell]]
        shared = np.flatnonzero(weight > 0)
        cell, pair, weight = cell[shared], np.searchsorted(upto, shared, "right"), weight[shared]
        n = chunks.count[cell]
        more = np.bincount(pair, asked.whole[chunks.term[cell]] * n * n, j - i)
        like[i:j] = np.bincount(pair, weight * n, j - i) / np.sqrt(1 / chunks.scale[c[i:j]] ** 2 + more)
        own[asked.term[cells]] = 0
    return like


class _Search:
    """The ``k`` chunks most like each query, of those that have passed by."""

    def __init__(self, asked: _Asked, k: int):
        self.asked, self.k = asked, k
        self.floor = np.zeros(len(asked.query_id))  # what a chunk has to reach
        self.best: list[pa.Table] = []
        self.kept = 0

    def meet(self, batches: list[pa.RecordBatch]) -> None:
        chunks = _block(pa.Table.from_batches(batches), self.asked.known)
        pairs = _multiplied(chunks, self.asked, self.k, self.floor)
        q = pairs["q"].to_numpy()
        like = _scored(chunks, self.asked, q, pairs["c"].to_numpy())
        digits = np.floor(like * 1e9 + 0.5)
        found = pa.table([pairs["q"], pa.array(-digits), pairs["chunk_id"], pa.array(like)], names=["q", "less", "chunk_id", "similarity"])
        self.best.append(found.filter(pa.array(like >= self.floor[q])))
        if sum(map(len, self.best)) > 1.5 * self.kept:
            self.cut()

    def cut(self) -> None:
        rows = pa.concat_tables(self.best)
        rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("q", "less", "chunk_id")], null_placement="at_start")).combine_chunks()
        q = rows["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, np.arange(len(self.floor)))[q]
        last = place == self.k - 1
        self.floor[q[last]] = (-rows["less"].to_numpy()[last] - 1) / 1e9
        self.best = [rows.filter(pa.array(place < self.k))]
        self.kept = len(self.best[0])

    def found(self, batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        if batches:
            self.meet(batches)
        self.cut()
        rows = self.best[0]
        named = pa.table([self.asked.query_id.take(rows["q"].combine_chunks()), rows["chunk_id"], rows["similarity"]], names=["query_id", "chunk_id", "similarity"])
        return named.to_batches(max_chunksize=10_000)


def verdict_rate(answers: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Number of judged answers and the share whose verdict begins with the word PASS."""
    passed = F.coalesce(F.col(verdict).rlike(r"(?i)^[\W_]*PASS\b"), F.lit(False))
    return answers.agg(F.count("*").alias("n"), F.avg(passed.cast("double")).alias("pass_rate"))
