"""Near-duplicate embeddings: HNSW graphs per shard, beams widened until audits pass, components of the links.

Vectors of one label and dimension are dealt into shards of about ``SHARD`` by a hash of their id; each
shard gets a graph. Every shard queries every shard of its label (itself included), both ways in one
task, so a link that either way finds counts for both ends. Per pair of shards the beam starts at
``EF`` and is doubled until an audit passes: for ``AUDIT`` queries, exhaustive search must find no link
that was missed, and the nearest vector must have been found in at least ``NEAREST`` of the cases (a
stricter test, as a chance neighbour is harder to reach than a copy). If no beam up to ``WIDEST``
passes, that pair of shards is compared exhaustively, in blocks. Around every hit the graph is
flooded, which finds the rest of a dense group. Links are confirmed by the cosine in double precision.

Vectors are scaled by a power of two to a largest part between 1/2 and 1, so that no square overflows or vanishes. Exactly equal
vectors are one node with a weight, so groups of copies of any size cost one vector. A node is known by a 64-bit hash of label,
dimension and vector. A shard's graph and vectors are a file in the shared folder; only file names are joined, and a task reads
the files of its pairs. Queries run in blocks of ``QUERIES``, and a pair of vectors that link is one bit of the task's matrix of two
shards (8 MB), so a group in which all vectors link with all takes no more memory than one without links. The task hands on each
vector's sum of weights and a star for each local component, not the pairs.

Vectors that are null, empty, zero, or hold null or non-finite parts, and those with null label or id,
link with nothing: 0 links, component of their own (null for a null id). Different dimensions don't link.
Rows with equal ids are separate vectors for the counts and one node for the components.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, open_store, shared_dir
from .graph import components
from .hnsw import Hnsw

THRESHOLD, SHARD, EF, WIDEST, AUDIT, NEAREST = 0.98, 8192, 96, 1024, 64, 0.98
QUERIES, READS = 256, 16  # QUERIES is a multiple of 8


def _clean(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, dim, v binary)``: the parts as doubles, null where the vector can't be compared."""

    def tasks(batches):
        for batch in batches:
            column = batch.column(2).cast(pa.list_(pa.float64()))
            out = []
            for row in column:
                v = None
                if row.is_valid and len(row.values) and not row.values.null_count:
                    x = row.values.to_numpy(zero_copy_only=False)
                    top = float(np.abs(x).max())
                    # + 0.0: no negative zeros, which would make other bytes
                    v = (np.ldexp(x, -int(np.frexp(top)[1])) + 0.0).tobytes() if np.isfinite(top) and top > 0 else None
                out.append(v)
            binary = pa.array(out, pa.binary())
            dim = pc.cast(pc.divide(pc.binary_length(binary), 8), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), dim, binary], names=["vec_id", "label", "dim", "v"])

    picked = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")
    return picked.mapInArrow(tasks, "vec_id long, label string, dim long, v binary")


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _shards(nodes: DataFrame, folder: str) -> DataFrame:
    """``(label, dim, file)``: a file for each shard of ``nodes`` with its vectors and their graph."""
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    dealt = nodes.join(F.broadcast(sizes) if sizes.count() < 10_000 else sizes, ["label", "dim"]).withColumn(
        "shard", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SHARD))
    )

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("node").combine_chunks()
        vectors = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(len(table), -1)
        graph = Hnsw.build(_unit(vectors).astype(np.float32))
        fs, path = open_store(folder)
        fs.create_dir(path, recursive=True)
        name = f"shard-{uuid.uuid4().hex}"
        packed = io.BytesIO()
        np.savez(
            packed, nodes=table.column("node").to_numpy(), reps=table.column("rep").to_numpy(), weights=table.column("weight").to_numpy(), vectors=vectors,
            levels=graph.levels, **{f"l{i}": x for i, x in enumerate(graph.links)},
        )
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(packed.getvalue())
        return pa.table({"label": [key[0].as_py()], "dim": [key[1].as_py()], "file": [name]})

    return dealt.groupBy("label", "dim", "shard").applyInArrow(build, "label string, dim long, file string")


class Shard:
    def __init__(self, nodes: np.ndarray, reps: np.ndarray, weights: np.ndarray, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray]):
        self.nodes, self.reps, self.weights, self.unit = nodes, reps, weights, _unit(vectors)
        self.graph = Hnsw(self.unit.astype(np.float32), levels, links)

    @classmethod
    def read(cls, uri: str) -> Shard:
        fs, path = open_store(uri)
        with fs.open_input_stream(path, compression=None) as source:
            x = np.load(io.BytesIO(source.read()))
        links = [x[f"l{i}"] for i in range(sum(k[0] == "l" and k[1:].isdigit() for k in x.files))]
        return cls(x["nodes"], x["reps"], x["weights"], x["vectors"], x["levels"], links)

    def _found(self, q: np.ndarray, ef: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Which vectors of the shard each query links with (query x vector), and the similarities of its beam."""
        q32 = q.astype(np.float32)
        ids, sims = self.graph.search(q32, min(ef, len(self.reps)))
        hit = np.zeros((len(q), len(self.reps)), bool)
        for i in np.flatnonzero((sims >= threshold - 1e-4).any(1)).tolist():
            mine = ids[i][(sims[i] >= threshold - 0.04) & (ids[i] >= 0)]
            hit[i, self.graph.flood(q32[i], mine, threshold - 0.04)] = True
        rows, cols = np.nonzero(hit)
        step = max(1, 4_000_000 // q.shape[1])
        for a in range(0, len(rows), step):
            r, c = rows[a : a + step], cols[a : a + step]
            hit[r, c] = np.einsum("ij,ij->i", q[r], self.unit[c]) >= threshold
        return hit, sims

    def beam(self, q: np.ndarray, threshold: float) -> int | None:
        """The first beam that passes the audit of ``AUDIT`` of the queries, or None."""
        asked = q[np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))]
        exact = asked @ self.unit.T
        np.putmask(exact, exact > 1 - 1e-12, -1.0)  # itself is no test
        ef = EF
        while True:
            hit, sims = self._found(asked, ef, threshold)
            itself = sims > 1 - 1e-6
            best = np.where(itself & (np.cumsum(itself, 1) == 1), -2.0, sims).max(1)
            reached = best >= exact.max(1) - 0.01
            if reached.mean() >= NEAREST and not (~hit & (exact >= threshold + 1e-12)).any():
                return ef
            if ef >= min(len(self.reps), WIDEST):
                return None
            ef *= 2

    def hits(self, q: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """Blocks of ``QUERIES`` of the queries: the first's place and which of the shard's vectors each links with, among them itself if it is here."""
        ef = self.beam(q, threshold)
        for a in range(0, len(q), QUERIES):
            own = q[a : a + QUERIES]
            # without a beam there are parts of the graph that no walk reaches: all of the shard
            yield a, own @ self.unit.T >= threshold if ef is None else self._found(own, ef, threshold)[0]


class Links:
    """Which of ``n`` vectors link with which of ``m`` others: a bit for each pair, whatever the number of links."""

    def __init__(self, n: int, m: int):
        self.m, self.bits = m, np.zeros((n, -(-m // 8)), np.uint8)

    def add_rows(self, at: int, hit: np.ndarray) -> None:
        self.bits[at : at + len(hit)] |= np.packbits(hit, axis=1)

    def add_columns(self, at: int, hit: np.ndarray) -> None:
        packed = np.packbits(hit.T, axis=1)
        self.bits[:, at // 8 : at // 8 + packed.shape[1]] |= packed

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        for a in range(0, len(self.bits), QUERIES):
            yield a, np.unpackbits(self.bits[a : a + QUERIES], axis=1, count=self.m).astype(bool)


def _least_labels(links: Links, first: int) -> np.ndarray:
    """The least place that each vector reaches over links; those of ``links``' columns begin at place ``first``."""
    label = np.arange(first + links.m)
    while True:
        new = label.copy()
        for at, hit in links.blocks():
            a, b = np.nonzero(hit)
            a, b = a + at, b + first
            low = np.minimum(new[a], new[b])
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(one: Shard, two: Shard, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector of both shards (of one, if they are the same) the sum of weights it links with and the least place in its component."""
    n, m, same = len(one.reps), len(two.reps), one is two
    links = Links(n, m)
    for at, hit in two.hits(one.unit, threshold):
        links.add_rows(at, hit)
        if same:
            links.add_columns(at, hit)
    if not same:
        for at, hit in one.hits(two.unit, threshold):
            links.add_columns(at, hit)
    left, right = np.zeros(n), np.zeros(m)
    weights = one.weights.astype(float), two.weights.astype(float)
    for at, hit in links.blocks():
        left[at : at + len(hit)] = hit @ weights[1]
        right += weights[0][at : at + len(hit)] @ hit
    if same:
        own = np.array([hit[i, at + i] for at, hit in links.blocks() for i in range(len(hit))])
        return left - own * weights[0], _least_labels(links, 0)
    return np.concatenate([left, right]), _least_labels(links, n)


def _linked(shards: DataFrame, folder: str, threshold: float) -> DataFrame:
    """``(node, rep, links, other)``: weights of the linked nodes, by pair of shards, and a link that spans the local component."""
    left = shards.select("label", "dim", F.col("file").alias("a"))
    right = shards.select("label", "dim", F.col("file").alias("b"))
    place = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    pairs = materialise(left.join(right, ["label", "dim"]).filter("a <= b").select("a", "b", place.alias("place")), "shard-pairs")

    def tasks(batches):
        kept: dict[str, Shard] = {}

        def shard(name: str, other: str) -> Shard:
            for old in [x for x in kept if x not in (name, other)]:
                del kept[old]
            if name not in kept:
                kept[name] = Shard.read(f"{folder}/{name}")
            return kept[name]

        for batch in batches:
            for name_a, name_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one, two = shard(name_a, name_b), shard(name_b, name_a)
                sums, label = compare(one, two, threshold)
                both = [one] if one is two else [one, two]
                reps, nodes = np.concatenate([x.reps for x in both]), np.concatenate([x.nodes for x in both])
                some = np.flatnonzero(sums > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[some]), pa.array(reps[some]), pa.array(sums[some].astype(np.int64)), pa.array(reps[label[some]])],
                    names=["node", "rep", "links", "other"],
                )

    # the rows are names only: a number of tasks that is given isn't lowered to fit their few bytes. Where there are more pairs than
    # the cluster has room for at once, a task has up to READS pairs of one shard, which it reads once
    n, room = pairs.count(), 4 * shards.sparkSession.sparkContext.defaultParallelism
    each = min(READS, max(1, n // room))
    dealt = pairs.withColumn("turn", F.floor((F.col("place") - 1) / each)).repartition(max(1, min(-(-n // each), 100_000)), "a", "turn")
    return dealt.sortWithinPartitions("a", "b").select("a", "b").mapInArrow(tasks, "node long, rep long, links long, other long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors(vec_id, embedding, label)``."""
    clean = materialise(_clean(vectors), "vectors")
    able = clean.filter("v is not null and label is not null and vec_id is not null")
    nodes = able.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    nodes = nodes.withColumn("node", F.xxhash64("label", "dim", "v"))
    folder = shared_dir(vectors.sparkSession, "hnsw-files")
    linked = materialise(_linked(materialise(_shards(nodes, folder), "hnsw"), folder, threshold), "vector-links")
    # the least id of a class stands for it in the components; rows of one id are one node there
    ends = linked.select(F.col("rep").alias("a"), F.col("other").alias("b")).filter("a <> b")
    same = able.join(nodes, ["label", "dim", "v"]).filter("vec_id <> rep").join(able.groupBy("vec_id").agg(F.count("*").alias("k")).filter("k > 1"), "vec_id")
    labels = components(ends.unionByName(same.select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))), "vector-components")
    sums = linked.groupBy("node").agg(F.sum("links").alias("links"))
    per_node = nodes.join(sums, "node", "left").join(labels, nodes["rep"] == labels["id"], "left").select(
        "label", "dim", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"),
        F.coalesce("component", "rep").alias("c"),
    )
    out = clean.join(per_node, ["label", "dim", "v"], "left")
    own = F.coalesce("c", "vec_id")
    return out.select(
        "vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), own).alias("component_id"),
        (F.col("vec_id") == own).alias("kept"),
    )


def op3_hnsw_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
