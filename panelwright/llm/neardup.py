"""Near-duplicate documents by a chosen-path similarity join over word shingles.

Documents are sets of 5-word shingles. Equal sets are one class from the start, so groups of exact
copies of any size cost one row. Each class gets ``HASHES`` minwise values. A trial is a tree: at a
node, the node's own path picks minwise coordinates (``WAYS``), and the node's classes branch by their
value there. A node of at most ``SMALL`` classes is compared exhaustively (by its minwise values); larger
ones branch again, to ``DEPTH`` levels. ``TREES`` independent trials: a pair of similarity s meets in one
tree that ends at level d with probability s^d, in one of ten with 1 - (1 - s^d)^10: 1 - 6e-9 for s = 0.85, d = 1,
and 0.99992 for d = 3; for s = 0.80 (the pipeline's threshold) 1 - 1e-7 for d = 1, and 0.9992 for d = 3.

A group of near copies stays large for many levels, so every large node is also contracted. On the first level its
classes are dealt into random blocks of about half of ``SMALL`` that are compared exhaustively, which
tells how central each class is (its mean similarity); on every level all classes of a large node are compared with its most
central one, the hub. Both are linear in the node. Links found on the first level are confirmed and their
components taken; below it, nodes whose classes are all of one component end, and only classes of different
components are compared. Nodes that are still large at the last level, or from level ``LATE`` on hold ``KEPT`` of their parent's
classes, are compared exhaustively, part by part, by full shingle sets, so that classes that are near the group but linked
with nothing make no candidates.

Candidate pairs are confirmed on full shingle sets: first, for each class, its best and its least
partner, then, after a round of components, every pair whose ends still lie apart. Pairs inside a
component can't change it, so no candidate between different components is left out. ``recall`` measures what
the trees miss, for every document whose id is divisible by 50 against all.

Null or empty text, or one without words: no shingles, linked with nothing, component of its own.
Rows with one doc_id are one document (linked with each other); a null doc_id gets null component
and kept null. Only ``doc_id`` and ``text`` are read, so other columns may have any name. Ids may be any long.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_text, materialise, mix, row_blocks, shingle_keys
from .graph import components

WIDTH, HASHES, TREES, DEPTH, SMALL = 5, 96, 10, 6, 24
#: Coordinates that a node picks at a level (1 elsewhere).
WAYS = {2: 2}
#: From level ``LATE`` on, a large node that holds this share of its parent's classes is compared whole: branching doesn't make it small.
LATE, KEPT = 4, 0.75
#: Links have 100 * |A n B| >= PERCENT * |A u B|.
PERCENT = 85
#: Standard deviations of the minwise estimate below the threshold that still make a candidate.
SLACK = 4.5
#: Rows of a part of a node that is compared whole, bytes of its texts, and shingles that its tasks count at a time.
GRID, GRID_BYTES, COLUMNS = 512, 8 << 20, 2048
#: Rows of a node that meet one copy of its hub.
HUB_ROWS = 2000
#: Candidate ids that are still broadcast to the scan of the texts.
BROADCAST_IDS = 1_000_000

_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def estimate_floor(percent: int, hashes: int = HASHES) -> float:
    s = percent / 100
    return s - SLACK * (s * (1 - s) / hashes) ** 0.5


# ---------------------------------------------------------------- sketches


def text_number(column: str) -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(column)


def sketch(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_shingles, set_id, sig, own)``: set size, 128-bit id of the set, minwise values (null if empty), number of the text."""

    def tasks(batches):
        for batch in batches:
            for a, b in row_blocks(batch.column(1)):
                keys, sizes, wide = shingle_keys(*flat_text(batch.column(1).slice(a, b - a)), width, wide=True)
                full = np.flatnonzero(sizes)
                h = keys & np.uint64((1 << 52) - 1)
                first = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
                sig = np.empty((len(full), HASHES), np.uint32)
                names = np.zeros((len(full), 2), np.uint64)
                if len(full):
                    for j in range(HASHES):
                        sig[:, j] = np.minimum.reduceat((h * _A[j] + _B[j]) >> np.uint64(32), first)
                    for j in range(2):
                        names[:, j] = np.add.reduceat(mix(wide ^ _B[j]), first)
                set_id, sigs = [None] * (b - a), [None] * (b - a)
                for i, at in enumerate(full.tolist()):
                    set_id[at], sigs[at] = names[i].tobytes(), sig[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(set_id, pa.binary()), pa.array(sigs, pa.binary()), batch.column(2).slice(a, b - a)],
                    names=["doc_id", "n_shingles", "set_id", "sig", "own"],
                )

    own = text_number("text").alias("own")
    return docs.select(F.col("doc_id").cast("long"), "text", own).mapInArrow(
        tasks, "doc_id long, n_shingles long, set_id binary, sig binary, own long"
    )


def class_number() -> Column:
    """The number of a class in the trees and links."""
    return F.xxhash64("set_id")


def _sigs(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint32).reshape(len(column), HASHES)


def _estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shares of equal minwise values of two rows of equal places."""
    parts = [(x[k : k + 20000] == y[k : k + 20000]).mean(1, dtype=np.float32) for k in range(0, len(x), 20000)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


# ---------------------------------------------------------------- the trees


def _branch(parents: DataFrame, level: int) -> DataFrame:
    """Children of ``parents(rep, sig, node, ...)``: the same columns without ``sig``, ``node`` being the child."""
    rest = [c for c in parents.columns if c not in ("sig", "node")]
    kinds = dict(parents.dtypes)

    def tasks(batches):
        for batch in batches:
            sig = _sigs(batch.column(0))
            node = np.asarray(batch.column(1), np.int64).view(np.uint64)
            draw = mix(node ^ np.uint64(level * 0x51ED2701))
            step = np.uint64(1) + mix(draw) % np.uint64(HASHES - 1)
            for way in range(WAYS.get(level, 1)):  # two ways never pick the same coordinate
                pick = (draw % np.uint64(HASHES) + np.uint64(way) * step) % np.uint64(HASHES)
                value = sig[np.arange(len(sig)), pick.astype(np.int64)].astype(np.uint64)
                child = mix(mix(node + pick) + value * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(child), *batch.columns[2:]], names=["node", *rest])

    schema = ", ".join(f"{c} {kinds[c]}" for c in rest)
    return parents.select("sig", "node", *rest).mapInArrow(tasks, f"node bigint, {schema}")


def _runs(batches, key: str):
    """Tables that hold whole runs of equal ``key`` of batches sorted by it."""
    kept: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table]).combine_chunks()
        at = table.column(key).to_numpy()
        whole = int(np.searchsorted(at, at[-1], "left")) if len(at) else 0
        kept = table.slice(whole)
        if whole:
            yield table.slice(0, whole).combine_chunks()
    if kept is not None and len(kept):
        yield kept.combine_chunks()


def _pairs_in(table: pa.Table, key: str):
    """Places ``(i, j)`` and estimates of all pairs of equal ``key`` (sorted), a lag at a time."""
    at, sig = table.column(key).to_numpy(), _sigs(table.column("sig"))
    for lag in range(1, len(at)):
        i = np.flatnonzero(at[lag:] == at[:-lag])
        if not len(i):
            break
        yield i, i + lag, _estimates(sig[i], sig[i + lag])


def _close_pairs(leaves: DataFrame, floor: float) -> DataFrame:
    """Pairs ``(a, b, est)`` of different components within equal ``node`` of ``leaves(rep, sig, node, comp)``."""

    def tasks(batches):
        for table in _runs(batches, "node"):
            rep, comp = table.column("rep").to_numpy(), table.column("comp").to_numpy()
            for i, j, est in _pairs_in(table, "node"):
                ok = (est >= floor) & (comp[i] != comp[j])
                a, b = rep[i[ok]], rep[j[ok]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(est[ok].astype(np.float64))], names=["a", "b", "est"]
                )

    dealt = leaves.select("rep", "sig", "node", "comp").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(tasks, "a long, b long, est double")


def _blocks(big: DataFrame, floor: float) -> DataFrame:
    """Of large nodes, dealt into random blocks: pairs ``(a, b, est)``, and ``(a, null, mean similarity)`` of each row to its block."""

    def tasks(batches):
        for table in _runs(batches, "block"):
            rep = table.column("rep").to_numpy()
            total, met = np.zeros(len(rep)), np.zeros(len(rep))
            for i, j, est in _pairs_in(table, "block"):
                for side in (i, j):
                    total[side] += est  # a lag has each place once on each side
                    met[side] += 1
                ok = est >= floor
                a, b = rep[i[ok]], rep[j[ok]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(est[ok].astype(np.float64))], names=["a", "b", "est"]
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep), pa.nulls(len(rep), pa.int64()), pa.array(total / np.maximum(met, 1))], names=["a", "b", "est"]
            )

    block = F.xxhash64("node", F.pmod(F.xxhash64("rep", "node"), F.ceil(F.col("n") * 2 / SMALL)))
    dealt = big.select("rep", "sig", block.alias("block")).repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(tasks, "a long, b long, est double")


def _hub_pairs(big: DataFrame, reps: DataFrame, floor: float) -> DataFrame:
    """Candidates ``(a, b, est)`` of every row of ``big(rep, node, n, score, comp)`` and its node's most central row.

    A node's hub is copied once for each ``HUB_ROWS`` of its rows, and these are dealt among the copies, so
    that no task holds a large node.
    """

    def tasks(batches):
        for batch in batches:
            est = _estimates(_sigs(batch.column(1)), _sigs(batch.column(3)))
            ok = est >= floor
            a, b = batch.column(0).to_numpy()[ok], batch.column(2).to_numpy()[ok]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(est[ok].astype(np.float64))], names=["a", "b", "est"]
            )

    copies = F.ceil(F.col("n") / HUB_ROWS)
    best = F.max_by(F.struct("rep", "comp"), F.struct("score", "rep")).alias("hub")
    hubs = big.groupBy("node").agg(best, F.max("n").alias("n")).select("node", F.col("hub.rep").alias("hub"), F.col("hub.comp").alias("hub_comp"), "n")
    hubs = hubs.join(reps.select(F.col("rep").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
    hubs = hubs.select("node", "hub", "hub_comp", "hub_sig", F.explode(F.sequence(F.lit(0), copies.cast("int") - 1)).alias("copy"))
    rows = big.withColumn("copy", F.pmod(F.xxhash64("rep"), copies).cast("int"))
    met = rows.join(hubs, ["node", "copy"]).filter("comp <> hub_comp").join(reps, "rep")
    return met.select("rep", "sig", "hub", "hub_sig").mapInArrow(tasks, "a long, b long, est double")


def _grid_pairs(large: DataFrame, reps: DataFrame, floor: float) -> DataFrame:
    """All pairs ``(a, b, est)`` of different components within the nodes of ``large(rep, node, n, comp)``, however large.

    A node's rows are dealt into parts of about ``GRID``; a task compares two parts, or the rows of one, so it holds two parts at most. Work grows with
    the square of the node.
    """

    def tasks(batches):
        for table in _runs(batches, "cell"):
            sig, rep, comp = _sigs(table.column("sig")), table.column("rep").to_numpy(), table.column("comp").to_numpy()
            cell, part, alone = table.column("cell").to_numpy(), table.column("part").to_numpy(), table.column("alone").to_numpy(zero_copy_only=False)
            ends = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for start, end in zip(ends[:-1], ends[1:], strict=True):
                second = end if alone[start] else start + int(np.searchsorted(part[start:end], part[start], "right"))
                a, b, close = [], [], []
                for i in range(start, second):
                    j = np.arange(i + 1 if alone[start] else second, end)
                    j = j[comp[j] != comp[i]]
                    est = _estimates(np.broadcast_to(sig[i], (len(j), HASHES)), sig[j])
                    ok = est >= floor
                    a.append(np.minimum(rep[i], rep[j[ok]]))
                    b.append(np.maximum(rep[i], rep[j[ok]]))
                    close.append(est[ok].astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, close)], names=["a", "b", "est"])

    parts = F.ceil(F.col("n") / GRID).cast("int")
    dealt = large.select("rep", "node", "comp", parts.alias("parts"), F.pmod(F.xxhash64("rep", "node"), parts).cast("int").alias("part"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.xxhash64("node", F.least("part", "other"), F.greatest("part", "other")).alias("cell")
    met = met.select("rep", "comp", "part", cell, (F.col("part") == F.col("other")).alias("alone")).join(reps, "rep")
    sorted_ = met.select("rep", "sig", "comp", "part", "cell", "alone").repartition("cell").sortWithinPartitions("cell", "part")
    return sorted_.mapInArrow(tasks, "a long, b long, est double")


def _forest(close: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(i, j)`` out of the symmetric ``close`` that join all components that it joins: fewer than it has rows."""
    a, b = [], []
    left = np.ones(len(close), bool)
    for root in range(len(close)):
        held = [root] if left[root] else []
        left[held] = False
        while held:
            i = held.pop()
            same = np.flatnonzero(left & (comp == comp[i]))
            left[same] = False
            new = np.flatnonzero(left & close[i])
            _, at = np.unique(comp[new], return_index=True)
            new = new[at]
            left[new] = False
            a += [i] * len(new)
            b += new.tolist()
            held += [*same.tolist(), *new.tolist()]
    return np.array(a, np.int64), np.array(b, np.int64)


def _linked(texts: pa.Array, percent: int, width: int) -> np.ndarray:
    """Which two of the texts have similar enough full shingle sets: sizes of intersections are a product of 0/1 matrices."""
    rows, h, size = [], [], []
    for a, b in row_blocks(texts):
        keys, n = shingle_keys(*flat_text(texts.slice(a, b - a)), width)
        rows.append((keys >> np.uint64(52)).astype(np.int64) + a)
        h.append(keys & np.uint64((1 << 52) - 1))
        size.append(n)
    rows, size = np.concatenate(rows), np.concatenate(size).astype(np.int64)
    _, at, times = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # a shingle of one text is in no intersection
    shared = times[at] > 1
    rows, at = rows[shared], number[at[shared]]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    inter = np.zeros((len(texts), len(texts)), np.int64)
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        lo, hi = np.searchsorted(at, [first, first + COLUMNS])
        x = np.zeros((len(texts), COLUMNS), np.float32)
        x[rows[lo:hi], at[lo:hi] - first] = 1
        inter += (x @ x.T).astype(np.int64)
    return 100 * inter >= percent * (size[:, None] + size[None, :] - inter)


def _grid_links(large: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Links ``(a, b, est)`` that join the components which the nodes of ``large(rep, node, comp)`` join, however large these are; ``texts(rep, text)``.

    A node's rows are dealt into parts of about ``GRID`` rows and ``GRID_BYTES`` of text; a task compares the full shingle sets of two parts, or of
    one, so it holds two parts at most. Work grows with the square of the node, but a task gives fewer links than it has rows.
    """

    def tasks(batches):
        for table in _runs(batches, "cell"):
            cell, rep, comp = (table.column(c).to_numpy() for c in ("cell", "rep", "comp"))
            ends = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for start, end in zip(ends[:-1], ends[1:], strict=True):
                own = comp[start:end]
                if (own == own[0]).all():
                    continue
                i, j = _forest(_linked(table.column("text").combine_chunks()[start:end], percent, width), own)
                a, b = rep[start + i], rep[start + j]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.ones(len(a)))], names=["a", "b", "est"]
                )

    rows = large.select("rep", "node", "comp").join(texts, "rep")
    parts = F.ceil(F.greatest(F.count("*") / GRID, F.sum(F.octet_length("text")) / GRID_BYTES)).cast("int")
    nodes = rows.groupBy("node").agg(parts.alias("parts"))
    dealt = large.select("rep", "node", "comp").join(nodes, "node").withColumn("part", F.pmod(F.xxhash64("rep", "node"), "parts").cast("int"))
    # two parts meet once; of more than one part, no part needs a task of its own
    other = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("part")))
    met = dealt.withColumn("other", F.explode(other))
    cell = F.xxhash64("node", F.least("part", "other"), F.greatest("part", "other")).alias("cell")
    sorted_ = met.select("rep", "comp", cell).join(texts, "rep").select("rep", "comp", "cell", "text").repartition("cell").sortWithinPartitions("cell")
    return sorted_.mapInArrow(tasks, "a long, b long, est double")


def _best(found: list[DataFrame], label: str) -> DataFrame:
    """Candidates of several steps, each pair once."""
    every = reduce(DataFrame.unionByName, found)
    return materialise(every.groupBy("a", "b").agg(F.max("est").alias("est")), label)


def first_level(reps: DataFrame, floor: float) -> tuple[DataFrame, DataFrame | None]:
    """Candidates of the first level of all trees, and its large nodes ``(rep, node, n, score)``."""
    trees = F.explode(F.expr(f"transform(sequence(1, {TREES}), t -> cast(t as long))"))
    parents = reps.select("rep", "sig", trees.alias("tree")).select("rep", "sig", F.xxhash64("tree").alias("node"))
    rows = _branch(parents, 1)
    counts = rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    live = materialise(rows.join(counts, "node"), "tree1")
    comp = F.col("rep").alias("comp")
    found = [_close_pairs(live.filter(F.col("n") <= SMALL).join(reps, "rep").select("rep", "sig", "node", comp), floor)]
    big = live.filter(F.col("n") > SMALL)
    if big.isEmpty():
        return _best(found, "candidates1"), None
    blocks = materialise(_blocks(big.join(reps, "rep"), floor), "blocks")
    central = blocks.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.avg("est").alias("score"))
    big = materialise(big.join(central, "rep").select("rep", "node", "n", "score"), "large1")
    found += [blocks.filter("b is not null"), _hub_pairs(big.withColumn("comp", F.col("rep")), reps, floor)]
    return _best(found, "candidates1"), big


def next_levels(big: DataFrame, reps: DataFrame, labels: DataFrame, floor: float, texts_of=None, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Candidates between different components of the levels below ``big(rep, node, n, score)``.

    ``texts_of`` gives the texts of classes ``(rep)``; with it, nodes that stay large give confirmed links only, which don't
    grow with the square of a node; without it all their pairs of near minwise values.

    A level's rows are made once and written, at most ``WAYS`` for each row of a large node above. The level of a node counts its
    members with a map-side combine before the shuffle; the join that hands the counts back is one whose skewed side Spark can
    split. Levels are written one by one, and all their leaves and hubs compared in one go.
    """
    comp = F.coalesce("component", "rep").alias("comp")
    rows = big.join(labels, big["rep"] == labels["id"], "left").select("rep", "node", "n", "score", comp)
    mixed = rows.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("node")
    rows, levels, whole = rows.join(mixed, "node", "left_semi"), [], []
    for level in range(2, DEPTH + 1):
        parents = rows.join(reps, "rep").select("rep", "sig", "node", "score", "comp", F.col("n").alias("above"))
        rows = materialise(_branch(parents, level), f"branch{level}")
        counts = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        live = materialise(rows.join(counts.filter("lo <> hi").select("node", "n"), "node").select("rep", "node", "n", "score", "comp", "above"), f"tree{level}")
        levels.append(live)
        rows = live.filter(F.col("n") > SMALL)
        ends = F.lit(level == DEPTH) | F.lit(level >= LATE) & (F.col("n") >= KEPT * F.col("above"))
        whole.append(rows.filter(ends))
        rows = rows.filter(~ends)
        if rows.isEmpty():
            break
    every = reduce(DataFrame.unionByName, levels)
    leaves = _close_pairs(every.filter(F.col("n") <= SMALL).join(reps, "rep"), floor)
    found = [leaves, _hub_pairs(every.filter(F.col("n") > SMALL), reps, floor)]
    rows = reduce(DataFrame.unionByName, whole)
    if not rows.isEmpty():  # what the levels don't make small
        found.append(_grid_links(rows, texts_of(rows.select("rep").distinct()), percent, width) if texts_of else _grid_pairs(rows, reps, floor))
    return _best(found, "candidates2")


# ---------------------------------------------------------------- confirmation


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Those ``pairs(a, b)`` whose full shingle sets are similar enough; ``texts(rep, text)``."""

    def tasks(batches):
        for batch in batches:
            for a, b in row_blocks(batch.column(2), 1 << 20):
                left, n_left = shingle_keys(*flat_text(batch.column(2).slice(a, b - a)), width)
                right, n_right = shingle_keys(*flat_text(batch.column(3).slice(a, b - a)), width)
                both = np.concatenate([left, right])
                both.sort()
                shared = both[1:][both[1:] == both[:-1]] >> np.uint64(52)
                inter = np.bincount(shared.astype(np.int64), minlength=b - a)
                ok = np.flatnonzero(100 * inter >= percent * (n_left + n_right - inter))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(ok)), batch.column(1).slice(a, b - a).take(pa.array(ok))],
                    names=["a", "b"],
                )

    one = pairs.select("a", "b").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(tasks, "a long, b long")


def _firsts(pairs: DataFrame) -> DataFrame:
    """Each class's most similar partner and its least partner: enough pairs to span most components."""
    ends = pairs.select("a", "b", "est", F.col("a").alias("u"), F.col("b").alias("w")).unionByName(
        pairs.select("a", "b", "est", F.col("b").alias("u"), F.col("a").alias("w"))
    )
    best = ends.groupBy("u").agg(
        F.max_by(F.struct("a", "b"), F.struct("est", F.bitwise_not("w"))).alias("x"), F.min_by(F.struct("a", "b"), "w").alias("y")
    )
    return best.select(F.explode(F.array("x", "y")).alias("p")).select("p.a", "p.b").distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends have different components so far."""
    la = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    lb = labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    joined = pairs.join(la, "a", "left").join(lb, "b", "left")
    return joined.filter("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def _stars_of(labels: DataFrame) -> DataFrame:
    """Links ``(a, b)`` with the components of ``labels(id, component)``, one for each class."""
    return labels.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()


def _texts(docs: DataFrame, reps: DataFrame, members: DataFrame) -> DataFrame:
    """``(rep, text)`` of the classes ``reps(rep)``; ``members(rep, doc_id, own)`` says where a class's text is."""
    ids = materialise(reps.join(members, "rep"), "ids")
    # few ids (24 bytes each, counted) go to the scan of the texts; many: both are shuffled
    to_texts = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    own = docs.join(to_texts, "doc_id").filter(F.col("own") == text_number("text"))
    return materialise(own.select("rep", "text").dropDuplicates(["rep"]), "texts")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = materialise(sketch(docs, width), "sketch")
    named = sketches.filter("set_id is not null and doc_id is not null")
    # the row with the least id stands for a class; a text that several documents share is summed up in the tasks
    classes = named.groupBy("set_id").agg(F.first("sig").alias("sig"), F.min(F.struct("doc_id", "own")).alias("of"))
    classes = materialise(classes.select("set_id", class_number().alias("rep"), "sig", "of.doc_id", "of.own"), "classes")
    reps = classes.select("rep", "sig")
    floor = estimate_floor(percent)

    members = classes.select("rep", "doc_id", "own")
    pairs, big = first_level(reps, floor)
    texts = _texts(docs, _ends(pairs), members)
    links = materialise(confirm(_firsts(pairs), texts, percent, width), "links")
    labels = components(links)
    more = materialise(confirm(_apart(pairs, labels), texts, percent, width), "links")
    links = _stars_of(labels).unionByName(more)
    labels = components(links)
    if big is not None:
        found = next_levels(big, reps, labels, floor, lambda ids: _texts(docs, ids, members), percent, width)
        pairs = materialise(_apart(found, labels), "apart")
        links = _stars_of(labels).unionByName(materialise(confirm(pairs, _texts(docs, _ends(pairs), members), percent, width), "links"))
    repeated = named.groupBy("doc_id").agg(F.min(class_number()).alias("a"), F.max(class_number()).alias("hi")).filter("a <> hi").select("doc_id", "a")
    labels = components(links.unionByName(named.join(repeated, "doc_id").select("a", class_number().alias("b"))))

    found = classes.join(labels, classes["rep"] == labels["id"], "left").select("set_id", "doc_id", F.coalesce("component", "rep").alias("comp"))
    least = found.groupBy("comp").agg(F.min("doc_id").alias("c"))
    out = sketches.join(found.join(least, "comp").select("set_id", "c"), "set_id", "left")
    own = F.coalesce("c", "doc_id")
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
        (F.col("doc_id") == own).alias("kept"),
    )


def recall(docs: DataFrame, groups: DataFrame, percent: int = PERCENT, width: int = WIDTH, every: int = 50) -> DataFrame:
    """One row ``(links, found)``: the links of all documents whose id is divisible by ``every`` to any other document, by
    a join of all shingles, and how many of them ``groups(doc_id, component_id)`` has in one component. Ids must be unique."""

    def tasks(batches):
        for batch in batches:
            for a, b in row_blocks(batch.column(1)):
                keys, _ = shingle_keys(*flat_text(batch.column(1).slice(a, b - a)), width)
                at = pa.array((keys >> np.uint64(52)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(at), pa.array((keys & np.uint64((1 << 52) - 1)).astype(np.int64))], names=["doc_id", "h"]
                )

    sets = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(tasks, "doc_id long, h long")
    sizes = sets.groupBy("doc_id").agg(F.count("*").alias("n"))
    asked = sets.filter(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("q"), "h")
    both = asked.join(sets, "h").filter("q <> doc_id").groupBy("q", "doc_id").agg(F.count("*").alias("m"))
    linked = both.join(sizes, "doc_id").join(sizes.select(F.col("doc_id").alias("q"), F.col("n").alias("nq")), "q")
    linked = linked.filter(100 * F.col("m") >= percent * (F.col("n") + F.col("nq") - F.col("m")))
    one = groups.select("doc_id", F.col("component_id").alias("c"))
    two = groups.select(F.col("doc_id").alias("q"), F.col("component_id").alias("cq"))
    return linked.join(one, "doc_id").join(two, "q").agg(F.count("*").alias("links"), F.coalesce(F.sum((F.col("c") == F.col("cq")).cast("long")), F.lit(0)).alias("found"))


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
