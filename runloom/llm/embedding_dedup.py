"""Embedding near-dedup by sorted projection passes.

Vectors are compared only within a label. Equal vectors are one entry first.
Each pass hashes every entry by 64 random hyperplanes of its own, orders all
entries by label and then lexicographically by the concatenated bits, and
compares each with its next `reach` neighbours in that order by exact cosine
in double precision. A pair counts in the first pass that has it within reach,
which the ranks of all passes tell, so links are summed and never listed; only
a forest of them leaves a task, and components are those of the forests.
Groups of more near vectors than windows hold are finished exactly, block by
block: see entry_links().

The order is global: the sort is by ranges, ranks come from the sizes of the
sorted partitions, and blocks of ranks take the neighbours after their end
along, so a label that holds a third of the rows is many blocks.

Null labels and vectors that are null, empty, zero or hold null or non-finite
components link with nothing; so do vectors of different lengths. A row is a
vector of its own: repeated rows link to each other, and rows that share an id
are judged each. An empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import components, cut, parts_for, stored
from runloom.llm.simhash import forest

THRESHOLD = 0.93
PASSES = 16
REACH = 192
BLOCK = 2048
#: Links from which on an entry is compared with all others of its label that have as many.
DENSE = 512


def _usable(vector) -> F.Column:
    """Not null, no null or non-finite component, not zero, by double components."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def _signed(passes: int, seed: int):
    """(pass, label, signature, entry) for each pass."""

    def planes(dim: int, p: int) -> np.ndarray:
        return np.random.default_rng([seed, p, dim]).standard_normal((dim, 64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                vectors = part.column(2)
                dims = np.diff(vectors.offsets.to_numpy())
                flat = vectors.flatten().to_numpy(zero_copy_only=False)
                begs = np.concatenate(([0], np.cumsum(dims)))
                for p in range(passes):
                    signature = np.zeros(len(dims), np.int64)
                    for dim in np.unique(dims):
                        own = np.flatnonzero(dims == dim)
                        x = flat[begs[own][:, None] + np.arange(dim)]
                        if (p, dim) not in made:
                            made[p, dim] = planes(int(dim), p)
                        x = x / np.abs(x).max(axis=1, keepdims=True)
                        bits = np.packbits(x @ made[p, dim] > 0, axis=1).view(">u8").ravel()
                        signature[own] = (bits ^ np.uint64(1 << 63)).astype(np.uint64).view(np.int64)  # signed numbers in the order of the bits
                    yield pa.record_batch([pa.array(np.full(len(dims), p, np.int32)), part.column(0), pa.array(signature), part.column(1)], names=["pass", "label", "signature", "entry"])

    return rows


def _unit_rows(flat: np.ndarray, begs: np.ndarray, own: np.ndarray, dim: int) -> np.ndarray:
    x = flat[begs[own][:, None] + np.arange(dim)].astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cosine(flat: np.ndarray, begs: np.ndarray, left: np.ndarray, right: np.ndarray, dim: int) -> np.ndarray:
    x, y = (flat[begs[i][:, None] + np.arange(dim)].astype(np.float64) for i in (left, right))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


class _Links:
    """What a task has found: for each entry how many rows it links to, and a forest of the links."""

    def __init__(self):
        self.counts: dict[int, int] = {}
        self.a = self.b = np.zeros(0, np.int64)

    def add(self, left: np.ndarray, right: np.ndarray, left_copies: np.ndarray, right_copies: np.ndarray) -> None:
        who, at = np.unique(np.concatenate((left, right)), return_inverse=True)
        for i, n in zip(who.tolist(), np.bincount(at, np.concatenate((right_copies, left_copies)), len(who)).astype(np.int64).tolist(), strict=True):
            self.counts[i] = self.counts.get(i, 0) + n
        if len(left):
            self.a, self.b = forest(np.concatenate((self.a, left)), np.concatenate((self.b, right)))

    def batch(self) -> pa.RecordBatch:
        a = np.concatenate((np.fromiter(self.counts, np.int64, len(self.counts)), self.a))
        b = np.concatenate((np.fromiter(self.counts.values(), np.int64, len(self.counts)), self.b))
        kind = np.repeat(np.array([0, 1], np.int8), (len(self.counts), len(self.a)))
        return pa.record_batch([pa.array(kind), pa.array(a), pa.array(b)], names=["kind", "a", "b"])


_FOUND = "kind tinyint, a bigint, b bigint"  # an entry and how many rows it links to, or an edge


def _vectors(part: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components of a column end to end, where each vector begins, lengths."""
    column = part.column("vector")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    dims = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(dims))), dims


def _compared(threshold: float, reach: int, block: int):
    """Links of a block's rows to rows up to reach further on, of the same pass, label and length.

    A pair is counted in the first pass whose order has it within reach.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        got = pa.Table.from_batches(got).sort_by([("block", "ascending"), ("rank", "ascending")])
        blocks, found = got.column("block").to_numpy(), _Links()
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for beg, end in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
            part = got.slice(beg, end - beg).combine_chunks()
            rank, entry, copies, run, turn = (part.column(c).to_numpy() for c in ("rank", "entry", "copies", "run", "pass"))
            ranks = np.stack(part.column("ranks").to_numpy(zero_copy_only=False))
            flat, begs, dims = _vectors(part)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = _unit_rows(flat, begs, own, int(dim))
                for i in range(0, len(own), 256):
                    j = min(len(own), i + 256 + reach)
                    left, right = own[i : i + 256], own[i:j]
                    ok = x[i : i + 256] @ x[i:j].T >= threshold - 1e-9
                    gap = rank[right][None, :] - rank[left][:, None]
                    ok &= (gap > 0) & (gap <= reach) & (run[right][None, :] == run[left][:, None])
                    ok &= (rank[left] // block == blocks[beg])[:, None]
                    p, q = np.nonzero(ok)
                    p, q = left[p], right[q]
                    before = np.arange(ranks.shape[1]) < turn[p][:, None]
                    new = ~((np.abs(ranks[p] - ranks[q]) <= reach) & before).any(axis=1)
                    p, q = p[new], q[new]
                    linked = _cosine(flat, begs, p, q, int(dim)) >= threshold
                    p, q = p[linked], q[linked]
                    found.add(entry[p], entry[q], copies[p], copies[q])
        yield found.batch()

    return rows


def _crossed(threshold: float):
    """Links between two blocks of dense entries, or within one, group by group of sorted rows."""

    def judged(held: list[pa.Table], lo: int, hi: int, found: _Links) -> None:
        part = pa.concat_tables(held).combine_chunks()
        entry, copies, own = (part.column(c).to_numpy() for c in ("entry", "copies", "own"))
        flat, begs, dims = _vectors(part)
        for dim in np.unique(dims):
            left, right = (np.flatnonzero((dims == dim) & (own == side)) for side in (lo, hi))
            y = _unit_rows(flat, begs, right, int(dim)) if len(right) else None
            for i in range(0, len(left) if len(right) else 0, 512):
                p, q = np.nonzero(_unit_rows(flat, begs, left[i : i + 512], int(dim)) @ y.T >= threshold - 1e-9)
                p, q = left[i + p], right[q]
                keep = (p < q) if lo == hi else np.ones(len(p), bool)
                p, q = p[keep], q[keep]
                linked = _cosine(flat, begs, p, q, int(dim)) >= threshold
                found.add(entry[p[linked]], entry[q[linked]], copies[p[linked]], copies[q[linked]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, found = None, [], _Links()
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("label", "lo", "hi")]
            keys = list(zip(*keys, strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
            for beg, end in zip(cuts, cuts[1:], strict=False):
                if keys[beg] != group:
                    if held:
                        judged(held, *group[1:], found)
                    group, held = keys[beg], []
                held.append(pa.Table.from_batches([batch.slice(beg, end - beg)]))
        if held:
            judged(held, *group[1:], found)
        yield found.batch()

    return rows


def _ranked(entries: DataFrame, passes: int, seed: int) -> DataFrame:
    """entries with ranks: the place in the order of each pass, all passes end to end."""
    spark = entries.sparkSession
    rows = entries.select("label", "entry", "vector").mapInArrow(_signed(passes, seed), f"pass int, label {entries.schema['label'].dataType.simpleString()}, signature bigint, entry bigint")
    parts = parts_for(passes * entries.count(), 200_000)
    order = ["pass", "label", "signature", "entry"]
    ordered = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("pass", "entry"))
    at = ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33).cast("int"))  # partition number, then place in it
    sizes = {r.part: r.n for r in at.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    starts = np.cumsum([0, *(sizes.get(p, 0) for p in range(max(sizes, default=0)))]).tolist()
    start = spark.createDataFrame(list(enumerate(starts)), "part int, start bigint")
    ranked = at.join(F.broadcast(start), "part").select("pass", "entry", (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))
    per_entry = ranked.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("pass", "rank"))).alias("ranks"))  # passes of them
    return entries.join(per_entry.select("entry", F.col("ranks.rank").alias("ranks")), "entry")


def window_links(ranked: DataFrame, threshold: float, reach: int, block: int) -> DataFrame:
    """Links (_FOUND) between entries that some pass has within reach of each other."""
    turned = ranked.select("label", "entry", "copies", "vector", "ranks", F.posexplode("ranks").alias("pass", "rank"))
    own = F.floor(F.col("rank") / block)
    # the first `reach` rows of a block are also the neighbours that follow the block before
    ahead = F.array_distinct(F.array(own, F.greatest(F.floor((F.col("rank") - reach) / block), F.lit(0))))
    dealt = turned.select("entry", "copies", "vector", "ranks", "pass", "rank", F.xxhash64("pass", "label").alias("run"), F.explode(ahead).alias("block"))
    n = ranked.agg(F.sum(F.size("ranks")).alias("n")).first().n or 0
    return dealt.repartition(parts_for(n, 20_000), "block").mapInArrow(_compared(threshold, reach, block), _FOUND)


def dense_links(dense: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links (_FOUND) between all dense entries of a label: each pair of its blocks is one group."""
    sizes = dense.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("many"))
    own = F.pmod(F.xxhash64("entry"), F.col("many")).cast("int")
    dealt = dense.join(cut(sizes), "label").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    dealt = dealt.select("label", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "entry", "copies", "vector")
    return dealt.repartition("label", "lo", "hi").sortWithinPartitions("label", "lo", "hi").mapInArrow(_crossed(threshold), _FOUND)


def entry_links(entries: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, reach: int = REACH, block: int = BLOCK, dense: int = DENSE, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(entry, others) and edges (a, b) of entries (label, entry, copies, vector).

    An entry that the passes link to `dense` rows or more may have more
    partners than its windows hold. Such entries of a label are compared with
    each other, all of them in blocks; links among them that the passes found
    are taken off and those of the blocks count.
    """
    ranked = stored(_ranked(entries, passes, seed))
    found = cut(window_links(ranked, threshold, reach, block))
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("others"))
    edges = found.where("kind = 1").select("a", "b")
    many = cut(counts.where(F.col("others") >= dense).select(F.col("a").alias("entry")))
    if many.isEmpty():
        return counts.withColumnRenamed("a", "entry"), edges
    hot = stored(ranked.join(many, "entry", "left_semi"))
    again = window_links(hot, threshold, reach, block).where("kind = 0").select("a", (-F.col("b")).alias("others"))
    whole = cut(dense_links(hot, threshold, block))
    parts = counts.unionByName(again).unionByName(whole.where("kind = 0").select("a", F.col("b").alias("others")))
    return parts.groupBy(F.col("a").alias("entry")).agg(F.sum("others").alias("others")), edges.unionByName(whole.where("kind = 1").select("a", "b"))


def dedup_embeddings(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """id_col, n_links, component_id, kept of every row."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    source = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), vector.alias("vector"))
    digest = F.sha2(F.to_json(F.transform("vector", lambda x: x + F.lit(0.0))), 256)
    usable = F.coalesce(F.col("label").isNotNull() & _usable(F.col("vector")), F.lit(False))
    source = stored(source.select("id", "label", "vector", usable.alias("usable")).withColumn("digest", F.when(F.col("usable"), digest)))
    # equal vectors of a label are one entry, with a number of its own, as ids may repeat
    alike = source.where("usable").groupBy("label", "digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    entries = stored(alike.withColumn("entry", F.monotonically_increasing_id()))
    others, edges = entry_links(entries.select("label", "entry", "copies", "vector"), **options)
    found = components(edges).withColumnRenamed("id", "entry")
    named = entries.select("label", "digest", "entry", "id", "copies").join(found, "entry", "left").withColumn("component", F.coalesce("component", "entry"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    per_entry = named.join(smallest, "component").join(others, "entry", "left").select("label", "digest", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    joined = source.where("usable").select("id", "label", "digest").join(per_entry, ["label", "digest"]).select("id", "n_links", "component_id")
    alone = source.where("not usable").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
