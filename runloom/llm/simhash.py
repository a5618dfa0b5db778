"""SimHash near-dedup by multi-index hashing.

A fingerprint is 64 bits a block. Its bits are cut into segments; two
fingerprints within the distance must agree, in at least one segment, up to a
small radius. Each distinct fingerprint is put into the table of each segment
under its value there and under the values of the Hamming ball around it;
fingerprints that meet under one key are verified by their complete distance.

For radius 1 the ball needs only the flips from 0 to 1: of two values that
differ in one bit, the one with the 0 reaches the other.

Copies share a fingerprint and are one entry. What meets is compared in the
partition of its key and leaves as a spanning forest, never as all pairs of a
group. A key of many fingerprints is split into blocks, each pair of blocks a
key of its own. Components come from joins over the forest's edges.

Null and empty texts have fingerprint zero and are linked like any other. Rows
without id get the component of equal fingerprints. Repeated rows and rows
that share an id get a row each. Texts of any length are read whole, by one
task each. An empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import components, cut, parts_for, spread, stored

SEED = 42
#: Share of the pairs at the similarity that segments_for() makes candidates.
RECALL = 0.99
#: Fingerprints of one key that a task compares; a key with more is split into blocks.
PER_KEY = 4096
#: The most keys that are split.
HOT_KEYS = 100_000
#: Texts, and shingles of texts, that a block of the exact comparison holds.
BLOCK_ROWS, BLOCK_DIGESTS = 1024, 2_000_000


def shingle_digests(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each shingle of k words, as rows of 8 big-endian bytes."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(words)
    if len(words) <= k:
        found = [xxhash.xxh64_digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begs = np.concatenate(([0], ends[:-1] + 1))
        found = [xxhash.xxh64_digest(joined[b:e], SEED) for b, e in zip(begs[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    return np.frombuffer(b"".join(found), np.uint8).reshape(-1, 8)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Another 64 bits from each digest (the finalizer of splitmix64)."""
    x = h.view(">u8").astype(np.uint64).ravel() + np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x ^ (x >> np.uint64(31))).astype(">u8").view(np.uint8).reshape(-1, 8)


def fingerprint(text: str | None, k: int, blocks: int = 1, split_ties: bool = False) -> list[int]:
    """Signed 64-bit numbers; a bit is 1 if set in over half the shingles' digests."""
    return _majority(shingle_digests(text, k), blocks, split_ties)


def _majority(h: np.ndarray, blocks: int, split_ties: bool) -> list[int]:
    """The fingerprint of rows of 8 big-endian bytes.

    split_ties: where half of them have a bit, one of them decides, another for
    each bit: unrelated texts of few shingles differ in half their bits, and a
    further shingle changes few of them, whatever its digest.
    """
    out = []
    for block in range(blocks):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
        bits = 2 * ones > len(h)
        following = _mixed(h) if split_ties or block + 1 < blocks else h
        tied = np.flatnonzero(2 * ones == len(h)) if split_ties and len(h) else []
        for b in tied:
            first = _turned(following, int(b)).argmin()
            bits[b] = h[first, b // 8] >> (7 - b % 8) & 1
        out.append(int(np.packbits(bits).view(">i8")[0]))
        h = following
    return out


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    """The digests as numbers whose bits are rotated."""
    x = h.view(">u8").astype(np.uint64).ravel()
    return x << np.uint64(by) | x >> np.uint64(64 - by) if by else x


def fingerprints(docs: DataFrame, k: int, blocks: int = 1, id_col: str = "doc_id", text_col: str = "text", split_ties: bool = False) -> DataFrame:
    """(id, copy, f0, f1, ...) of every row; copy is a hash of the text, -1 for a null text's."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), k, blocks, split_ties) for t in batch.column(1)]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(blocks)]
            yield pa.record_batch([batch.column(0), batch.column(2), *columns], names=["id", "copy", *(f"f{i}" for i in range(blocks))])

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"), _copy(F.col(text_col)).alias("copy"))
    return spread(texts).mapInArrow(rows, "id bigint, copy bigint, " + ", ".join(f"f{i} bigint" for i in range(blocks)))


def set_fingerprints(docs: DataFrame, k: int, blocks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, copy, rep, f0, f1, ...) of every row, of the set of its shingles: rep is a hash of the set itself.

    Repeats don't count, as they don't in the similarity: a shingle that stands
    in a text often would otherwise decide the fingerprint by itself.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(1):
                own = _shingle_set(t.as_py(), k)
                rep = np.frombuffer(xxhash.xxh64_digest(own.tobytes(), SEED), ">i8")[0]
                found.append((rep, *_majority(own, blocks, split_ties=True)))
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(blocks + 1)]
            yield pa.record_batch([batch.column(0), batch.column(2), *columns], names=["id", "copy", "rep", *(f"f{i}" for i in range(blocks))])

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"), _copy(F.col(text_col)).alias("copy"))
    return spread(texts).mapInArrow(rows, "id bigint, copy bigint, rep bigint, " + ", ".join(f"f{i} bigint" for i in range(blocks)))


def _shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct digests in order, as rows of 8 big-endian bytes."""
    return np.unique(shingle_digests(text, k).view(">u8")).view(np.uint8).reshape(-1, 8)


def _copy(text: F.Column) -> F.Column:
    return F.when(text.isNull(), F.lit(-1).cast("bigint")).otherwise(F.xxhash64(text, F.octet_length(text)))


def even_segments(bits: int, parts: int) -> list[list[int]]:
    return [list(range(i * bits // parts, (i + 1) * bits // parts)) for i in range(parts)]


def drawn_segments(bits: int, parts: int, width: int, seed: int = 7) -> list[list[int]]:
    draw = random.Random(seed)
    return [sorted(draw.sample(range(bits), width)) for _ in range(parts)]


def meeting_rate(bits: int, parts: int, width: int, distance: int, similarity: float) -> float:
    """Chance that two sets of this Jaccard similarity meet in a drawn segment and differ in at most distance bits."""
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    share = [math.comb(bits, d) * apart**d * (1 - apart) ** (bits - d) for d in range(distance + 1)]
    return sum(p * (1 - (1 - math.comb(bits - d, width) / math.comb(bits, width)) ** parts) for d, p in enumerate(share))


def segments_for(n: int, bits: int, distance: int, similarity: float, recall: float = RECALL) -> list[list[int]]:
    """Drawn segments for n fingerprints: a value has a few hundred of them at most, and there are as many segments as the recall takes."""
    width = min(40, max(14, math.ceil(math.log2(max(2, n))) - 9))
    parts = next((m for m in range(1, 1 << 15) if meeting_rate(bits, m, width, distance, similarity) >= recall), None)
    if parts is None:
        raise ValueError("segments_for: this distance can't give the recall")
    return drawn_segments(bits, parts, width)


def _keys(words: Sequence[np.ndarray], s: int, bits: Sequence[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints in segment s, the ball's included, and which fingerprint has each."""
    value = np.zeros(len(words[0]), np.uint64)
    for j, b in enumerate(bits):
        value |= ((words[b // 64] >> np.uint64(b % 64)) & np.uint64(1)) << np.uint64(j)
    base = np.uint64(s << 48)
    keys, who = [base | value], [np.arange(len(value))]
    for j in range(len(bits) if radius else 0):
        low = np.flatnonzero(value >> np.uint64(j) & np.uint64(1) == 0)
        keys.append(base | value[low] | np.uint64(1 << j))
        who.append(low)
    return np.concatenate(keys), np.concatenate(who)


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _frequent(segments: Sequence[Sequence[int]], radius: int, blocks: int, least: int):
    """(key, n): keys that a partition has at least `least` times."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i + 1).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(blocks)] for b in batches]
        words = [np.concatenate([g[i] for g in got]) for i in range(blocks)] if got else []
        for s, bits in enumerate(segments if got else ()):
            key, n = np.unique(_keys(words, s, bits, radius)[0], return_counts=True)
            key, n = key[n >= least], n[n >= least]
            if len(key):
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return rows


def _hot_keys(distinct: DataFrame, segments: Sequence[Sequence[int]], radius: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of over PER_KEY fingerprints, sorted, and the number of blocks for each.

    A key that many fingerprints have is frequent in some partition. A count
    too low by what infrequent partitions hold makes blocks larger, no more.
    At most HOT_KEYS keys, the largest, are split (16 bytes for each go along
    with every task).
    """
    parts = distinct.rdd.getNumPartitions()
    least = max(2, -(-PER_KEY // max(1, parts)))
    found = distinct.select("rep", *(f"f{i}" for i in range(blocks))).mapInArrow(_frequent(segments, radius, blocks, least), "key bigint, n bigint")
    hot = found.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > PER_KEY // 2).orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect()
    key = np.array([r.key for r in hot], np.int64).view(np.uint64)
    many = np.array([-(-(r.n + least) // PER_KEY) for r in hot], np.int64)
    order = np.argsort(key)
    return key[order], many[order]


def _entries(segments: Sequence[Sequence[int]], radius: int, blocks: int, hot: tuple[np.ndarray, np.ndarray]):
    """For each fingerprint its keys: in every segment the value and the ball's values.

    A hot key is one key for each pair of its blocks: side is 1 or 2 for the
    two blocks of a pair and 0 where all are compared.
    """
    if radius not in (0, 1):
        raise ValueError("radius: 0 or 1")
    names = ["key", "side", "rep", *(f"f{i}" for i in range(blocks))]
    hot_key, hot_blocks = hot

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = [batch.column(i).to_numpy(zero_copy_only=False)[at : at + 4096] for i in range(blocks + 1)]
                words = [p.view(np.uint64) for p in part[1:]]
                for s in range(0, len(segments), 16):
                    found = [_keys(words, i, segments[i], radius) for i in range(s, min(s + 16, len(segments)))]
                    key, who = (np.concatenate([f[c] for f in found]) for c in (0, 1))
                    key, side, who = _dealt(key, part[0].view(np.uint64)[who], who)
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(side), *(pa.array(p[who]) for p in part)], names=names)

    def _dealt(key: np.ndarray, rep: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        side = np.zeros(len(key), np.int8)
        if not len(hot_key):
            return key, side, who
        at = np.minimum(np.searchsorted(hot_key, key), len(hot_key) - 1)
        many = np.where(hot_key[at] == key, hot_blocks[at], 1)
        split = np.flatnonzero(many > 1)
        if not len(split):
            return key, side, who
        n = many[split]
        own = np.repeat((_hash(rep[split]) >> np.uint64(33)).astype(np.int64) % n, n)
        other = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        pair = (np.minimum(own, other) * np.repeat(n, n) + np.maximum(own, other)).astype(np.uint64)
        rest = many == 1
        new = _hash(np.repeat(key[split], n) + _hash(pair + np.uint64(1)))
        return np.concatenate((key[rest], new)), np.concatenate((side[rest], np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.int8))), np.concatenate((who[rest], np.repeat(who[split], n)))

    return rows


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the graph with edges (a, b)."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, parent = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        p, q = parent[x], parent[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    far = parent != np.arange(len(nodes))
    return nodes[far], nodes[parent[far]]


def _near(key: np.ndarray, side: np.ndarray, f: Sequence[np.ndarray], distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of a key, in its sorted order, that differ in at most distance bits."""
    left, d = np.arange(len(key) - 1), 1
    while len(left := left[left < len(key) - d]):
        left = left[key[left] == key[left + d]]
        near = left[sum(np.bitwise_count(x[left] ^ x[left + d]).astype(np.int64) for x in f) <= distance]
        near = near[(side[near] != side[near + d]) | (side[near] == 0)]
        if len(near):
            yield near, near + d
        d += 1


def _verified(blocks: int, distance: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        key, side, rep, *f = (got.column(i).to_numpy() for i in range(blocks + 3))
        order = np.argsort(key, kind="stable")
        key, side, rep, f = key[order], side[order], rep[order], [x[order].view(np.uint64) for x in f]
        a, b, held = [], [], 0
        for i, j in _near(key, side, f, distance):
            a.append(rep[i])
            b.append(rep[j])
            held += len(i)
            if held > 2_000_000:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], len(x)
        if a:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            yield pa.record_batch([pa.array(x), pa.array(y)], names=["a", "b"])

    return rows


def _met(distinct: DataFrame, n: int, blocks: int, segments: Sequence[Sequence[int]], radius: int, distance: int, per_part: int) -> DataFrame:
    """Edges (a, b) between n distinct fingerprints that meet within the distance: a forest of each task's keys."""
    known = distinct.where("rep is not null")
    names = [f"f{i}" for i in range(blocks)]
    hot = _hot_keys(known, segments, radius, blocks)
    keys = n * sum(1 + radius * len(s) / 2 for s in segments)
    entries = known.select("rep", *names).mapInArrow(_entries(segments, radius, blocks, hot), "key bigint, side tinyint, rep bigint, " + ", ".join(f"{x} bigint" for x in names))
    parts = parts_for(keys, per_part, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return entries.repartition(parts, "key").mapInArrow(_verified(blocks, distance), "a bigint, b bigint")


def _distinct(prints: DataFrame, blocks: int) -> DataFrame:
    names = [f"f{i}" for i in range(blocks)]
    return cut(prints.groupBy(*names).agg(F.min("id").alias("rep")).select("rep", *names))


def linked(prints: DataFrame, blocks: int, segments: Sequence[Sequence[int]], radius: int, distance: int, per_part: int = 1_000_000) -> DataFrame:
    """(id, f0, ..., component) for rows (id, f0, ...): components of distance or less between fingerprints."""
    prints = stored(prints)
    distinct = _distinct(prints, blocks)
    edges = cut(_met(distinct, distinct.count(), blocks, segments, radius, distance, per_part))
    found, names = components(edges), [f"f{i}" for i in range(blocks)]
    named = distinct.join(found, distinct.rep == found.id, "left").select(*names, F.coalesce("component", "rep").alias("component"))
    # fingerprints that many rows share: the rows' side is the one that adaptive execution splits
    return prints.join(named, names).select("id", *names, "component")


def _set_rows(k: int):
    """(component, id, n, digests): the distinct shingles of each text, sorted, as bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [_shingle_set(t.as_py(), k).view(">u8").astype("<u8").ravel() for t in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["component", "id", "n", "digests"])

    return rows


def similar_pairs(sets: Sequence[np.ndarray], similarity: float, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of sets with this Jaccard similarity or more; with first, of one of the first so many with one of the others.

    Shingles that many sets have are columns of a matrix that is multiplied by
    itself, chunk by chunk; the pairs of the others are counted one by one.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    top = n if first is None else first
    low = 0 if first is None else first
    both = np.zeros((top, n - low), np.float32)
    dense = np.flatnonzero(count > 48)
    place = np.full(len(value), -1)
    place[dense] = np.arange(len(dense))
    at = place[column]
    order = np.argsort(at, kind="stable")
    at, who = at[order], owner[order]
    for beg in range(0, len(dense), 2048):
        cut_ = slice(*np.searchsorted(at, (beg, beg + 2048)))
        x = np.zeros((n, min(2048, len(dense) - beg)), np.float32)
        x[who[cut_], at[cut_] - beg] = 1
        both += x[:top] @ x[low:].T
    few = (count[column] > 1) & (place[column] < 0)
    order = np.argsort(column[few], kind="stable")  # owners stay in order within a column
    c, o = column[few][order], owner[few][order]
    left, d = np.arange(len(c)), 1
    while len(left := left[left < len(c) - d]):
        left = left[c[left] == c[left + d]]
        i, j = o[left], o[left + d]
        keep = (i < top) & (j >= low)
        both += np.bincount(i[keep] * (n - low) + j[keep] - low, minlength=both.size).reshape(both.shape)
        d += 1
    union = sizes[:top, None] + sizes[None, low:] - both
    i, j = np.nonzero(both >= union * similarity - 1e-6)
    j = j + low
    return i[i < j], j[i < j]


def _alike(similarity: float):
    """Forest edges of similar texts, group by group of sorted rows (component, lo, hi, own, id, digests)."""

    def judged(held: list[tuple[int, int, bytes]], lo: int, hi: int) -> pa.RecordBatch:
        held.sort(key=lambda h: h[0] != lo)
        ids = np.array([h[1] for h in held])
        i, j = similar_pairs([np.frombuffer(h[2], "<u8") for h in held], similarity, None if lo == hi else sum(h[0] == lo for h in held))
        a, b = forest(ids[i], ids[j]) if len(i) else (ids[:0], ids[:0])
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for component, lo, hi, own, i, digests in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if group != (component, lo, hi):
                    if len(held) > 1:
                        yield judged(held, *group[1:])
                    group, held = (component, lo, hi), []
                held.append((own, i, digests))
        if len(held) > 1:
            yield judged(held, *group[1:])

    return rows


def _confirmed(docs: DataFrame, found: DataFrame, k: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(a, b): a forest of the pairs within each candidate component whose texts have the similarity.

    A component is cut into blocks of bounded rows and bytes, and every pair
    of blocks is one group, so no task holds more than two blocks at a time.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), _copy(F.col(text_col)).alias("_copy"), F.col(text_col).alias("t"))
    ours = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_copy") == F.col("copy"))
    texts = texts.join(found, ours).dropDuplicates(["rep"]).select("component", "rep", "t")
    sets = stored(texts.mapInArrow(_set_rows(k), "component bigint, id bigint, n bigint, digests binary"))
    sizes = sets.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_DIGESTS)).cast("int").alias("many"))
    own = F.pmod(F.xxhash64("id"), F.col("many")).cast("int")
    dealt = sets.join(cut(sizes), "component").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "digests")
    grouped = dealt.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    return grouped.mapInArrow(_alike(similarity), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, distance: int = 60, blocks: int = 4, segments: Sequence[Sequence[int]] | None = None, similarity: float = 0.8, per_part: int = 1_000_000
) -> DataFrame:
    """(id, copy, f0, ..., component): components of pairs whose sets of k-word shingles have this Jaccard similarity or more.

    SimHash only names candidates: a similarity of 0.8 is a cosine of 0.89 and
    a distance of 39 of 256 bits on average, with a deviation of 5.7, of 48
    bits for texts of four and five shingles, so 60 bits lose few pairs of any
    size, while unrelated texts (128 bits, 8) are candidates at no corpus size. Segments widen with the corpus and their number
    follows, so that a pair at the similarity is a candidate with the
    probability RECALL at any size.

    The texts of each component of candidates are then held against each other
    by the exact similarity. Rows of equal sets are copies; equal fingerprints
    of different sets, as of two texts of one and two shingles, are not.
    """
    if segments is None:
        segments = segments_for(docs.count(), 64 * blocks, distance, similarity)
    prints = stored(set_fingerprints(docs, k, blocks, id_col, text_col))
    names = [f"f{i}" for i in range(blocks)]
    # rep stands for a set of shingles: ids may repeat; row is the one whose text is taken
    fields = [F.first(x).alias(x) for x in names]
    distinct = cut(prints.groupBy("rep").agg(F.min(F.struct("id", "copy")).alias("row"), *fields))
    edges = cut(_met(distinct, distinct.count(), blocks, segments, 0, distance, per_part))
    found = cut(_rows_of(components(edges), distinct))
    parts = cut(components(_confirmed(docs, found, k, similarity, id_col, text_col)).withColumnRenamed("id", "rep"))
    # sets that many rows share: the rows' side is the one that adaptive execution splits
    return prints.join(parts, "rep", "left").select("id", "copy", *names, F.coalesce("component", "rep").alias("component"))


def _rows_of(parts: DataFrame, distinct: DataFrame) -> DataFrame:
    """(component, rep, id, copy) of the fingerprints in components (id, component)."""
    return parts.select(F.col("id").alias("rep"), "component").join(distinct.select("rep", "row.id", "row.copy"), "rep").select("component", "rep", "id", "copy")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component: that of the smallest id (nulls last), of these the smallest text hash.

    Decisions are by id and text, so rows that share an id are judged each;
    of repeated rows one stays.
    """
    found = stored(near_duplicates(docs, id_col, text_col, **options).select("id", "copy", "component"))
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "copy")
    # stored, so that the join splits a component of very many rows
    first = cut(found.groupBy("component").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1"))
    judged = found.join(first.drop("n"), "component").select("id", "copy", (rank == F.col("first")).alias("stays"))
    keys = judged.groupBy("id", "copy").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    keys = cut(keys.select(F.col("id").alias("_id"), F.col("copy").alias("_copy"), F.col("stays").alias("_stays")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("bigint").alias("id"), _copy(F.col(text_col)).alias("copy"))
    ours = F.col("id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy"))
    rest = rows.join(keys, ours, "left_anti").select("row.*")
    again = keys.where("_stays")
    if again.isEmpty():
        return rest
    return rest.unionByName(rows.join(again, ours).dropDuplicates(["_id", "_copy"]).select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of 3 words; 3 bits or fewer: in one half of the bits at most one differs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = linked(fingerprints(docs, 3), 1, even_segments(64, 2), 1, 3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
