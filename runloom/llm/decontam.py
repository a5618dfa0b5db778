"""Benchmark decontamination by suffix arrays over the training documents.

Every task indexes its documents in shards: the words of the shard become
numbers (0 for words outside the benchmark and between documents), and the
suffixes that start with words a test window could start with are sorted by
their first `window` words. Every test suffix is then searched in that array
by bisection; equal ranges are its verbatim occurrences, and runs of them on
one diagonal are the longest matches. What a document is charged with (hit
words, items, whether it stays) comes from its longest matches. The shard's
array holds no suffix that no window can match, and all others, so nothing is
lost.

The test side goes to the tasks in parts of bounded size, one broadcast each;
a task takes its documents through all of them, holding one part at a time, so
the documents are scanned once and give one row each at any benchmark size.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A test
item of fewer words than the window is one window itself; one without words
matches nothing; one without id hits words but isn't listed. Null texts have
no words. Repeated rows, and rows that share an id, are judged each; texts of
any length are read whole; an empty benchmark hits nothing and an empty table
gives no rows. Further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import spread

WINDOW = 10
SHARD_WORDS = 1_000_000
#: Bytes of benchmark text in a part; an item that is longer is a part by itself.
PART_BYTES = 4 << 20
SLOT_BITS = 22
#: Pairs of a place in a shard and one in a part that are laid on diagonals at once.
PAIRS = 2_000_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


@dataclass
class TestSide:
    """A part of the benchmark: its words as numbers, and the starts of its windows in the order of their words."""

    vocabulary: dict[bytes, int]
    window: int
    lead: int  # words that every window has
    slots: np.ndarray  # which hashes of `lead` words start a window
    items: list[int | None]
    begs: np.ndarray  # first word of each item in ids
    ids: np.ndarray  # all items, a 0 after each
    starts: list[tuple[int, np.ndarray, np.ndarray]]  # by window length: starts in order, first of each distinct window

    @staticmethod
    def of(items: Sequence[tuple[int | None, str | None]], window: int) -> TestSide:
        vocabulary: dict[bytes, int] = {}
        texts = [np.array([*(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(t)), 0], np.uint32) for _, t in items]
        sizes = np.array([len(t) - 1 for t in texts], np.int64)
        begs = np.cumsum(np.concatenate(([0], sizes + 1)))
        ids = np.concatenate([*texts, np.zeros(window, np.uint32)])
        lead, slots, starts = min([4, *sizes[sizes > 0].tolist()]), np.zeros(1 << SLOT_BITS, bool), []
        for n in sorted(set(np.minimum(sizes[sizes > 0], window).tolist())):
            own = np.flatnonzero(np.minimum(sizes, window) == n)
            at = np.concatenate([np.arange(begs[i], begs[i] + sizes[i] - n + 1) for i in own])
            slots[_slot(ids[at[:, None] + np.arange(lead)].T.astype(np.uint64))] = True
            keys = _as_keys(ids[at[:, None] + np.arange(n)], n, 0)
            order = np.argsort(keys, kind="stable")
            firsts = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
            starts.append((n, at[order], firsts))
        return TestSide(vocabulary, window, lead, slots, [i for i, _ in items], begs, ids, starts)


def _slot(columns: np.ndarray) -> np.ndarray:
    h = np.zeros(columns.shape[1], np.uint64)
    for c in columns:
        h = (h + c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _as_keys(matrix: np.ndarray, width: int, pad: int) -> np.ndarray:
    """Rows of numbers as byte strings that sort alike, filled up with pad."""
    out = np.full((len(matrix), width), pad, ">u4")
    out[:, : matrix.shape[1]] = matrix
    return np.ascontiguousarray(out).view(f"S{4 * width}").ravel()


class SuffixArray:
    """The shard's suffixes that a window can start, ordered by their first words."""

    def __init__(self, ids: np.ndarray, test: TestSide):
        padded = np.concatenate((ids, np.zeros(test.window, ids.dtype)))
        n, width = len(ids), test.window
        h = _slot(np.lib.stride_tricks.sliding_window_view(padded[: n + test.lead - 1], test.lead).T.astype(np.uint64)) if n else np.zeros(0, np.int64)
        starts = np.flatnonzero(test.slots[h] & (ids != 0))
        suffixes = padded[starts[:, None] + np.arange(width)] if len(starts) else np.zeros((0, width), ids.dtype)
        keys = _as_keys(suffixes, width, 0)
        order = np.argsort(keys, kind="stable")
        self.starts, self.keys = starts[order], keys[order]

    def ranges(self, windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """[left, right) of the suffixes that start with each window, by bisection."""
        left = np.searchsorted(self.keys, _as_keys(windows, width, 0), "left")
        right = np.searchsorted(self.keys, _as_keys(windows, width, 0xFFFFFFFF), "right")
        return left, right


def _spread_out(count: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of so many."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _occurrences(ids: np.ndarray, test: TestSide) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window length, places in the shard, places in the part) of windows that occur, at most about PAIRS at a time."""
    array = SuffixArray(ids, test)
    for n, starts, firsts in test.starts:
        ends = np.append(firsts[1:], len(starts))
        for at in range(0, len(firsts), 1 << 17):
            own = slice(at, at + (1 << 17))
            left, right = array.ranges(test.ids[starts[firsts[own]][:, None] + np.arange(n)], test.window)
            hit = np.flatnonzero(right > left)
            here, there = right[hit] - left[hit], ends[own][hit] - firsts[own][hit]
            for beg, end in _chunks(here * there, PAIRS):
                i = hit[beg:end]
                a, b = here[beg:end], there[beg:end]
                nth = _spread_out(a * b)
                many = np.repeat(b, a * b)
                p = array.starts[np.repeat(left[i], a * b) + nth // many]
                q = starts[np.repeat(firsts[own][i], a * b) + nth % many]
                yield n, p, q


def _chunks(cost: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges whose cost is at most `most`, or single ones."""
    beg, total = 0, 0
    for i, c in enumerate(cost.tolist()):
        if total and total + c > most:
            yield beg, i
            beg, total = i, 0
        total += c
    if total:
        yield beg, len(cost)


def longest_matches(ids: np.ndarray, test: TestSide) -> np.ndarray:
    """(place in the shard, place in the part, words) of every longest match: runs of occurrences on one diagonal."""
    runs = np.zeros((0, 3), np.int64)
    for n, p, q in _occurrences(ids, test):
        runs = _merged(np.concatenate((runs, np.stack((p, q, np.full(len(p), n)), axis=1))))
    return runs


def _merged(runs: np.ndarray) -> np.ndarray:
    """Runs on one diagonal that overlap or touch by a word, as one."""
    runs = runs[np.lexsort((runs[:, 0], runs[:, 0] - runs[:, 1]))]
    lag, end = runs[:, 0] - runs[:, 1], runs[:, 0] + runs[:, 2]
    group = np.cumsum(np.concatenate(([0], lag[1:] != lag[:-1])))
    span = int(end.max(initial=0)) + 2
    reach = np.maximum.accumulate(end + group * span)
    first = np.concatenate(([True], (runs[1:, 0] + group[1:] * span) >= reach[:-1]))[: len(runs)]
    begs = np.flatnonzero(first)
    last = np.append(begs[1:], len(runs)) - 1
    return np.stack((runs[begs, 0], runs[begs, 1], reach[last] - group[last] * span - runs[begs, 0]), axis=1)


def _shards(texts: Sequence[str | None]) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """(rows, their words) of about SHARD_WORDS words."""
    rows, held, size = [], [], 0
    for i, text in enumerate(texts):
        rows.append(i)
        held.append(words_of(text))
        size += len(held[-1]) + 1
        if size >= SHARD_WORDS:
            yield rows, held
            rows, held, size = [], [], 0
    if rows:
        yield rows, held


def _numbers(words: list[list[bytes]], vocabulary: dict[bytes, int]) -> np.ndarray:
    """All words as numbers, a 0 after each document."""
    get, n = vocabulary.get, sum(map(len, words)) + len(words)
    return np.fromiter((x for w in words for x in (*(get(v, 0) for v in w), 0)), np.uint32, n)


def _parts(tests: Sequence) -> Iterator[TestSide]:
    """The parts one after the other; of several only one is held."""
    for test in tests:
        yield test.value
        if len(tests) > 1:
            test.__dict__.pop("_value", None)  # a worker would keep it


def matched(texts: Sequence[str | None], tests: Sequence) -> Iterator[tuple[list[int], np.ndarray, list[tuple[list[int | None], np.ndarray, np.ndarray]]]]:
    """(rows, first word of each, [(items, words in them, longest matches)]) of every shard."""
    for rows, words in _shards(texts):
        begs = np.cumsum([0, *(len(w) + 1 for w in words)])
        found = []
        for test in _parts(tests):
            runs = longest_matches(_numbers(words, test.vocabulary), test)
            if len(runs):
                item = np.searchsorted(test.begs, runs[:, 1], "right") - 1
                found.append(([test.items[i] for i in item.tolist()], runs[:, 1] - test.begs[item], runs))
        yield rows, begs, found


def scan(texts: Sequence[str | None], tests: Sequence) -> tuple[list[int], list[np.ndarray], list[set[int]], list[int]]:
    """For each text: number of words, positions of hit words, items that occur, words of its longest match."""
    n_words, hits, items, longest = [0] * len(texts), [np.zeros(0, np.int64)] * len(texts), [set() for _ in texts], [0] * len(texts)
    for rows, begs, found in matched(texts, tests):
        cover = np.zeros(int(begs[-1]) + 1, np.int64)
        for names, _, runs in found:
            np.add.at(cover, runs[:, 0], 1)
            np.add.at(cover, runs[:, 0] + runs[:, 2], -1)
            for d, item, n in {*zip((np.searchsorted(begs, runs[:, 0], "right") - 1).tolist(), names, runs[:, 2].tolist(), strict=True)}:
                longest[rows[d]] = max(longest[rows[d]], n)
                if item is not None:
                    items[rows[d]].add(item)
        hit = np.flatnonzero(np.cumsum(cover) > 0)
        cuts = np.searchsorted(hit, begs)
        for d, row in enumerate(rows):
            n_words[row] = int(begs[d + 1] - begs[d] - 1)
            hits[row] = hit[cuts[d] : cuts[d + 1]] - begs[d]
    return n_words, hits, items, longest


def _broadcast(benchmark: DataFrame, item_col: str, text_col: str, window: int, part_bytes: int) -> list:
    """The test side in parts, each built by itself."""
    sc, out, held, size = benchmark.sparkSession.sparkContext, [], [], 0
    rows = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(text_col).alias("t")).where("t is not null")
    for r in rows.toLocalIterator():
        held.append((r.item, r.t))
        size += len(r.t.encode())
        if size >= part_bytes:
            out.append(sc.broadcast(TestSide.of(held, window)))
            held, size = [], 0
    if held:
        out.append(sc.broadcast(TestSide.of(held, window)))
    return out


def annotated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """(row struct, n_words, hits, items, longest) of every row."""
    tests = _broadcast(benchmark, item_col, "text", window, part_bytes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                piece = batch.slice(at, 2000)
                n_words, hits, items, longest = scan(piece.column(1).to_pylist(), tests)
                columns = [pa.array(n_words, pa.int64()), pa.array([h.tolist() for h in hits], pa.list_(pa.int64())), pa.array([sorted(i) for i in items], pa.list_(pa.int64())), pa.array(longest, pa.int64())]
                yield pa.record_batch([piece.column(0), *columns], names=["row", "n_words", "hits", "items", "longest"])

    source = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("t"))
    return spread(source).mapInArrow(rows, f"row {source.schema['row'].dataType.simpleString()}, n_words bigint, hits array<bigint>, items array<bigint>, longest bigint")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256, contaminated, longest (words of the longest match)."""
    found = annotated(docs.select(F.col(id_col), F.col(text_col)), benchmark, text_col, **options)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        F.col(f"row.{id_col}").alias(id_col),
        "n_words",
        F.size("hits").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "longest",
    )


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Longest verbatim matches and their places: (id, item, doc_word, item_word, n_words)."""
    tests = _broadcast(benchmark, item_col, "text", window, part_bytes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for own, begs, found in matched(batch.column(1).to_pylist(), tests):
                for names, item_word, runs in found:
                    d = np.searchsorted(begs, runs[:, 0], "right") - 1
                    columns = [[ids[own[i]] for i in d.tolist()], names, runs[:, 0] - begs[d], item_word, runs[:, 2]]
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["id", "item", "doc_word", "item_word", "n_words"])

    texts = docs.select(F.col(id_col).cast("bigint"), F.col(text_col))
    return spread(texts).mapInArrow(rows, "id bigint, item bigint, doc_word bigint, item_word bigint, n_words bigint")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without a match, with their columns."""
    return annotated(docs, benchmark, text_col, **options).where("longest = 0").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("longest")


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bw
), sizes AS (
  SELECT DISTINCT n FROM win
), dw AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n
), hits AS (
  SELECT doc_id, dw.n, i, item_id FROM dw JOIN win ON dw.n = win.n AND array_to_string(w[i:i + dw.n - 1], ' ') = g
), words AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS s FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
