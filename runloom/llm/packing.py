"""Best-fit packing of tokenised documents by bin completion.

A document is its tokens and an end token. Only documents longer than a
sequence are cut; all their pieces but the first are full sequences. What is
left to pack is known by its length, so the search works on the histogram of
lengths (as many entries as a sequence has tokens, at any corpus size): it
takes the largest piece left, enumerates the undominated fillings of the room
beside it, largest sum first, and applies the chosen filling as often as the
counts allow, then less often. Branches whose waste exceeds what a better
solution may waste are pruned. The incumbent at the start is the best-fit
decreasing solution. Nothing but the number of nodes ends the search early.

Pieces of a length are numbered in buckets by a hash, so a length that a third
of the documents has is numbered by many tasks; the plan says for each number
which sequence and offset it gets.

Null and empty texts are documents of the end token alone. Texts of any length
are encoded whole. Repeated rows are packed each. An empty table gives no rows.
Further columns don't matter.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runloom.llm.common import parts_for, spread, stored

LENGTH = 1024
END = 2
#: Nodes that the search may open before it returns the best solution so far.
NODES = 2_000

_encoders: dict[str, object] = {}


def encoder(path: str):
    """text -> ids of the tokenizers file at path.

    A byte-level BPE whose ids follow the order of its merges is run by
    tiktoken with the same ranks, which gives the same ids several times
    faster; any other file by tokenizers itself, and so are texts that hold an
    added token's string or a long run without a change between white space
    and other characters, which tiktoken can't take.
    """
    if path not in _encoders:
        fast, plain = _ranked(path), _plain(path)
        _encoders[path] = (lambda text: (plain if fast[1].search(text) else fast[0])(text)) if fast else plain
    return _encoders[path]


def _plain(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


LONG_RUN = 1000


def _ranked(path: str):
    """The fast encoder and a pattern of what it must not be given; None if the file isn't of that kind."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    if model.get("type") not in (None, "BPE") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False or spec.get("normalizer") or model.get("ignore_merges") or model.get("unk_token"):
        return None
    # byte-level BPE writes printable bytes as themselves and the others from U+0100 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    order = [model["vocab"][m] for m in merged]
    if order != sorted(order) or len(ranks) != len(merged) + 256:
        return None
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the pattern of byte-level pre-tokenizers
    other = "|".join([rf"\s{{{LONG_RUN}}}", rf"\S{{{LONG_RUN}}}", *(re.escape(t["content"]) for t in spec.get("added_tokens", []))])
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, re.compile(other)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def cut_points(n: int, length: int) -> list[int]:
    """Where the pieces of a document of n tokens begin: the first piece is the one that may be shorter."""
    return [0, *range(n % length or length, n, length)] if n > length else [0]


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, crc32[, ids]) of every piece."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, out, all_ids = batch.slice(at, 1000), [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                    begs = cut_points(len(ids), length)
                    for i, (b, e) in enumerate(zip(begs, [*begs[1:], len(ids)], strict=True)):
                        out.append((doc, i, b, e - b, zlib.crc32(ids[b:e].tobytes())))
                        if with_ids:
                            all_ids.append(ids[b:e].tolist())
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
                names = ["id", "piece", "start", "length", "crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(all_ids, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.record_batch(columns, names=names)

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    return spread(texts).mapInArrow(rows, "id bigint, piece int, start bigint, length bigint, crc32 bigint" + ", ids array<bigint>" * with_ids)


Pattern = tuple[tuple[int, int], ...]  # (length, how often) in a sequence


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Sequences by pattern, placing lengths in falling order where the least room is left."""
    rooms: dict[int, dict[Pattern, int]] = {}

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            rooms.setdefault(room, {})
            rooms[room][pattern] = rooms[room].get(pattern, 0) + n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in sorted(r for r in rooms if r >= size):
            each = room // size
            for pattern, n in list(rooms[room].items()):
                whole = min(n, left // each)
                for k, m in ((each, whole), (left - whole * each if whole < n and left - whole * each < each else 0, 1)):
                    if k and m and left >= k * m:
                        rooms[room][pattern] -= m
                        put(room - k * size, (*pattern, (size, k)), m)
                        left -= k * m
                if not rooms[room][pattern]:
                    del rooms[room][pattern]
                if not left:
                    break
            if not rooms[room]:
                del rooms[room]
            if not left:
                break
        each = capacity // size
        put(capacity - each * size, ((size, each),), left // each)
        put(capacity - left % each * size, ((size, left % each),), 1 if left % each else 0)
    return [(p, n) for patterns in rooms.values() for p, n in patterns.items()]


class Fillings:
    """Undominated fillings of a room by pieces, as often as `left` has them: largest sum first, then fewest and largest pieces.

    A filling is dominated if some pieces of it could be exchanged for one
    larger piece that is left over, or for one of their sum, and it would still
    fit; also if a piece that is left over fits beside it. A dominated filling
    comes after what dominates it, so leaving it out loses no best solution.
    """

    def __init__(self, left: list[int]):
        self.left = left
        self.sizes = sum(1 << s for s, n in enumerate(left) if n)
        self.width = len(left)
        self.mirror = sum(1 << self.width - s for s, n in enumerate(left) if n)
        self.made: dict[int, list[int]] = {}

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if (self.left[size] > 0) != (self.sizes >> size & 1):
            self.sizes ^= 1 << size
            self.mirror ^= 1 << self.width - size

    def largest(self) -> int:
        return self.sizes.bit_length() - 1

    def _sums(self, k: int) -> int:
        """Bit set of the sums of k pieces of the lengths there are."""
        known = self.made.setdefault(self.sizes, [1])
        while len(known) <= k:
            rest, new, mask = self.sizes, 0, (1 << self.width) - 1
            while rest:
                low = rest & -rest
                new |= known[-1] << (low.bit_length() - 1)
                rest ^= low
            known.append(new & mask)
        if len(self.made) > 64:
            self.made = {self.sizes: known}
        return known[k]

    def _some(self, total: int, k: int) -> bool:
        """Whether k pieces of the lengths there are have this sum."""
        if k == 2:  # lengths s with total - s there too
            return self.sizes & (self.mirror >> (self.width - total)) != 0
        return (self.sizes if k == 1 else self._sums(k)) >> total & 1 == 1

    def _of(self, total: int, k: int, top: int, after: tuple[int, ...] = ()) -> Iterator[tuple[int, ...]]:
        """All fillings of k pieces of at most top with this sum that come after the given one, largest pieces first."""
        left = self.left
        if k == 1:
            if total <= top and left[total] and (not after or total < after[0]):
                yield (total,)
            return
        rest = self.sizes & ((2 << min(top, total - k + 1, *after[:1])) - 1)
        least = -(-total // k)
        while (a := rest.bit_length() - 1) >= least and a > 0:
            rest ^= 1 << a
            if left[a] and self._some(total - a, k - 1):
                left[a] -= 1
                for more in self._of(total - a, k - 1, a, after[1:] if after and a == after[0] else ()):
                    left[a] += 1
                    yield (a, *more)
                    left[a] -= 1
                left[a] += 1

    def _dominated(self, filling: tuple[int, ...], spare: int) -> bool:
        over = self.sizes
        for x in set(filling):
            if self.left[x] == filling.count(x):
                over &= ~(1 << x)
        if not over:
            return False
        if over & ((2 << spare) - 2):
            return True
        sums = {(0, 0)}  # (how many of up to two pieces, their sum); of three or more, likewise
        for x in filling[:12]:
            sums |= {(min(2, n + 1), t + x) for n, t in sums}
        return any(n and over >> (t + (n < 2)) & ((1 << (spare + (n > 1))) - 1) for n, t in sums)

    def within(self, room: int, least: int, after: tuple[int, ...] | None = None) -> Iterator[tuple[int, ...]]:
        """Fillings of sum least or more that come after the given one."""
        top = room if after is None else sum(after)
        if room - least >= room and (after is None or after) and not self.sizes & ((2 << room) - 2):
            yield ()
            return
        for total in range(top, max(0, least - 1), -1):
            for k in range(1, total + 1):
                if k > 1 and not self.sizes or k * ((self.sizes & -self.sizes).bit_length() - 1) > total:
                    break
                if after is not None and total == top and k < len(after) or k != 3 and not self._some(total, k):
                    continue
                same = after is not None and total == top and k == len(after)
                for filling in self._of(total, k, total, after if same else ()):
                    if not self._dominated(filling, room - total):
                        yield filling


@dataclass
class _Step:
    size: int
    options: Iterator[tuple[int, ...]]
    taken: tuple[int, ...] = ()
    times: int = 0
    spare: int = 0  # room left in each


def bin_completion(counts: dict[int, int], capacity: int, nodes: int | None = NODES) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences have each; as few sequences as the search finds, the fewest there can be with nodes=None.

    The fillings beside pieces of one length are taken in falling order, each
    as often as the counts allow at first, then less often.
    """
    total = sum(s * n for s, n in counts.items())
    bound = -(-total // capacity)
    best = best_fit_decreasing(counts, capacity)
    fewest = sum(n for _, n in best)
    left = [0] * (capacity + 1)
    for s, n in counts.items():
        left[s] = n
    there = Fillings(left)
    stack: list[_Step] = []
    opened = waste = used = 0

    def apply(step: _Step, sign: int) -> None:
        nonlocal waste, used
        for x in (step.size, *step.taken):
            there.take(x, sign * step.times)
        used += sign * step.times
        waste += sign * step.times * step.spare

    while fewest > bound and (nodes is None or opened < nodes):
        allowed = (fewest - 1) * capacity - total - waste
        if there.sizes and allowed >= 0:
            size = there.largest()
            after = stack[-1].taken if stack and stack[-1].size == size else None
            stack.append(_Step(size, _beside(there, size, capacity - size, capacity - size - allowed, after)))
        elif not there.sizes and used < fewest:
            best, fewest = [(_pattern(s.size, s.taken), s.times) for s in stack], used
            continue
        while stack:  # the next option of the deepest step that has one
            step = stack[-1]
            opened += 1
            if step.times:
                apply(step, -1)
                step.times -= 1
            allowed = (fewest - 1) * capacity - total - waste
            if not step.times:
                found = next(step.options, None)
                if found is None:
                    stack.pop()
                    continue
                step.taken, step.spare = found, capacity - step.size - sum(found)
                step.times = min(left[x] // k for x, k in _pattern(step.size, found))
                if step.spare:
                    step.times = min(step.times, max(0, allowed) // step.spare)
            if step.times and step.times * step.spare <= allowed:
                apply(step, 1)
                break
            step.times = 0
        if not stack:
            break
    return best


def _beside(there: Fillings, size: int, room: int, least: int, after: tuple[int, ...] | None) -> Iterator[tuple[int, ...]]:
    """Fillings beside one piece of this length, which is out while the next one is looked for."""
    there.take(size, 1)
    found = there.within(room, least, after)
    while True:
        filling = next(found, None)
        there.take(size, -1)
        if filling is None:
            return
        yield filling
        there.take(size, 1)


def _pattern(size: int, taken: tuple[int, ...]) -> Pattern:
    need: dict[int, int] = {}
    for x in (size, *taken):
        need[x] = need.get(x, 0) + 1
    return tuple(sorted(need.items(), reverse=True))


class Plan:
    """Which sequence and offset the n-th piece of a length gets."""

    def __init__(self, patterns: list[tuple[Pattern, int]]):
        rows, given, sequence = [], {}, 0
        for pattern, times in patterns:
            offset = 0
            for size, k in pattern:
                rows.append((size, given.get(size, 0), k, sequence, offset))
                given[size] = given.get(size, 0) + k * times
                offset += size * k
            sequence += times
        rows.sort()
        self.sequences = sequence
        self.size, self.first, self.each, self.base, self.offset = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 5))
        self.key = (self.size << 44) | self.first

    def place(self, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (size << 44) | number, "right") - 1
        nth = number - self.first[i]
        return self.base[i] + nth // self.each[i], self.offset[i] + nth % self.each[i] * size


def pack(pieces: DataFrame, capacity: int = LENGTH, nodes: int | None = NODES) -> DataFrame:
    """The rows of pieces (id, piece, length, ...) with sequence_id and offset. Reads pieces twice: pass a stored frame."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = spark.sparkContext.broadcast(Plan(bin_completion(counts, capacity, nodes)))
    buckets = parts_for(sum(counts.values()), 50_000, 64)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    # numbers within a length: those of the buckets before, and the row's own in its bucket
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("id", "piece")) - 1)
    numbered = own.join(starts, ["length", "_bucket"]).select(*pieces.columns, (F.col("_first") + F.col("_own")).alias("_number"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [pieces_columns.index("length"), len(pieces_columns)]
        for batch in batches:
            sequence, offset = plan.value.place(*(batch.column(i).to_numpy() for i in at)) if batch.num_rows else (np.zeros(0, np.int64),) * 2
            yield pa.record_batch([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*pieces_columns, "sequence_id", "offset"])

    pieces_columns = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(rows, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, nodes: int | None = NODES) -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids] of every piece."""
    pieces = stored(token_pieces(docs, tokenizer or default_tokenizer(), length, END, id_col, text_col, with_ids))
    return pack(pieces, length, nodes).withColumnsRenamed({"id": id_col, "crc32": "ids_crc32"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
