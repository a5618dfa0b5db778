"""The engine on golden strings, random strings and awkward bytes, against direct definitions."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runloom.functions import growing, kernels
from runloom.functions.runindex import RunIndex
from runloom.operators import checks, edits, factors, points, search
from runloom.operators.asof import asof
from runloom.plans import huge, stored
from runloom.plans import relations as R
from runloom.sources import readers
from runloom.streaming import appends

GOLDEN = {
    b"": ([0], [], []),
    b"a": ([0, 1], [("a", 1)], [(0, 0, "a")]),
    b"aaaa": ([0, 1, 2, 3, 4], [("a", 4)], [(0, 0, "a"), (0, 2, "a")]),
    b"banana": ([0, 2, 4, 6, 1, 3, 5], [("b", 1), ("n", 2), ("a", 3)], [(0, 0, "b"), (0, 0, "a"), (0, 0, "n"), (1, 2, "a")]),
    b"abababab": ([0, 1, 3, 5, 7, 2, 4, 6, 8], [("a", 1), ("b", 4), ("a", 3)], [(0, 0, "a"), (0, 0, "b"), (0, 5, "b")]),
    b"abracadabra": ([0, 1, 6, 8, 4, 11, 2, 9, 5, 7, 3, 10], [("a", 1), ("b", 1), ("d", 1), ("b", 1), ("c", 1), ("r", 2), ("a", 4)], [(0, 0, "a"), (0, 0, "b"), (0, 0, "r"), (0, 1, "c"), (0, 1, "d"), (0, 3, "a")]),
    b"mississippi": ([0, 2, 11, 5, 8, 1, 9, 10, 3, 6, 4, 7], [("m", 1), ("s", 2), ("p", 1), ("i", 1), ("p", 1), ("i", 1), ("s", 2), ("i", 2)], [(0, 0, "m"), (0, 0, "i"), (0, 0, "s"), (2, 1, "i"), (2, 3, "p"), (8, 1, "i")]),
}
PATTERNS = [b"a", b"abra", b"bra", b"abx", b"z", b"", b"ssi", b"issi", b"i", b"ppi", b"aa"]
MORE = [bytes(range(256)), b"\x00\xff\x00\xff\x00", "été ☃ été ☃".encode()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate([*GOLDEN, *MORE])], "doc_id bigint, text binary").cache()


@pytest.fixture(scope="module")
def bwt(docs):
    return R.bwt(docs).cache()


def prefixes(text):
    return sorted(range(len(text) + 1), key=lambda k: text[:k][::-1])


def by_doc(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in columns))
    return out


def test_golden_rows_runs_and_factors(docs, bwt):
    rows = by_doc(bwt.orderBy("bwt_pos"), "txt_pos", "ch")
    runs = by_doc(R.runs(bwt).orderBy("run_id"), "ch", "run_len")
    found = by_doc(factors.factorise(docs).orderBy("factor_no"), "beg", "len", "ch")
    for i, (text, (order, expected, parsed)) in enumerate(GOLDEN.items()):
        assert [r[0] for r in rows[i]] == order
        assert [r[1] for r in rows[i]] == [text[k] if k < len(text) else None for k in order]
        assert [(chr(c), n) for c, n in runs.get(i, [])] == expected
        assert [(b, n, chr(c)) for b, n, c in found.get(i, [])] == parsed


def test_golden_run_samples(bwt):
    i = list(GOLDEN).index(b"abracadabra")
    got = by_doc(R.runs(bwt).where(F.col("doc_id") == i).orderBy("run_id"), "ch", "run_len", "rle_start", "head_txt", "tail_txt")[i]
    assert [(chr(c), *rest) for c, *rest in got] == [("a", 1, 0, 0, 0), ("b", 1, 1, 1, 1), ("d", 1, 2, 6, 6), ("b", 1, 3, 8, 8), ("c", 1, 4, 4, 4), ("r", 2, 5, 2, 9), ("a", 4, 7, 5, 10)]
    entries = dict(by_doc(R.next_position_map(bwt).where(F.col("doc_id") == i), "key", "val")[i])
    assert entries == {0: 1, 1: 6, 4: 11, 6: 8, 8: 4, 9: 5, 11: 2}


def test_golden_points(spark, bwt):
    i = list(GOLDEN).index(b"abracadabra")
    asked = spark.createDataFrame([(i, ord("a"), 7), (i, ord("r"), 6), (i, ord("z"), 6)], "doc_id bigint, ch int, rle_pos bigint")
    assert {chr(r.ch): r.total_rank for r in points.total_rank(bwt, asked).collect()} == {"a": 2, "r": 11, "z": 0}
    asked = spark.createDataFrame([(i, t) for t in (1, 5, 6, 8, 11, 12)], "doc_id bigint, t bigint")
    assert {r.t: r.rle_pos for r in points.select_total(bwt, asked).collect()} == {1: 0, 5: 10, 6: 1, 8: 4, 11: 6, 12: None}


def test_patterns_in_both_index_forms_and_by_scan(spark, docs, bwt):
    patterns = readers.pattern_rows(spark, PATTERNS)
    found = search.intervals(docs, patterns)
    index = {(r.doc_id, r.pat_id): r for r in found.collect()}
    steps = {(r.doc_id, r.pat_id): r for r in search.stepped_intervals(bwt, patterns).collect()}
    scan = {(r.doc_id, r.pat_id): r.n_occ for r in search.scan_counts(docs, PATTERNS).collect()}
    places = {}
    for r in search.locate(bwt, found).orderBy("bwt_pos").collect():
        places.setdefault((r.doc_id, r.pat_id), []).append(r.beg)
    ends = {(r.doc_id, r.pat_id): r.ends for r in search.at_end(bwt, found).collect()}
    first = {(r.doc_id, r.pat_id): r.first_end for r in search.first_occurrence(bwt, found).collect()}
    for d, text in enumerate([*GOLDEN, *MORE]):
        order = prefixes(text)
        for p, pattern in enumerate(PATTERNS):
            rows = [i for i, k in enumerate(order) if text[:k].endswith(pattern)]
            got = index[d, p]
            assert tuple(got) == tuple(steps[d, p])
            assert got.n_occ == len(rows) == scan[d, p]
            assert (got.l, got.r) == ((rows[0], rows[-1] + 1) if rows else (None, None))
            assert got.matched == max(m for m in range(len(pattern) + 1) if pattern[:m] in text)
            assert places.get((d, p), []) == [order[i] - len(pattern) for i in rows]
            assert ends[d, p] == text.endswith(pattern)
            assert first.get((d, p)) == (order[rows[0]] if rows else None)


def test_direct_forms_equal_the_relational_ones(docs, bwt):
    key = lambda df: sorted(map(str, df.collect()))
    columns = ("doc_id", "run_id", "ch", "run_len", "rle_start", "head_txt", "tail_txt")
    assert key(R.text_runs(docs)) == key(R.runs(bwt).select(*columns))
    assert key(R.text_stats(docs)) == key(R.stats(bwt).select("doc_id", "n", "r", "sigma", "em_pos", "n_per_run"))
    assert key(R.text_next_position_map(docs)) == key(R.next_position_map(bwt))


def test_doubling_form_gives_the_same_rows(docs, bwt):
    assert sorted(map(str, huge.bwt(huge.symbols(docs)).collect())) == sorted(map(str, bwt.select("doc_id", "bwt_pos", "txt_pos", "ch").collect()))


def test_inversion_chain_and_next_positions(docs, bwt):
    assert all(r.same for r in checks.roundtrip(docs, checks.invert(bwt)).collect())
    assert all(r.n_bad == 0 for r in checks.chain_check(bwt).collect())
    lead = sorted(R.next_positions(bwt).where("next_txt is not null").collect())
    assert sorted(checks.next_position_by_map(bwt).collect()) == lead
    bad = checks.run_invariants(R.runs(bwt)).where("n_empty > 0 or n_unmerged > 0")
    assert bad.count() == 0


def test_stats_of_empty_and_single_texts(bwt):
    got = {r.doc_id: (r.n, r.r, r.sigma, r.em_pos) for r in R.stats(bwt).collect()}
    assert got[0] == (0, 0, 0, 0) and got[1] == (1, 1, 1, 1) and got[3] == (6, 3, 3, 3)


def test_factor_files(spark, docs):
    found = factors.factorise(docs)
    files = readers.factor_files(found)
    assert all(len(r.content) % readers.RECORD_BYTES == 0 for r in files.collect())
    assert sorted(readers.read_factor_files(files).collect()) == sorted(found.collect())
    decoded = {r.doc_id: bytes(r.text) for r in factors.decode(readers.read_factor_files(files)).collect()}
    assert decoded == {i: t for i, t in enumerate([*GOLDEN, *MORE]) if t}
    torn = spark.createDataFrame([(1, bytearray(b"\x01\0\0\0\x02\0\0\0a\x05"))], "doc_id bigint, content binary")
    assert [tuple(r) for r in readers.read_factor_files(torn).collect()] == [(1, 0, 1, 2, 97)]


def plain_factors(text):
    """Factors by their definition: all earlier occurrences, the one whose prefix comes first."""
    out, s = [], 0
    while s < len(text):
        full = 0
        while s + full < len(text) and text.find(text[s : s + full + 1], 0, s + full) >= 0:
            full += 1
        begs = [j for j in range(s) if text[j : j + full] == text[s : s + full]] if full else [0]
        close = min(s + full, len(text) - 1)
        out.append((min(begs, key=lambda j: text[: j + full][::-1]), close - s, text[close]))
        s = close + 1
    return out


def repetitive(rng):
    """A text of pieces that come again, alone or many times, with other symbols between them."""
    symbols = rng.choice([b"\0", b"\0a", b"ab", b"abcdefgh", bytes(range(256))])
    pieces = [bytes(rng.choices(symbols, k=rng.choice([1, 3, 12, 70]))) for _ in range(3)]
    return b"".join(rng.choice(pieces) * rng.choice([1, 1, 2, 9]) + bytes(rng.choices(symbols, k=rng.randint(0, 2))) for _ in range(rng.randint(0, 25)))


def test_factors_of_many_texts_at_once():
    rng = random.Random(6)
    for _ in range(40):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 6))] + [b"", b"\0" * 90, b"abcdefghijklmnop".join(bytes([i]) for i in range(60))]
        rng.shuffle(texts)
        counts, *columns = kernels.factor_arrays(texts)
        found = iter(zip(*(c.tolist() for c in columns), strict=True))
        assert [[next(found) for _ in range(n)] for n in counts.tolist()] == [plain_factors(t) for t in texts]
        assert next(found, None) is None
    assert [len(x) for x in kernels.factor_arrays([])] == [0] * 4


def test_factors_of_a_text_that_grows_by_long_pieces():
    rng = random.Random(8)
    for _ in range(20):
        index, found, text = growing.Growing(), [], b""
        for piece in [repetitive(rng) * 2 for _ in range(3)]:
            found += index.extend(piece)
            text += piece
            last = index.open_factor()
            assert [f[1:] for f in found] + ([last[1:]] if last else []) == kernels.factorise(text)


def test_files_straight_from_texts(spark, docs, tmp_path):
    rng = random.Random(7)
    more = spark.createDataFrame([(100 + i, bytearray(repetitive(rng))) for i in range(300)], docs.schema).repartition(2)
    docs = docs.unionByName(more)
    want = {r.doc_id: bytes(r.content) for r in readers.factor_files(factors.factorise(docs)).collect()}
    factors.factorise_files(docs, f"{tmp_path}/lz")
    assert {int(p.stem): p.read_bytes() for p in (tmp_path / "lz").glob("*.lz")} == want
    read = readers.read_files(spark, f"{tmp_path}/lz", ".lz")
    assert {r.doc_id: bytes(r.content) for r in read.collect()} == want
    assert read.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism  # no task for every few files
    texts = {r.doc_id: bytes(r.text) for r in docs.collect() if r.text}
    assert {r.doc_id: r.n_bytes for r in factors.decode_files(spark, f"{tmp_path}/lz", f"{tmp_path}/txt").collect()} == {i: len(t) for i, t in texts.items()}
    assert {int(p.stem): p.read_bytes() for p in (tmp_path / "txt").glob("[0-9]*")} == texts
    dealt = readers.write_files(docs.select((F.col("doc_id") - 9).alias("doc_id"), "text"), f"{tmp_path}/dealt", ".txt", folders=7)
    assert {r.path.removeprefix(f"{tmp_path}/dealt/") for r in dealt.collect()} == {f"{(r.doc_id - 9) % 7}/{r.doc_id - 9}.txt" for r in docs.collect()}
    assert {r.doc_id + 9: bytes(r.content) for r in readers.read_files(spark, f"{tmp_path}/dealt", ".txt").collect()} == texts
    readers.write_files(spark.createDataFrame([(1, bytearray(b"\0\0\0\0\0\0\0\0a\x05")), (2, None)], "doc_id bigint, content binary"), f"{tmp_path}/torn", ".lz")
    assert [tuple(r) for r in factors.decode_files(spark, f"{tmp_path}/torn", f"{tmp_path}/torn-txt").select("doc_id", "n_bytes").collect()] == [(1, 1)]
    with pytest.raises(ValueError, match="no room in a record"):
        readers.records(np.array([0]), np.array([1 << 32]), np.array([97], np.uint8))


def test_roundtrip_tells_texts_apart(spark):
    docs = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate([b"ab", b"", b"ab", b"", b"ab", b"ab"])], "doc_id bigint, text binary")
    other = spark.createDataFrame([(0, bytearray(b"ab")), (1, bytearray(b"")), (2, bytearray(b"ba")), (4, None)], docs.schema)
    got = sorted(tuple(r) for r in checks.roundtrip(docs, other).collect())
    assert got == [(0, 2, True), (1, 0, True), (2, 2, False), (3, 0, True), (4, 2, False), (5, 2, False)]


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=30) | st.text("ab", max_size=30).map(str.encode) | st.text("abc", max_size=60).map(str.encode))
def test_kernels_against_definitions(text):
    symbols = np.frombuffer(text, np.uint8)
    order = kernels.prefix_order(symbols)
    assert order.tolist() == prefixes(text)
    follow = np.array([text[k] if k < len(text) else -1 for k in order], np.int64)
    assert kernels.invert(follow, int(np.flatnonzero(order == len(text))[0])).astype(np.uint8).tobytes() == text
    found = kernels.factorise(text)
    assert kernels.unfactorise(found) == text
    row = {k: i for i, k in enumerate(order.tolist())}
    s = 0
    for beg, length, ch in found:
        full = max(m for m in range(len(text) - s + 1) if any(text[j : j + m] == text[s : s + m] for j in range(s)) or m == 0)
        ends = [j + full for j in range(s) if text[j : j + full] == text[s : s + full]]
        assert beg == (min(ends, key=row.get) - full if full else 0)
        assert (length, ch) == ((full, text[s + full]) if s + full < len(text) else (full - 1, text[-1]))
        s += length + 1
    for pattern in (text[2:5], text[:1] + b"q", text[-3:]):
        left, right, matched = kernels.Intervals(symbols, order).find(np.frombuffer(pattern, np.uint8))
        assert matched == max(m for m in range(len(pattern) + 1) if pattern[:m] in text)
        assert [i for i, k in enumerate(order) if text[:k].endswith(pattern[:matched])] == list(range(left, right))


def test_symbols_beyond_bytes(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([500, 7, 500, 7, 100000])], "k long, at long, s int")
    rows = R.bwt(readers.symbol_sequences(df, "k", ["at"], F.col("s")), "symbols")
    assert [(r.txt_pos, r.ch) for r in rows.orderBy("bwt_pos").collect()] == [(0, 500), (2, 500), (4, 100000), (1, 7), (3, 7), (5, None)]


def apply_insert(runs, pos, ch, weight, val1, val2):
    at = 0
    for i, (c, w, v) in enumerate(runs):
        if at <= pos < at + w or i == len(runs) - 1 and pos == at + w:
            if c == ch:
                return [*runs[:i], (c, w + weight, v), *runs[i + 1 :]]
            if pos == at + w:
                return [*runs, (ch, weight, val1)]
            if pos == at:
                if i and runs[i - 1][0] == ch:
                    p = runs[i - 1]
                    return [*runs[: i - 1], (p[0], p[1] + weight, p[2]), *runs[i:]]
                return [*runs[:i], (ch, weight, val1), *runs[i:]]
            return [*runs[:i], (c, pos - at, v), (ch, weight, val1), (c, at + w - pos, val2), *runs[i + 1 :]]
        at += w
    return runs


def test_valued_runs(spark):
    rng = random.Random(1)
    strings, asked, want, pushed = [], [], {}, {}
    for d in range(150):
        runs = []
        for _ in range(rng.randint(1, 5)):
            c = rng.choice([x for x in (1, 2, 3) if not runs or x != runs[-1][0]])
            runs.append((c, rng.randint(1, 4), rng.randint(0, 9)))
        strings += [(d, i, *r) for i, r in enumerate(runs)]
        edit = (rng.randint(0, sum(w for _, w, _ in runs)), rng.randint(1, 3), rng.randint(1, 3), 50, 60)
        asked.append((d, *edit))
        want[d] = apply_insert(runs, *edit)
        pushed[d] = apply_insert(runs, sum(w for _, w, _ in runs), *edit[1:])
    df = spark.createDataFrame(strings, "doc_id bigint, run_id bigint, ch int, weight bigint, val bigint")
    e = spark.createDataFrame(asked, "doc_id bigint, pos bigint, new_ch int, new_weight bigint, val1 bigint, val2 bigint")
    assert by_doc(edits.insert_run(df, e).orderBy("run_id"), "ch", "weight", "val") == want
    assert by_doc(edits.push_back(df, e.drop("pos", "val2")).orderBy("run_id"), "ch", "weight", "val") == pushed
    split = by_doc(edits.split_run(df, e.select("doc_id", "pos", "val2")).orderBy("run_id"), "ch", "weight")
    assert all(sum(w for _, w in split[d]) == sum(r[3] for r in strings if r[0] == d) for d in split)
    changed = edits.change_weight(df, spark.createDataFrame([(0, 0, -1), (1, 0, 5)], "doc_id bigint, run_id bigint, delta bigint"))
    assert changed.agg(F.sum("weight")).first()[0] == sum(r[3] for r in strings) + 4
    valued = edits.set_value(df, spark.createDataFrame([(0, 0, None), (1, 0, 5)], "doc_id bigint, run_id bigint, new_val bigint"))
    assert {(r.doc_id, r.val) for r in valued.where("run_id = 0 and doc_id < 2").collect()} == {(0, None), (1, 5)}


def test_successor_entries(spark):
    entries = spark.createDataFrame([(1, 5, 50), (1, 9, 90)], "doc_id bigint, key bigint, val bigint")
    changed = edits.set_key(entries, spark.createDataFrame([(1, 5, 0), (2, 1, 1)], entries.schema))
    assert sorted(map(tuple, changed.collect())) == [(1, 5, 0), (1, 9, 90), (2, 1, 1)]
    assert [tuple(r) for r in edits.remove_key(entries, entries.where("key = 5")).collect()] == [(1, 9, 90)]


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, forward, strict):
    rng = random.Random(2)
    asked = [(i, rng.randint(0, 2), rng.randint(0, 30)) for i in range(80)]
    facts = [(rng.randint(0, 2), at, at * 10) for at in rng.sample(range(31), 12)]
    q, f = spark.createDataFrame(asked, "i int, k int, at int"), spark.createDataFrame(facts, "k int, at int, v int")
    for r in asof(q, f, ["k"], "at", ["v"], forward, strict).collect():
        near = [at for k, at, _ in facts if k == r.k and ((at > r.at if strict else at >= r.at) if forward else (at < r.at if strict else at <= r.at))]
        assert r.v == ((min(near) if forward else max(near)) * 10 if near else None)


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"banana\x00\xff")
    (tmp_path / "b.txt").write_bytes(b"ab\n")
    got = {r.path.rsplit("/", 1)[1]: bytes(r.text) for r in readers.text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": b"banana\x00\xff", "b.txt": b"ab\n"}


def test_written_files(spark, docs, tmp_path):
    found = factors.factorise(docs)
    listed = readers.write_files(readers.factor_files(found), f"{tmp_path}/lz", ".lz")
    assert {r.doc_id: r.n_bytes for r in listed.collect()} == {int(p.stem): p.stat().st_size for p in (tmp_path / "lz").glob("*.lz")}
    read = readers.read_factor_files(readers.read_files(spark, f"{tmp_path}/lz", ".lz"))
    assert sorted(read.collect()) == sorted(found.collect())
    readers.write_text_files(docs.unionByName(spark.createDataFrame([(99, None)], docs.schema)), f"{tmp_path}/txt")
    assert {int(p.stem): p.read_bytes() for p in (tmp_path / "txt").glob("[0-9]*")} == dict(enumerate([*GOLDEN, *MORE])) | {99: b""}
    assert not list((tmp_path / "txt").glob("_part*"))
    assert {r.doc_id: bytes(r.content) for r in readers.read_files(spark, f"{tmp_path}/txt", ".txt").collect()} == {i: t for i, t in enumerate([*GOLDEN, *MORE]) if t}
    assert readers.write_text_files(docs.limit(0), f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="no room in a record"):
        readers.factor_files(spark.createDataFrame([(1, 0, 1 << 32, 5, 97)], "doc_id bigint, factor_no bigint, beg bigint, len bigint, ch int")).collect()


def test_streams_equal_batch(spark, tmp_path):
    rng = random.Random(4)
    whole = {d: ["".join(rng.choice("abr") for _ in range(rng.randint(0, 12))) for _ in range(5)] for d in range(4)}
    pieces = [(d, i, t) for d, parts in whole.items() for i, t in enumerate(parts)]
    rng.shuffle(pieces)
    for b in range(4):
        spark.createDataFrame(pieces[b::4], "c long, s long, t string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    source = lambda: appends.pieces_of(spark, str(tmp_path / "in"), schema, "c", "s", "t")
    docs = spark.createDataFrame([(d, bytearray("".join(p).encode())) for d, p in whole.items()], "doc_id bigint, text binary")
    sizes = appends.drained(appends.grow_index(source()), "update", str(tmp_path))
    last = sizes.groupBy("doc_id").agg(F.max_by(F.struct("n", "r", "sigma"), "batch").alias("x")).select("doc_id", "x.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, R.stats(R.bwt(docs)).select("doc_id", "n", "r", "sigma").collect()))
    assert {r.waiting for r in appends.latest(sizes, ["doc_id"]).collect()} == {0}
    found = by_doc(appends.complete_factors(appends.drained(appends.grow_factors(source()), "append", str(tmp_path))).orderBy("factor_no"), "factor_no", "beg", "len", "ch")
    assert found == by_doc(factors.factorise(docs).orderBy("factor_no"), "factor_no", "beg", "len", "ch")
    patterns = [b"a", b"ab", b"bra", b"q", b""]
    answers = appends.latest(appends.drained(appends.grow_answers(source(), patterns), "update", str(tmp_path)), ["doc_id", "pat_id"])
    for r in answers.collect():
        text, p = "".join(whole[r.doc_id]).encode(), patterns[r.pat_id]
        assert r.begs == [k - len(p) for k in prefixes(text) if k >= len(p) and text[k - len(p) : k] == p] and r.n_occ == len(r.begs)


def test_stream_reset_waiting_and_progress(spark, tmp_path):
    batches = [[(1, 0, "abra"), (2, 0, "xy"), (3, 1, "late")], [(1, 1, "cadabra"), (2, -1, None), (2, 0, "banana")], [(1, 1, "again"), (3, 2, None)]]
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, "c long, s long, t string").coalesce(1).write.parquet(str(tmp_path / f"in{b}"))
        for f in (tmp_path / f"in{b}").glob("*.parquet"):
            (tmp_path / "all").mkdir(exist_ok=True)
            f.rename(tmp_path / "all" / f"{b}-{f.name}")
            os.utime(tmp_path / "all" / f"{b}-{f.name}", (1_000_000 + b, 1_000_000 + b))
    schema, progress = spark.read.parquet(str(tmp_path / "all")).schema, []
    pieces = appends.pieces_of(spark, str(tmp_path / "all"), schema, "c", "s", "t")
    rows = appends.drained(appends.grow_index(pieces), "update", str(tmp_path), progress=progress)
    last = {r.doc_id: (r.n, r.r, r.waiting) for r in appends.latest(rows, ["doc_id"]).collect()}
    assert last == {1: (11, 7, 0), 2: (6, 3, 0), 3: (0, 0, 2)}  # text 3 waits for its first piece; a piece again is ignored
    assert [p[1] for p in progress if p[1]] == [3, 3, 2] and progress[-1][3] == 3


@given(st.binary(max_size=60), st.integers(0, 60), st.integers(0, 60), st.sampled_from([0, 1 / 16, 1e9]))
@settings(max_examples=150, deadline=None)
def test_growing_equals_batch(text, first, second, share):
    text = bytes(b % 3 for b in text)
    growing.SHARE, before = share, growing.SHARE
    try:
        index, found = growing.Growing(), []
        for piece in (text[: min(first, second)], text[min(first, second) : max(first, second)], text[max(first, second) :]):
            found += index.extend(piece)
    finally:
        growing.SHARE = before
    assert list(index.places) == prefixes(text)
    last = index.open_factor()
    assert [f[1:] for f in found] + ([last[1:]] if last else []) == kernels.factorise(text)
    assert growing.Growing.unpacked(*index.packed()) == index


@given(st.binary(max_size=80), st.binary(max_size=3))
@settings(max_examples=200, deadline=None)
def test_run_index_equals_rows(text, pattern):
    text, pattern = bytes(b % 3 for b in text), bytes(b % 4 for b in pattern)
    index = RunIndex.unpacked(*RunIndex.of(np.frombuffer(text, np.uint8)).packed())
    left, right, txt = index.find(pattern)
    want = [(i, k) for i, k in enumerate(prefixes(text)) if k >= len(pattern) and text[k - len(pattern) : k] == pattern]
    assert list(zip(range(left, right), index.places(left, right, txt).tolist(), strict=True)) == want


def test_stored_index_and_inversion(spark, docs, bwt):
    index = stored.build(docs)
    got = {(r.doc_id, r.pat_id): r.n_occ for r in stored.count(index, PATTERNS).collect()}
    places = by_doc(stored.locate(index, PATTERNS).orderBy("pat_id", "bwt_pos"), "pat_id", "bwt_pos", "beg")
    for i, text in enumerate([*GOLDEN, *MORE]):
        want = [(j, row, k - len(p)) for j, p in enumerate(PATTERNS) for row, k in enumerate(prefixes(text)) if k >= len(p) and text[k - len(p) : k] == p]
        assert places.get(i, []) == want
        assert all(got[i, j] == sum(w[0] == j for w in want) for j in range(len(PATTERNS)))
    assert all(r.same for r in stored.check_inversion(docs).collect())
    assert {r.doc_id: r.r for r in stored.sizes(index).collect()} == {r.doc_id: r.r for r in R.stats(bwt).collect()}
    long = huge.routed(docs, most_bytes=6)
    assert sorted(map(str, long.collect())) == sorted(map(str, bwt.collect()))


def test_edits_of_empty_strings_and_emptied_runs(spark):
    runs = spark.createDataFrame([(1, 0, 5, 2, 10), (1, 1, 6, 1, 11), (1, 2, 5, 3, 12), (1, 3, 7, 1, 13)], "doc_id bigint, run_id bigint, ch int, weight bigint, val bigint")
    new = spark.createDataFrame([(1, 0, 9, 1, 1, 2), (2, 0, 9, 4, 1, 2), (3, 5, 9, 4, 1, 2)], "doc_id bigint, pos bigint, new_ch int, new_weight bigint, val1 bigint, val2 bigint")
    got = by_doc(edits.insert_run(runs, new).orderBy("run_id"), "run_id", "ch", "weight", "val")
    assert got == {1: [(0, 9, 1, 1), (1, 5, 2, 10), (2, 6, 1, 11), (3, 5, 3, 12), (4, 7, 1, 13)], 2: [(0, 9, 4, 1)]}
    assert by_doc(edits.push_back(runs.where("doc_id = 9"), new.where("doc_id = 3").drop("pos", "val2")), "ch", "weight", "val") == {3: [(9, 4, 1)]}
    gone = edits.change_weight(runs, spark.createDataFrame([(1, 1, -1), (1, 3, -5)], "doc_id bigint, run_id bigint, delta bigint"))
    assert by_doc(gone, "run_id", "ch", "weight", "val") == {1: [(0, 5, 5, 10)]}


def test_places_past_the_end_and_previous_runs(spark, bwt):
    asked = spark.createDataFrame([(3, 0), (3, 5), (3, 6), (3, 99)], "doc_id bigint, rle_pos bigint")
    assert {r.rle_pos: (r.run_id, r.offset) for r in points.run_at(bwt, asked).collect()} == {0: (0, 0), 5: (2, 2), 6: (None, None), 99: (None, None)}
    asked = spark.createDataFrame([(5, ord("b"), 2), (5, ord("b"), 1), (5, ord("b"), 6), (5, ord("z"), 3)], "doc_id bigint, ch int, run_id bigint")
    assert {(r.ch, r.run_id): r.pred_run for r in points.previous_runs(bwt, asked).collect()} == {(98, 2): 1, (98, 1): None, (98, 6): 3, (122, 3): None}


def test_every_query_has_a_callable_and_sql_is_known(spark):
    import __spark_entry__ as entry

    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and all(map(callable, queries.values()))
