"""Queries over the engine's relations and the SQL that checks them.

SQL is given where whole tables allow it: it sorts all prefixes of all texts,
so those queries read `benchmark`, `events` or `nation`. Queries over
`documents` have SQL where their result can be had without that.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.operators import checks, edits, factors, points, search
from runloom.plans import huge, stored
from runloom.plans import relations as R
from runloom.sources import readers
from runloom.sources.shared import shared_folder
from runloom.streaming import appends

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Patterns of the pattern queries.
PATTERNS = (b"th", b"the ", b"e", b"zzz", b". ", b"on the", b"\xc3", b"anan", b"")
#: Folders over which a file for each document is dealt.
FOLDERS = 256
PROBES = (0, 32, 101, 109, 200, 255)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.texts(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.spread(readers.texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bwt(_texts(spark, sf_dir))


_SOURCE = """
src AS (SELECT item_id AS doc_id, hex(encode(coalesce(text, ''))) AS h FROM benchmark)"""

_BWT = """,
txt AS (SELECT doc_id, h, (length(h) // 2)::BIGINT AS n,
  coalesce(array_to_string(list_reverse(list_transform(range(0, length(h) // 2), lambda i: substr(h, 2 * i + 1, 2))), ''), '') AS rev FROM src),
pre AS (SELECT doc_id, n, h, k, substr(rev, 2 * (n - k) + 1) AS key FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM txt)),
bwt AS MATERIALIZED (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY key) - 1 AS bwt_pos, k::BIGINT AS txt_pos,
  CASE WHEN k < n THEN ('0x' || substr(h, 2 * k + 1, 2))::INTEGER END AS ch FROM pre),
em AS (SELECT doc_id, bwt_pos AS em_pos, n FROM bwt WHERE ch IS NULL),
rle AS MATERIALIZED (SELECT b.doc_id, bwt_pos, txt_pos, ch, bwt_pos - (bwt_pos > em_pos)::BIGINT AS rle_pos FROM bwt b JOIN em USING (doc_id) WHERE ch IS NOT NULL)"""

_RUNS = """,
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY rle_pos)::BIGINT AS run_id FROM
  (SELECT *, CASE WHEN ch <> lag(ch) OVER (PARTITION BY doc_id ORDER BY rle_pos) THEN 1 ELSE 0 END AS new FROM rle)),
runs AS MATERIALIZED (SELECT doc_id, run_id, min(ch) AS ch, count(*) AS run_len, min(rle_pos) AS rle_start,
  arg_min(txt_pos, rle_pos) AS head_txt, arg_max(txt_pos, rle_pos) AS tail_txt FROM numbered GROUP BY doc_id, run_id)"""

_ALPHABET = """,
alphabet AS MATERIALIZED (SELECT *, coalesce(sum(occ) OVER (PARTITION BY doc_id ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c_before
  FROM (SELECT doc_id, ch, count(*) AS occ FROM rle GROUP BY doc_id, ch))"""


def _sql(body: str, *parts: str, source: str = _SOURCE, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{source}{_BWT}{''.join(parts)}{body}"


def _add(name: str, sql: str | None = None):
    def wrap(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return wrap


def _explode(*values, kind: str = "bigint") -> Column:
    return F.explode(F.array(*[(v if isinstance(v, Column) else F.lit(v)).cast(kind) for v in values]))


_PLACES_SQL = "unnest([0, n // 2, n - 1])::BIGINT"


def _symbol_questions(rows: DataFrame) -> DataFrame:
    ends = R.marker_rows(rows).where("n > 0")
    asked = ends.select("doc_id", "n", _explode(*PROBES, kind="int").alias("ch"))
    return asked.select("doc_id", "ch", _explode(0, F.floor(F.col("n") / 2), F.col("n") - 1).alias("rle_pos"))


_ASKED = f", asked AS (SELECT doc_id, ch, {_PLACES_SQL} AS rle_pos FROM (SELECT *, unnest({list(PROBES)})::INTEGER AS ch FROM em WHERE n > 0))"


@_add("bwt_rows", _sql(" SELECT doc_id, bwt_pos, txt_pos, ch FROM bwt"))
def bwt_rows(spark, sf_dir):
    return _rows(spark, sf_dir)


@_add("bwt_rows_doubling", SQL["bwt_rows"])
def bwt_rows_doubling(spark, sf_dir):
    """The same relation by the form for texts that are too long for one task."""
    return huge.bwt(huge.symbols(_texts(spark, sf_dir)))


@_add("bwt_access", _sql(" SELECT b.doc_id, bwt_pos, ch, ch IS NULL AS is_marker FROM bwt b JOIN em USING (doc_id) WHERE bwt_pos IN (0, em_pos, em.n // 2, em.n)"))
def bwt_access(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    places = R.marker_rows(rows).select("doc_id", _explode(0, F.col("em_pos"), F.floor(F.col("n") / 2), F.col("n")).alias("bwt_pos")).distinct()
    return points.access(rows, places)


@_add("marker_samples", _sql(" SELECT doc_id, bwt_pos AS em_pos, prev_txt, next_txt FROM (SELECT *, lag(txt_pos) OVER w AS prev_txt, lead(txt_pos) OVER w AS next_txt FROM bwt WINDOW w AS (PARTITION BY doc_id ORDER BY bwt_pos)) WHERE ch IS NULL"))
def marker_samples(spark, sf_dir):
    return points.marker_samples(_rows(spark, sf_dir))


@_add("rlbwt_runs", _sql(" SELECT * FROM runs", _RUNS))
def rlbwt_runs(spark, sf_dir):
    return R.runs(_rows(spark, sf_dir))


@_add("run_range_weight", _sql(" SELECT doc_id, coalesce(sum(run_len) FILTER (run_id >= 2 AND run_id < 7), 0)::BIGINT AS weight FROM runs GROUP BY doc_id", _RUNS))
def run_range_weight(spark, sf_dir):
    """Summed length of the runs 2 to 6 of each text."""
    return points.range_weight(R.runs(_rows(spark, sf_dir)), 2, 7)


@_add("rlbwt_runs_direct", SQL["rlbwt_runs"])
def rlbwt_runs_direct(spark, sf_dir):
    return R.text_runs(_texts(spark, sf_dir))


@_add("run_neighbors", _sql(" SELECT doc_id, run_id, row_number() OVER s AS run_no_in_ch, lag(run_id) OVER w AS prev_run, lead(run_id) OVER w AS next_run, lag(run_id) OVER s AS prev_same, lead(run_id) OVER s AS next_same FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY run_id), s AS (PARTITION BY doc_id, ch ORDER BY run_id)", _RUNS))
def run_neighbors(spark, sf_dir):
    return points.run_neighbours(_rows(spark, sf_dir))


@_add("alphabet_counts", _sql(" SELECT * FROM alphabet", _ALPHABET))
def alphabet_counts(spark, sf_dir):
    return R.alphabet(_rows(spark, sf_dir))


@_add("alphabet_neighbors", _sql(" SELECT doc_id, ch, min(ch) OVER (PARTITION BY doc_id) AS first_ch, lag(ch) OVER w AS prev_ch, lead(ch) OVER w AS next_ch FROM alphabet WINDOW w AS (PARTITION BY doc_id ORDER BY ch)", _ALPHABET))
def alphabet_neighbors(spark, sf_dir):
    return points.alphabet_neighbours(_rows(spark, sf_dir))


@_add("alphabet_asof", _sql(f" SELECT em.doc_id, x, max(ch) AS found FROM (SELECT doc_id, unnest({list(PROBES)})::INTEGER AS x FROM em) em LEFT JOIN alphabet a ON a.doc_id = em.doc_id AND ch <= x GROUP BY em.doc_id, x", _ALPHABET))
def alphabet_asof(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return points.symbol_at_most(rows, R.marker_rows(rows).select("doc_id", _explode(*PROBES, kind="int").alias("x")))


@_add("bwt_stats", _sql(" SELECT em.doc_id, em.n, coalesce(r, 0)::BIGINT AS r, coalesce(sigma, 0)::BIGINT AS sigma, em_pos, em.n / r AS n_per_run FROM em LEFT JOIN (SELECT doc_id, count(*) AS r, count(DISTINCT ch) AS sigma FROM runs GROUP BY doc_id) USING (doc_id)", _RUNS))
def bwt_stats(spark, sf_dir):
    return R.stats(_rows(spark, sf_dir))


@_add("bwt_stats_direct", SQL["bwt_stats"])
def bwt_stats_direct(spark, sf_dir):
    return R.text_stats(_texts(spark, sf_dir))


@_add("rank_char", _sql(" SELECT q.doc_id, q.ch, q.rle_pos, count(r.rle_pos) AS rank FROM asked q LEFT JOIN rle r ON r.doc_id = q.doc_id AND r.ch = q.ch AND r.rle_pos <= q.rle_pos GROUP BY ALL", _ASKED))
def rank_char(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return points.rank(rows, _symbol_questions(rows))


@_add("total_rank", _sql(" SELECT q.doc_id, q.ch, q.rle_pos, CASE WHEN count_if(r.ch = q.ch) = 0 THEN 0 ELSE count_if(r.ch < q.ch) + count_if(r.ch = q.ch AND r.rle_pos <= q.rle_pos) END::BIGINT AS total_rank FROM asked q LEFT JOIN rle r ON r.doc_id = q.doc_id GROUP BY ALL", _ASKED))
def total_rank(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return points.total_rank(rows, _symbol_questions(rows))


_RANKED = ", ranked AS (SELECT doc_id, ch, rle_pos, row_number() OVER (PARTITION BY doc_id, ch ORDER BY rle_pos) AS rank, row_number() OVER (PARTITION BY doc_id ORDER BY ch, rle_pos) AS t FROM rle)"


def _rank_questions(rows: DataFrame) -> DataFrame:
    asked = R.marker_rows(rows).select("doc_id", _explode(*PROBES, kind="int").alias("ch"))
    return asked.select("doc_id", "ch", _explode(1, 5, 1000).alias("rank"))


_RANK_ASKED = f", asked AS (SELECT doc_id, ch, unnest([1, 5, 1000])::BIGINT AS rank FROM (SELECT doc_id, unnest({list(PROBES)})::INTEGER AS ch FROM em))"


@_add("select_char", _sql(" SELECT doc_id, ch, rank, rle_pos FROM asked LEFT JOIN ranked USING (doc_id, ch, rank)", _RANKED, _RANK_ASKED))
def select_char(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return points.select_symbol(rows, _rank_questions(rows))


@_add("rank_to_run", _sql(" SELECT q.doc_id, q.ch, q.rank, run_id, rle_pos - rle_start AS \"offset\" FROM asked q LEFT JOIN ranked k ON k.doc_id = q.doc_id AND k.ch = q.ch AND k.rank = q.rank LEFT JOIN runs r ON r.doc_id = q.doc_id AND rle_pos >= rle_start AND rle_pos < rle_start + run_len", _RANKED, _RANK_ASKED, _RUNS))
def rank_to_run(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return points.run_of_rank(rows, _rank_questions(rows))


def _total_questions(rows: DataFrame) -> DataFrame:
    return R.marker_rows(rows).select("doc_id", _explode(1, F.floor(F.col("n") / 2) + 1, F.col("n"), F.col("n") + 1).alias("t"))


_TOTALS = ", asked AS (SELECT doc_id, unnest([1, n // 2 + 1, n, n + 1])::BIGINT AS t FROM em)"


@_add("select_total", _sql(" SELECT doc_id, t, rle_pos FROM asked LEFT JOIN ranked USING (doc_id, t)", _RANKED, _TOTALS))
def select_total(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return points.select_total(rows, _total_questions(rows))


@_add("sorted_place_symbol", _sql(" SELECT doc_id, t, ch FROM asked LEFT JOIN ranked USING (doc_id, t)", _RANKED, _TOTALS))
def sorted_place_symbol(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return points.symbol_of_sorted_place(rows, _total_questions(rows))


@_add("lf_map", _sql(" SELECT doc_id, bwt_pos, (row_number() OVER (PARTITION BY doc_id ORDER BY ch NULLS FIRST, bwt_pos) - 1)::BIGINT AS lf FROM bwt"))
def lf_map(spark, sf_dir):
    return R.last_to_first(_rows(spark, sf_dir))


@_add("lf_chain_check", _sql(" SELECT doc_id, count(*) AS n_rows, 0::BIGINT AS n_bad FROM bwt GROUP BY doc_id"))
def lf_chain_check(spark, sf_dir):
    return checks.chain_check(_rows(spark, sf_dir))


@_add("pos_to_run", _sql(f" SELECT q.doc_id, q.rle_pos, run_id, q.rle_pos - rle_start AS \"offset\" FROM (SELECT doc_id, {_PLACES_SQL} AS rle_pos FROM em WHERE n > 0) q JOIN runs r ON r.doc_id = q.doc_id AND q.rle_pos >= rle_start AND q.rle_pos < rle_start + run_len", _RUNS))
def pos_to_run(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    places = R.marker_rows(rows).where("n > 0").select("doc_id", _explode(0, F.floor(F.col("n") / 2), F.col("n") - 1).alias("rle_pos"))
    return points.run_at(rows, places)


@_add("pred_run_of_char", _sql(" SELECT a.doc_id, a.run_id, max(b.run_id) AS pred_run FROM runs a LEFT JOIN runs b ON b.doc_id = a.doc_id AND b.run_id < a.run_id AND b.ch = 101 GROUP BY ALL", _RUNS))
def pred_run_of_char(spark, sf_dir):
    return points.previous_run_of(_rows(spark, sf_dir), 101)


@_add("pred_runs", _sql(f" SELECT a.doc_id, a.run_id, c.ch, max(b.run_id) AS pred_run FROM runs a CROSS JOIN (SELECT unnest({list(PROBES)})::INTEGER AS ch) c LEFT JOIN runs b ON b.doc_id = a.doc_id AND b.run_id < a.run_id AND b.ch = c.ch GROUP BY ALL", _RUNS))
def pred_runs(spark, sf_dir):
    """The previous run of each probe symbol for every run."""
    rows = _rows(spark, sf_dir)
    return points.previous_runs(rows, R.runs(rows).select("doc_id", _explode(*PROBES, kind="int").alias("ch"), "run_id"))


_NEXT = " SELECT doc_id, txt_pos, lead(txt_pos) OVER (PARTITION BY doc_id ORDER BY bwt_pos) AS next_txt FROM bwt"


@_add("next_position", _sql(_NEXT))
def next_position(spark, sf_dir):
    return R.next_positions(_rows(spark, sf_dir))


@_add("phi_asof", _sql(f" SELECT * FROM ({_NEXT}) WHERE next_txt IS NOT NULL"))
def phi_asof(spark, sf_dir):
    return checks.next_position_by_map(_rows(spark, sf_dir))


_ENTRIES = ", entries AS (SELECT doc_id, txt_pos AS key, next_txt AS val FROM (SELECT *, lead(txt_pos) OVER w AS next_txt, lead(ch) OVER w AS next_ch FROM bwt WINDOW w AS (PARTITION BY doc_id ORDER BY bwt_pos)) WHERE next_txt IS NOT NULL AND ch IS DISTINCT FROM next_ch)"


@_add("succ_entries", _sql(" SELECT * FROM entries", _ENTRIES))
def succ_entries(spark, sf_dir):
    return R.text_next_position_map(_texts(spark, sf_dir))


@_add("succ_upsert", _sql(" SELECT doc_id, key, max(val) AS val FROM (SELECT doc_id, key, CASE WHEN key = 0 THEN -1 ELSE val END AS val FROM entries UNION ALL SELECT doc_id, 0, -1 FROM em UNION ALL SELECT doc_id, n + 5, n FROM em) GROUP BY doc_id, key", _ENTRIES))
def succ_upsert(spark, sf_dir):
    """Sets the key 0 to -1 and a new key past the end."""
    rows = _rows(spark, sf_dir)
    ends = R.marker_rows(rows)
    new = ends.select("doc_id", F.lit(0).cast("bigint").alias("key"), F.lit(-1).cast("bigint").alias("val")).unionByName(ends.select("doc_id", (F.col("n") + 5).alias("key"), F.col("n").alias("val")))
    return edits.set_key(R.next_position_map(rows), new)


@_add("succ_delete", _sql(" SELECT * FROM entries WHERE key NOT IN (0, 7)", _ENTRIES))
def succ_delete(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return edits.remove_key(R.next_position_map(rows), R.marker_rows(rows).select("doc_id", _explode(0, 7).alias("key")))


def _patterns_sql() -> str:
    return ", ".join(f"({i}, '{p.hex().upper()}')" for i, p in enumerate(PATTERNS))


_PATTERNS = f""", pat(pat_id, p) AS (VALUES {_patterns_sql()}),
ends AS MATERIALIZED (SELECT b.doc_id, pat_id::BIGINT AS pat_id, (length(p) // 2)::INTEGER AS plen, bwt_pos, txt_pos FROM bwt b JOIN src USING (doc_id), pat
  WHERE txt_pos >= length(p) // 2 AND substr(h, 2 * (txt_pos - length(p) // 2) + 1, length(p)) = p),
hits AS (SELECT doc_id, pat_id, min(bwt_pos) AS l, max(bwt_pos) + 1 AS r, count(*) AS n_occ FROM ends GROUP BY doc_id, pat_id)"""
_MATCHED = """, starts AS (SELECT b.doc_id, pat_id::BIGINT AS pat_id, max(k)::INTEGER AS matched FROM bwt b JOIN src USING (doc_id), pat, unnest(range(0, length(p) // 2 + 1)) AS u(k)
  WHERE txt_pos >= k AND substr(h, 2 * (txt_pos - k) + 1, 2 * k) = substr(p, 1, 2 * k) GROUP BY b.doc_id, pat_id)"""


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.intervals(_texts(spark, sf_dir), readers.pattern_rows(spark, PATTERNS))


_INTERVALS = " SELECT doc_id, pat_id, (length(p) // 2)::INTEGER AS plen, matched, l, r, coalesce(n_occ, 0)::BIGINT AS n_occ FROM starts JOIN pat USING (pat_id) LEFT JOIN hits USING (doc_id, pat_id)"


@_add("pattern_interval", _sql(_INTERVALS, _PATTERNS, _MATCHED))
def pattern_interval(spark, sf_dir):
    return _intervals(spark, sf_dir)


@_add("pattern_interval_steps", _sql(_INTERVALS, _PATTERNS, _MATCHED))
def pattern_interval_steps(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return search.stepped_intervals(rows, readers.pattern_rows(spark, PATTERNS))


@_add("pattern_count", _sql(" SELECT doc_id, pat_id, coalesce(n_occ, 0)::BIGINT AS n_occ FROM src CROSS JOIN (SELECT pat_id::BIGINT AS pat_id FROM pat) LEFT JOIN hits USING (doc_id, pat_id)", _PATTERNS))
def pattern_count(spark, sf_dir):
    return search.scan_counts(_texts(spark, sf_dir), list(PATTERNS))


@_add("pattern_prefix_match", _sql(" SELECT * FROM starts", _PATTERNS, _MATCHED))
def pattern_prefix_match(spark, sf_dir):
    return _intervals(spark, sf_dir).select("doc_id", "pat_id", "matched")


@_add("pattern_locate", _sql(" SELECT doc_id, pat_id, bwt_pos, txt_pos - plen AS beg FROM ends", _PATTERNS))
def pattern_locate(spark, sf_dir):
    return search.locate(_rows(spark, sf_dir), _intervals(spark, sf_dir))


@_add("pattern_locate_csv", _sql(" SELECT doc_id, pat_id, string_agg((txt_pos - plen)::VARCHAR, ', ' ORDER BY bwt_pos) AS begs FROM ends GROUP BY doc_id, pat_id", _PATTERNS))
def pattern_locate_csv(spark, sf_dir):
    return search.listed(search.locate(_rows(spark, sf_dir), _intervals(spark, sf_dir)))


@_add("pattern_first_occ", _sql(" SELECT doc_id, pat_id, arg_min(txt_pos, bwt_pos) AS first_end FROM ends GROUP BY doc_id, pat_id", _PATTERNS))
def pattern_first_occ(spark, sf_dir):
    return search.first_occurrence(_rows(spark, sf_dir), _intervals(spark, sf_dir))


@_add("pattern_at_end", _sql(" SELECT src.doc_id, pat_id::BIGINT AS pat_id, ends_with(h, p) AS ends FROM src, pat", _PATTERNS))
def pattern_at_end(spark, sf_dir):
    return search.at_end(_rows(spark, sf_dir), _intervals(spark, sf_dir))


@_add("count_as_of", _sql(" SELECT doc_id, m::BIGINT AS m, pat_id, count(CASE WHEN txt_pos <= m THEN 1 END) AS n_occ FROM (SELECT src.doc_id, m, pat_id::BIGINT AS pat_id FROM src, pat, unnest([10, 100, 1000]) AS u(m)) q LEFT JOIN ends USING (doc_id, pat_id) GROUP BY doc_id, m, pat_id", _PATTERNS))
def count_as_of(spark, sf_dir):
    return search.scan_counts_as_of(_texts(spark, sf_dir), list(PATTERNS), [10, 100, 1000])


@_add("invert_text", "SELECT item_id AS doc_id, coalesce(text, '') AS text FROM benchmark")
def invert_text(spark, sf_dir):
    return checks.invert(_rows(spark, sf_dir)).select("doc_id", F.decode("text", "UTF-8").alias("text"))


_SAME = "SELECT {id} AS doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, TRUE AS same FROM {table}"


@_add("check_roundtrip", _SAME.format(id="item_id", table="benchmark"))
def check_roundtrip(spark, sf_dir):
    return checks.roundtrip(_texts(spark, sf_dir), checks.invert(_rows(spark, sf_dir)))


@_add("rle_expand", _sql(" SELECT doc_id, string_agg(printf('%02X', ch), '' ORDER BY rle_pos) AS expanded FROM rle GROUP BY doc_id"))
def rle_expand(spark, sf_dir):
    return checks.expand(R.runs(_rows(spark, sf_dir)))


@_add("run_invariants", _sql(" SELECT doc_id, count(*) AS n_runs, 0::BIGINT AS n_empty, 0::BIGINT AS n_unmerged FROM runs GROUP BY doc_id", _RUNS))
def run_invariants(spark, sf_dir):
    return checks.run_invariants(R.runs(_rows(spark, sf_dir)))


_FACTORS = """,
places AS (SELECT doc_id, n, i, substr(h, 2 * i + 1, 2) AS c FROM (SELECT *, unnest(range(0, n)) AS i FROM txt)),
pairs AS (SELECT a.doc_id, a.n, a.i AS s, b.i AS j, a.i - b.i AS d, a.c = b.c AS eq FROM places a JOIN places b ON a.doc_id = b.doc_id AND b.i < a.i),
lens AS MATERIALIZED (SELECT doc_id, n, s, j, least(coalesce(min(CASE WHEN NOT eq THEN s END) OVER (PARTITION BY doc_id, d ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n), n) - s AS l FROM pairs),
lpf AS MATERIALIZED (SELECT doc_id, n, i AS s, coalesce(max(l), 0) AS l FROM (SELECT p.doc_id, p.n, i, lens.l FROM places p LEFT JOIN lens ON lens.doc_id = p.doc_id AND lens.s = i) GROUP BY doc_id, n, i),
walk AS (SELECT doc_id, n, list(l ORDER BY s) AS ls, 0::BIGINT AS s, arg_min(l, s) AS l, 0::BIGINT AS factor_no FROM lpf GROUP BY doc_id, n
  UNION ALL SELECT doc_id, n, ls, s + l + 1, ls[s + l + 2], factor_no + 1 FROM walk WHERE s + l + 1 < n),
chain AS MATERIALIZED (SELECT doc_id, n, s, l, factor_no FROM walk),
copies AS MATERIALIZED (SELECT c.doc_id, factor_no, j, j + c.l AS k FROM chain c JOIN lens ON lens.doc_id = c.doc_id AND lens.s = c.s WHERE c.l > 0 AND lens.l >= c.l),
sources AS MATERIALIZED (SELECT c.doc_id, factor_no, arg_min(j, bwt_pos) AS beg FROM copies c JOIN bwt ON bwt.doc_id = c.doc_id AND txt_pos = k GROUP BY c.doc_id, factor_no),
factors AS MATERIALIZED (SELECT c.doc_id, c.factor_no, coalesce(beg, 0)::BIGINT AS beg, (CASE WHEN c.s + c.l < c.n THEN c.l ELSE c.l - 1 END)::BIGINT AS len,
  ('0x' || substr(h, 2 * least(c.s + c.l, c.n - 1) + 1, 2))::INTEGER AS ch FROM chain c LEFT JOIN sources USING (doc_id, factor_no) JOIN src ON src.doc_id = c.doc_id)"""


@_add("lz77_factors", _sql(" SELECT * FROM factors", _FACTORS, recursive=True))
def lz77_factors(spark, sf_dir):
    return factors.factorise(_texts(spark, sf_dir))


@_add("lz77_summary", _sql(" SELECT doc_id, count(*) AS z, sum(len + 1)::BIGINT AS n FROM factors GROUP BY doc_id", _FACTORS, recursive=True))
def lz77_summary(spark, sf_dir):
    return factors.summary(factors.factorise(_texts(spark, sf_dir)))


@_add("lz77_decode", "SELECT item_id AS doc_id, coalesce(text, '') AS text FROM benchmark WHERE coalesce(text, '') <> ''")
def lz77_decode(spark, sf_dir):
    return factors.decode(factors.factorise(_texts(spark, sf_dir))).select("doc_id", F.decode("text", "UTF-8").alias("text"))


@_add("lz77_file_roundtrip", _sql(" SELECT * FROM factors", _FACTORS, recursive=True))
def lz77_file_roundtrip(spark, sf_dir):
    return readers.read_factor_files(readers.factor_files(factors.factorise(_texts(spark, sf_dir))))


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.runs(_rows(spark, sf_dir)).select("doc_id", "run_id", "ch", F.col("run_len").alias("weight"), F.col("head_txt").alias("val"))


def _middle(runs: DataFrame) -> DataFrame:
    return runs.groupBy("doc_id").agg(F.floor(F.sum("weight") / 2).alias("pos"))


# a run-length string written out as symbols with values, edited there and encoded again
_EDITED = """, places AS (SELECT doc_id, ch, head_txt AS val, run_id, rle_start + i AS p, FALSE AS fresh, 0 AS part FROM (SELECT *, unnest(range(0, run_len)) AS i FROM runs)),
mid AS (SELECT doc_id, sum(run_len)::BIGINT // 2 AS pos FROM runs GROUP BY doc_id)"""


@_add(
    "valued_run_insert",
    _sql(
        """, cutrun AS (SELECT r.*, pos, pos = rle_start AS head FROM runs r JOIN mid USING (doc_id) WHERE pos >= rle_start AND pos < rle_start + run_len),
before AS (SELECT c.doc_id, p.ch AS prev_ch FROM cutrun c LEFT JOIN runs p ON p.doc_id = c.doc_id AND p.run_id = c.run_id - 1),
parts AS (
  SELECT r.doc_id, r.run_id, 0 AS part, r.ch, r.run_len + CASE WHEN c.run_id IS NOT NULL AND r.ch = 101 THEN 3 WHEN nx.run_id IS NOT NULL AND nx.head AND nx.ch <> 101 AND r.ch = 101 THEN 3 ELSE 0 END AS weight, r.head_txt AS val
    FROM runs r LEFT JOIN cutrun c ON c.doc_id = r.doc_id AND c.run_id = r.run_id LEFT JOIN cutrun nx ON nx.doc_id = r.doc_id AND nx.run_id = r.run_id + 1
    WHERE c.run_id IS NULL OR c.head OR c.ch = 101
  UNION ALL SELECT doc_id, run_id, 0, ch, pos - rle_start, head_txt FROM cutrun WHERE NOT head AND ch <> 101
  UNION ALL SELECT doc_id, run_id, CASE WHEN head THEN -1 ELSE 1 END, 101, 3, 1000 FROM cutrun JOIN before USING (doc_id) WHERE ch <> 101 AND NOT (head AND prev_ch IS NOT DISTINCT FROM 101)
  UNION ALL SELECT doc_id, run_id, 2, ch, rle_start + run_len - pos, 2000 FROM cutrun WHERE NOT head AND ch <> 101)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run_id, part) - 1 AS run_id, ch::INTEGER AS ch, weight::BIGINT AS weight, val::BIGINT AS val FROM parts""",
        _RUNS,
        _EDITED,
    ),
)
def valued_run_insert(spark, sf_dir):
    """Inserts e three times, with values 1000 and 2000, in the middle of each run-length string."""
    runs = _valued(spark, sf_dir)
    new = _middle(runs).select("doc_id", "pos", F.lit(101).alias("new_ch"), F.lit(3).cast("bigint").alias("new_weight"), F.lit(1000).cast("bigint").alias("val1"), F.lit(2000).cast("bigint").alias("val2"))
    return edits.insert_run(runs, new)


@_add(
    "run_split",
    _sql(
        """, parts AS (SELECT r.doc_id, run_id, 0 AS part, ch, CASE WHEN pos > rle_start AND pos < rle_start + run_len THEN pos - rle_start ELSE run_len END AS weight, head_txt AS val FROM runs r JOIN mid USING (doc_id)
  UNION ALL SELECT r.doc_id, run_id, 1, ch, rle_start + run_len - pos, 2000 FROM runs r JOIN mid USING (doc_id) WHERE pos > rle_start AND pos < rle_start + run_len)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run_id, part) - 1 AS run_id, ch, weight::BIGINT AS weight, val::BIGINT AS val FROM parts""",
        _RUNS,
        _EDITED,
    ),
)
def run_split(spark, sf_dir):
    runs = _valued(spark, sf_dir)
    return edits.split_run(runs, _middle(runs).withColumn("val2", F.lit(2000).cast("bigint")))


@_add(
    "run_change_weight",
    _sql(
        """, w AS (SELECT doc_id, run_id, ch, run_len + CASE WHEN run_id = 1 THEN 4 WHEN run_id = 2 THEN -1 ELSE 0 END AS weight, head_txt AS val FROM runs),
kept AS (SELECT *, CASE WHEN ch = lag(ch) OVER o AND run_id > lag(run_id) OVER o + 1 THEN 0 ELSE 1 END AS new FROM w WHERE weight > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY run_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY run_id) - 1 AS grp FROM kept)
SELECT doc_id, grp::BIGINT AS run_id, min(ch) AS ch, sum(weight)::BIGINT AS weight, arg_min(val, run_id) AS val FROM g GROUP BY doc_id, grp""",
        _RUNS,
    ),
)
def run_change_weight(spark, sf_dir):
    runs = _valued(spark, sf_dir)
    change = runs.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.struct(F.lit(r).cast("bigint").alias("run_id"), F.lit(d).cast("bigint").alias("delta")) for r, d in ((1, 4), (2, -1))])).alias("c")).select("doc_id", "c.*")
    return edits.change_weight(runs, change)


@_add("run_set_value", _sql(" SELECT doc_id, run_id, ch, run_len AS weight, CASE WHEN run_id = 3 THEN 77 ELSE head_txt END AS val FROM runs", _RUNS))
def run_set_value(spark, sf_dir):
    runs = _valued(spark, sf_dir)
    return edits.set_value(runs, runs.select("doc_id").distinct().select("doc_id", F.lit(3).cast("bigint").alias("run_id"), F.lit(77).cast("bigint").alias("new_val")))


@_add("run_push_back", _sql(" SELECT doc_id, run_id, ch, run_len + CASE WHEN ch = 46 AND last THEN 2 ELSE 0 END AS weight, head_txt AS val FROM (SELECT *, lead(run_id) OVER (PARTITION BY doc_id ORDER BY run_id) IS NULL AS last FROM runs) UNION ALL SELECT doc_id, max(run_id) + 1, 46, 2, 9 FROM runs GROUP BY doc_id HAVING arg_max(ch, run_id) <> 46", _RUNS))
def run_push_back(spark, sf_dir):
    runs = _valued(spark, sf_dir)
    new = runs.select("doc_id").distinct().select("doc_id", F.lit(46).alias("new_ch"), F.lit(2).cast("bigint").alias("new_weight"), F.lit(9).cast("bigint").alias("val1"))
    return edits.push_back(runs, new)


_EVENTS = """
codes AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) AS code FROM (SELECT DISTINCT event_type FROM events)),
src AS (SELECT user_id AS doc_id, string_agg(printf('%02X', code), '' ORDER BY ts, event_id) AS h FROM events JOIN codes USING (event_type) GROUP BY user_id)"""


@_add("event_symbol_bwt", _sql(" SELECT doc_id, bwt_pos, txt_pos, ch FROM bwt", source=_EVENTS))
def event_symbol_bwt(spark, sf_dir):
    """Event types of each user, coded in the order of their names, as symbols in order of time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type is not null")  # no symbol
    names = events.agg(F.array_sort(F.collect_set("event_type")).alias("names"))  # one row: the alphabet
    coded = events.join(F.broadcast(names)).withColumn("code", F.array_position("names", F.col("event_type")))
    return R.bwt(readers.symbol_sequences(coded, "user_id", ["ts", "event_id"], F.col("code")), "symbols")


# ---- whole documents

_DOC_TEXT = "SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents"
_DOC_CODES = f"SELECT doc_id, unnest(list_transform(range(0, length(h) // 2), lambda i: substr(h, 2 * i + 1, 2))) AS c FROM ({_DOC_TEXT})"


@_add("documents_stats")
def documents_stats(spark, sf_dir):
    return R.text_stats(_documents(spark, sf_dir))


@_add("documents_alphabet", f"SELECT d.doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n, coalesce(sigma, 0)::BIGINT AS sigma FROM documents d LEFT JOIN (SELECT doc_id, count(DISTINCT c) AS sigma FROM ({_DOC_CODES}) GROUP BY doc_id) USING (doc_id)")
def documents_alphabet(spark, sf_dir):
    """Lengths and alphabets by the transforms of whole documents."""
    return R.text_stats(_documents(spark, sf_dir)).select("doc_id", "n", "sigma")


@_add("documents_runs")
def documents_runs(spark, sf_dir):
    return R.text_runs(_documents(spark, sf_dir))


@_add("documents_run_symbols", f"SELECT doc_id, ('0x' || c)::INTEGER AS ch, count(*)::BIGINT AS occ FROM ({_DOC_CODES}) GROUP BY doc_id, c")
def documents_run_symbols(spark, sf_dir):
    """How often each symbol occurs, summed from the runs."""
    return R.text_runs(_documents(spark, sf_dir)).groupBy("doc_id", "ch").agg(F.sum("run_len").alias("occ"))


@_add("documents_next_position_map")
def documents_next_position_map(spark, sf_dir):
    return R.text_next_position_map(_documents(spark, sf_dir))


@_add("documents_rows")
def documents_rows(spark, sf_dir):
    return R.bwt(_documents(spark, sf_dir))


@_add("documents_roundtrip", _SAME.format(id="doc_id", table="documents"))
def documents_roundtrip(spark, sf_dir):
    return stored.check_inversion(_documents(spark, sf_dir))


@_add("documents_lz77_summary")
def documents_lz77_summary(spark, sf_dir):
    return factors.summary(factors.factorise(_documents(spark, sf_dir)))


@_add("documents_lz77_lengths", "SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents WHERE coalesce(text, '') <> ''")
def documents_lz77_lengths(spark, sf_dir):
    """Text lengths by the factors."""
    return factors.summary(factors.factorise(_documents(spark, sf_dir))).select("doc_id", "n")


@_add("documents_lz77_roundtrip", _SAME.format(id="doc_id", table="documents"))
def documents_lz77_roundtrip(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return checks.roundtrip(docs, factors.decode(factors.factorise(docs)))


@_add("documents_lz77_files", _SAME.format(id="doc_id", table="documents"))
def documents_lz77_files(spark, sf_dir):
    """Documents to factor files on disk, from these to text files on disk, and the texts read from them."""
    docs, folder = _documents(spark, sf_dir), f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    factors.factorise_files(docs, f"{folder}/factors", FOLDERS)
    factors.decode_files(spark, f"{folder}/factors", f"{folder}/texts", FOLDERS)
    return checks.roundtrip(docs, readers.read_files(spark, f"{folder}/texts", ".txt").withColumnRenamed("content", "text"))


#: None of them overlaps itself, so splitting by them finds all occurrences.
_DOC_PATTERNS = ["on the", "the ", ". ", "ç", "zq", "That the"]
_DOC_HITS = f"WITH pat(pat_id, p) AS (VALUES {', '.join(f"({i}, '{p}')" for i, p in enumerate(_DOC_PATTERNS))})"
_DOC_HITS += f", parts AS (SELECT doc_id, pat_id::BIGINT AS pat_id, octet_length(encode(p)) AS plen, string_split(t, p) AS ps FROM ({_DOC_TEXT}), pat)"
_DOC_HITS += ", placed AS (SELECT doc_id, pat_id, plen, k, n, sum(octet_length(encode(piece))) OVER (PARTITION BY doc_id, pat_id ORDER BY k) AS upto FROM (SELECT doc_id, pat_id, plen, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k, len(ps) AS n FROM parts))"


def _stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run index of all documents, written and read again."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    stored.build(_documents(spark, sf_dir)).write.parquet(path)
    return spark.read.schema(stored.INDEX).parquet(path)


@_add("documents_index_count", f"{_DOC_HITS} SELECT doc_id, pat_id, (len(ps) - 1)::BIGINT AS n_occ FROM parts")
def documents_index_count(spark, sf_dir):
    """Pattern counts on whole documents, answered from the stored runs."""
    return stored.count(_stored_index(spark, sf_dir), [p.encode() for p in _DOC_PATTERNS])


@_add("documents_locate", f"{_DOC_HITS} SELECT doc_id, pat_id, (upto + (k - 1) * plen)::BIGINT AS beg FROM placed WHERE k < n")
def documents_locate(spark, sf_dir):
    """Every occurrence on whole documents, from the stored runs and next-position map."""
    return stored.locate(_stored_index(spark, sf_dir), [p.encode() for p in _DOC_PATTERNS]).drop("bwt_pos")


@_add("documents_index_sizes")
def documents_index_sizes(spark, sf_dir):
    """Bytes of each part of the stored index."""
    return stored.sizes(_stored_index(spark, sf_dir))


@_add("documents_pattern_count", "SELECT doc_id, pat_id, ((length(t) - length(replace(t, p, ''))) // length(p))::BIGINT AS n_occ FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), (VALUES (0::BIGINT, 'th'), (1, 'the '), (2, 'e'), (3, 'ç'), (4, '. '), (5, 'on the')) v(pat_id, p)")
def documents_pattern_count(spark, sf_dir):
    return search.scan_counts(_documents(spark, sf_dir), [b"th", b"the ", b"e", "ç".encode(), b". ", b"on the"])


# ---- streams


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/conversations.parquet"
    return appends.pieces_of(spark, path, spark.read.parquet(path).schema, "conv_id", "turn", "text")


_GROWN = "src AS (SELECT conv_id AS doc_id, string_agg(hex(encode(coalesce(text, ''))), '' ORDER BY turn) AS h FROM conversations GROUP BY conv_id)"


@_add("stream_append", "SELECT conv_id AS doc_id, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS n FROM conversations GROUP BY conv_id")
def stream_append(spark, sf_dir):
    """Length of each conversation's index after the stream's last batch for it."""
    rows = appends.drained(appends.grow_index(_pieces(spark, sf_dir)), "update", shared_folder(spark))
    return appends.latest(rows, ["doc_id"]).select("doc_id", "n")


@_add("stream_sizes", _sql(" SELECT em.doc_id, em.n, coalesce(r, 0)::BIGINT AS r, coalesce(sigma, 0)::BIGINT AS sigma FROM em LEFT JOIN (SELECT doc_id, count(*) AS r, count(DISTINCT ch) AS sigma FROM runs GROUP BY doc_id) USING (doc_id)", _RUNS, source=_GROWN))
def stream_sizes(spark, sf_dir):
    rows = appends.drained(appends.grow_index(_pieces(spark, sf_dir)), "update", shared_folder(spark))
    return appends.latest(rows, ["doc_id"]).select("doc_id", "n", "r", "sigma")


@_add("stream_lz")
def stream_lz(spark, sf_dir):
    """All factors of every conversation, the last one included. The SQL for factors is cubic, too slow here; a test holds them against the batch form."""
    return appends.complete_factors(appends.drained(appends.grow_factors(_pieces(spark, sf_dir)), "append", shared_folder(spark)))


@_add("stream_lz_decode", "SELECT conv_id AS doc_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id HAVING sum(length(coalesce(text, ''))) > 0")
def stream_lz_decode(spark, sf_dir):
    """The conversations again, from the factors of the stream."""
    return factors.decode(stream_lz(spark, sf_dir)).select("doc_id", F.decode("text", "UTF-8").alias("text"))


_STREAM_PATTERNS = (b"th", b"the ", b". ", b"on the", b"zzz")
_GROWN_HITS = f"WITH {_GROWN}, pat(pat_id, p) AS (VALUES {', '.join(f"({i}, '{p.hex().upper()}')" for i, p in enumerate(_STREAM_PATTERNS))}), hits AS (SELECT doc_id, pat_id::BIGINT AS pat_id, list_filter(range(0, greatest(length(h) // 2 - length(p) // 2 + 1, 0)), lambda i: substr(h, 2 * i + 1, length(p)) = p) AS begs FROM src, pat)"


def _stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = appends.drained(appends.grow_answers(_pieces(spark, sf_dir), _STREAM_PATTERNS), "update", shared_folder(spark))
    return appends.latest(rows, ["doc_id", "pat_id"])


@_add("stream_count", f"{_GROWN_HITS} SELECT doc_id, pat_id, len(begs)::BIGINT AS n_occ FROM hits")
def stream_count(spark, sf_dir):
    """Pattern counts answered from the state of each conversation's index as it has grown."""
    return _stream_answers(spark, sf_dir).select("doc_id", "pat_id", "n_occ")


@_add("stream_locate", f"{_GROWN_HITS} SELECT doc_id, pat_id, unnest(begs)::BIGINT AS beg FROM hits")
def stream_locate(spark, sf_dir):
    return _stream_answers(spark, sf_dir).select("doc_id", "pat_id", F.explode("begs").alias("beg"))


@_add("stream_progress")
def stream_progress(spark, sf_dir):
    """A row for each batch: rows read, rate, rows and bytes of state, time taken."""
    progress: list[tuple] = []
    appends.drained(appends.grow_index(_pieces(spark, sf_dir)), "update", shared_folder(spark), progress=progress)
    return spark.createDataFrame(progress, appends.PROGRESS)
