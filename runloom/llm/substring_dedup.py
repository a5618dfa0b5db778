"""Substring dedup by hashing lines, and sentences within lines.

A text is cut after every line feed into lines, and a line after the blank
that follows a sentence end (. ! ?) into sentences; offsets are those of the
original text. A unit is normalised (A-Z lower-cased, runs of ASCII white
space as one blank, trimmed) and hashed to 128 bits. Units are all lines with
a word, whatever their length, and in lines of several sentences also the
sentences of min_bytes normalised bytes or more, so that a passage is found
where the rest of its line differs. Of each digest the occurrence ranked first
(smallest id, then text hash, then offset) stays; every other one is removed,
and its span in the original text is returned.

Null text: no units, text stays null. Empty text: kept. A row without id is
returned whole. Rows that share an id are documents of their own if their
texts differ; rows of equal id and text are one document, and each row is
returned with its result. Texts of any length are read whole, by one task
each. An empty table gives no rows. Further columns are dropped, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import spread, stored

MIN_BYTES = 40
_END = re.compile(r"(?<=[.!?]) ")
_LINE = re.compile(r"[^\n]*\n|[^\n]+")


def _tiles(text: str, ends: Iterator[int], beg: int) -> Iterator[tuple[int, int]]:
    at = beg
    for end in ends:
        yield at, end
        at = end
    yield at, beg + len(text)


def normal(unit: str) -> bytes:
    """bytes.lower() and bytes.split() know ASCII letters and ASCII white space only."""
    return b" ".join(unit.encode().lower().split())


def split_units(text: str, min_bytes: int = MIN_BYTES) -> Iterator[tuple[int, int, bytes]]:
    """(beg, end, normalised bytes) of every unit."""
    at = 0
    for line in _LINE.findall(text):
        whole = normal(line)
        if whole:
            yield at, at + len(line), whole
        sentences = [(b, e, normal(text[b:e])) for b, e in _tiles(line, (at + m.end() for m in _END.finditer(line)), at)] if whole else []
        if sum(1 for s in sentences if s[2]) > 1:
            yield from (s for s in sentences if len(s[2]) >= min_bytes and s[2])
        at += len(line)


def digest(unit: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(unit, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_UNIT = pa.schema([("id", pa.int64()), ("copy", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("beg", pa.int32()), ("end", pa.int32())])


def _unit_rows(min_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, copy, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for beg, end, unit in split_units(text.as_py(), min_bytes):
                    out.append((doc, copy, *digest(unit), beg, end))
                    if len(out) >= 50_000:
                        yield _batch(out)
                        out = []
            yield _batch(out)

    return rows


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [()] * len(_UNIT)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _UNIT, strict=True)], schema=_UNIT)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("t"))


def unit_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, copy, d1, d2, beg, end) of every unit; copy tells texts of one id apart."""
    texts = _texts(docs, id_col, text_col).where("t is not null and id is not null")
    return spread(texts).mapInArrow(_unit_rows(min_bytes), "id bigint, copy bigint, d1 bigint, d2 bigint, beg int, end int")


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, copy, beg, end, first_id, first_beg): the occurrences to remove and the one that stays for each.

    Digests are first grouped with map-side minima. Only those that repeat are
    joined back; a digest that a third of the corpus shares is one row on one
    side, and adaptive execution splits its occurrences on the other.
    """
    units = stored(unit_rows(docs, id_col, text_col, min_bytes))
    place = F.struct("id", "copy", "beg")
    firsts = units.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("d1", "d2", "first")
    found = units.join(firsts, ["d1", "d2"]).where(place != F.col("first"))
    return found.select("id", "copy", "beg", "end", F.col("first.id").alias("first_id"), F.col("first.beg").alias("first_beg"))


def widest(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Cuts without those that lie in another."""
    out: list[tuple[int, int]] = []
    for beg, end in sorted(set(cuts), key=lambda c: (c[0], -c[1])):
        if not out or end > out[-1][1]:
            out.append((beg, end))
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n_chars, n_removed, spans = [], [], [], []
        for text, cuts in zip(batch.column(1), batch.column(2), strict=True):
            text, cuts = text.as_py(), widest([(c["beg"], c["end"]) for c in cuts.as_py() or ()])
            merged: list[list[int]] = []
            for beg, end in cuts:
                if merged and merged[-1][1] == beg:
                    merged[-1][1] = end
                else:
                    merged.append([beg, end])
            if text is not None:
                at, kept = 0, []
                for beg, end in merged:
                    kept.append(text[at:beg])
                    at = end
                text = "".join([*kept, text[at:]])
            texts.append(text)
            n_chars.append(sum(e - b for b, e in merged))
            n_removed.append(len(cuts))
            spans.append(",".join(f"{b}:{e}" for b, e in merged))
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(n_removed, pa.int64()), pa.array(n_chars, pa.int64()), pa.array(spans, pa.string())], names=["id", "text", "n_removed", "removed_chars", "removed_spans"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """id_col, text (what is kept), n_removed (lines, and sentences of other lines), removed_chars, removed_spans ("beg:end,..." merged, code points)."""
    cuts = repeated_units(docs, id_col, text_col, min_bytes).groupBy("id", "copy").agg(F.collect_set(F.struct("beg", "end")).alias("cuts"))
    done = _texts(docs, id_col, text_col).join(cuts, ["id", "copy"], "left").select("id", "t", "cuts")
    done = done.mapInArrow(_apply, "id bigint, text string, n_removed bigint, removed_chars bigint, removed_spans string")
    return done.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, line, k, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1)::BIGINT AS line_beg, k = n AS last
  FROM (SELECT doc_id, len(l) AS n, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
), pieces AS (
  SELECT *, line_beg + sum(n) OVER (PARTITION BY doc_id, k ORDER BY j)::BIGINT - n AS beg FROM (
    SELECT doc_id, k, j, line, line_beg, p AS piece, (length(p) + CASE WHEN j < len(ps) OR NOT last THEN 1 ELSE 0 END)::BIGINT AS n
    FROM (SELECT *, unnest(ps) AS p, generate_subscripts(ps, 1) AS j FROM (SELECT *, string_split(regexp_replace(line, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) AS ps FROM lines)))
), plain AS (
  SELECT doc_id, k, j, n, beg, line_beg, array_to_string(list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> ''), ' ') AS whole,
         array_to_string(list_filter(regexp_split_to_array(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> ''), ' ') AS part FROM pieces
), parts AS (
  SELECT *, count_if(part <> '') OVER (PARTITION BY doc_id, k) > 1 AND octet_length(encode(part)) >= 40 AS unit FROM plain
), units AS (
  SELECT doc_id, k, NULL AS j, line_beg AS beg, whole AS u FROM parts WHERE j = 1 AND whole <> '' UNION ALL SELECT doc_id, k, j, beg, part FROM parts WHERE unit
), again AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY doc_id, beg) AS r FROM units) WHERE r > 1
), judged AS (
  SELECT p.*, l.u IS NOT NULL AS line_gone, l.u IS NOT NULL OR s.u IS NOT NULL AS gone, substr(t.text, (p.beg + 1)::BIGINT, p.n) AS piece,
         row_number() OVER (PARTITION BY p.doc_id ORDER BY p.k, p.j) AS nr
  FROM parts p JOIN documents t ON t.doc_id = p.doc_id LEFT JOIN again l ON l.doc_id = p.doc_id AND l.k = p.k AND l.j IS NULL LEFT JOIN again s ON s.doc_id = p.doc_id AND s.k = p.k AND s.j = p.j
), runs AS (
  SELECT *, nr - row_number() OVER (PARTITION BY doc_id, gone ORDER BY nr) AS run FROM judged WHERE n > 0
), spans AS (
  SELECT doc_id, min(beg) AS b, max(beg + n) AS e FROM runs WHERE gone GROUP BY doc_id, run
), per_span AS (
  SELECT doc_id, sum(e - b)::BIGINT AS removed_chars, string_agg(b::BIGINT || ':' || e::BIGINT, ',' ORDER BY b) AS removed_spans FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, (count_if(line_gone AND j = 1) + count_if(gone AND NOT line_gone))::BIGINT AS n_removed, coalesce(string_agg(piece, '' ORDER BY nr) FILTER (NOT gone), '') AS text FROM judged GROUP BY doc_id
)
SELECT d.doc_id, kept.text, coalesce(n_removed, 0) AS n_removed, coalesce(removed_chars, 0) AS removed_chars, coalesce(removed_spans, '') AS removed_spans
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN per_span USING (doc_id)
"""
