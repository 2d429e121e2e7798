"""Queries of the steps from texts to chunks, over documents and pages together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpalith.operators import packing as P
from corpalith.operators.chunking import MOST, OVERLAP, PARENT, RUNT, TARGET
from corpalith.plans.queries import SQL, query
from corpalith.sources.corpus import table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of all documents, and of all pages as marked lines: their ids are below 0."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.union(table(spark, sf_dir, "pages").select(-F.col("page_id") - 1, P.marked(F.col("html"))))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.packed(_texts(spark, sf_dir), "id", F.col("text"))


_MARKED = f"regexp_replace(html, '{P.UNSEEN}', ' ', 'g')"
for _level in range(1, 7):
    _MARKED = f"regexp_replace({_MARKED}, '(?i)<h{_level}\\b[^>]*>', chr(10) || '{'#' * _level} ', 'g')"
_MARKED = f"regexp_replace(regexp_replace({_MARKED}, '{P.BLOCKS}', chr(10), 'g'), '{P.TAGS}', ' ', 'g')"
_WHITE = " || ".join(f"chr({ord(c)})" for c in P.WHITE)
_TITLE = f"trim(substring(line, marks + 1), {_WHITE})"

_PACKED = f"""RECURSIVE texts AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -page_id - 1, {_MARKED} FROM pages),
split AS (SELECT id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_WHITE})), lambda x: x <> '') AS ls FROM texts),
lines AS (SELECT id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS place FROM split),
counted AS (SELECT *, length(regexp_extract(line, '{P.MARKS}')) AS marks FROM lines),
titled AS (SELECT *, CASE WHEN marks BETWEEN 1 AND 6 AND {_TITLE} <> '' THEN {_TITLE} END AS title FROM counted),
blocks AS (SELECT id, place, CASE WHEN title IS NULL THEN 0 ELSE marks END AS level, title, CASE WHEN title IS NULL THEN line ELSE substring(line, 1, marks) || ' ' || title END AS text FROM titled),
sized AS (SELECT *, greatest(1, length(text) // 4) AS size FROM blocks),
walk AS (
  SELECT DISTINCT id, 0::BIGINT AS place, 0::BIGINT AS level, []::VARCHAR[] AS path, 0 AS section, 0 AS grp, 0::BIGINT AS size, false AS is_open, ''::VARCHAR AS text FROM sized
  UNION ALL
  SELECT id, place, level, path, section, grp, size, level > 0 OR size < {TARGET}, text FROM (
    SELECT s.id, s.place, s.level, CASE WHEN s.level > 0 THEN list_concat(list_slice(w.path, 1, s.level - 1), [s.title]) ELSE w.path END AS path, w.section + CASE WHEN s.level > 0 THEN 1 ELSE 0 END AS section,
      w.grp + CASE WHEN s.level > 0 OR NOT w.is_open OR w.size + s.size > {MOST} THEN 1 ELSE 0 END AS grp,
      CASE WHEN s.level > 0 OR NOT w.is_open OR w.size + s.size > {MOST} THEN s.size ELSE w.size + s.size END AS size, s.text
    FROM walk w JOIN sized s ON s.id = w.id AND s.place = w.place + 1)),
grouped AS (
  SELECT id, grp, max(section) AS section, arg_max(path, place) AS path, min(place) AS first, max(place) AS last, string_agg(text, chr(10) || chr(10) ORDER BY place) AS text
  FROM walk WHERE place > 0 GROUP BY id, grp HAVING bool_or(level = 0)),
made AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY grp) - 1 AS nth, CASE WHEN lag(section) OVER w = section THEN lag(text) OVER w END AS before FROM grouped WINDOW w AS (PARTITION BY id ORDER BY grp)),
ended AS (SELECT *, CASE WHEN length(before) > {OVERLAP} THEN right(before, {OVERLAP}) END AS tail FROM made),
carried AS (
  SELECT * EXCLUDE (tail, before), CASE WHEN before IS NULL THEN '' WHEN tail IS NULL THEN before WHEN contains(tail, '. ') THEN substring(tail, instr(tail, '. ') + 2) ELSE substring(tail, instr(tail, ' ') + 1) END AS overlap FROM ended),
fold AS (
  SELECT id, nth, 0 AS ordinal, text, path, overlap FROM carried WHERE nth = 0
  UNION ALL
  SELECT c.id, c.nth, f.ordinal + CASE WHEN length(f.text) < {RUNT} AND length(f.text) + 2 + length(c.text) <= {TARGET * 6} THEN 0 ELSE 1 END,
    CASE WHEN length(f.text) < {RUNT} AND length(f.text) + 2 + length(c.text) <= {TARGET * 6} THEN f.text || chr(10) || chr(10) || c.text ELSE c.text END,
    CASE WHEN length(f.text) < {RUNT} AND length(f.text) + 2 + length(c.text) <= {TARGET * 6} THEN f.path ELSE c.path END,
    CASE WHEN length(f.text) < {RUNT} AND length(f.text) + 2 + length(c.text) <= {TARGET * 6} THEN f.overlap ELSE c.overlap END
  FROM fold f JOIN carried c ON c.id = f.id AND c.nth = f.nth + 1),
merged AS (SELECT id, ordinal, arg_max(text, nth) AS text, arg_max(path, nth) AS path, arg_max(overlap, nth) AS overlap FROM fold GROUP BY id, ordinal)"""


@query(f"WITH {_PACKED} SELECT id, CAST(nth AS INTEGER) AS nth, overlap FROM carried")
def w6_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every chunk carries over from the one before it in its section."""
    return _packed(spark, sf_dir).select("id", F.posexplode("made").alias("nth", "c")).select("id", "nth", "c.overlap")


@query(f"WITH {_PACKED} SELECT id, CAST(ordinal AS INTEGER) AS ordinal, md5(text) AS body FROM merged")
def w7_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks' numbers once small ones have taken others in."""
    return P.chunks(_texts(spark, sf_dir), "id", F.col("text")).select("id", "ordinal", F.md5("text").alias("body"))


@query(f"WITH {_PACKED} SELECT id, CAST(nth AS INTEGER) AS nth, CAST(section AS INTEGER) AS section, array_to_string(path, ' > ') AS path FROM carried")
def w8_heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packed(spark, sf_dir).select("id", F.posexplode("groups").alias("nth", "g"))
    return rows.select("id", "nth", "g.section", F.array_join("g.path", " > ").alias("path"))


@query(f"WITH {_PACKED} SELECT id, CAST(nth AS INTEGER) AS nth, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM carried")
def w9_packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last block of every chunk, by greedy packing."""
    return _packed(spark, sf_dir).select("id", F.posexplode("groups").alias("nth", "g")).select("id", "nth", "g.first", "g.last")


@query(f"WITH {_PACKED} SELECT id, CAST(ordinal AS INTEGER) AS ordinal, length(text) AS n_chars, array_to_string(path, ' > ') AS path, overlap FROM merged")
def w10_merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of which small ones have taken the next in; the first one's path and overlap stay."""
    rows = P.chunks(_texts(spark, sf_dir), "id", F.col("text"))
    return rows.select("id", "ordinal", F.length("text").cast("long").alias("n_chars"), F.col("heading_path").alias("path"), "overlap")


#: Chunks of plain texts, which ``chunking`` makes in Arrow batches: several times faster than the folds here, with the same result.
SQL["p7_chunks"] = f"""WITH {_PACKED},
sections AS (SELECT id, section, substring(string_agg(text, chr(10) || chr(10) ORDER BY place), 1, {PARENT}) AS parent FROM walk WHERE place > 0 GROUP BY id, section),
begun AS (SELECT f.id, f.ordinal, arg_min(c.section, f.nth) AS section FROM fold f JOIN carried c ON c.id = f.id AND c.nth = f.nth GROUP BY f.id, f.ordinal)
SELECT id, CAST(ordinal AS INTEGER) AS ordinal, array_to_string(path, ' > ') AS heading_path, text, overlap, parent, CAST(greatest(1, length(text) // 4) AS INTEGER) AS n_tokens
FROM merged JOIN begun USING (id, ordinal) JOIN sections USING (id, section) WHERE id >= 0"""
