"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpalith.llm import chat, decontaminate, flac, funnel, html_text, langid, line_dedup, merkle, mixing, quality, simhash, suffix_lm, url_filter
from corpalith.llm.common import ascii_lower, dropped, fold, held_out, small_batches, stored

#: The rules of the URL query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: The tables hold no list of unwanted URLs: the canonical URLs whose MD5 starts with this digit stand in for one, in any input.
LISTED = "0"
#: The funnels of the funnel query.
FUNNELS = (
    funnel.Funnel("A", ("view", "click", "view", "purchase"), "error"),
    funnel.Funnel("B", ("signup", "view", "click", "purchase"), "error"),
    funnel.Funnel("C", ("click", "click", "purchase", "view"), "signup"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the rules, then by the list; see ``url_filter.filter_urls``."""
    pages = _table(spark, sf_dir, "pages")
    listed = pages.where(F.md5(url_filter.canonical(F.col("url"))).startswith(LISTED))
    return url_filter.filter_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "canonical")


def op2_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as FLAC streams; the features are read from the PCM blocks that these decode to, a block at a time."""
    media = flac.encode_texts(_table(spark, sf_dir, "documents"))
    return flac.digests(flac.pcm_blocks(media, keep=("n_bytes",)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by rules learned from labelled ones outside fold 2 of 4; null texts count as empty."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), learn=fold("id", 4) != 2)
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 4), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that contain a benchmark item; see ``decontaminate.contaminated``."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat or nearly repeat an earlier one; see ``line_dedup.dedup_lines``."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned outside fold 2 of 4; texts without letters are ``und``."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, learn=fold("doc_id", 4) != 2)
    return langid.identify(docs, model).select("doc_id", held_out("doc_id", 4), "lang_pred", "score", F.size("mixture").alias("n_langs"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document; see ``mixing.mix``."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "shard_no", "quota")


def op8_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; see ``html_text.extract``."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; see ``simhash.near_duplicates``."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside fold 2 of 7; the tokenised table goes once its scores are kept."""
    with small_batches(spark):
        tokens = suffix_lm.tokenise(_table(spark, sf_dir, "documents"), learn=fold("doc_id", 7) != 2)
        lm = suffix_lm.fit(tokens)
        scored = stored(suffix_lm.score(tokens, lm))
    dropped(tokens, lm.values)
    return scored.select("doc_id", held_out("doc_id", 7), "n_tokens", "n_known", F.lit(lm.total).cast("long").alias("train_tokens"), "base_score", "score")


def op11_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three funnels over all clicks; see ``funnel.count_funnels``."""
    return funnel.count_funnels(_table(spark, sf_dir, "clicks"), FUNNELS)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and proofs of all documents; of each fifth, by its id's crc32, a text with A-Z lower-cased is shown. See ``merkle.manifest``."""
    text = F.when(fold("doc_id", 5) == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(_table(spark, sf_dir, "documents"), {"text": text})


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back; see ``chat.digests``."""
    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit("</s>[INST] ok [/INST]"))
    return chat.digests(talks.union(odd))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filter, op2_flac_media, op3_quality_rules, op4_decontaminate, op5_line_dedup, op6_language_mixture, op7_mix_sources, op8_html_blocks, op9_simhash_tiles, op10_suffix_tree, op11_funnels, op12_merkle, op13_chat)
}

_TRACKING = ", ".join(f"'{t}'" for t in url_filter.TRACKING)


def _leaf_sql(text: str) -> str:
    values = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"


_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, n))"
_UP = "list_transform(range(0, len(l), 16), lambda i: sha256(array_to_string(l[i + 1:i + 16], '')))"
_SIDES = "array_to_string(l[p // 16 * 16 + 1:p], '') AS lft, array_to_string(l[p + 2:p // 16 * 16 + 16], '') AS rgt"

ORACLE_SQL = {
    "op1_url_filter": f"""
WITH cut AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^(?s).*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s).*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^(?s)[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '' AND string_split(p, '=')[1] NOT IN ({_TRACKING}))) AS kept
  FROM pages),
named AS (
  SELECT *, CASE WHEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www[.]', '') <> '' THEN
    regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www[.]', '') || regexp_replace(regexp_replace(path, '/index[.]html?$', '/'), '/+$', '')
      || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical
  FROM cut),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}) r(h, p, v)),
fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS ruled
  FROM named JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
listed AS (SELECT DISTINCT canonical AS c FROM named WHERE starts_with(md5(canonical), '{LISTED}'))
SELECT n.page_id, host, path, rule, coalesce(ruled, CASE WHEN c IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, canonical
FROM named n LEFT JOIN fits USING (page_id) LEFT JOIN listed ON canonical = c
""",
    "op4_decontaminate": r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') FROM benchmark WHERE text IS NOT NULL),
shingles AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words),
sizes AS (SELECT id AS item_id, count(*) AS n_shingles FROM shingles WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n_shingles) AS n_shingles, count(*) AS n_shared, count(*) / any_value(n_shingles) AS containment
FROM shingles b JOIN shingles d ON b.s = d.s AND b.kind = 'b' AND d.kind = 'd' JOIN sizes ON item_id = b.id
GROUP BY d.id, b.id HAVING count(*) >= ceil(any_value(n_shingles) * 0.8 - 1e-9)
""",
    "op5_line_dedup": r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
every AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM split),
worded AS (
  SELECT doc_id, line_no, regexp_split_to_array(trim(lower(line), ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[ \t\x0B\f\r]+') AS w FROM every),
lines AS (SELECT doc_id, line_no, w, len(w) AS n FROM worded WHERE w <> ['']),
firsts AS (SELECT w, any_value(n) AS n, min({'d': doc_id, 'l': line_no}) AS f FROM lines GROUP BY w),
long AS (SELECT * FROM firsts WHERE n >= 6),
halves AS (
  SELECT f, w, n, 0 AS side, n - less AS m, w[1:((n - less) // 2)] AS half FROM long, (VALUES (0), (1)) v(less)
  UNION ALL
  SELECT f, w, n, 1, n - less, w[(n - (n - less) // 2 + 1):n] FROM long, (VALUES (0), (1)) v(less)),
near AS (
  SELECT DISTINCT b.f FROM halves a JOIN halves b ON a.side = b.side AND a.m = b.m AND a.half = b.half AND a.f < b.f AND least(a.n, b.n) = a.m
  WHERE len(list_filter(range(1, least(a.n, b.n) + 1), lambda i: a.w[1:i] = b.w[1:i]))
      + len(list_filter(range(1, least(a.n, b.n) + 1), lambda i: a.w[(a.n - i + 1):a.n] = b.w[(b.n - i + 1):b.n])) >= greatest(a.n, b.n) - 1),
gone AS (
  SELECT l.doc_id, l.line_no FROM lines l JOIN firsts USING (w) LEFT JOIN near ON near.f = firsts.f
  WHERE near.f IS NOT NULL OR firsts.f < {'d': l.doc_id, 'l': l.line_no}),
left_over AS (
  SELECT e.doc_id, coalesce(string_agg(e.line, chr(10) ORDER BY e.line_no) FILTER (WHERE g.line_no IS NULL), '') AS text, count(g.line_no) AS n
  FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.line_no = g.line_no GROUP BY e.doc_id)
SELECT d.doc_id, CASE WHEN o.n > 0 THEN o.text ELSE d.text END AS text, CAST(coalesce(o.n, 0) AS INTEGER) AS n_lines_dropped
FROM documents d LEFT JOIN left_over o USING (doc_id)
""",
    "op11_funnels": f"""
WITH seen AS (SELECT DISTINCT client_id, kind, epoch_us(arrived_at) AS t FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL),
later AS (
  SELECT client_id, kind, t, {", ".join(f"min(t) FILTER (kind = '{k}') OVER after AS {k}" for k in ("view", "click", "purchase", "error", "signup"))}
  FROM seen WINDOW after AS (PARTITION BY client_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
funnels AS (SELECT * FROM (VALUES {", ".join(f"('{f.name}', {list(f.steps)}, '{f.excluded}')" for f in FUNNELS)}) v(funnel, steps, excluded)),
hops AS (
  SELECT funnel, step, client_id, t, CASE steps[step + 1] WHEN 'view' THEN view WHEN 'click' THEN click WHEN 'purchase' THEN purchase END AS upcoming,
    CASE excluded WHEN 'error' THEN error ELSE signup END AS bar
  FROM funnels, (VALUES (1), (2), (3)) s(step), later WHERE kind = steps[step]),
s1 AS (SELECT funnel, client_id, t AS t1, upcoming, bar FROM hops WHERE step = 1),
{", ".join(f"""r{k} AS (SELECT *, upcoming AS t{k} FROM s{k - 1} WHERE upcoming <= t1 + 1800000000 AND (bar IS NULL OR bar > upcoming)),
s{k} AS (SELECT r.* EXCLUDE (upcoming, bar), h.upcoming, h.bar FROM r{k} r JOIN hops h ON h.funnel = r.funnel AND h.client_id = r.client_id AND h.step = {k} AND h.t = r.t{k})""" for k in (2, 3))},
r4 AS (SELECT *, upcoming AS t4 FROM s3 WHERE upcoming <= t1 + 1800000000 AND (bar IS NULL OR bar > upcoming)),
took AS (
  SELECT funnel, client_id, 1 AS step, NULL::BIGINT AS took FROM s1
  UNION ALL SELECT funnel, client_id, 2, t2 - t1 FROM r2 UNION ALL SELECT funnel, client_id, 3, t3 - t2 FROM r3 UNION ALL SELECT funnel, client_id, 4, t4 - t3 FROM r4),
steps AS (SELECT funnel, client_id, step, count(*) AS n, list_sort(list(took))[(90 * count(*) + 99) // 100] AS tk FROM took GROUP BY ALL),
wide AS (
  SELECT funnel, client_id, {", ".join(f"CAST(coalesce(max(n) FILTER (step = {k}), 0) AS BIGINT) AS n{k}" for k in (1, 2, 3, 4))}, CAST(max(step) AS INTEGER) AS deepest,
    {", ".join(f"max(tk) FILTER (step = {k}) AS t{k}" for k in (2, 3, 4))}
  FROM steps GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM wide
""",
    "op12_merkle": f"""
WITH RECURSIVE crcs AS (SELECT {_CRC_TABLE} AS tbl),
hit AS (
  SELECT *, xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, b: xor(crc >> 8, tbl[(xor(crc, b) & 255) + 1]), 4294967295::BIGINT)) % 5 = 0 AS shows FROM documents, crcs),
leaves AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
    CASE WHEN shows THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql("text")} END AS shown FROM hit),
placed AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
lower_tree AS (
  SELECT source, 0 AS lvl, list(leaf ORDER BY pos) AS l FROM placed GROUP BY source
  UNION ALL SELECT source, lvl + 1, {_UP} FROM lower_tree WHERE len(l) > 1),
subroots AS (SELECT source, l[1] AS subroot, lvl AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM lower_tree WHERE len(l) = 1),
upper_tree AS (
  SELECT 0 AS lvl, list(subroot ORDER BY pos) AS l FROM subroots
  UNION ALL SELECT lvl + 1, {_UP} FROM upper_tree WHERE len(l) > 1),
steps AS (
  SELECT rid, lvl AS k, {_SIDES} FROM (SELECT rid, lvl, l, pos >> (4 * lvl) AS p FROM placed x JOIN lower_tree t ON x.source IS NOT DISTINCT FROM t.source WHERE len(l) > 1)
  UNION ALL
  SELECT rid, k, {_SIDES} FROM (
    SELECT rid, height + lvl AS k, l, s.pos >> (4 * lvl) AS p FROM placed x JOIN subroots s ON x.source IS NOT DISTINCT FROM s.source, upper_tree WHERE len(l) > 1)),
folds AS (
  SELECT rid, 0 AS k, shown AS node FROM placed
  UNION ALL SELECT f.rid, f.k + 1, sha256(lft || node || rgt) FROM folds f JOIN steps s ON f.rid = s.rid AND f.k = s.k),
proofs AS (SELECT rid, sha256(coalesce(string_agg(lft || rgt, '' ORDER BY k), '')) AS proof_sha256 FROM placed LEFT JOIN steps USING (rid) GROUP BY rid),
whole AS (SELECT l[1] AS root FROM upper_tree WHERE len(l) = 1),
ends AS (SELECT rid, arg_max(node, k) AS folded_root FROM folds GROUP BY rid)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM placed x JOIN subroots s ON x.source IS NOT DISTINCT FROM s.source JOIN proofs USING (rid) JOIN ends USING (rid), whole
""",
    "op13_chat": r"""
WITH talks AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, v.t, v.r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
sized AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|OUT\]|ROLE:|/ROLE\])', '\1\\\2\3', 'g'))
    + CASE role WHEN 'user' THEN 22 WHEN 'assistant' THEN 13
      ELSE 23 + length(replace(replace(replace(replace(role, '%', '%25'), ']', '%5D'), '<', '%3C'), '[', '%5B')) END AS chars
  FROM talks)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, NULL::BIGINT AS rewritten_at
FROM sized GROUP BY conv_id
""",
}
