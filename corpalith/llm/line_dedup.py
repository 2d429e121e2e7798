"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Edits are of words: two lines are near if inserting, deleting or replacing one word turns one
into the other (with ``MIN_WORDS`` = 6 they share five sixths or more of their words). Later
lines that repeat an earlier line, or are near one, go; the earliest stays. Exact repeats go
whatever a line's length.

Exact repeats are settled first by a hash. Emitting every deletion variant of every remaining
line would cost as many rows as the corpus has words, so variants are made only for lines that
can have a partner: a single edit falls into one half of a line, so near lines agree on the
other half, and lines that share no half drop out. This loses no pair.

Variants are keyed so that a key alone nearly proves the distance, and only the least position
of a key is needed, not its pairs:

* replacing: the hash of the line without word j, with j and n. All lines of a key are near.
* inserting: the hash of the shorter line, and that of the longer one without word j. Every
  shorter line of a key is near to every longer one.

Each line is paired with the earliest line of each of its keys, and the pair is verified on the
words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpalith.llm.common import dropped, durable, hot_join, like, small, stored

MIN_WORDS = 6

#: White space inside a line.
BLANKS = " \t\u000b\f\r"
BLANK_RUN = r"[ \t\x0B\f\r]+"


def _squeezed(text: Column) -> Column:
    """A trimmed line with one space between words."""
    rough = F.contains(text, F.lit("  "))
    for blank in BLANKS[1:]:
        rough = rough | F.contains(text, F.lit(blank))
    return F.when(rough, F.regexp_replace(text, BLANK_RUN, " ")).otherwise(text)


def _normal(rows: DataFrame, line: Column, *keep: str) -> DataFrame:
    """``keep`` and ``text``: the line lower-cased and trimmed, with one space between words.

    In two projections, as each part is used more than once.
    """
    return rows.select(*keep, F.btrim(F.lower(line), F.lit(BLANKS)).alias("text")).select(*keep, _squeezed(F.col("text")).alias("text"))


def _halves(words: Column, n: Column) -> list[Column]:
    """Keys of a line's two halves, as the shorter line (of m = n words) and as the longer one (m = n - 1).

    One edit falls into one half of the shorter line, so two near lines agree on its first m div 2
    words or on its last ones.
    """

    def key(side: int, m: Column) -> Column:
        half = F.floor(m / 2).cast("int")
        ends = F.slice(words, F.lit(1), half) if side == 0 else F.slice(words, n - half + 1, half)
        return F.xxhash64(F.lit(side), m, ends)

    return [key(side, n - less).alias(f"half{2 * less + side}") for less in (0, 1) for side in (0, 1)]


def _with_partner(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed(h, key, ...)`` whose key another row has too."""
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("shared"))
    return hot_join(keyed, shared, [("key", "shared")], "left_semi")


def _without(words: Column, j: Column) -> Column:
    """Hash of an array without its j-th element: arrays hash element by element, so the rest need not be joined."""
    return F.xxhash64(F.slice(words, F.lit(1), j - 1), F.slice(words, j + 1, F.size(words)))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by at most one inserted, deleted or replaced word."""

    def shared(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False)
        return F.when(at == 0, F.least(F.size(x), F.size(y))).otherwise(at - 1)

    return shared(a, b) + shared(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_words: int, exact_words: int) -> DataFrame:
    """(id, th, line_no, h, half0 .. half3) of every line that is not blank, with at least ``exact_words`` words; no halves under ``min_words``.

    ``th``, the hash of the text, tells rows with the same id and other texts apart.
    """
    picked = like(docs, id_col, text_col).toDF("id", "text").where("id is not null and text is not null")
    rows = picked.select("id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = _normal(rows.where(F.octet_length("line") >= 2 * exact_words - 1), F.col("line"), "id", "th", "line_no")
    rows = rows.select("id", "th", "line_no", "text", F.split("text", " ").alias("words"))
    halves = _halves(F.col("words"), F.size("words"))
    if exact_words < min_words:
        halves = [F.when(F.size("words") >= min_words, half).alias(f"half{i}") for i, half in enumerate(halves)]
    keys = F.struct(F.xxhash64("text").alias("h"), *halves)
    # Short lines give no row here: a filter on the number of words would be pushed down and redo the text.
    return rows.select("id", "th", "line_no", F.inline(F.when((F.size("words") >= exact_words) & (F.col("text") != ""), F.array(keys))))


def _matching(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """(row, id, th, lines) of the documents, each as one struct so that no name can clash, joined to ``wanted(id, th, lines)``.

    ``wanted`` is broadcast if its counted bytes allow.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("th", F.xxhash64(f"row.`{text_col}`"))
    n, lines = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()
    return rows.join(small(wanted.withColumnRenamed("th", "w_th"), 1, 32 * n + 48 * lines), (F.col(f"row.`{id_col}`") == F.col("id")) & (F.col("th") == F.col("w_th")), how)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, exact_words: int = 1) -> DataFrame:
    """(id, th, line_no, how) of the lines that repeat an earlier line: how is ``exact`` or ``near``.

    Earlier is by id, text hash and line number. Lines under ``min_words`` words are compared for
    exact repeats only, those under ``exact_words``, blank lines, and lines of rows with a null id or
    text not at all. Repeated rows (same id and text) are one document.
    """
    hashed = stored(line_keys(docs, id_col, text_col, min_words, min(min_words, exact_words)))
    place = F.struct("id", "th", "line_no")
    halves = [f"half{i}" for i in range(4)]
    grouped = hashed.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), *(F.min(c).alias(c) for c in halves))
    unique = stored(grouped.select("h", "first", (F.col("first") < F.col("last")).alias("repeated"), *halves))

    partnered = _with_partner(unique.where("half0 is not null").select("h", F.explode(F.array(*halves)).alias("key"))).select(F.col("h").alias("ph")).distinct()
    firsts = unique.join(partnered, F.col("h") == F.col("ph"), "left_semi").select("h", "first")
    wanted = stored(firsts.groupBy(F.col("first.id").alias("id"), F.col("first.th").alias("th")).agg(F.collect_list(F.struct("first.line_no", "h", "first")).alias("lines")))
    texts = _matching(like(docs, id_col, text_col), wanted, id_col, text_col, "inner")
    texts = texts.select(F.split(f"row.`{text_col}`", "\n").alias("ls"), F.explode("lines").alias("x"))
    texts = texts.select("x.h", "x.first", F.element_at("ls", F.col("x.line_no") + 1).alias("line"))
    chosen = stored(_normal(texts, F.col("line"), "h", "first").select("h", "first", F.split("text", " ").alias("words")).dropDuplicates(["h"]))
    n = F.size("words")
    hashes = chosen.select("h", n.alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("ws"))
    keys = F.concat(F.array(F.xxhash64("ws")), F.transform(F.sequence(F.lit(1), F.col("n")), lambda j: _without(F.col("ws"), j)))
    dropped(wanted)
    variants = stored(hashes.select("h", "n", F.posexplode(keys).alias("j", "key")))
    replaced = F.struct(F.xxhash64("key", "n", "j").alias("key"), F.lit(0).alias("side"))
    shorter = F.struct(F.xxhash64("key", F.col("n"), F.lit(-1)).alias("key"), F.lit(1).alias("side"))
    longer = F.struct(F.xxhash64("key", F.col("n") - 1, F.lit(-1)).alias("key"), F.lit(2).alias("side"))
    emitted = variants.select("h", F.inline(F.when(F.col("j") > 0, F.array(replaced, longer)).otherwise(F.array(shorter))))
    met = _with_partner(emitted).join(chosen.select(F.col("h").alias("fh"), "first"), F.col("h") == F.col("fh")).select("h", "first", "key", "side")
    earliest = [F.min(F.when(F.col("side") == side, F.struct("first", "h"))).alias(f"m{side}") for side in range(3)]
    least = met.groupBy("key").agg(*earliest).withColumnRenamed("key", "k")
    other = F.when(F.col("side") == 0, F.col("m0")).when(F.col("side") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = hot_join(met, least, [("key", "k")]).select("h", "first", other.alias("o")).where("o.first < first").select("h", F.col("o.h").alias("oh")).distinct()
    texts = chosen.select("h", "words")
    near = pairs.join(texts, "h").join(texts.toDF("oh", "owords"), "oh").where(within_one_edit(F.col("words"), F.col("owords")))
    near = stored(near.select(F.col("h").alias("nh")).distinct())
    dropped(variants, chosen)

    flagged = unique.join(near, unique.h == near.nh, "left").where("nh is not null or repeated").select(F.col("h").alias("rh"), "first", F.col("nh").isNotNull().alias("near"))
    out = hot_join(hashed.select("h", place.alias("place"), "id", "th", "line_no"), flagged, [("h", "rh")])
    out = stored(out.where("near or first < place").select("id", "th", "line_no", F.when(F.col("first") < F.col("place"), "exact").otherwise("near").alias("how")))
    dropped(hashed, unique, near)
    return out


def _without_lines(text: Column, lines: Column) -> Column:
    """The lines of a text but for those numbered in ``lines``, an ordered array: the stretches between these, so the work grows with the text alone."""

    def stretches(every: Column) -> Column:
        def stretch(j: Column) -> Column:
            before = F.when(j > 0, F.get(lines, j - 1)).otherwise(-1)
            after = F.when(j < F.size(lines), F.get(lines, j)).otherwise(F.size(every))
            return F.slice(every, before + 2, after - before - 1)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(lines)), stretch))

    # As a variable the split text is made once, not for each stretch.
    return F.element_at(F.transform(F.array(F.split(text, "\n")), stretches), 1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, exact_words: int = 1) -> DataFrame:
    """The documents with repeated lines taken out of ``text_col``, and ``n_lines_dropped``.

    Every input row and column comes out; null texts, empty texts and rows with null ids are
    unchanged. A document that only repeats others is left with an empty text. An input column
    named ``n_lines_dropped`` is replaced; no other name has a meaning.
    """
    repeats = repeated_lines(docs, id_col, text_col, min_words, exact_words)
    gone = durable(repeats.groupBy("id", "th").agg(F.array_sort(F.collect_set("line_no")).alias("lines")))
    dropped(repeats)
    joined = _matching(docs, gone, id_col, text_col, "left")
    text = F.col(f"row.`{text_col}`")
    kept = F.array_join(_without_lines(text, F.col("lines")), "\n")
    columns = [F.when(F.col("lines").isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "n_lines_dropped"]
    return joined.select(*columns, F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines_dropped"))
