"""Line dedup by winnowing over line hashes, in DataFrame operations only.

The smallest line hash of every window of WINDOW lines is a fingerprint: equal windows have equal
minima in the same place, so every repeated run of at least WINDOW lines shares one. Only fingerprints
that occur more than once are followed up: from their position the match is extended to the lines
before and after, and joined to the first position whose surroundings agree. Matches that meet form
a run, and later runs are deleted. A line of at least ``alone`` words, where that is set, is a
window of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import Scratch, let, salted, small_enough

WINDOW = 3
#: Words from which a single line counts as a passage in the pipeline; the op3 query has windows alone.
ALONE = 50


def line_table(docs: DataFrame, key: str, text: str, window: int, alone: int | None) -> DataFrame:
    """(k, h, x, y, long): two independent hashes of each line, the lowest bit of x telling a blank one.

    Fingerprints are taken from x; that surroundings agree is told by x and y, 127 bits a line.
    """
    lines = docs.select(
        F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.split(F.col(text).cast("string"), "\n").alias("lines")
    ).filter(F.size("lines") >= (window if alone is None else 1))
    blank = F.transform("lines", lambda s: F.shiftleft(F.shiftright(F.xxhash64(s), 1), 1).bitwiseOR((F.trim(s) == "").cast("long")))
    wide = F.transform("lines", lambda s: F.size(F.regexp_extract_all(s, F.lit(r"\S+"), F.lit(0))) >= alone) if alone else F.lit(None).cast("array<boolean>")
    return lines.select("k", "h", blank.alias("x"), F.transform("lines", lambda s: F.xxhash64(F.lit(window), s)).alias("y"), wide.alias("long"))


def fingerprint_table(lines: DataFrame, window: int) -> DataFrame:
    """(k, h, at, least, lo, x, y): the positions that hold the minimum of a window, with the lines around from lo on."""

    def leftmost(i: Column) -> Column:
        return let(F.slice("x", i + 1, window), lambda part: i + F.array_position(part, F.array_min(part)).cast("int") - 1)

    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("x") - window), leftmost))
    placed = lines.filter(F.size("x") >= window).select("k", "h", "x", "y", F.explode(at).alias("at"))
    lo = F.greatest(F.col("at") - window + 1, F.lit(0))
    n = F.col("at") + window - lo
    return placed.select("k", "h", "at", F.get("x", F.col("at")).alias("least"), lo.alias("lo"), F.slice("x", lo + 1, n).alias("x"), F.slice("y", lo + 1, n).alias("y"))


def extended(positions: DataFrame, window: int) -> DataFrame:
    """(k, h, i, w, p, q): each window around a position whose leftmost minimum it is, p and q naming its lines."""

    def one(back: int) -> Column:
        first = F.col("at") - back - F.col("lo")  # of the window, within the lines around
        part = F.slice("x", F.greatest(first, F.lit(0)) + 1, window)
        whole = (first >= 0) & (F.size(part) == window)
        own = (F.array_min(part) == F.col("least")) & (F.array_position(part, F.col("least")) == back + 1)
        blank = F.forall(part, lambda v: v.bitwiseAND(F.lit(1)) == 1)
        told = F.struct(
            (F.col("at") - back).alias("i"), F.lit(window).alias("w"), F.xxhash64(part).alias("p"),
            F.xxhash64(F.slice("y", F.greatest(first, F.lit(0)) + 1, window)).alias("q"),
        )
        return F.when(whole & own & ~blank, told)

    found = F.filter(F.array(*[one(back) for back in range(window)]), lambda m: m.isNotNull())
    return positions.select("k", "h", F.inline(found))


def long_lines(lines: DataFrame) -> DataFrame:
    """The long lines that are not blank, as windows of one line."""
    rows = lines.select("k", "h", F.posexplode(F.arrays_zip("x", "y", "long")).alias("i", "z"))
    good = F.col("z.long") & (F.col("z.x").bitwiseAND(F.lit(1)) == 0)
    return rows.filter(good).select("k", "h", "i", F.lit(1).alias("w"), F.col("z.x").alias("p"), F.col("z.y").alias("q"))


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, alone: int | None = None) -> DataFrame:
    """(k, h, first_line, last_line): the later repeated runs of at least ``window`` lines, lines from 0.

    With ``alone``, a run may also be one line of at least so many words.

    h is the hash of the text, which tells rows with equal keys apart. Groups of equal fingerprints
    or windows are aggregated before they are shuffled and met again in parts, so that no task meets
    a whole one.
    """
    scratch = Scratch(docs.sparkSession)
    lines = scratch.save(line_table(docs, key, text, window, alone), "lines")
    positions = scratch.save(fingerprint_table(lines, window), "positions")
    shared = positions.groupBy("least").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("least")
    windows = extended(salted(positions, shared, ["least"], F.xxhash64("k", "h", "at")), window)
    if alone is not None:
        windows = windows.unionByName(long_lines(lines))
    windows = scratch.save(windows, "windows")
    place = F.struct("k", "h", "i")
    first = windows.groupBy("w", "p", "q").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    matched = salted(windows, first.select("w", "p", "q", "first"), ["w", "p", "q"], F.xxhash64("k", "h", "i")).filter(place > F.col("first"))
    # a window that overlaps its own first occurrence is not a later one
    own = F.col("k").eqNullSafe(F.col("first.k")) & (F.col("h") == F.col("first.h")) & (F.col("i") < F.col("first.i") + F.col("w"))
    later = matched.filter(~own).groupBy("k", "h", "i").agg(F.max(F.col("i") + F.col("w")).alias("stop"))
    in_order = Window.partitionBy("k", "h").orderBy("i")
    reached = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opened = later.withColumn("open", F.when(F.col("i") <= reached, 0).otherwise(1))
    numbered = opened.withColumn("run", F.sum("open").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("k", "h", "run").agg(
        F.min("i").alias("first_line"), (F.max("stop") - 1).alias("last_line")
    ).drop("run")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, alone: int | None = None) -> DataFrame:
    """All rows and columns of docs, the later repeated runs taken out of the text, plus n_lines and n_deleted.

    Lines are split at line feeds. Of a run of at least ``window`` lines that occurs more than once,
    the occurrence with the smallest key (then place) stays; every line that lies in a window with
    an earlier occurrence goes. With ``alone``, so does every later line of at least so many words,
    in texts of any number of lines. Windows of blank lines are no match. A text whose lines all go
    becomes empty; a null text stays null, with no lines. Identical rows count as one document and
    are treated alike. Columns n_lines and n_deleted of the input, if any, are replaced.
    """
    runs = repeated_runs(docs, key, text, window, alone)
    run = F.struct(F.col("first_line").alias("a"), F.col("last_line").alias("b"))
    cut = runs.groupBy(F.col("k").alias("_k"), F.col("h").alias("_h")).agg(F.array_sort(F.collect_list(run)).alias("_runs"))
    cut = Scratch(docs.sparkSession).save(cut, "cut")
    rows_, runs_ = cut.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_runs")), F.lit(0))).first()
    # the row as one column, so that no name of the input can meet one of ours
    rows = docs.select(F.struct(*docs.columns).alias("d"))
    own = F.col("d")[text]
    joined = rows.join(small_enough(cut, 64 * rows_ + 16 * runs_), (F.xxhash64(own) == F.col("_h")) & F.col("d")[key].eqNullSafe(F.col("_k")), "left")

    def kept_of(lines: Column) -> Column:
        """What stands between the runs, then what follows the last one."""

        def before(r: Column, i: Column) -> Column:
            start = F.when(i == 0, 0).otherwise(F.get("_runs", i - 1)["b"] + 1)
            return F.slice(lines, start + 1, r["a"] - start)

        tail = F.slice(lines, F.get("_runs", F.size("_runs") - 1)["b"] + 2, F.size(lines))
        return F.array_join(F.concat(F.flatten(F.transform("_runs", before)), tail), "\n")

    split = F.split(own.cast("string"), "\n")
    deleted = F.aggregate("_runs", F.lit(0), lambda n, r: n + r["b"] - r["a"] + 1)
    kept = [F.when(F.col("_h").isNull(), own).otherwise(let(split, kept_of)).alias(c) if c == text else F.col("d")[c].alias(c)
            for c in docs.columns if c not in ("n_lines", "n_deleted")]
    return joined.select(
        *kept, F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(deleted, F.lit(0)).cast("long").alias("n_deleted"),
    )


ORACLE_SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS ln,
         unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents
), win AS (
  SELECT doc_id, i, ln,
         ln || chr(10) || lead(ln, 1) OVER w || chr(10) || lead(ln, 2) OVER w AS whole
  FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), placed AS (
  SELECT doc_id, i, first_value(doc_id) OVER f AS fd, first_value(i) OVER f AS fi
  FROM win WHERE whole IS NOT NULL AND trim(replace(whole, chr(10), '')) <> ''
  WINDOW f AS (PARTITION BY whole ORDER BY doc_id, i)
), gone AS (
  SELECT DISTINCT doc_id, i + d AS i
  FROM placed, (SELECT unnest([0, 1, 2]) AS d)
  WHERE doc_id > fd OR (doc_id = fd AND i >= fi + 3)
), kept AS (
  SELECT line.doc_id, count(*) AS n_lines, count(gone.i) AS n_deleted,
         coalesce(string_agg(ln, chr(10) ORDER BY line.i) FILTER (WHERE gone.i IS NULL), '') AS text
  FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.i = gone.i
  GROUP BY line.doc_id
)
SELECT doc_id, text, n_lines, n_deleted FROM kept
"""
