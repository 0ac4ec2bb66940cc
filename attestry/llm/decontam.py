"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask looks at some of the words from a place on and ignores the others, so a substituted word in
an ignored place does not disturb the hash. Hashes of test items and training texts under the same
masks are joined; around each hit the item is laid over the text word by word, and the share of
equal words decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import Scratch, let, small_enough

#: Five words each. Where every fifth word is replaced, the second mask still hits.
MASKS = ("11111", "111101", "1101011")
WEIGHT, SIMILARITY, DRIFT = 5, 0.8, 8


def word_hashes(text: str) -> Column:
    """Hashes of the lower-cased runs of letters and digits, in order."""
    words = F.split(F.lower(F.col(text).cast("string")), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(x: str, i: Column) -> Column:
    """The hashes under all masks from word i on; a mask that leads past the end is null."""

    def one(number: int, mask: str) -> Column:
        at = [F.get(F.col(x), i + j) for j, bit in enumerate(mask) if bit == "1"]
        return F.when(at[-1].isNotNull(), F.xxhash64(F.lit(number), *at))

    return F.array(*[one(n, m) for n, m in enumerate(MASKS)])


def runs_of(x: str, i: Column, n: int) -> Column:
    """The hash of the n words from word i on, null past the end; for items of so few words."""
    at = [F.get(F.col(x), i + j) for j in range(n)]
    return F.when(at[-1].isNotNull(), F.xxhash64(F.lit(-n), *at))


def seed_table(table: DataFrame, names: list[str], short: list[int]) -> DataFrame:
    """A row for each place i and mask of the hash array x, and for runs of the lengths in short."""
    # the outer form, and places past the end, keep the optimiser from hashing the text once more in a filter
    places = table.select(*names, "x", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("x") - 1, F.lit(0)))).alias("i"))
    keys = F.concat(seeds("x", F.col("i")), F.array(*[runs_of("x", F.col("i"), n) for n in short])) if short else seeds("x", F.col("i"))
    return places.select(*names, "i", F.explode(keys).alias("seed"))


def overlaid(x: str, y: str, shifts: str) -> Column:
    """(start, matched): the best shift of y over x, and how many words of y stand in place there or within DRIFT."""
    places = F.sequence(F.lit(0), F.size(y) - 1)

    def own(s: Column) -> Column:
        equal = F.filter(places, lambda j: F.get(F.col(x), j + s) == F.get(F.col(y), j))
        return F.struct(F.size(equal).alias("own"), (-s).alias("back"))

    def around(best: Column) -> Column:
        return let(F.filter(shifts, lambda s: F.abs(s - best) <= DRIFT), lambda near: F.struct(
            best.alias("start"),
            F.size(F.filter(places, lambda j: F.exists(near, lambda s: F.get(F.col(x), j + s) == F.get(F.col(y), j)))).alias("matched"),
        ))

    return let(-F.array_max(F.transform(shifts, own))["back"], around)


def matches(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, similarity: float) -> DataFrame:
    """(k, h, item, start, matched, n) of contaminated rows; h, the hash of the text, tells rows of one key apart."""
    scratch = Scratch(docs.sparkSession)
    items = benchmark.select(F.col(item).alias("item"), word_hashes("text").alias("x")).filter(F.col("item").isNotNull() & (F.size("x") > 0))
    items = scratch.save(items.distinct(), "items")
    n_items, n_words, lengths = items.agg(F.count(F.lit(1)), F.sum(F.size("x")), F.collect_set(F.when(F.size("x") < WEIGHT, F.size("x")))).first()
    short = sorted(lengths)  # at most WEIGHT - 1 numbers
    # an item's seed stands for its first place: a place where the item repeats itself adds nothing
    wanted = seed_table(items.filter(F.size("x") >= WEIGHT), ["item"], [])
    if short:
        whole = F.coalesce(*[F.when(F.size("x") == n, runs_of("x", F.lit(0), n)) for n in short])
        wanted = wanted.unionByName(items.filter(F.size("x") < WEIGHT).select("item", F.lit(0).alias("i"), whole.alias("seed")))
    wanted = wanted.filter("seed IS NOT NULL").groupBy("item", "seed").agg(F.min("i").alias("j"))
    wanted = scratch.save(wanted, "seeds")

    texts = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text)).filter("k IS NOT NULL")
    hashed = texts.select("k", "h", word_hashes(text).alias("x"))
    seed_bytes = 40 * len(MASKS) * (n_words or 0)
    hits = seed_table(hashed, ["k", "h"], short).join(small_enough(wanted, seed_bytes), "seed")
    shift = (F.col("i") - F.col("j")).alias("shift")
    # a list of shifts is no longer than the text that it belongs to
    found = hits.groupBy("k", "h", "item", shift).agg(F.lit(1)).groupBy("k", "h", "item").agg(F.collect_set("shift").alias("shifts"))
    found = scratch.save(found, "hits")
    hit_texts = found.select("k", "h").distinct()
    hit_texts = texts.join(small_enough(hit_texts, 48 * hit_texts.count()), ["k", "h"], "left_semi").dropDuplicates(["k", "h"])
    # written, so that no expression below hashes a text again
    hit_texts = scratch.save(hit_texts.select("k", "h", word_hashes(text).alias("x")), "texts")

    laid = found.join(small_enough(items.withColumnRenamed("x", "y"), 16 * (n_items or 0) + 8 * (n_words or 0)), "item").join(hit_texts, ["k", "h"])
    told = laid.select("k", "h", "item", F.size("y").alias("n"), overlaid("x", "y", "shifts").alias("o"))
    told = told.select("k", "h", "item", "n", F.col("o.start").alias("start"), F.col("o.matched").alias("matched"))
    least = F.when(F.col("n") < WEIGHT, F.col("n")).otherwise(F.lit(similarity) * F.col("n"))
    return told.filter(F.col("matched") >= least)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """One row per contaminated document and item: key, item, start_word, matched_words, item_words, similarity.

    similarity is the share of the item's words that stand in the document in place, on the best
    alignment and those within DRIFT words of it (so that a few inserted or lost words do not
    matter); rows have at least ``similarity``. Words are lower-cased runs of letters and digits.
    An item of fewer than five words matches where all of them stand in a row. Null and empty texts
    match nothing; so do rows with a null key. Rows with equal keys are told apart by their texts;
    identical ones are reported once. Repeated items are each reported. Other columns are not read.
    """
    return matches(docs, benchmark, key, text, item, similarity).select(
        F.col("k").alias(key), F.col("item").alias(item), F.col("start").cast("long").alias("start_word"),
        F.col("matched").cast("long").alias("matched_words"), F.col("n").cast("long").alias("item_words"),
        (F.col("matched") / F.col("n")).alias("similarity"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """The rows of docs that are in no contaminated() row, all columns as they were; rows with a null key stay."""
    leaks = matches(docs, benchmark, key, text, item, similarity).select(F.col("k").alias("_k"), F.col("h").alias("_h")).distinct()
    leaks = Scratch(docs.sparkSession).save(leaks, "leaks")
    leaks = small_enough(leaks, 48 * leaks.count())
    return docs.join(leaks, (docs[key] == leaks["_k"]) & (F.xxhash64(docs[text]) == leaks["_h"]), "left_anti").select(docs.columns)
