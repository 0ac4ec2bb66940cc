"""Batch retrieval: postings, three channels, fusion, reranking, duplicate removal, diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import numbers as N
from attestry.functions import text as T
from attestry.operators.cells import best_of_cells

# Fusion constant and weights, reranking weights, duplicate threshold.
RRF_K, WEIGHTS = 60, {"lexical": 1.0, "vector": 1.0, "locator": 2.0}
RERANK = {
    "retrieval": 0.24, "coverage": 0.18, "overlap": 0.10, "proximity": 0.08, "phrase": 0.09, "locator": 0.11,
    "agreement": 0.05, "structural": 0.06, "recency": 0.03, "length": 0.03, "requirement": 0.03,
}
DUPLICATE = 0.82


def index_terms(text: Column) -> Column:
    """Stemmed terms in order; null where a word is left out, so that places stay."""
    found = F.regexp_extract_all(F.lower(T.fold(text)), F.lit(r"[a-z0-9]+(?:\.[a-z0-9]+)*"), F.lit(0))
    return F.transform(found, lambda t: F.when((F.length(t) > 1) & ~t.isin(T.QUERY_STOPWORDS), T.stem(t)))


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(term, key, tf, positions); write it bucketed by term.

    The words of a row are counted in the row. Only rows whose key stands more than once meet in a
    shuffle; which keys these are is told by the keys alone.
    """
    many = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    twice = not many.isEmpty()

    def counted(terms: Column) -> Column:
        placed = F.filter(F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("at"))), lambda x: x["term"].isNotNull())

        def runs(sorted_: Column) -> Column:
            n = F.size(sorted_)
            first = F.filter(
                F.transform(sorted_, lambda x, i: F.when((i == 0) | (F.get(sorted_, i - 1)["term"] != x["term"]), i)), lambda i: i.isNotNull()
            )
            own = T.let(first, lambda at: F.transform(at, lambda p, j: F.slice(sorted_, p + 1, F.coalesce(F.get(at, j + 1), n) - p)))
            return F.transform(own, lambda xs: F.struct(F.get(xs, F.lit(0))["term"].alias("term"), F.size(xs).cast("long").alias("tf"), xs["at"].alias("positions")))

        return T.let(F.array_sort(placed), runs)

    def in_rows(rows: DataFrame) -> DataFrame:
        return rows.select(key, F.explode(counted(index_terms(F.col(text)))).alias("x")).select("x.term", key, "x.tf", "x.positions")

    if not twice:
        return in_rows(chunks)
    once = in_rows(chunks.join(many, key, "left_anti"))
    again = in_rows(chunks.join(many, key, "left_semi")).groupBy("term", key).agg(
        F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")
    )
    return once.unionByName(again)


def top(rows: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their 1-based rank; the limit reaches below the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def lexical(queries: DataFrame, index: DataFrame, k: int = 40, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, matched_all, score, rank): any term admits, all terms rank first, then density s / (s + 1).

    s is the number of occurrences of the query's terms, a phrase counting once for each place where
    its words stand in a row. Scores are scaled by the best of the k kept.
    """
    asked = queries.select("query_id", T.query_terms(F.col("text")).alias("terms"), T.query_phrases(F.col("text")).alias("phrases"))
    wanted = asked.withColumn("n", F.size("terms") + F.size("phrases"))
    every = F.concat("terms", F.flatten(F.transform("phrases", lambda p: F.split(p, " "))))
    stems = wanted.select(F.explode(every).alias("raw")).select(T.stem(F.col("raw")).alias("term")).distinct()
    # only the asked terms leave the tokens of the corpus, once for terms and phrases alike
    index = index.join(small(stems), "term", "left_semi")
    single = wanted.select("query_id", "n", F.explode("terms").alias("raw")).select("query_id", "n", "raw", T.stem(F.col("raw")).alias("term"))
    hits = single.join(index, "term").select("query_id", "n", key, F.col("raw").alias("part"), "tf")
    words = wanted.select("query_id", "n", F.explode("phrases").alias("part")).select(
        "query_id", "n", "part", F.size(F.split("part", " ")).alias("len"), F.posexplode(F.split("part", " ")).alias("off", "raw")
    )
    placed = words.withColumn("term", T.stem(F.col("raw"))).join(index, "term").select(
        "query_id", "n", key, "part", "len", "off", F.explode("positions").alias("at")
    )
    rows = placed.groupBy("query_id", "n", key, "part", "len", (F.col("at") - F.col("off")).alias("start")).agg(F.countDistinct("off").alias("got"))
    phrases = rows.filter("got = len").groupBy("query_id", "n", key, "part").agg(F.count(F.lit(1)).alias("tf"))
    every = hits.unionByName(phrases)
    scored = every.groupBy("query_id", key).agg(F.sum("tf").alias("s"), (F.countDistinct("part") == F.max("n")).alias("matched_all"))
    scored = scored.withColumn("raw", F.col("s") / (F.col("s") + 1))
    kept = top(scored, ["query_id"], [F.desc("matched_all"), F.desc("raw"), key], k)
    best = F.max("raw").over(Window.partitionBy("query_id"))
    return kept.select("query_id", key, "matched_all", N.clamp(F.col("raw") / best).alias("score"), "rank")


BROADCAST_ROWS = 10_000  # of queries or terms; more queries are met in blocks, more terms by a shuffle


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def vector(queries: DataFrame, vectors: DataFrame, k: int = 40, key: str = "chunk_id", scope: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank) by exact cosine; blocks of queries meet blocks of vectors in cells.

    Both tables have an embedding; a join column ``model`` in both keeps models apart. All pairs are
    compared, but a task holds one cell and gives the k best of each query of it (cells.py).
    With ``scope`` (query_id, source_id) only vectors of a query's sources count (column source_id).
    """
    if scope is None:
        return top(best_of_cells(queries, vectors, k, key), ["query_id"], [F.desc("score"), key], k)
    q = queries.select("query_id", F.col("embedding").alias("_q"), "model")
    blocks, out = -(-q.count() // BROADCAST_ROWS) or 1, None
    for n in range(blocks):
        block = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)
        met = vectors.join(F.broadcast(block), "model").join(scope.select("query_id", "source_id"), ["query_id", "source_id"], "left_semi")
        scored = met.select("query_id", key, N.cosine(F.col("_q"), F.col("embedding")).alias("score"))
        own = top(scored, ["query_id"], [F.desc("score"), key], k)
        out = own if out is None else out.unionByName(own)
    return out


def locator(queries: DataFrame, chunks: DataFrame, k: int = 40, key: str = "chunk_id", most: int = 8, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank): clause 1.0, section 0.8, chapter 0.6, a sub-clause 0.4.

    Prefixes are met by an equi-join on every prefix of the chunk's own clause number. ``scope``: as in vector().
    A chunk has one row; a query meets at most k chunks of each locator and weight (and source, with a scope).
    """
    wanted = queries.select("query_id", F.explode(F.slice(T.retrievable_locators(F.col("text")), 1, most)).alias("loc"))
    parts = F.split("clause", r"\.")
    prefixes = F.when(
        F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    )
    offered = F.concat(
        F.array(F.struct(F.col("clause").alias("loc"), F.lit(1.0).alias("w")), F.struct(F.col("section").alias("loc"), F.lit(0.8).alias("w")),
                F.struct(F.col("chapter").alias("loc"), F.lit(0.6).alias("w"))),
        F.coalesce(F.transform(prefixes, lambda p: F.struct(p.alias("loc"), F.lit(0.4).alias("w"))), F.array().cast("array<struct<loc:string,w:double>>")),
    )
    own = [] if scope is None else ["source_id"]
    keys = chunks.select(key, "ordinal", *own, F.explode(offered).alias("o")).select(key, "ordinal", *own, "o.loc", "o.w").filter("loc IS NOT NULL")
    keys = keys.join(small(wanted.select("loc").distinct()), "loc", "left_semi")  # only named locators leave their task
    # of one locator and weight only the first k can be among a query's first k, in each source that it may see
    keys = top(keys, ["loc", "w", *own], ["ordinal", key], k).drop("rank")
    met = wanted.join(keys, "loc")
    met = met if scope is None else met.join(scope.select("query_id", "source_id"), ["query_id", "source_id"], "left_semi")
    hits = met.groupBy("query_id", key, "ordinal").agg(F.max("w").alias("score"))
    return top(hits, ["query_id"], [F.desc("score"), "ordinal", key], k)


def fuse(channels: dict[str, DataFrame], key: str = "chunk_id") -> DataFrame:
    """(query_id, key, fused, best, channels, lexical_rank, vector_rank, locator_rank) by reciprocal rank."""
    rows = None
    for name, hits in channels.items():
        own = hits.select("query_id", key, "rank", "score", F.lit(name).alias("channel"), F.lit(WEIGHTS[name]).alias("w"))
        rows = own if rows is None else rows.unionByName(own)
    ranks = [F.max(F.when(F.col("channel") == c, F.col("rank"))).alias(f"{c}_rank") for c in WEIGHTS]
    return rows.groupBy("query_id", key).agg(
        F.sum(F.col("w") / (RRF_K + F.col("rank"))).alias("fused"), F.max("score").alias("best"),
        F.array_sort(F.collect_set("channel")).alias("channels"), *ranks,
    )


def rerank(fused: DataFrame, as_of: Column, prefer_requirements: bool = False, key: str = "chunk_id") -> DataFrame:
    """Adds ``rerank``: eleven signals weighed, in 0..1.

    Rows carry query_text, content, chapter, section, clause, kind and effective_date besides the
    fused columns.
    """
    q = F.transform(T.content_tokens(F.col("query_text")), T.stem)
    c = F.transform(T.content_tokens(F.col("content")), T.stem)
    rows = fused.withColumns({"_q": q, "_c": c, "_nq": T.normal_match(F.col("query_text")), "_nc": T.normal_match(F.col("content"))})
    rows = rows.withColumn("_loc", T.locators(F.col("query_text")))
    covered = F.size(F.filter("_q", lambda t: F.array_contains(F.col("_c"), t)))
    names_it = F.exists(
        "_loc",
        lambda x: F.coalesce(F.col("clause") == x, F.lit(False)) | F.coalesce(F.col("section") == x, F.lit(False))
        | F.coalesce(F.col("chapter") == x, F.lit(False)) | F.contains(F.col("_nc"), F.lower(x)),
    )
    signals = {
        "retrieval": F.coalesce(F.col("fused") / F.nullif(F.max("fused").over(Window.partitionBy("query_id")), F.lit(0.0)), F.lit(0.0)),
        "coverage": F.when(F.size("_q") == 0, 0.0).otherwise(covered / F.greatest(F.size("_q"), F.lit(1))),
        "overlap": T.jaccard(F.array_distinct("_q"), F.array_distinct("_c")),
        "proximity": N.proximity(F.col("_c"), F.col("_q")),
        "phrase": ((F.length("_nq") > 12) & F.contains(F.col("_nc"), F.col("_nq"))).cast("double"),
        "locator": names_it.cast("double"),
        "agreement": (F.size("channels") > 1).cast("double"),
        "structural": F.when(F.col("clause").isNotNull(), 1.0).when(F.col("kind") == "table", 0.8).when(F.col("section").isNotNull(), 0.6).otherwise(0.3),
        "recency": N.recency(F.col("effective_date"), as_of, 10),
        "length": N.length_fit(F.length("content")),
        "requirement": F.col("content").rlike(T.words("shall|must")).cast("double") if prefer_requirements else F.lit(0.0),
    }
    total = sum((signals[name] * weight for name, weight in RERANK.items()), F.lit(0.0))
    return rows.withColumn("rerank", N.clamp(total)).drop("_q", "_c", "_nq", "_nc", "_loc")


def drop_near_duplicates(ranked: DataFrame, threshold: float = DUPLICATE, key: str = "chunk_id") -> DataFrame:
    """Best first, drops a passage of a kept one's (version, clause), or close to a kept one by Jaccard.

    A query has at most the channels' limits of candidates, so its list is bounded and folds in one
    array. Order is rerank descending, then key.
    """
    item = F.struct(
        (-F.col("rerank")).alias("o"), F.col(key).alias("id"), F.col("version_id").alias("v"), F.col("clause").alias("c"),
        F.array_distinct(T.stems(F.col("content"))).alias("w"),
    )
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = listed.schema["items"].dataType.simpleString()

    def fold(kept: Column, x: Column) -> Column:
        same = F.exists(
            kept, lambda k: F.coalesce((k["v"] == x["v"]) & (k["c"] == x["c"]), F.lit(False)) | (T.jaccard(k["w"], x["w"]) >= threshold)
        )
        return F.when(same, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("items", F.array().cast(kind), fold)
    ids = listed.select("query_id", F.explode(kept).alias("k")).select("query_id", F.col("k.id").alias(key))
    return ranked.join(ids, ["query_id", key], "left_semi")


def diversify(ranked: DataFrame, limit: int = 12, per_source: int = 4, per_page: int | None = None, key: str = "chunk_id") -> DataFrame:
    """At most so many of a source and of a page, then filled up from the overflow in order; adds ``picked``."""
    order = [F.desc("rerank"), key]
    rows = ranked.withColumn("_order", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    page = Window.partitionBy("query_id", "source_id", "page_number").orderBy("_order")
    rows = rows.withColumn("_page_ok", F.row_number().over(page) <= per_page if per_page else F.lit(True))
    source = Window.partitionBy("query_id", "source_id", "_page_ok").orderBy("_order")
    rows = rows.withColumn("_over", ~(F.col("_page_ok") & (F.row_number().over(source) <= per_source)))
    return top(rows, ["query_id"], ["_over", "_order"], limit, "picked").drop("_order", "_page_ok", "_over")


def expand_query(queries: DataFrame, scope: DataFrame) -> DataFrame:
    """Queries with locators spelled out; a query of at most two longer words gets up to four titles of its scope."""
    titles = top(scope, ["query_id"], ["title", "source_id"], 4, "_t").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("_t", "title"))).alias("titles")
    )
    found = T.locators(F.col("text"))
    spelled = F.array_join(F.transform(found, lambda x: F.concat(F.lit("clause "), x, F.lit(" section "), x)), " ")
    few = F.size(F.filter(F.split(T.normal_match(F.col("text")), " "), lambda w: F.length(w) > 3)) <= 2
    more = F.when(few, F.array_join("titles.title", " "))
    text = F.substring(T.normal_space(F.concat_ws(" ", "text", spelled, more)), 1, 1200)
    columns = [text.alias("text") if c == "text" else F.col(c) for c in queries.columns]
    return queries.join(titles, "query_id", "left").select(*columns)


def model_mismatch(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, mismatch): no vector of the query's model, but some of another."""
    models = vectors.select("model").distinct().withColumn("has", F.lit(True))
    some = F.broadcast(models.agg((F.count(F.lit(1)) > 0).alias("some")))  # one row
    return queries.join(models, "model", "left").join(some, F.lit(True)).select("query_id", (F.col("has").isNull() & F.col("some")).alias("mismatch"))


# What a summary of each format asks for, and its number of sentences.
FOCUS = {
    "obligations": "obligations requirements shall must required prohibited",
    "risks": "risk hazard liability penalty non-compliance failure exposure",
}
SENTENCES = {"executive": 6, "other": 12}


def focus_query(format_: Column, instruction: Column, titles: Column) -> Column:
    """What to retrieve for a summary: the format's words, a custom instruction, else the titles of the scope."""
    fixed = F.coalesce(*[F.when(format_ == name, F.lit(words)) for name, words in FOCUS.items()])
    custom = F.when((format_ == "custom") & (instruction != ""), instruction)
    return F.coalesce(fixed, custom, F.array_join(titles, " "))


def summary_sentences(format_: Column) -> Column:
    return F.when(format_ == "executive", SENTENCES["executive"]).otherwise(SENTENCES["other"])


def ranked_metrics(gold: DataFrame, ranked: DataFrame, k: int = 5, key: str = "chunk_id") -> DataFrame:
    """One row: queries, recall at 1, 5 and k, mean reciprocal rank, binary nDCG at k."""
    first = gold.join(ranked, ["query_id", key], "left").groupBy("query_id").agg(F.min("rank").alias("r"))
    hit = F.col("r") <= k
    return first.agg(
        F.count(F.lit(1)).alias("queries"),
        *[F.avg(F.when(F.col("r") <= n, 1.0).otherwise(0.0)).alias(f"recall_{n}") for n in sorted({1, 5, k})],
        F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"),
        F.avg(F.when(hit, 1 / F.log2(F.col("r") + 1)).otherwise(0.0)).alias(f"ndcg_{k}"),
    )
