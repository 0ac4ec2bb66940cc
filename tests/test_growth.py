"""Steps whose work must grow with their input, each held against the plain way on odd rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from attestry.functions import numbers as N
from attestry.functions import text as T
from attestry.operators import access as A
from attestry.operators import cells
from attestry.operators import corpus as C
from attestry.operators import lsh as L
from attestry.operators import metrics as M
from attestry.operators import retrieve as R
from attestry.operators import verify as V


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [7, cells.BLOCK])
def test_vectors_meet_in_cells_with_the_plain_cosines(spark, monkeypatch, block):
    rng, nan, inf = random.Random(3), float("nan"), float("inf")
    rows = [(f"k{i:03}", [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(rng.choice([3, 3, 3, 5]))], "mn"[i % 2]) for i in range(120)]
    rows += [(f"x{i}", x, "m") for i, x in enumerate([None, [], [0.0, 0.0, 0.0], [nan, 1.0, 1.0], [inf, 1.0, 0.0], [None, 1.0, 2.0], [1e-170] * 3, [1e200] * 3, [1.0]])]
    v = spark.createDataFrame(rows, "chunk_id string, embedding array<double>, model string").repartition(3)
    q = v.select(F.concat("chunk_id", F.lit("?")).alias("query_id"), "embedding", "model").filter("chunk_id LIKE '%5' OR chunk_id LIKE 'x%'")
    monkeypatch.setattr(R, "best_of_cells", lambda *a: cells.best_of_cells(*a, block=block))
    for k in (4, 200):
        pairs = q.select("query_id", F.col("embedding").alias("_q"), "model").join(v, "model").select("query_id", "chunk_id", N.cosine(F.col("_q"), F.col("embedding")).alias("score"))
        want = R.top(pairs, ["query_id"], [F.desc("score"), "chunk_id"], k)
        found = R.vector(q, v, k)
        assert "FlatMapCoGroupsInArrow" in plan(found)
        show = F.coalesce(F.col("score").cast("string"), F.lit("none"))
        got = {tuple(r) for r in found.select("query_id", "chunk_id", "rank", show).collect()}
        assert got == {tuple(r) for r in want.select("query_id", "chunk_id", "rank", show).collect()} and len(got) > 50
    assert R.vector(q.limit(0), v, 4).count() == 0 == R.vector(q, v.limit(0), 4).count()


def test_candidates_of_buckets_are_scored_in_their_cell(spark):
    rng = random.Random(4)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)], "m") for i in range(300)], "chunk_id long, embedding array<float>, model string")
    q = v.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", "model")
    found = L.vector_lsh(q, v, 5)
    assert "FlatMapCoGroupsInArrow" in plan(found) and "Generate explode(buckets" not in plan(found)
    assert L.recall(found, R.vector(q, v, 5)).first()["recall"] >= 0.9


def test_a_locator_meets_no_more_chunks_than_are_kept(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(30), rng.choice("56"), f"6.{rng.randrange(3)}", rng.choice([None, "6.1.4", "6.1", "6.2.4.1", "6"]), i % 3) for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id int, ordinal int, chapter string, section string, clause string, source_id int").repartition(3)
    asked = {1: ["6.1.4"], 2: ["6.1", "6.2.4"], 3: ["6.2", "6.1.4", "6.0"], 4: ["7.1"]}
    queries = spark.createDataFrame([(n, " and ".join(f"see section {x}" for x in own)) for n, own in asked.items()], "query_id int, text string")
    scope = spark.createDataFrame([(n, i) for n in asked for i in (0, 2) if n != 3 or i], "query_id int, source_id int")

    def weight(loc, chapter, section, clause):
        parts = (clause or "").split(".")
        return max([0, (clause == loc) * 1.0, (section == loc) * 0.8, (chapter == loc) * 0.6, *[0.4 for i in range(1, len(parts)) if ".".join(parts[:i]) == loc]])

    for k in (1, 7, 1000):
        for seen in (None, {n: {r["source_id"] for r in scope.filter(f"query_id = {n}").collect()} for n in asked}):
            want = set()
            for n, own in asked.items():
                hits = [(-max(weight(x, *r[2:5]) for x in own), r[1], r[0]) for r in rows if seen is None or r[5] in seen[n]]
                want |= {(n, c, -w, at) for at, (w, _, c) in enumerate(sorted(h for h in hits if h[0])[:k], 1)}
            found = R.locator(queries, chunks, k, scope=None if seen is None else scope)
            assert plan(found).count("WindowGroupLimit") > 2
            assert {(r["query_id"], r["chunk_id"], float(r["score"]), r["rank"]) for r in found.collect()} == want and want


def test_visible_pairs_come_out_once_without_a_shuffle_of_pairs(spark, monkeypatch):
    rng = random.Random(6)
    s = [(i, rng.randrange(3), rng.choice([None, *range(40)]), rng.choice(["workspace", "restricted", "restricted", None]), "2026-01-01" if i % 11 == 0 else None) for i in range(90)]
    u = [(i, i % 3, rng.choice(["admin", "member", "member", "member", None])) for i in range(40)] + [(4, 1, "member"), (5, 0, "owner")]
    g = [(rng.randrange(45), rng.choice([None, 0, 1, 2, 3])) for _ in range(70)]
    p = [(rng.randrange(95), rng.choice(["workspace", "users", "users", "group", "group", "group"]), rng.choice([0, 1, 2, 3]), rng.choice([None, *range(42)])) for _ in range(120)]
    want = set()
    for user, workspace, role in u:
        mine = {b for a, b in g if a == user and b is not None}
        for i, w, owner, access, gone in s:
            told = any(i == x and (how == "workspace" or (how == "users" and who == user) or (how == "group" and group in mine)) for x, how, group, who in p)
            if w == workspace and gone is None and (role in A.PRIVILEGED or owner == user or access == "workspace" or told):
                want.add((user, i))
    tables = [
        spark.createDataFrame(s, "source_id int, workspace_id int, owner_user_id int, access_scope string, deleted_at string"),
        spark.createDataFrame(p, "source_id int, scope string, group_id int, user_id int"),
        spark.createDataFrame(u, "user_id int, workspace_id int, role string"), spark.createDataFrame(g, "user_id int, group_id int"),
    ]
    for listed, most in ((A.LISTED, A.ROUND), (3, 20)):
        monkeypatch.setattr(A, "LISTED", listed)
        monkeypatch.setattr(A, "ROUND", most)
        found = A.visible_sources(*tables)
        assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
        got = [tuple(r) for r in found.collect()]
        assert sorted(got) == sorted(want) and len(want) > 100


def test_pieces_of_a_long_body_do_not_go_through_the_body_again(spark):
    rng = random.Random(7)
    sentences = [" ".join(rng.choice(["stair", "exit", "width", "landing"]) for _ in range(rng.choice([1, 3, 8, 30]))).capitalize() + "." for _ in range(200)]
    pages = spark.createDataFrame([(1, 1, "6.4 Stairs\n" + " ".join(sentences)), (2, 1, ""), (3, 1, "6.5 Bare"), (4, 1, None)], "version_id int, page_number int, text string")
    chunks = C.section_chunks(C.sections(pages), target=40, most=45, overlap=2)
    assert "body#" not in plan(chunks).split("Generate posexplode")[0]
    want, held, start, cost = [], [], 11, lambda x: -(-len(x) // 4)
    start = C.sections(pages).filter("version_id = 1").first()["char_start"]

    def flush():
        nonlocal held, start
        if held:
            want.append((" ".join(held), start))
            start += len(" ".join(held))
            held = held[-2:]

    for s in sentences:
        if cost(s) > 45:
            flush()
            want.append((s, start))
            start, held = start + len(s), []
        else:
            if held and sum(map(cost, held)) + cost(s) > 40:
                flush()
            held = [*held, s]
    flush()
    rows = chunks.orderBy("version_id", "ordinal").collect()
    assert [(r["content"], r["char_start"], r["char_end"]) for r in rows if r["version_id"] == 1] == [("Stairs\n" + x, at, at + len(x)) for x, at in want]
    assert [(r["version_id"], r["content"]) for r in rows if r["version_id"] > 1] == [(2, "Introduction"), (3, "Bare")] and len(want) > 20


def test_redaction_goes_through_a_text_once_for_each_pattern_that_may_match(spark):
    texts = [
        "key sk-abcdefghijklmnop and BEARER abcdefghijklmnopqrst=", "a.b-c@mail.example.org, 4111 1111 1111 1111", "eyJabcdefghijk.abcdefghijk.abcdefghijk",
        "sk-short, bearer of news, a@b, eyJ, 12 34", "", None, "x" * 1995 + " me@mail.example.org", "bİearer x",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = F.col("t")
    for pattern, mark, _ in T.REDACTIONS:
        plain = F.regexp_replace(plain, pattern, mark)
    plain = F.when(F.length(plain) > 2000, F.concat(F.substring(plain, 1, 2000), F.lit("...[truncated]"))).otherwise(plain)
    rows = df.select("i", T.redact(F.col("t")).alias("a"), plain.alias("b"))
    got = rows.orderBy("i").collect()
    assert all(r["a"] == r["b"] for r in got) and got[1]["a"] == "[email], [card]" and got[0]["a"] == "key sk-[redacted] and Bearer [redacted]"
    assert plan(df.select(T.redact(F.col("t")).alias("a"))).count("regexp_replace") == len(T.REDACTIONS)


def test_terms_are_counted_in_their_row_and_repeated_documents_apart(spark):
    rows = [(1, 1, "1:0", "Exit exit stair"), (1, 2, "1:1", "stair"), (2, 1, "2:0", "exit"), (2, 1, "2:0", "exit lobby"), (3, 1, "3:0", None), (4, 1, "4:0", "")]
    chunks = spark.createDataFrame(rows, "version_id int, ordinal int, chunk_id string, content string")
    got = {tuple(r) for r in M.term_counts(chunks, "chunk_id", "version_id").collect()}
    assert got == {("exit", 4, 2), ("stair", 2, 2), ("lobby", 1, 1)}
    once = M.term_counts(chunks.filter("version_id <> 2"), "chunk_id", "version_id")
    assert plan(once).count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in once.collect()} == {("exit", 2, 1), ("stair", 2, 2)}


def test_offsets_of_normalised_quotations_take_one_text_at_a_time(spark):
    pages = spark.createDataFrame([(1, 1, "The  exit\n stair ’s width"), (2, 1, None)], "version_id int, page_number int, text string")
    drafts = spark.createDataFrame([(1, 1, "the exit stair"), (1, 1, "exit\n stair"), (1, 1, "lobby"), (2, 1, "exit")], "version_id int, page_number int, excerpt string")
    told = V.verify_citations(drafts, pages)
    assert {(r["excerpt"], r["method"], r["char_start"], r["matched_text"]) for r in told.collect()} == {
        ("the exit stair", "normalized", 0, "The  exit\n stair"), ("exit\n stair", "exact", 5, "exit\n stair"), ("lobby", "failed", None, None), ("exit", "failed", None, None),
    }
