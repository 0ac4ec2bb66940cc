"""Ways that avoid large intermediate tables, against the plain ways."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from attestry.functions import numbers as N
from attestry.operators import access as A
from attestry.operators import compliance as C
from attestry.operators import lsh as L
from attestry.operators import metrics as M
from attestry.operators import retrieve as R
from attestry.operators import verify as V


def test_visibility_by_classes_equals_the_listing(spark):
    rng = random.Random(2)
    users = spark.createDataFrame([(u, u % 3, "owner" if u % 17 == 0 else "member") for u in range(60)], "user_id long, workspace_id long, role string")
    groups = spark.createDataFrame([(rng.randrange(60), rng.randrange(6)) for _ in range(90)] + [(3, 1), (3, 1)], "user_id long, group_id long")
    sources = spark.createDataFrame(
        [(s * 70_001, s % 3, rng.randrange(60), rng.choice(["workspace", "restricted", "restricted"]), dt.datetime(2024, 1, 1) if s % 11 == 0 else None) for s in range(120)],
        "source_id long, workspace_id long, owner_user_id long, access_scope string, deleted_at timestamp",
    )
    grants = []
    for s in range(120):
        for _ in range(rng.randrange(4)):
            scope = rng.choice(["workspace", "users", "group", "group"])
            grants.append((s * 70_001, scope, rng.randrange(6) if scope == "group" else None, rng.randrange(60) if scope == "users" else None))
    permissions = spark.createDataFrame(grants, "source_id long, scope string, group_id long, user_id long")
    listed = A.visible_sources(sources, permissions, users, groups)
    want = {tuple(r) for r in listed.groupBy("user_id").count().collect()}
    assert {tuple(r) for r in A.visible_counts(sources, permissions, users, groups).collect()} == want
    asked = spark.createDataFrame([(u, s * 70_001) for u in range(0, 66, 2) for s in range(0, 125, 3)] * 2, "user_id long, source_id long")
    some = {tuple(r) for r in A.visible_among(asked, sources, permissions, users, groups).collect()}
    assert some == {tuple(r) for r in listed.join(asked.distinct(), ["user_id", "source_id"]).select("user_id", "source_id").collect()}


def test_queue_alerts_over_hours(spark):
    rng, start = random.Random(3), dt.datetime(2024, 1, 1)
    rows, want = [], set()
    for q in ("a", "b"):
        at, depth, over, events = start, 0, None, {}
        for _ in range(1500):
            at += dt.timedelta(seconds=rng.choice([0, 20, 200, 200, 9000 if rng.random() < 0.02 else 60]))
            d = rng.choice([1, 1, -1] if depth < 20 else [1, -1, -1])
            events[at] = events.get(at, 0) + d
            depth += d
            rows.append((q, at, d))
        depth = 0
        for at in sorted(events):
            depth += events[at]
            if depth > 20 and over is None:
                over = at
            elif depth <= 20 and over is not None:
                want |= {(q, over, at)} if at - over >= dt.timedelta(minutes=10) else set()
                over = None
        if over is not None and at - over >= dt.timedelta(minutes=10):
            want.add((q, over, at))
    changes = spark.createDataFrame(rows + [("a", None, 1)], "queue string, ts timestamp, delta int").repartition(5)
    assert {tuple(r) for r in M.queue_alerts(changes, 20, 10).collect()} == want and len(want) > 3
    assert M.queue_alerts(changes.limit(0), 20, 10).count() == 0


def test_metric_points_keep_null_labels_and_limit_before_the_shuffle(spark):
    rows = [(["x", None][i % 2], dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "label string, ts timestamp, event_id long, value double")
    points = M.metric_points(df, ["label"], 20)
    got = {r["label"]: (r["count"], r["p50"], r["p99"]) for r in points.collect()}
    assert got == {"x": (100, 178.0, 198.0), None: (100, 179.0, 199.0)}
    assert "WindowGroupLimit" in points._jdf.queryExecution().executedPlan().toString()


def test_buckets_find_near_vectors_and_copies(spark):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in centres[i % 30]], "m") for i in range(1200)]
    rows += [(2000 + i, rows[0][1], "m") for i in range(500)]  # a third of all are copies
    rows += [(3000, None, "m"), (3001, [], "m"), (3002, [0.0] * 16, "m"), (3003, rows[1][1], "other"), (3004, [1.0], "m")]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, model string")
    q = v.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", "model").filter("embedding IS NOT NULL")
    exact, found = R.vector(q, v.filter("embedding IS NOT NULL"), 10), L.vector_lsh(q, v, 10)
    assert L.recall(found, exact).first()["recall"] >= 0.9
    score = {(r["query_id"], r["chunk_id"]): round(r["score"], 9) for r in R.vector(q, v.filter("embedding IS NOT NULL"), 5000).collect()}
    assert all(round(r["score"], 9) == score[r["query_id"], r["chunk_id"]] for r in found.collect())
    first = [r["chunk_id"] for r in found.filter("query_id = 0").orderBy("rank").collect()]
    assert first == [0, *range(2000, 2009)]
    assert L.nearest(q, v.filter("embedding IS NOT NULL"), 10).count() == exact.count()


def test_short_passages_are_candidates(spark):
    passages = spark.createDataFrame([(1, "two words"), (2, "Stand"), (3, ""), (4, None), (5, "here two words stand"), (6, "wo wor")], "query_id int, text string")
    documents = spark.createDataFrame([(10, "here  Two words stand"), (11, "nothing"), (12, None), (13, "two\nwords")], "version_id int, text string")
    got = {tuple(r) for r in V.passage_candidates(passages, documents).collect()}
    # the inner words of the fifth stand in document 13 too; whether it holds the passage is for verification to say
    assert got == {(1, 10), (1, 13), (2, 10), (5, 10), (5, 13), (6, 10), (6, 13)}


def test_conflicts_equal_all_pairs(spark):
    texts = [
        "The stair width shall be 1200 mm at every landing", "The stair width shall be 1500 mm at every landing", "The stair width shall be 1200 mm at every landing",
        "The stair width is prohibited at every landing", "Lighting of 10 lux and width 900 mm", "The stair landing width must be 1200 mm",
    ]
    rows = [(r, i, t, 0.9 if i != 4 else 0.5) for r in (1, 2) for i, t in enumerate(texts) if r == 1 or i in (0, 2, 4)] + [(3, 0, texts[0], 0.1), (3, 1, texts[1], 0.9)]
    evidence = spark.createDataFrame(rows, "requirement_id int, evidence_id int, content string, term_coverage double")
    got = {tuple(r) for r in C.passage_conflicts(evidence).collect()}
    on = {}
    for r, i, t, c in rows:
        if c >= C.ANCHOR and t not in on.setdefault(r, {}).values():
            on[r][i] = t
    pairs = [(r, a, b, x, y) for r, own in on.items() for a, x in own.items() for b, y in own.items() if a < b]
    told = spark.createDataFrame(pairs, "r int, a int, b int, x string, y string").select("r", "a", "b", V.conflict_reason(F.col("x"), F.col("y")).alias("reason"))
    assert got == {tuple(r) for r in told.filter("reason IS NOT NULL").collect()} and len(got) >= 3


def test_passages_are_paired_only_where_clashes_decide(spark, monkeypatch):
    """Before, all conflicting passages of a requirement were paired and shuffled, also where figures had decided."""
    kind = "requirement_id long, obligation_text string, modality string"
    words = "exit stair landing width"
    rows = [(1, f"The {words} shall be not less than 3 m.", "mandatory"), (2, f"The {words} shall be kept clear.", "mandatory")]
    req = spark.createDataFrame(rows, kind).withColumns({"key_terms": C.key_terms(F.col("obligation_text")), "measurements": N.measurements(F.col("obligation_text"))})
    said = [(r, 10 * r + i, f"Exit stair landing clear width {i} m as drawn.") for r in (1, 2) for i in (2, 4, 5)]
    evidence = C.score_evidence(spark.createDataFrame(said, "requirement_id long, evidence_id long, content string"), req.select("requirement_id", "key_terms"))
    met, plain = [], C.passage_conflicts

    def conflicts(evidence, rid):
        met.extend(r[0] for r in evidence.select(rid).distinct().collect())
        return plain(evidence, rid)

    monkeypatch.setattr(C, "passage_conflicts", conflicts)
    told = {r.requirement_id: (r.result, r.confidence) for r in C.verdicts(req, evidence).collect()}
    assert told == {1: ("needs_evidence", 0.45), 2: ("needs_evidence", 0.45)}
    assert met == [2]
