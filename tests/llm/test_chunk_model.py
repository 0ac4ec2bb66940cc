"""op10 against a plain model: cuts by definition, chunks compared by their bytes, spans merged one by one."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from attestry.llm import chunks


def model_cuts(data: bytes, radius: int, longest: int) -> list[int]:
    table = [int(x) for x in chunks.gear_table(chunks.SEED)]
    n, top = len(data), (1 << 16) - 1
    h = [sum(table[data[i - j]] << j for j in range(16) if i >= j) & 0xFFFF for i in range(n)]
    ends = []
    for i in range(n):
        after = min(h[i : i + radius + 1])
        before = min(h[max(0, i - 1 - radius) : i], default=top)
        if h[i] <= after and h[i] < before and radius < i + 1 < n - radius:
            ends.append(i + 1)
    out, start = [], 0
    for end in [*ends, n]:
        while end - start > longest:
            start += longest
            out.append(start)
        out.append(end)
        start = end
    return out


def model_spans(rows, least_words, radius=chunks.RADIUS, longest=chunks.LONGEST):
    found, seen = {}, {}
    for k, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        if not data:
            continue
        ends = model_cuts(data, radius, longest)
        places = list(zip([0, *ends[:-2]], ends[1:], strict=True)) if len(ends) > 1 else [(0, ends[0])]
        for a, b in places:
            first = seen.setdefault(data[a:b], k)
            if (k, data[a:b]) in found or first < k:
                found.setdefault(k, []).append((a, b, first))
            found[k, data[a:b]] = True
    out = Counter()
    for k, text in rows:
        data, spans = (text or "").encode(), []
        for a, b, first in sorted(found.get(k, [])):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
                spans[-1][2] = min(spans[-1][2], first)
            else:
                spans.append([a, b, first])
        for a, b, first in spans:
            words = [i for i in range(len(data)) if data[i : i + 1] not in b"\t\n\x0b\x0c\r " and (i == 0 or data[i - 1 : i] in b"\t\n\x0b\x0c\r ")]
            n = sum(a <= i < b for i in words)
            if n >= least_words:
                points = [len([x for x in data[:c] if x & 0xC0 != 0x80]) for c in (a, b)]
                out[k, *points, n, first] += 1
    return out


@pytest.mark.parametrize("least", [20, 5])
def test_spans_equal_the_model(spark, least):
    rng = random.Random(11)
    words = [f"w{i}é"[: rng.randrange(2, 6)] + "qrstuv"[: rng.randrange(6)] for i in range(300)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared = [prose(n) for n in (60, 52, 34, 25, 12)]
    rows = []
    for i in range(40):
        parts = [prose(rng.randrange(5, 40)) for _ in range(3)]
        if i % 2:
            parts.insert(rng.randrange(4), rng.choice(shared))
        rows.append((i, " ".join(parts)))
    own = prose(55)
    rows += [(50, f"{own} {prose(20)} {own}"), (51, None), (52, ""), (53, "z" * 900), (54, "z" * 900), (None, shared[0]), (55, rows[3][1]), (56, "漢字 " * 120)]
    got = chunks.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least_words=least)
    got = Counter(map(tuple, got.select("doc_id", "span_start", "span_stop", "n_words", "first_doc_id").collect()))
    assert got == model_spans(rows, least) and len(got) > 10
