"""Brute force for licenses, secrets and packing, long texts, null keys and repeated rows."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from attestry.llm import decontam, licenses, packing, secrets, spotsigs

public_tokenizers = pytest.importorskip("public_tokenizers")


def table(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


def template_pattern(template: str) -> re.Pattern:
    """The template as a pattern over words that each end in a space."""
    out = []
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        if part == "[[":
            out.append("(?:")
        elif part == "]]":
            out.append(")?")
        elif part.startswith("{{"):
            out.append(r"(?:\S+ ){0,%s}" % part[2:-2])
        else:
            out.append(re.escape(part) + " ")
    return re.compile("".join(out))


def test_licenses_equal_brute_force(spark):
    rng = random.Random(1)
    templates = (("a", "b c [[d]] e"), ("f", "b {{2}} e [[x {{1}}]]"), ("g", "[[b]] e b"), ("h", "c [[d [[e]]]] b"))
    phrases = ["under the mit license", "apache license version 2", "cc by nc"]
    rows = []
    for i in range(150):
        words = [rng.choice(["b", "c", "d", "e", "x", "Cc", "bY", "nc", "é", *phrases]) for _ in range(rng.randrange(0, 25))]
        text = "".join(w + rng.choice([" ", "_", "-", ", ", "\n", "/"]) for w in " ".join(words).split())
        rows.append((i if i % 9 else None, text if i % 11 else None))
    rows += rows[:5]
    found = licenses.find_licenses(table(spark, rows), templates=templates)
    got = Counter(
        (r["doc_id"], r["n_words"], tuple(sorted(map(tuple, r["base"]))), tuple(sorted((m["start"], m["stop"], m["label"]) for m in r["matches"])))
        for r in found.collect()
    )
    want = Counter()
    for k, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        words = [w for w in words if w]
        base = [(i, label) for i in range(len(words)) for p, label in licenses.PHRASES.items() if words[i : i + len(p.split())] == p.split()]
        matches = []
        for i in range(len(words)):
            rest = "".join(w + " " for w in words[i:])
            for label, template in templates:
                ends = [n for n in range(1, len(words) - i + 1) if template_pattern(template).fullmatch("".join(w + " " for w in words[i : i + n]))]
                if ends and rest:
                    matches.append((i, i + max(ends), label))
        want[(k, len(words), tuple(sorted(base)), tuple(sorted(matches)))] += 1
    assert got == want
    assert licenses.license_report(licenses.find_licenses(table(spark, []))).count() == 0


def test_novel_spans_equal_brute_force(spark):
    rng = random.Random(2)
    novelty = secrets.Novelty(64, 256, 0.5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(1, 60)):
            words.append(rng.choice(["word", "is", "the token", "Authorization:", "x" * 30, "secret = ", "".join(rng.choices(letters, k=rng.choice([12, 16, 40])))]))
        rows.append((i if i % 7 else None, " ".join(words)))
    got = Counter((r["doc_id"], tuple((s["start"], s["stop"]) for s in r["secrets"] if s["kind"] == "novel")) for r in secrets.find_secrets(table(spark, rows)).collect())
    want = Counter()
    for k, t in rows:
        words = [m.span() for m in secrets.SENSITIVE.finditer(t)]
        base = [m.span() for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 6] + [m.span() for m in secrets.HEX.finditer(t)]
        spans = []
        for m in secrets.CANDIDATE.finditer(t):
            a, b = m.span()
            near = any(a - 64 <= stop and start <= b + 64 for start, stop in words)
            if near and not any(s <= a and b <= e for s, e in base):
                if novelty.added(t, a, b) >= 0.5 * (b - a):
                    spans.append((a, b))
        want[(k, tuple(spans))] += 1
    assert got == want and sum(len(s) for _, s in want) > 20
    assert secrets.secret_report(secrets.find_secrets(table(spark, []))).count() == 0


def test_long_texts_take_seconds():
    novelty, scanner = secrets.Novelty(64, 256, 0.5), licenses.Scanner()
    for text in ("token ab " * 110_000, "token" * 200_000, "a" * 1_000_000 + " token", "the secret " + "aB3" * 300_000, "under the mit " * 70_000, "permission is hereby granted " * 40_000):
        began = time.time()
        low = text.lower()
        novelty.spans(text, secrets.base_spans(text, low))
        scanner.scan(low)
        assert time.time() - began < 10


def test_remembered_ids_equal_the_tokenizers_own(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(packing, "CACHED", 500)
    encoder, rng = packing.Encoder(path), random.Random(3)
    parts = ["a", "B", "é", "ß", " ", " ", "  ", "\n", "\t", "\u3000", "\xa0", "1", "½", ".", "'", "'s", "'re", "don", "<|endoftext|>", "$$", "\x85", "\x1c", "漢", "😀", "\r\n", "\u0120", "word"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 14))) for _ in range(20_000)] + ["word " * 50_000]
    for low in range(0, len(texts), 700):
        some = texts[low : low + 700]
        for text, ids in zip(some, encoder(pa.array(some)), strict=True):
            assert encoder.tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist(), text


def test_packing_of_null_keys_and_repeated_rows(spark):
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(4)
    rows = [(None, "same words here")] * 300 + [(7, "a b c " * 900)] * 40 + [(i, "w " * rng.randrange(0, 300)) for i in range(200)] + [(None, None)] * 5
    out = packing.pack_documents(table(spark, rows), path, workers=70).collect()
    tokenizer, by_seq = packing.Encoder(path).tokenizer, {}
    want = Counter()
    for k, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for size in packing.pieces_of(len(ids), 2048, packing.SLACK):
            want[(k, at, size, zlib.crc32(ids[at : at + size].tobytes()), len(ids))] += 1
            at += size
    assert want == Counter(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in out)
    for r in out:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def model_overlay(words, item, shifts):
    own = {s: sum(1 for j, w in enumerate(item) if 0 <= j + s < len(words) and words[j + s] == w) for s in shifts}
    best = min(s for s in own if own[s] == max(own.values()))
    near = [s for s in shifts if abs(s - best) <= decontam.DRIFT]
    return best, sum(1 for j, w in enumerate(item) if any(0 <= j + s < len(words) and words[j + s] == w for s in near))


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    letters = ["un", "do", "tri", "qua", "cin", "ses", "sep", "oct"]
    vocabulary = [a + b for a in letters for b in letters]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 8, 20, 40]))]) for i in range(12)]
    items += [(50, ["again"] * 30), (51, ["a", "b"] * 20), (None, ["x"] * 9), (52, [])]
    docs = []
    for d in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            _, item = rng.choice(items)
            changed = [w if rng.random() > 0.08 else "zzz" for w in item]
            at = rng.randrange(len(words) + 1)
            words = words[:at] + changed + words[at:]
        docs.append((d if d % 10 else None, words))
    docs += [docs[3], (7, ["other"]), (200, ["again"] * 100), (201, ["a", "b"] * 50)]
    got = Counter(
        (r["doc_id"], r["item_id"], r["start_word"], r["matched_words"])
        for r in decontam.contaminated(table(spark, [(d, ", ".join(w)) for d, w in docs]), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    )
    want = Counter()
    for d, words in {(d, tuple(w)) for d, w in docs if d is not None}:
        for i, item in items:
            if i is None or not item:
                continue
            n, first, shifts = len(item), {}, set()
            masks = [[j for j, b in enumerate(m) if b == "1"] for m in decontam.MASKS] if n >= 5 else [list(range(n))]
            for m, mask in enumerate(masks):
                for j in range(n - mask[-1]):
                    first.setdefault((m, tuple(item[j + k] for k in mask)), j)
                for p in range(len(words) - mask[-1]):
                    if (j := first.get((m, tuple(words[p + k] for k in mask)))) is not None:
                        shifts.add(p - j)
            if shifts:
                best, matched = model_overlay(words, item, shifts)
                if matched >= (n if n < 5 else 0.8 * n):
                    want[(d, i, best, matched)] += 1
    assert got == want and len(want) > 40


def test_long_texts_against_items_take_seconds(spark):
    rng = random.Random(6)
    words = [rng.choice("abcdefghijklmnop") + rng.choice("abcdefghijklmnop") for _ in range(300_000)]
    docs = table(spark, [(1, " ".join(words)), (2, "again " * 150_000), (3, None)])
    bench = spark.createDataFrame([(1, " ".join(words[1000:1500])), (2, "again " * 500)], "item_id long, text string")
    began = time.time()
    got = {(r["doc_id"], r["item_id"], r["similarity"]) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, 1, 1.0), (2, 2, 1.0)} and time.time() - began < 60


def test_bounds_below(spark):
    rng = random.Random(7)
    bounds = sorted({rng.randrange(-50, 50) for _ in range(30)})
    df = spark.range(-60, 60)
    for some in (bounds, bounds[:1], []):
        got = df.select("id", spotsigs.number_below(df["id"], some).alias("n")).collect()
        assert all(r["n"] == sum(b < r["id"] for b in some) for r in got)
