"""Brute force for token alignment, hard negatives and chat formatting, with odd inputs."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


def table(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


# ---------------------------------------------------------------- alignment


def byte_entries(tokenizer):
    """Bytes of each entry, by the tokenizer's own decoder where it can: single bytes through the byte-level alphabet."""
    from tokenizers.pre_tokenizers import ByteLevel

    pre = ByteLevel(add_prefix_space=False, use_regex=False)
    letter = {}
    for code in range(0x800):
        for c, b in zip(pre.pre_tokenize_str(chr(code))[0][0], chr(code).encode(), strict=True):
            letter[c] = b
    for high in (0x800, 0x10000, 0x40000, 0x80000, 0xC0000, 0x100000, *range(0x1000, 0xE000 - 1, 0x1000), 0xE000, 0xF000):
        for c, b in zip(pre.pre_tokenize_str(chr(high))[0][0], chr(high).encode(), strict=True):
            letter[c] = b
    return lambda i: bytes(letter[c] for c in tokenizer.id_to_token(i))


def model_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    entry = byte_entries(a)

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    links, told = [], []
    for _, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(map(entry, ids_a)) != raw or b"".join(map(piece, ids_b)) != raw:
            links.append([])
            told.append((0, 0, ""))
            continue
        ends_a, ends_b, at = {}, {}, 0
        for n, i in enumerate(ids_a):
            at += len(entry(i))
            ends_a[at] = n
        at = 0
        for n, i in enumerate(ids_b):
            at += len(piece(i))
            ends_b[at] = n
        groups, p, q, own = [], 0, 0, []
        for end in sorted(ends_a.keys() & ends_b.keys()):
            x, y = ends_a[end] + 1, ends_b[end] + 1
            groups.append(",".join(map(str, ids_a[p:x])) + "|" + ",".join(map(str, ids_b[q:y])))
            own.append((ids_a[x - 1], ids_b[y - 1]))
            p, q = x, y
        links.append(own)
        told.append((len(ids_a), len(ids_b), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(x for own in links for x in own)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return Counter(
        (k, x, y, len(own), len(own), sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), digest)
        for (k, _), own, (x, y, digest) in zip(rows, links, told, strict=True)
    )


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_texts():
    rng = random.Random(3)
    parts = ["the", "of", "Thtion", "漢字", "𝄞", "é", "é", "  ", "\n", "\t", "<|endoftext|>", "</s>", "<0x0A>", "don't", "12345", "ﬁ", " ", "\x1c", "　", "🙂", "\x00", "ß."]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 30)))) for i in range(150)]
    rows += [(i + 200, " ".join(rng.choice(parts) for _ in range(20))) for i in range(100)]
    rows += [(900, None), (901, ""), (902, " "), (903, "a ▁ b"), (904, "x" * 3000), (905, "the of " * 4000), (None, "the of"), (0, rows[0][1]), (0, rows[0][1])]
    return rows


def test_alignment_equals_brute_force(spark):
    from attestry.llm.alignment import alignment_report

    rows = odd_texts()
    docs = table(spark, [(k, t, "x", 1) for k, t in rows], "doc_id long, text string, pairs string, n_a int").repartition(3)
    got = alignment_report(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert got.columns == ALIGNED
    assert Counter(map(tuple, got.collect())) == model_alignment(rows)


def test_alignment_remembers_and_forgets(spark, monkeypatch):
    from attestry.llm import alignment

    monkeypatch.setattr(alignment, "CACHED", 5)
    monkeypatch.setattr(alignment, "AT_ONCE", 3)
    import pyarrow as pa

    aligner = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t for _, t in odd_texts() if t]
    for low in range(0, len(texts), 7):
        own = texts[low : low + 7]
        for text, found in zip(own, aligner(pa.array(own)), strict=True):
            whole = aligner.alone(text)
            assert (found is None) == (whole is None)
            assert found is None or (found[:3], Counter(found[3])) == (whole[:3], Counter(whole[3]))


def test_alignment_of_two_spaces(spark):
    """One piece may take both spaces before a word that is not a piece after a space."""
    from attestry.llm.alignment import alignment_report

    rows = [(1, "of  漢 of"), (2, "foo bar  the  \U0010ff13 x"), (3, "a  b\n  c"), (4, "the  of  漢字  漢  12"), (5, "of 漢  of")]
    got = alignment_report(table(spark, rows).coalesce(1), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter(map(tuple, got.collect())) == model_alignment(rows)


def own_aligner():
    from attestry.llm import alignment

    return alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def test_alignment_learns_letters_once():
    """The same letters with other marks do not reach the tokenizers again."""
    import pyarrow as pa

    aligner, taken = own_aligner(), []
    encoded = aligner.encoded
    aligner.encoded = lambda text: taken.append(len(text)) or encoded(text)
    rng = random.Random(5)
    stems = ["".join(rng.choice("aeiouthrné") for _ in range(12)) for _ in range(100)]
    marks = ["", ".", ",", "!!", "%%%", ".***", "'s", "9", ".\nThe", ",,", "\n"]
    texts = [" ".join(w + m for w in stems) for m in marks]
    found = list(aligner(pa.array(texts)))
    assert sum(taken) < 3 * len(texts[0])  # of more than 11 times that
    for text, x in zip(texts, found, strict=True):
        whole = aligner.alone(text)
        assert (x[:3], Counter(x[3])) == (whole[:3], Counter(whole[3]))


def test_alignment_of_units_equals_whole_texts(monkeypatch):
    """Marks, new lines, digits and contractions after and before letters, with and without forgetting."""
    import pyarrow as pa

    from attestry.llm import alignment

    rng = random.Random(6)
    parts = ["the", "Thtion", "é", "é", "Ñlles", "Жук", "漢", "ª", "²", "0", "12", "\n", "\n\n", "\r\n", "\t", "  ", " ", ".", ",,", "!!", "'s", "'t", "'re", "ll", '"', "(", "-", "<s>", "\x00", "\xa0", "▁", "\\", "]", "^"]
    aligner = own_aligner()
    for cached in (4, 300, 10**6):
        monkeypatch.setattr(alignment, "CACHED", cached)
        for _ in range(4):
            texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 20))) for _ in range(150)]
            for text, x in zip(texts, aligner(pa.array(texts)), strict=True):
                whole = aligner.alone(text)
                assert (x is None) == (whole is None)
                assert x is None or (x[:3], Counter(x[3])) == (whole[:3], Counter(whole[3]))


def test_alignment_forgets_what_few_chunks_had(monkeypatch):
    import pyarrow as pa

    from attestry.llm import alignment

    monkeypatch.setattr(alignment, "CACHED", 40)
    aligner = own_aligner()
    for n in range(10):
        list(aligner(pa.array([f"the of and w{'abcdefghij'[n]}x " + " ".join(f"q{'abcdefghij'[n]}{c}" for c in "abcdefghijklmnop")])))
        assert len(aligner.known) == len(aligner.groups) <= 40 + 20
    assert {" the", " of", " and"} <= aligner.known.keys()


def test_alignment_without_broadcast_and_of_nothing(spark, monkeypatch):
    from attestry.llm import alignment

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    assert alignment.alignment_report(table(spark, []), *files).collect() == []
    monkeypatch.setattr(alignment, "PAIR_BYTES", 1 << 40)
    rows = odd_texts()[:60]
    got = alignment.alignment_report(table(spark, rows), *files)
    assert Counter(map(tuple, got.collect())) == model_alignment(rows)


# ---------------------------------------------------------------- hard negatives


def model_negatives(rows, every=100, most=5):
    import math

    kept = []
    for k, label, vector in rows:
        if k is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((k, (label + 1) % 10 if k % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    out = Counter()
    for k, label, v in kept:
        if k % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), i, c) for i, c, w in kept if i != k]
        for p, i, c in sorted(s for s in scored if s[2] == label)[:most]:
            fits = sorted(s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p)
            for rank, (n, j, _) in enumerate(fits[:most], 1):
                out[k, i, rank, j, -p, -n] += 1
    return out


NEGATIVES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def vector_rows(n=700, dims=20, seed=5, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = rng.randrange(labels)
        near = centres[rng.randrange(labels)]
        rows.append((i, label, [0.2 * x + rng.gauss(0, 0.1) for x in near]))
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_negatives_equal_brute_force(spark, parts):
    from attestry.llm.hardneg import hard_negatives

    rows = vector_rows()
    rows += [(700, None, [1.0] * 20), (None, 1, [1.0] * 20), (800, 2, None), (900, 1, [1.0, None] + [0.0] * 18), (1000, 1, [float("nan")] * 20)]
    rows += [(1100, 1, [float("-inf")] * 20), (1200, 3, []), (1300, 2, [0.5]), (1301, 1, [0.5, 0.1]), (1400, 2, [0.0] * 20)]
    rows += [(2000 + i, i % 3, rows[100][2]) for i in range(40)]  # equal scores
    data = [(k, c, v, "x") for k, c, v in rows]
    table_ = spark.createDataFrame(data, "vec_id long, label int, embedding array<float>, anchor string").repartition(parts)
    import struct

    single = [(k, c, v and [x if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v]) for k, c, v in rows]
    got = hard_negatives(table_)
    assert got.columns == NEGATIVES
    want = model_negatives(single)
    assert Counter(map(tuple, got.collect())) == want
    assert len(want) > 40


def test_negatives_in_rounds_with_large_components_and_of_nothing(spark):
    from attestry.llm.hardneg import hard_negatives

    kind = "vec_id long, label int, embedding array<double>"
    assert hard_negatives(spark.createDataFrame([], kind)).collect() == []
    assert hard_negatives(spark.createDataFrame([(1, 1, [1.0])], kind)).collect() == []
    rows = [(i, c, [x * 2.0**21 for x in v]) for i, c, v in vector_rows(400, 6, 9)]  # beyond what doubles add exactly
    want = model_negatives(rows, 20)
    got = hard_negatives(spark.createDataFrame(rows, kind).repartition(3), every=20, round_bytes=6 * 8 * 3)
    assert Counter(map(tuple, got.collect())) == want and want


def test_negatives_of_repeated_rows(spark):
    from attestry.llm.hardneg import hard_negatives

    rows = vector_rows(150, 8, 2)
    rows += [rows[100], rows[3], rows[3]]
    got = hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4))
    assert Counter(map(tuple, got.collect())) == model_negatives(rows)


# ---------------------------------------------------------------- chat formatting


def model_chats(rows):
    odd = "</s>[INST] ok [/INST]"
    rows = [(k, t, r or "", x or "") for k, t, r, x in rows] + [(-1, 0, "user", odd), (-1, 1, "assistant", odd)]
    groups = {}
    for k, t, r, x in rows:
        groups.setdefault(k, []).append(((t is not None, t or 0), r, x))
    out = Counter()
    for k, turns in groups.items():
        turns.sort()
        told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[k, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()] += 1
    return out


def odd_chats():
    from attestry.llm import chat

    rng = random.Random(4)
    bits = [*chat.CONTROL, *(c[:-1] for c in chat.CONTROL), *(c[1:] for c in chat.CONTROL), chat.ESCAPE, chat.ESCAPE * 2, "<", "[", "\n", " ", "é𝄞", "human", "gpt", '"', "\\", "$1"]
    roles = ["user", "assistant", "system", "tool", "human", "gpt", "", None, "[ROLE]", "a\nb", "␛"]
    rows = [(rng.randrange(40), rng.choice([*range(12), None]), rng.choice(roles), "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for _ in range(600)]
    rows += [(41, i, ["user", "assistant"][i % 2], None if i % 3 == 0 else "x" * i) for i in range(30)]
    rows += [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (42, 0, "assistant", "same"), (42, 0, "assistant", "same")]
    return rows


CHATS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("part", [1 << 16, 10])
def test_chats_read_back_what_went_in(spark, monkeypatch, part):
    from attestry.llm import chat

    monkeypatch.setattr(chat, "PART_CHARS", part)
    rows = odd_chats()
    got = chat.chat_report(spark.createDataFrame([(*r, "z") for r in rows], CHATS + ", record string").repartition(5))
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert Counter(tuple(r)[:5] for r in got.collect()) == model_chats(rows)
    assert chat.chat_report(spark.createDataFrame([], CHATS)).count() == 1


def test_layouts_become_canonical_turns(spark):
    import json

    from attestry.llm import chat

    hi, yes = ("user", "hi"), ("assistant", "yes")
    cases = [
        ({"messages": [{"role": "user", "content": "hi"}, {"content": "yes", "role": "assistant"}]}, "messages", [hi, yes]),
        ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yes"}]}, "shared", [hi, yes]),
        ({"instruction": "hi", "output": "yes"}, "instruction", [hi, yes]),
        ({"output": "yes", "input": "there", "instruction": "hi", "system": "be"}, "instruction", [("system", "be"), ("user", "hi\n\nthere"), yes]),
        ({"prompt": "hi", "completion": "yes"}, "prompt", [hi, yes]),
        ({"response": "yes", "prompt": None}, "prompt_response", [("user", ""), yes]),
        ({"question": "hi", "answer": "yes", "context": "c"}, "question", [("user", "c\n\nhi"), yes]),
        ({"text": 5, "role": None}, "turn", [("", "5")]),
        ({"messages": [{"role": "user", "content": "hi"}, {"role": "tool"}]}, "messages", [hi, ("tool", "")]),
        ({"messages": []}, None, None), ({}, None, None), ([1], None, None), ({"prompt": "x", "other": 1}, None, None), ({"a.b": {"c": [1]}}, None, None),
    ]
    rows = [(i, json.dumps(c)) for i, (c, _, _) in enumerate(cases)] + [(100, "{"), (101, None)]
    got = {}
    for r in sorted(chat.canonical_turns(spark.createDataFrame(rows, "k int, rec string"), "k", [], "rec").collect(), key=lambda r: (r["k"], r["place"] or 0)):
        got.setdefault(r["k"], (r["layout"], []))[1].append((r["role"], r["text"]))
    for i, (_, layout, turns) in enumerate(cases):
        assert got[i] == (layout, turns or [(None, None)]), cases[i]
    assert got[100] == got[101] == (None, [(None, None)])
    struct = spark.createDataFrame([(1, ([("user", "hi")],))], "k int, rec struct<messages: array<struct<role: string, content: string>>>")
    assert [tuple(r)[1:] for r in chat.canonical_turns(struct, "k", [], "rec").collect()] == [("messages", 0, "user", "hi")]


def test_a_long_conversation_goes_on_in_parts(spark):
    from attestry.llm import chat

    turns = spark.createDataFrame([(7, i, ["user", "assistant"][i % 2], "word " * 200) for i in range(500)], "conv_id long, turn long, role string, text string")
    written = chat.format_chats(turns, "conv_id", ["turn"])
    parts = written.collect()
    assert len(parts) > 5 and max(len(r["formatted"]) for r in parts) < chat.PART_CHARS + 2000
    assert chat.read_chats(written, "conv_id").first()["n_turns"] == 500


def test_new_queries_match_their_sql(spark):
    import duckdb

    from attestry.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name in ("op12_vertical_negatives", "op13_schema_fingerprints"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        want = con.sql(ORACLE_SQL[name])
        at = [want.columns.index(c) for c in df.columns]
        assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in at) for r in want.fetchall()), name
