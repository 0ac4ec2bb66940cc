"""Alignment of two tokenizers' tokens over the same bytes.

The byte-level tokenizer tells character offsets, the piece tokenizer character spans. Where a token's
span is not empty and ends before the next one starts, its end is a coarse cut: a byte place known
from the text alone. Tokens that share a character (a multibyte character cut into bytes, or written in
byte-fallback tokens) have spans that overlap or are empty; their ends follow from the bytes that the
tokens decode to, counted from the last coarse cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import Scratch, salted, small_enough
from attestry.llm.packing import WHITE, sliced

CACHED = 800_000  # units remembered before the less used ones are forgotten
CHUNK_BYTES = 2 << 20  # of text taken at once; a longer text is taken alone
AT_ONCE = 300  # new units that reach the tokenizers in one text
PAIR_BYTES = 48  # of one id pair with its count, in a broadcast table

SPACE = "▁"  # how pieces write a space
#: Texts that are not the concatenation of their words: longer white space in a row, spaces at an edge, or the letter of a space itself.
ODD = f"{WHITE} (?:{WHITE}|$)|^ | $|{SPACE}|^$"
#: The space before a word; of two spaces the second one belongs to the word, since one piece may take both.
GAP = re.compile("(?<! ) ")
#: Letters that one run of the byte-level tokenizer's pattern takes whole; there are others.
LETTER = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u0400-\u0481\u048A-\u052F"
#: What may end a run of letters, if no piece holds it beside a letter.
MARKS = "\n!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable bytes stand for themselves, the rest follow U+0100 in order."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_ends(ids: np.ndarray, spans: np.ndarray, widths: np.ndarray, places: np.ndarray | None) -> np.ndarray:
    """Byte end of each token: of its span at coarse cuts, else by decoded bytes from the coarse cut before.

    ``places``: byte place of each character; None if a character is a byte.
    """
    reached = np.cumsum(widths[ids])
    begin, end = spans[:, 0], spans[:, 1]
    coarse = end > begin
    coarse[:-1] &= end[:-1] <= begin[1:]
    told = end if places is None else places[end]
    if coarse.all():
        return told
    drift = np.where(coarse, told - reached, 0)
    last = np.maximum.accumulate(np.where(coarse, np.arange(len(ids)), -1))
    return reached + np.where(last >= 0, drift[last], 0)


def unit_pattern(pieces: list[str]) -> re.Pattern:
    """Cuts " " + text into units at whose ends both tokenizers end a token, whatever stands around them.

    A unit starts at spaces, at a mark after a letter, or at a letter after one new line. The byte-level
    tokenizer breaks there, and no piece goes across: spaces stand only first in a piece, and the marks
    are those that no piece has beside a letter.
    """
    beside = {m for p in pieces for m in re.findall(rf"(?<=[{LETTER}])[^{LETTER}]|[^{LETTER}](?=[{LETTER}])", p)}
    marks = "".join(m for m in MARKS if m not in beside)
    inside = rf"(?<=[{LETTER}])[{re.escape(marks)}]" if marks else r"(?!)"
    if "\n" in marks:
        inside += rf"|(?<=[!-~{LETTER}]\n)[{LETTER}]"
    return re.compile(rf" *(?:[{LETTER}]+(?=[ {re.escape(marks)}]|\Z)|[^ {LETTER}]+(?= |\Z)|[^ ](?:(?!{inside})[^ ])*)")


def before(unit: str) -> str:
    """What stands before a unit while it is learnt: by its first character, it follows a space, a letter or a new line."""
    return "" if unit[0] == " " else " a" if unit[0] in MARKS else " a\n"


def spread(at: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Places of runs that start at ``at`` and have ``many`` elements each, one run after the other."""
    return np.repeat(at - (np.cumsum(many) - many), many) + np.arange(many.sum())


def sums(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each run of values between two places."""
    reached = np.append(0, np.cumsum(values))
    return reached[ends] - reached[begins]


class Aligner:
    """Ids and groups of whole texts by both tokenizers, with remembered units.

    A text without longer runs of spaces or spaces at its edges is the concatenation of its units (see
    unit_pattern): words after their space, and what follows a word's letters. Most words differ, but
    their letters recur with other marks. A unit is encoded when it is first met; the different words of
    a chunk are then put together from numbers of units, and its texts from numbers of words. Other texts
    are encoded whole.
    """

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True  # their strings in a text are then ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters = byte_letters()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(letters[c] for c in e) if all(c in letters for c in e) else e.encode() for e in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_width, self.b_width = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.numbers = [str(i) for i in range(max(len(entries), len(pieces)))]
        ordinary = [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)]
        self.by_units = not any(SPACE in p.lstrip(SPACE) for p in ordinary)
        self.units = unit_pattern([p.lstrip(SPACE) for p in ordinary]).findall
        self.known: dict[str, int] = {}  # number of each unit
        self.groups: list[bytes] = []
        #: of each unit: ids of either kind (none: a text with it has no tokens), pairs, place of its pairs, chunks with it
        self.n_a, self.n_b, self.n_pairs, self.at, self.uses = (np.zeros(1 << 16, np.int64) for _ in range(5))
        self.pairs, self.n_kept = np.zeros(1 << 18, np.int64), 0

    def encoded(self, text: str):
        """Of " " + text, by each tokenizer: ids and byte ends; None where the decoded bytes differ from the text's."""
        spaced = " " + text
        raw = spaced.encode()
        places = None
        if len(raw) != len(spaced):
            letters = np.frombuffer(spaced.encode("utf-32-le"), np.uint32)
            places = np.append(0, np.cumsum(1 + sum((letters >= least).astype(np.int64) for least in (0x80, 0x800, 0x10000))))
        a = self.a.encode(spaced, add_special_tokens=False)
        b = self.b.encode(text, return_type="offset_mapping")
        out = []
        for ids, spans, table, widths, shift in ((a.ids, a.offsets, self.a_bytes, self.a_width, 0), (b["ids"], b["offsets"], self.b_bytes, self.b_width, 1)):
            if b"".join(map(table.__getitem__, ids)) != raw:
                return None
            ids = np.array(ids, np.int64)
            spans = np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(ids)).reshape(-1, 2)
            if shift:  # spans of the second tokenizer do not count the space that it adds itself
                spans = spans + 1
                spans[0, 0] = 0
            out += [ids, token_ends(ids, spans, widths, places)]
        return out

    def entries(self, found, begins: np.ndarray, ends: np.ndarray) -> tuple | None:
        """Of the units between two byte places each: groups as text; counts of ids and of pairs; all their pairs in order."""
        a, a_end, b, b_end = found
        # an end of either kind stands once, so a place that both have stands twice in the sorted ends
        both = np.sort(np.concatenate([a_end, b_end]))
        shared = np.append(0, both[1:][both[1:] == both[:-1]])
        low, high = np.searchsorted(shared, begins), np.searchsorted(shared, ends)
        last = len(shared) - 1
        if not (np.array_equal(shared[np.minimum(low, last)], begins) and np.array_equal(shared[np.minimum(high, last)], ends)):
            return None
        to_a, to_b = np.append(0, np.searchsorted(a_end, shared[1:]) + 1), np.append(0, np.searchsorted(b_end, shared[1:]) + 1)
        number = self.numbers
        a_text, b_text = [number[i] for i in a.tolist()], [number[i] for i in b.tolist()]
        x, y = to_a.tolist(), to_b.tolist()
        groups = [
            f"{a_text[i]}|{b_text[j]}" if p == i + 1 and q == j + 1 else f"{','.join(a_text[i:p])}|{','.join(b_text[j:q])}"
            for i, p, j, q in zip(x[:-1], x[1:], y[:-1], y[1:], strict=True)
        ]
        told = [";".join(groups[i:j]).encode() for i, j in zip(low.tolist(), high.tolist(), strict=True)]
        pairs = a[to_a[1:] - 1] * len(self.b_bytes) + b[to_b[1:] - 1]
        inside = np.zeros(len(pairs) + 1, np.int64)  # begins and ends of units alternate, so their sum is 1 inside a unit
        np.add.at(inside, low, 1)
        np.add.at(inside, high, -1)
        return told, to_a[high] - to_a[low], to_b[high] - to_b[low], high - low, pairs[np.cumsum(inside[:-1]) > 0]

    def whole(self, text: str, begin: int = 0) -> tuple | None:
        """Entries of one unit: what follows the byte place ``begin`` of " " + text."""
        found = self.encoded(text)
        return None if found is None else self.entries(found, np.array([begin]), np.array([len(text.encode()) + 1]))

    def alone(self, text: str) -> tuple | None:
        made = self.whole(text)
        return made and (made[0][0], int(made[1][0]), int(made[2][0]), self.outer(made[4]).tolist())

    def outer(self, pairs: np.ndarray) -> np.ndarray:
        """Pairs as a << 32 | b."""
        a, b = np.divmod(pairs, len(self.b_bytes))
        return a << 32 | b

    def keep(self, units: list[str], made: tuple | None) -> None:
        told, n_a, n_b, n_pairs, pairs = made or ([b""] * len(units), *np.zeros((3, len(units)), np.int64), np.zeros(0, np.int64))
        low, high = len(self.groups), len(self.groups) + len(units)
        while high > len(self.n_a):
            self.n_a, self.n_b, self.n_pairs, self.at, self.uses = (np.append(x, np.zeros_like(x)) for x in (self.n_a, self.n_b, self.n_pairs, self.at, self.uses))
        while self.n_kept + len(pairs) > len(self.pairs):
            self.pairs = np.append(self.pairs, np.zeros_like(self.pairs))
        self.pairs[self.n_kept : self.n_kept + len(pairs)] = pairs
        self.n_a[low:high], self.n_b[low:high], self.n_pairs[low:high], self.uses[low:high] = n_a, n_b, n_pairs, 0
        self.at[low:high] = self.n_kept + np.cumsum(n_pairs) - n_pairs
        self.n_kept += len(pairs)
        self.known.update(zip(units, range(low, high), strict=True))
        self.groups += told

    def forget(self) -> None:
        """Forgets the units that the fewest chunks had, so that at most half of CACHED stay."""
        n = len(self.groups)
        uses = self.uses[:n]
        least = np.sort(uses)[max(n - CACHED // 2 - 1, 0)]
        stay = np.flatnonzero(uses > least)
        names = list(self.known)  # in the order of their numbers
        self.pairs = self.pairs[spread(self.at[stay], self.n_pairs[stay])]
        self.n_kept = len(self.pairs)
        self.pairs = np.append(self.pairs, np.zeros(1 << 18, np.int64))
        self.groups = [self.groups[i] for i in stay.tolist()]
        self.known = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.n_a, self.n_b, self.n_pairs, self.uses = (np.append(x[stay], np.zeros(1 << 16, np.int64)) for x in (self.n_a, self.n_b, self.n_pairs, self.uses >> 1))
        self.at = np.cumsum(self.n_pairs) - self.n_pairs

    def learn(self, units: list[str]) -> None:
        plain = []
        for u in units:  # white space at an edge would run together with the next unit's space
            bare = u[1:] if u[0] == " " else u
            if bare.strip() == bare:
                plain.append(u)
            else:
                self.learn_alone(u)
        for low in range(0, len(plain), AT_ONCE):
            own = plain[low : low + AT_ONCE]
            led = list(map(before, own))
            sizes = np.array([list(map(len, led)), [len(u.encode()) for u in own]])
            ends = np.cumsum(sizes.T).reshape(-1, 2)
            found = self.encoded("".join(chain.from_iterable(zip(led, own, strict=True)))[1:])
            made = found and self.entries(found, ends[:, 0], ends[:, 1])
            if made:
                self.keep(own, made)
            else:
                for u in own:
                    self.learn_alone(u)

    def learn_alone(self, unit: str) -> None:
        led = before(unit)
        self.keep([unit], self.whole((led + unit)[1:], len(led)))

    def words(self, words: list[str]) -> tuple:
        """Of different words: groups as text; counts of ids (none: a text with it has no tokens) and of pairs; all their pairs in order."""
        if len(self.groups) > CACHED:
            self.forget()
        known = self.known
        units, ends = [], []
        for w in words:
            if w.isalpha():
                units.append(" " + w)
            else:
                units += self.units(" " + w)
            ends.append(len(units))
        self.learn([u for u in set(units) if u not in known])
        own = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
        self.uses[np.unique(own)] += 1
        numbers, told, begins = own.tolist(), self.groups, [0, *ends[:-1]][: len(ends)]
        groups = [told[numbers[i]] if j == i + 1 else b";".join([told[k] for k in numbers[i:j]]) for i, j in zip(begins, ends, strict=True)]
        begins, ends = np.array(begins, np.int64), np.array(ends, np.int64)
        right = sums(self.n_a[own] == 0, begins, ends) == 0
        n_a, n_b, n_pairs = (sums(x[own], begins, ends) for x in (self.n_a, self.n_b, self.n_pairs))
        return groups, n_a * right, n_b * right, n_pairs, self.pairs[spread(self.at[own], self.n_pairs[own])]

    def arrays(self, texts: pa.Array) -> tuple:
        """Of texts: groups as text, counts of ids (None and 0 where it has no tokens); and text, pair, times of each text's pairs."""
        odd = pc.match_substring_regex(texts, ODD).to_pylist()
        texts = texts.to_pylist()
        split = [[] if o or not self.by_units else GAP.split(t) if "  " in t else t.split(" ") for t, o in zip(texts, odd, strict=True)]
        coded = pa.array(list(chain.from_iterable(split)), pa.string()).dictionary_encode()
        told, *of_words, pairs = self.words(coded.dictionary.to_pylist())
        own = np.asarray(coded.indices)
        x, y, many = (v[own] for v in of_words)
        ends = np.cumsum(list(map(len, split)), dtype=np.int64)
        begins = np.append(0, ends[:-1])[: len(ends)]
        right = (ends > begins) & (sums(x == 0, begins, ends) == 0)
        n_a, n_b = sums(x, begins, ends) * right, sums(y, begins, ends) * right
        numbers, told = own.tolist(), told.__getitem__
        groups = [b";".join(map(told, numbers[i:j])) if r else None for i, j, r in zip(begins.tolist(), ends.tolist(), right.tolist(), strict=True)]
        text_of = np.repeat(np.arange(len(texts)), ends - begins)
        stay = right[text_of]
        at = np.cumsum(of_words[2]) - of_words[2]
        linked = [pairs[spread(at[own[stay]], many[stay])]]
        of = [np.repeat(text_of[stay], many[stay])]
        for i in np.flatnonzero(ends == begins).tolist():
            made = self.whole(texts[i]) if texts[i] else None
            if made:
                groups[i], n_a[i], n_b[i] = made[0][0], made[1][0], made[2][0]
                linked.append(made[4])
                of.append(np.full(len(made[4]), i))
        size = len(self.a_bytes) * len(self.b_bytes)
        both, times = np.unique(np.concatenate(of) * size + np.concatenate(linked), return_counts=True)
        text, pair = np.divmod(both, size)
        return groups, n_a, n_b, text, self.outer(pair), times

    def __call__(self, texts: pa.Array) -> Iterator[tuple[bytes, int, int, dict[int, int]] | None]:
        """Groups as text, counts of ids and linked pairs of each text; None where it has no tokens."""
        groups, n_a, n_b, text, pairs, times = self.arrays(texts)
        ends = np.searchsorted(text, np.arange(len(groups) + 1))
        for i, own in enumerate(groups):
            at = slice(ends[i], ends[i + 1])
            yield None if own is None else (own, int(n_a[i]), int(n_b[i]), dict(zip(pairs[at].tolist(), times[at].tolist(), strict=True)))


ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner_of(a_file: str, b_file: str) -> Aligner:
    """One aligner a worker process, so that later tasks find what earlier ones have learnt."""
    if (a_file, b_file) not in ALIGNERS:
        ALIGNERS[a_file, b_file] = Aligner(a_file, b_file)
    return ALIGNERS[a_file, b_file]


PAIRS = "pairs array<long>, times array<long>"


def align_tokens(docs: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: key, n_a, n_b, n_groups, n_links, groups_sha256, and its different id pairs with times.

    A pair is a << 32 | b. Besides, rows with ``is_sum`` hold the summed pairs of some documents, so that
    corpus counts need not read every document's pairs again. A null or empty text, or one whose decoded
    bytes differ, has zeros, '' and no pairs. Repeated rows and null keys have a row each.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a_file, b_file)
        for batch in batches:
            for part, texts in sliced(batch, pc.fill_null(batch.column(1), ""), CHUNK_BYTES):
                groups, n_a, n_b, text, pairs, times = aligner.arrays(texts)
                different, which = np.unique(pairs, return_inverse=True)
                total = np.bincount(which, times, len(different)).astype(np.int64)
                ends = np.searchsorted(text, np.arange(len(groups) + 1))
                linked = np.diff(np.append(0, np.cumsum(times))[ends])
                digests = ["" if g is None else hashlib.sha256(g).hexdigest() for g in groups]
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v)) for v in (pairs, times)]
                counts = [pa.array(c, pa.int64()) for c in (n_a, n_b, linked, linked)]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(digests, pa.string()), pa.array([False] * len(groups)), *lists], names)
                none = [pa.nulls(1, x.type) for x in (part.column(0), *counts)]
                sums = [pa.array([v], pa.list_(pa.int64())) for v in (different, total)]
                yield pa.RecordBatch.from_arrays([*none, pa.nulls(1, pa.string()), pa.array([True]), *sums], names)

    names = ["k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "is_sum", "pairs", "times"]
    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = slim.schema["k"].dataType.simpleString()
    schema = f"k {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, is_sum boolean, {PAIRS}"
    return slim.mapInArrow(encode, schema).withColumnRenamed("k", key)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of the corpus hold an id pair, and whether no pair of its second id has more."""
    sums = aligned.filter("is_sum").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = sums.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    top = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_report(docs: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; see align_tokens.

    Each text is encoded once and its pairs are written; counts of the corpus then meet them by broadcast
    while their table is small, else by a salted shuffle join of each document's different pairs.
    """
    scratch = Scratch(docs.sparkSession)
    aligned = scratch.save(align_tokens(docs, a_file, b_file, key, text).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = scratch.save(pair_counts(aligned), "counts")
    size = counts.count() * PAIR_BYTES
    told = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = aligned.filter("NOT is_sum").select(key, "_row", *told, F.explode_outer(F.arrays_zip("pairs", "times")).alias("x"))
    rows = rows.select(key, "_row", *told, F.coalesce("x.pairs", F.lit(-1).cast("long")).alias("pair"), "x.times")
    none = counts.sparkSession.createDataFrame([(-1, 0, False)], counts.schema)  # of documents without pairs
    counts = small_enough(counts.unionByName(none), size)
    joined = rows.join(counts, "pair") if size <= 64 << 20 else salted(rows, counts, ["pair"], F.col("_row"))
    best = F.when(F.col("best"), F.col("times")).otherwise(0)
    sums = joined.groupBy("_row", key, *told).agg(F.sum(best).alias("n_best"), F.sum(F.coalesce("times", F.lit(0)) * F.col("count")).alias("count_sum"))
    return sums.select(key, *told[:4], "n_best", "count_sum", "groups_sha256")
