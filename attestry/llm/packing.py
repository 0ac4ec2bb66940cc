"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Class j holds pieces of at most capacity / j tokens, and each of its bins takes exactly j of them, so
workers fill bins without knowing of each other. Documents are cut at class sizes wherever a piece
would leave its slot visibly unfilled; what is left over of a class is bounded and packed at the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import Scratch

CAPACITY, END_ID, SLACK = 2048, 1, 0.03
CACHED = 400_000  # words whose ids a worker process remembers
CHUNK_BYTES = 2 << 20  # of text taken at once; a longer text is taken alone
AT_ONCE = 10_000  # new words that reach the tokenizer in one call
MERGED = 32  # shares whose rests meet at the next level

#: White space of any script, and a few control characters that some call so.
WHITE = r"[\t-\r \x{1c}-\x{1f}\x{85}\p{Z}]"


class Encoder:
    """Ids of whole texts by the tokenizer, with remembered ids of words.

    The byte-level pre-tokenizer always breaks before a single space that starts a word, so a text is
    the concatenation of its first word and its parts " word", each tokenised for itself. Arrow splits
    the texts and numbers the different words; only new ones reach the tokenizer, many in one call.
    Texts where a space stands between other white space, or that name a special token, are tokenised
    whole.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([f"{WHITE} (?:{WHITE}|$)", *("".join(f"\\x{{{ord(c):x}}}" for c in s) for s in special)])
        self.edge = f"^{WHITE}|{WHITE}$|^$"
        space = self.tokenizer.model.tokenize("\u0120")[0].value  # the letter of a space byte
        size = self.tokenizer.get_vocab_size()
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(space) for i in range(size)])
        self.known: dict[str | tuple, int] = {}  # words after a space; first words as ("", word)
        self.ids, self.ends = np.zeros(1 << 18, np.uint32), np.zeros(1 << 16, np.int64)

    def forget_but(self, words: list[str]) -> None:
        """Forgets all words but those of the given ones that are known: of a chunk's words, the frequent."""
        stay = [w for w in words if w in self.known]
        at = np.array([self.known[w] for w in stay], np.int64)
        parts = [self.ids[a:b] for a, b in zip(self.ends[at].tolist(), self.ends[at + 1].tolist(), strict=True)]
        self.known, self.ids, self.ends = {}, np.zeros(1 << 18, np.uint32), np.zeros(1 << 16, np.int64)
        if stay:
            self.remember(stay, np.concatenate(parts), np.array([len(p) for p in parts]))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def remember(self, names: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        used = int(self.ends[n])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(names) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[used : used + len(ids)] = ids
        self.ends[n + 1 : n + len(names) + 1] = used + np.cumsum(sizes)
        self.known.update(zip(names, range(n, n + len(names)), strict=True))

    def numbers(self, words: pa.Array, after_space: bool) -> np.ndarray:
        """The number of each of some different words, new ones learnt."""
        names = words.to_pylist() if after_space else [("", w) for w in words.to_pylist()]
        known = self.known
        found = np.array([known.get(w, -1) for w in names], np.int64)
        new = np.flatnonzero(found < 0)
        if not len(new):
            return found
        fresh = words.take(pa.array(new))
        # white space at an edge would run together with the next word's space
        alone = np.asarray(pc.match_substring_regex(fresh, self.edge)) if after_space else np.ones(len(new), bool)
        plain = new[~alone].tolist()
        for low in range(0, len(plain), AT_ONCE):
            own = [names[i] for i in plain[low : low + AT_ONCE]]
            ids = self.whole([" " + " ".join(own)])[0]
            self.remember(own, ids, np.diff(np.flatnonzero(self.opens[ids]), append=len(ids)))
        if alone.any():
            own = [names[i] for i in new[alone].tolist()]
            parts = self.whole([" " + w if after_space else w[1] for w in own])
            self.remember(own, np.concatenate(parts), np.array([len(p) for p in parts]))
        found[new] = [known[names[i]] for i in new.tolist()]
        return found

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; no nulls."""
        odd = np.asarray(pc.match_substring_regex(texts, self.odd))
        out: list = [None] * len(texts)
        at = np.flatnonzero(odd)
        for i, ids in zip(at.tolist(), self.whole(texts.take(pa.array(at)).to_pylist()), strict=True):
            out[i] = ids
        at = np.flatnonzero(~odd)
        if not len(at):
            return out
        split = pc.split_pattern(texts.take(pa.array(at)).cast(pa.large_string()), pattern=" ")
        places = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        codes = np.asarray(coded.indices)
        if len(self.known) > CACHED:
            self.forget_but(coded.dictionary.to_pylist())
        number = self.numbers(coded.dictionary, True)[codes]
        first = coded.dictionary.take(pa.array(codes[places[:-1]])).dictionary_encode()
        number[places[:-1]] = self.numbers(first.dictionary, False)[np.asarray(first.indices)]
        start = self.ends[number]
        size = self.ends[number + 1] - start
        end = np.cumsum(size)
        ids = self.ids[np.repeat(start - end + size, size) + np.arange(end[-1])]
        cuts = np.append(0, end)[places].tolist()
        for i, a, b in zip(at.tolist(), cuts, cuts[1:], strict=False):
            out[i] = ids[a:b]
        return out


#: One encoder a worker process, so that later tasks find what earlier ones have learnt.
ENCODERS: dict[str, Encoder] = {}


def encoder_of(tokenizer_file: str) -> Encoder:
    if tokenizer_file not in ENCODERS:
        ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return ENCODERS[tokenizer_file]


def sliced(batch: pa.RecordBatch, texts: pa.Array, most: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch and its texts in parts of at most ``most`` bytes, or one text."""
    reached = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
    low = 0
    while low < len(texts):
        before = reached[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(reached, before + most, "right")))
        yield batch.slice(low, high - low), texts.slice(low, high - low)
        low = high


def pieces_of(n: int, capacity: int, slack: float) -> list[int]:
    """Lengths of the pieces of n tokens: full ones, then class sizes until the rest fits its slot."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        if capacity / j - rest <= slack * rest:
            out.append(rest)
            break
        size = capacity // (j + 1)  # the largest class size below the rest
        out.append(size)
        rest -= size
    return out


def tokenize(
    docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, slack: float = SLACK, with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents: key, start, length, ids_crc32, doc_tokens and, if asked, ids.

    ``_row`` numbers a task's documents, so that equal rows can be dealt apart.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, row = encoder_of(tokenizer_file), 0
        for batch in batches:
            for part, texts in sliced(batch, pc.fill_null(batch.column(1), ""), CHUNK_BYTES):
                whose, rows, ids = [], [], []
                for at, found in enumerate(encoder(texts)):
                    data = np.append(found, np.uint32(end_id)).astype("<u4")
                    n, cut = len(data), 0
                    for size in pieces_of(n, capacity, slack):
                        own = data[cut : cut + size]
                        whose.append(at)
                        rows.append((cut, size, zlib.crc32(own), n, row + at))
                        if with_ids:
                            ids.append(own.astype(np.int32))
                        cut += size
                row += len(part)
                columns = [part.column(0).take(pa.array(whose, pa.int32()))]
                columns += [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    names = ["k", "start", "length", "ids_crc32", "doc_tokens", "_row", "ids"]
    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = slim.schema["k"].dataType.simpleString()
    schema = f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, _row long"
    return slim.mapInArrow(encode, schema + ", ids array<int>" * with_ids).withColumnRenamed("k", key)


def harmonic_bins(pieces: DataFrame, capacity: int = CAPACITY, workers: int | None = None, key: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (key, start, length, ids_crc32, doc_tokens, _row, ...).

    First each of ``workers`` shares of a class fills bins of its own. What a share has left, fewer
    than j pieces, meets the rests of MERGED - 1 other shares of that class, which again fill bins of
    j, and so on until one share is left: a group of rests has fewer than MERGED * j pieces, whatever
    the input's size. At most j - 1 pieces of each class then remain, some 10,000 in all; one small
    task fits them.
    """
    spark = pieces.sparkSession
    shares = workers or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = [c for c in pieces.columns if c != "_row"]
    order = [F.col(c) for c in (key, "start", "ids_crc32", "doc_tokens", "_row")]
    rest = pieces.withColumn("_class", F.floor(F.lit(capacity) / F.col("length")).cast("long")).withColumn(
        "_share", F.pmod(F.xxhash64(key, "start", "ids_crc32", "_row"), F.lit(shares))
    )

    def fill(df: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        within = Window.partitionBy("_class", "_share")
        ranked = df.withColumn("_rank", F.row_number().over(within.orderBy(*order)) - 1).withColumn(
            "_count", F.count(F.lit(1)).over(within)
        )
        ranked = ranked.withColumn("_bin", F.floor(F.col("_rank") / F.col("_class")))
        is_full = (F.col("_bin") + 1) * F.col("_class") <= F.col("_count")
        before = Window.partitionBy("_class", "_share", "_bin").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
        full = ranked.filter(is_full).select(
            *columns, numbered(level).alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
        )
        return full, ranked.filter(~is_full).select(*columns, "_row", "_class", "_share")

    def numbered(level: int) -> Column:
        return (
            F.shiftleft(F.lit(level).cast("long"), 59) + F.shiftleft(F.col("_class"), 47)
            + F.shiftleft(F.col("_share").cast("long"), 31) + F.col("_bin")
        )

    packed, level = None, 0
    while True:
        full, rest = fill(rest, level)
        packed = full if packed is None else packed.unionByName(full)
        if shares == 1:
            break
        shares, level = -(-shares // MERGED), level + 1
        # written, so that a level reads what the one before has left and does not fill its bins again
        rest = Scratch(spark).save(rest, "rest").withColumn("_share", F.pmod("_share", F.lit(shares)))

    def fit(frame):
        """First fit, longest first, of the bounded remainder."""
        frame = frame.sort_values(["length", key, "start", "ids_crc32"], ascending=[False, True, True, True])
        room, at, bins = [], [], []
        for n in frame["length"]:
            k = next((k for k, r in enumerate(room) if r >= n), len(room))
            if k == len(room):
                room.append(capacity)
            at.append(capacity - room[k])
            bins.append((level + 1 << 59) + k)
            room[k] -= n
        return frame.drop(columns=["_row", "_class", "_share", "_all"]).assign(sequence_id=bins, offset=at)

    last = rest.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fit, packed.schema)
    return packed.unionByName(last)


def pack_documents(
    docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, slack: float = SLACK, with_ids: bool = False, workers: int | None = None,
) -> DataFrame:
    """Tokenises whole texts, cuts them and packs the pieces; one row per piece.

    Columns: key, start (the document's ids before it), length, ids_crc32, doc_tokens, sequence_id,
    offset and, with ``with_ids``, the ids. Null or empty text: the end id alone. A document longer
    than the capacity fills whole sequences first. Repeated rows are packed once each. An empty
    table gives no pieces. Other columns of the input are not read.
    """
    pieces = tokenize(docs, tokenizer_file, key, text, capacity, end_id, slack, with_ids)
    pieces = Scratch(docs.sparkSession).save(pieces, "pieces")  # tokenised once, read at the first level and for its rest
    return harmonic_bins(pieces, capacity, workers, key)
