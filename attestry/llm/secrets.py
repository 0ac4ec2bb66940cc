"""Secret scan: fixed patterns plus dictionary-primed zstandard novelty.

A candidate string near a sensitive word, before or after it, is priced by the bytes that it adds when it is compressed
inside its surrounding text by a compressor that already knows a dictionary of common identifiers.
Prose and identifiers cost little; keys and tokens cost nearly their own length and are reported.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
SPANS = "array<struct<kind:string,start:int,stop:int,added:int>>"

#: Identifiers and code words that the compressor knows beforehand.
IDENTIFIERS = """
    access account address admin api application args array async auth authorization await base64
    bearer boolean branch bucket buffer build bytes cache callback certificate class client client_id
    client_secret cluster code column commit config connection const container context cookie
    credential credentials database dataframe date debug decode default delete description
    development dictionary directory document domain email enabled encode encoding encrypt endpoint
    environment error example exception export false filename float format function getenv github
    global handler hash header headers host hostname http https identifier import index input
    instance integer interface json kubernetes lambda length library license list local localhost
    logger login logout machine manager message method module namespace network null number object
    optional option options output package parameter params parser password path placeholder port
    postgres prefix private private_key process production profile project property protocol public
    public_key query random read redirect refresh_token region register release remote repository
    request require response return role schema script secret secret_key security select self server
    service session session_id settings signature source staging static status storage string
    subscription suffix system table target template test testing thread timeout timestamp token
    true tuple type undefined update upload url user user_id username utf-8 uuid value variable
    version volume warning webhook workspace xxxxxxxx your_password your_token your_api_key_here
    changeme 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ
"""

# The three base patterns and their least lengths.
ASSIGN = re.compile(
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

SENSITIVE = re.compile(
    r"(?i:passw|passphrase|pwd|secret|token|api[_-]?key|private[_-]?key|access[_-]?key|credential|bearer"
    r"|authorization|client[_-]?id|signature|session[_-]?id|webhook|conn(?:ection)?[_-]?str)",
    re.ASCII,
)
#: Shorter strings have too few bytes for a compressor to tell words from keys.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~-]{16,}")
#: Every match of ASSIGN, and of SENSITIVE, holds one of these in lower case.
ASSIGN_ROOTS = ("passw", "secret", "token", "api")
SENSITIVE_ROOTS = (
    "passw", "passphrase", "pwd", "secret", "token", "api", "private", "access", "credential", "bearer", "authorization",
    "client", "signature", "session", "webhook", "conn",
)


def holds(low: str, roots: tuple[str, ...]) -> bool:
    return any(root in low for root in roots)


class Novelty:
    """Marginal compressed size of a string inside its context."""

    def __init__(self, reach: int, around: int, least: float):
        import zstandard

        known = " ".join(IDENTIFIERS.split()).encode()
        primed = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zip = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)
        self.reach, self.around, self.least = reach, around, least

    def added(self, text: str, start: int, stop: int) -> int:
        before = text[max(0, start - self.around) : start].encode("utf-8", "replace")
        after = text[stop : stop + self.around].encode("utf-8", "replace")
        with_it = len(self.zip.compress(before + text[start:stop].encode() + after))
        return with_it - len(self.zip.compress(before + after))

    def spans(self, text: str, base: list[tuple]) -> list[tuple]:
        """Candidates within reach of a sensitive word, before or after it, whose added bytes suffice.

        Sensitive words, candidates and base spans are each found once and met in order, so that the
        work is in proportion to the text.
        """
        words = [m.span() for m in SENSITIVE.finditer(text)]
        if not words:
            return []
        starts, stops = [a for a, _ in words], [b for _, b in words]
        known = sorted((a, b) for _, a, b, _ in base)
        opens, reached = [a for a, _ in known], list(accumulate((b for _, b in known), max))
        found = []
        for hit in CANDIDATE.finditer(text):
            start, stop = hit.span()
            # a word ends at most ``reach`` before the candidate or starts at most ``reach`` after it
            if bisect_right(starts, stop + self.reach) <= bisect_left(stops, start - self.reach):
                continue
            covered = bisect_right(opens, start)
            if covered and reached[covered - 1] >= stop:
                continue
            added = self.added(text, start, stop)
            if added >= self.least * (stop - start):
                found.append(("novel", start, stop, added))
        return found


def base_spans(text: str, low: str) -> list[tuple]:
    """Spans of the fixed patterns; ``low`` is the text in lower case, which tells most texts apart early."""
    found = []
    if holds(low, ASSIGN_ROOTS):
        found += [("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span(), None) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", *m.span(), None) for m in HEX.finditer(text)]
    return found


def find_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 64, around: int = 256, least: float = 0.5
) -> DataFrame:
    """One row per input row: ``key`` and ``secrets``, its spans by start, then kind.

    Offsets are code points, the end exclusive. ``added`` is the marginal size in bytes of a novel
    span (null for pattern spans). ``reach``: how many characters may lie between a candidate
    and a sensitive word before or after it; ``around``: context on either side; ``least``: marginal bytes per character to be reported.
    Null or empty text: no spans. Repeated rows stay, each with its own spans. Very long texts are
    scanned whole, a row at a time. Other columns of the input, whatever their names, are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(reach, around, least)
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("added", pa.int32())])
        )
        for batch in batches:
            rows = []
            for value in batch.column(1):
                whole = value.as_py() or ""
                low = whole.lower()
                spans = base_spans(whole, low)
                if holds(low, SENSITIVE_ROOTS):
                    spans += novelty.spans(whole, spans)
                spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                rows.append([dict(zip(("kind", "start", "stop", "added"), s, strict=True)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["k", "secrets"])

    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    out = slim.mapInArrow(scan, f"k {slim.schema['k'].dataType.simpleString()}, secrets {SPANS}")
    return out.select(F.col("k").alias(key), "secrets")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def secret_report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    def n(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.select(
        key, n("assign"), n("access"), n("hex"), F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"), n("novel"),
    )
