"""Chat records of many layouts into canonical turns, one template's text and its loss mask, and back.

The nested field paths of a record, without the types of its leaves, are hashed; the fingerprint selects
a declared mapping. Turns are marked by control strings. Inside texts a control string is broken by an
escape letter after its first letter, and escape letters are doubled, so reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from attestry.llm.common import Scratch

ESCAPE = "␛"
#: Role, what opens its turns, what closes them.
MARKS = (("system", "<<SYS>>\n", "\n<</SYS>>\n"), ("user", "[INST] ", " [/INST]"), ("assistant", "<s>", "</s>"))
NAMED = ("[ROLE]", "[/ROLE]", "[/TURN]")  # a turn of any other role
CONTROL = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", *NAMED)
LOSS = "assistant"
PART_CHARS = 1 << 16  # after so many characters a conversation goes on in a further row

_TAILS = r"(?=/?INST\]|/?ROLE\]|/TURN\]|/?s>|<SYS>>|</SYS>>)"
BREAK = rf"([\[<]){_TAILS}"
JOIN = f"{ESCAPE}({ESCAPE}?)"
TURN = re.compile(
    "|".join([
        *(f"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, a, b in MARKS),
        rf"{re.escape(NAMED[0])}(?P<name>.*?){re.escape(NAMED[1])}(?P<other>.*?){re.escape(NAMED[2])}",
    ]), re.DOTALL,
)


@dataclass(frozen=True)
class Layout:
    """A declared mapping: the paths that a record must and may have, and where its turns are.

    ``listed``: path of a list of messages with the fields that hold role and text. Otherwise ``turns``:
    role and the fields whose texts, where not empty, make that turn, blank line between; a turn none of
    whose fields the record has is left out. A record of a layout without ``must`` has one field at least.
    """

    name: str
    must: tuple[str, ...] = ()
    may: tuple[str, ...] = ()
    listed: tuple[str, str, str] | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    single: tuple[str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)

    def shapes(self) -> list[str]:
        chosen = chain.from_iterable(combinations(self.may, n) for n in range(len(self.may) + 1))
        return [shape_of([*self.must, *more]) for more in chosen if self.must or more]

    def turns_of(self, v: Column) -> Column:
        names = F.create_map(*[F.lit(x) for pair in self.roles.items() for x in pair]) if self.roles else None

        def turn(role: Column, text: Column) -> Column:
            role = F.coalesce(F.try_element_at(names, role), role) if names is not None else role
            return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

        if self.listed:
            path, role, text = self.listed
            found = F.try_variant_get(v, f"$.{path}", f"array<struct<`{role}`: string, `{text}`: string>>")
            return F.transform(found, lambda m: turn(m[role], m[text]))
        if self.single:
            role, text = (F.try_variant_get(v, f"$.{f}", "string") for f in self.single)
            return F.array(turn(role, text))
        out = []
        for role, fields in self.turns:
            values = [F.try_variant_get(v, f"$.{f}", "string") for f in fields]
            there = F.greatest(*[F.try_variant_get(v, f"$.{f}", "variant").isNotNull() for f in fields], F.lit(False))
            text = F.array_join(F.filter(F.array(*values), lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n")
            out.append(F.when(there, turn(F.lit(role), text)))
        return F.array_compact(F.array(*out))


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), listed=("messages", "role", "content")),
    Layout("shared", ("conversations[].from", "conversations[].value"), listed=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Layout("instruction", may=("system", "instruction", "input", "output"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt", may=("prompt", "completion"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question", ("question", "answer"), ("context",), turns=(("user", ("context", "question")), ("assistant", ("answer",)))),
    Layout("turn", ("role", "text"), single=("role", "text")),
)


def shape_of(paths: list[str]) -> str:
    """The nested field paths as one text, in the way that Spark writes a variant's schema, leaves as *."""
    tree: dict = {}
    for path in paths:
        at = tree
        for step in re.findall(r"[^.\[\]]+|\[\]", path):
            at = at.setdefault(step, {})

    def told(node: dict) -> str:
        if not node:
            return "*"
        if "[]" in node:
            return f"ARRAY<{told(node['[]'])}>"
        return f"OBJECT<{', '.join(f'{k}: {told(node[k])}' for k in sorted(node))}>"

    return told(tree)


LEAF = r"\b(?:STRING|VOID|BOOLEAN|TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\(\d+,\d+\)|DATE|TIMESTAMP(?:_NTZ)?|BINARY|UUID|VARIANT)(?=[,>]|$)"


def fingerprint(v: Column) -> Column:
    """Hash of a variant's nested field paths, whatever the order of its fields and the types of its leaves."""
    return F.xxhash64(F.regexp_replace(F.schema_of_variant(v), LEAF, "*"))


def canonical_turns(records: DataFrame, key: str, order: list[str], record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, order..., layout, place, role, text): a row per turn of each record.

    ``record`` holds JSON texts or structs. Null roles and texts are ''. A record of no declared layout
    (also null, not JSON, or an empty list) is one row with null layout, place, role and text, so that
    nothing goes unseen. Repeated records have their turns again. Other columns are not read.
    """
    kind = records.schema[record].dataType
    value = F.try_parse_json(F.col(record)) if isinstance(kind, StringType) else F.to_variant_object(F.col(record))
    rows = records.select(key, *order, value.alias("_v"))
    table = F.create_map(*[x for layout in layouts for s in layout.shapes() for x in (F.xxhash64(F.lit(s)), F.lit(layout.name))])
    rows = rows.withColumn("_layout", F.try_element_at(table, fingerprint(F.col("_v"))))
    turns = F.lit(None)
    for layout in layouts:
        turns = F.when(F.col("_layout") == layout.name, layout.turns_of(F.col("_v"))).otherwise(turns)
    told = rows.select(key, *order, F.col("_layout").alias("layout"), F.posexplode_outer(turns).alias("place", "_t"))
    return told.select(key, *order, "layout", "place", "_t.role", "_t.text")


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), BREAK, f"$1{ESCAPE}")


def unescaped(text: str) -> str:
    return re.sub(JOIN, r"\1", text) if ESCAPE in text else text


def formatted_turn(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """Text of one turn, and where in it the loss mask starts and stops (null without)."""
    body = escaped(text)
    out = F.concat(F.lit(NAMED[0]), escaped(role), F.lit(NAMED[1]), body, F.lit(NAMED[2]))
    start = None
    for name, opens, closes in MARKS:
        out = F.when(role == name, F.concat(F.lit(opens), body, F.lit(closes))).otherwise(out)
        if name == LOSS:
            start = F.when(role == name, F.lit(len(opens)))
    return out, start, start + F.length(body)


def format_chats(turns: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, part, formatted, loss): the text of each conversation, in rows of about PART_CHARS, and the spans under the loss.

    Turns follow ``order``, nulls first, equal ones by role and text. A conversation's rows pass one task
    in order and are written as they come, so that a long one takes no more memory than a part.
    """
    shown, start, stop = formatted_turn(F.col("role"), F.col("text"))
    sort = [F.asc_nulls_first(c) for c in (key, *order, "role", "text")]
    slim = turns.filter("role IS NOT NULL").select(key, *order, "role", "text")
    dealt = slim.repartition(key).sortWithinPartitions(*sort)
    rows = dealt.select(F.col(key).alias("k"), shown.alias("shown"), start.cast("long").alias("start"), stop.cast("long").alias("stop"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, pieces, size, loss, out = None, 0, [], 0, [], []

        def ready() -> pa.RecordBatch:
            keys, *others = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, kind_pa), *(pa.array(c, t) for c, t in zip(others, types, strict=True))], names)

        types = [pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
        names, started, held, kind_pa = ["k", "part", "formatted", "loss"], False, 0, None
        for batch in batches:
            kind_pa = batch.schema.field(0).type
            for k, text, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if started and (k != now or size >= PART_CHARS):
                    out.append((now, part, "".join(pieces), loss))
                    held += size
                    part, pieces, size, loss = (part + 1 if k == now else 0), [], 0, []
                    if held > 4 * PART_CHARS:
                        yield ready()
                        out, held = [], 0
                now, started = k, True
                if a is not None:
                    loss.append({"start": size + a, "stop": size + b})
                pieces.append(text)
                size += len(text)
        if started:
            out.append((now, part, "".join(pieces), loss))
            yield ready()

    kind = turns.schema[key].dataType.simpleString()
    schema = f"k {kind}, part long, formatted string, loss array<struct<start: long, stop: long>>"
    return rows.mapInArrow(assemble, schema).withColumnRenamed("k", key)


def turns_in(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    at = 0
    for m in TURN.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        kind = m.lastgroup
        yield (unescaped(m["name"]) if kind == "other" else kind), unescaped(m[kind])
    if at != len(text):
        raise ValueError(f"no turn at character {at}")


def read_chats(formatted: DataFrame, key: str) -> DataFrame:
    """Per conversation, from its formatted rows: key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Digests run over the parts in order; a null key is one conversation.
    """
    rows = formatted.select(F.col(key).alias("k"), "part", "formatted", "loss").repartition("k").sortWithinPartitions(F.asc_nulls_first("k"), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, started, kind_pa = [], None, False, None
        n = chars = under = 0
        turns = loss = None
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def ready() -> pa.RecordBatch:
            keys, *others = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, kind_pa), *(pa.array(c, t) for c, t in zip(others, types, strict=True))], names)

        for batch in batches:
            kind_pa = batch.schema.field(0).type
            for k, part, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == 0:
                    if started:
                        out.append((now, n, turns.hexdigest(), under, loss.hexdigest(), chars))
                    now, started, n, chars, under, turns, loss = k, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                chars += len(text)
                for role, said in turns_in(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for span in spans:
                    said = unescaped(text[span["start"] : span["stop"]])
                    loss.update(said.encode())
                    under += len(said)
            if len(out) > 5_000:
                yield ready()
                out = []
        if started:
            out.append((now, n, turns.hexdigest(), under, loss.hexdigest(), chars))
            yield ready()

    names = ["k", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema[key].dataType.simpleString()
    schema = f"k {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(read, schema).withColumnRenamed("k", key)


def as_records(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, record): each row as JSON in one of five layouts, by its key, as if from several corpora."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    usual, k = r.isin("system", "user", "assistant"), F.pmod(F.col(key), F.lit(5))
    said = F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    shared = F.to_json(F.struct(F.array(F.struct(said.alias("from"), t.alias("value"))).alias("conversations")))
    instruction = F.when(r == "user", F.to_json(F.struct(t.alias("instruction"), F.lit("").alias("input")))).when(
        r == "assistant", F.to_json(F.struct(t.alias("output")))
    ).otherwise(F.to_json(F.struct(t.alias("system"))))
    prompt = F.when(r == "user", F.to_json(F.struct(t.alias("prompt")))).otherwise(F.to_json(F.struct(t.alias("completion"))))
    record = (
        F.when((k == 1) & usual, shared).when((k == 2) & usual, instruction).when((k == 3) & r.isin("user", "assistant"), prompt)
        .when(k == 4, F.to_json(F.struct(r.alias("role"), t.alias("text"))))
        .otherwise(F.to_json(F.struct(F.array(F.struct(t.alias("content"), r.alias("role"))).alias("messages"))))
    )
    return rows.select(key, turn, record.alias("record"))


def chat_report(rows: DataFrame) -> DataFrame:
    """op13: rows (conv_id, turn, role, text) and conversation -1 as records, canonical turns, formatted text written, and read back."""
    spark = rows.sparkSession
    odd = "</s>[INST] ok [/INST]"
    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn", "role", "text"))
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], kind)
    records = as_records(rows.select(*more.columns).unionByName(more))
    turns = canonical_turns(records, "conv_id", ["turn"], "record")
    written = Scratch(spark).save(format_chats(turns, "conv_id", ["turn", "place"]), "formatted")
    return read_chats(written, "conv_id")


ORACLE_SQL = """
WITH r AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]'))
), e AS (
    SELECT *, length(text) + length(text) - length(replace(text, chr(9243), ''))
           + len(regexp_extract_all(text, '<<SYS>>|<</SYS>>|<s>|</s>|\\[/?INST\\]|\\[/?ROLE\\]|\\[/TURN\\]')) AS shown
    FROM r
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(shown + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 20 + length(role) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
