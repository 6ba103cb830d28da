r"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record's nested field paths, cut down to the paths that some declared layout knows, are hashed;
the hash selects a declarative mapping that turns the record into canonical turns
``array<struct<role, text>>``.  A record with fields of several layouts, which no hash names, takes the first
layout whose required paths it has.  Records are fingerprinted one by one, nested columns of a typed table (where a
null stands for an absent field) and JSON alike; a table with a row for each turn is by its schema.  The
template then writes

    <|im_start|>ROLE \n TEXT <|im_end|> \n

for each turn.  Texts are escaped (``\`` doubled, then ``<|`` split by a ``\``), so no control
string can stand inside one, and roles are URL-encoded; both are reversed exactly on reading.
The loss mask names, for each assistant text, its segment and the code points it spans there.

A conversation is one row of the output, so gathering its turns is bounded by that row.

Defined edge cases: null text or role is the empty string; turns sort by turn (null first), then
role, then text, and repeated rows are each a turn; a null conversation id is a conversation; a
record of no known layout keeps its row with null layout and turns; an empty table gives no rows;
extra columns and unknown fields are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.shared import unused

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role: string, text: string>>"


#: Names of the canonical roles where turns are "from" somebody.
ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


@dataclass(frozen=True)
class Layout:
    """``required`` and ``optional`` field paths, and how they map to turns.

    ``array``: the field that holds the turns, with ``role`` and ``text`` inside it; else
    ``pairs``: (role, paths of the texts that make up that turn) in order; else ``role``, ``text``
    and ``order`` are columns of a table with a row for each turn.  ``roles``: the layout's own
    names of the canonical roles.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    array: str | None = None
    role: str | None = None
    text: str | None = None
    order: str | None = None
    pairs: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("turn_rows", ("role", "text", "turn"), role="role", text="text", order="turn"),
    Layout("messages", ("messages[].content", "messages[].role"), ("system",), array="messages", role="role", text="content", pairs=(("system", ("system",)),)),
    Layout("from_value", ("conversations[].from", "conversations[].value"), ("system",), array="conversations", role="from", text="value", pairs=(("system", ("system",)),), roles=ROLES),
    Layout("instruction", ("instruction", "output"), ("input", "system"), pairs=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt_response", ("prompt", "response"), ("system",), pairs=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("completion", "prompt"), ("system",), pairs=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question_answer", ("answer", "question"), ("context",), pairs=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def known_paths(layouts: tuple[Layout, ...] = LAYOUTS) -> list[str]:
    return sorted({p for one in layouts for p in (*one.required, *one.optional)})


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()


def mappings(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    """Each layout under the fingerprints of its required paths with any of its optional ones."""
    return {fingerprint([*one.required, *more]): one for one in layouts for n in range(len(one.optional) + 1) for more in combinations(one.optional, n)}


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema; ``[]`` stands for the elements of an array."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def layout_of(table: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """The layout of a typed table, by the fingerprint of its schema."""
    known, paths = set(known_paths(layouts)), set(schema_paths(table.schema))
    return mappings(layouts).get(fingerprint([p for p in paths if p in known])) or next((one for one in layouts if set(one.required) <= paths), None)


def _role(role: Column, roles: tuple[tuple[str, str], ...]) -> Column:
    out = F.coalesce(role, F.lit(""))
    for other, own in roles:
        out = F.when(F.lower(role) == other, F.lit(own)).otherwise(out)
    return out


def _turns(one: Layout, array, value) -> Column:
    """Turns of a record; ``array(name, role, text)`` and ``value(path)`` read its fields."""
    parts = []
    for role, paths in one.pairs:
        text = F.concat_ws("\n", *[F.when(value(p) != "", value(p)) for p in paths])
        present = F.lit(False)
        for p in paths:
            present = present | value(p).isNotNull()
        turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
        parts.append(F.when(present | F.lit(role != "system"), F.array(turn)).otherwise(F.array().cast(TURNS)))
    if one.array:
        got = F.transform(array(one.array, one.role, one.text), lambda m: F.struct(_role(m[one.role], one.roles).alias("role"), F.coalesce(m[one.text], F.lit("")).alias("text")))
        parts.append(got)
    return F.concat(*parts)


def _selected(records: DataFrame, has: dict[str, Column], turns, layouts: tuple[Layout, ...]) -> DataFrame:
    """Adds fingerprint, layout and turns; ``has`` says for each known path whether the record has it, ``turns(layout)`` reads them."""
    mark, held = unused(records, "fingerprint"), unused(records, "has")
    out = records.withColumn(held, F.struct(*[F.coalesce(c, F.lit(False)).alias(f"p{k}") for k, c in enumerate(has.values())]))
    own = {p: F.col(held)[f"p{k}"] for k, p in enumerate(has)}
    out = out.withColumn(mark, F.sha2(F.concat_ws(",", *[F.when(own[p], F.lit(p)) for p in sorted(own)]), 256))
    nested = [one for one in layouts if not one.order and set(one.required) <= set(own)]
    chosen = F.lit(None).cast("string")
    for one in reversed(nested):
        every = F.lit(True)
        for p in one.required:
            every = every & own[p]
        chosen = F.when(every, F.lit(one.name)).otherwise(chosen)
    for key, one in mappings(layouts).items():
        if one in nested:
            chosen = F.when(F.col(mark) == key, F.lit(one.name)).otherwise(chosen)
    layout = unused(records, "layout")
    out = out.withColumn(layout, chosen)
    result = F.lit(None).cast(TURNS)
    for one in nested:
        result = F.when(F.col(layout) == one.name, turns(one)).otherwise(result)
    return out.withColumn(unused(records, "turns"), result).select(*[F.col(f"`{c}`") for c in records.columns], F.col(mark).alias("fingerprint"), F.col(layout).alias("layout"), F.col(unused(records, "turns")).alias("turns"))


def turns_of_json(records: DataFrame, payload: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with ``fingerprint``, ``layout`` and ``turns`` of their JSON, each by its own fingerprint.

    A field that is null is there; an array's paths are those of all its elements, or all known
    ones if it is empty.  Columns of ``records`` with these three names are replaced.
    """
    records = records.drop(*({"fingerprint", "layout", "turns"} - {payload}))
    parsed = unused(records, "record")
    out, v = records.withColumn(parsed, F.try_parse_json(F.col(f"`{payload}`"))), F.col(parsed)
    has = {}
    for path in known_paths(layouts):
        name, _, inner = path.partition("[].")
        if inner:
            elements = F.try_variant_get(v, f"$.{name}", "array<variant>")
            has[path] = (F.size(elements) == 0) | F.exists(elements, lambda x: F.try_variant_get(x, f"$.{inner}", "variant").isNotNull())
        else:
            has[path] = F.try_variant_get(v, f"$.{name}", "variant").isNotNull()
    array = lambda name, role, text: F.try_variant_get(v, f"$.{name}", f"array<struct<`{role}`: string, `{text}`: string>>")
    return _selected(out, has, lambda one: _turns(one, array, lambda p: F.try_variant_get(v, f"$.{p}", "string")), layouts).drop(parsed)


def turns_of_records(records: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with ``fingerprint``, ``layout`` and ``turns`` of the struct column ``record``, each by its own fingerprint.

    Fields that are null are absent.  Columns of ``records`` with these three names are replaced.
    """
    records = records.drop(*({"fingerprint", "layout", "turns"} - {record}))
    own, there = F.col(f"`{record}`"), set(schema_paths(records.schema[record].dataType))
    has = {p: own[p.partition("[]")[0]].isNotNull() for p in known_paths(layouts) if p in there}
    array = lambda name, role, text: own[name]
    value = lambda p: own[p].cast("string") if p in there else F.lit(None).cast("string")
    return _selected(records, has, lambda one: _turns(one, array, value), layouts)


def turns_of_rows(rows: DataFrame, conversation: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``conversation``, ``layout`` and ``turns`` of a typed table, by the fingerprint of its schema."""
    one = layout_of(rows, layouts)
    if one is None:
        raise ValueError(f"no layout has the fields {schema_paths(rows.schema)}")
    if one.order:
        turn = F.struct(F.col(one.order).alias("turn"), F.coalesce(F.col(one.role), F.lit("")).alias("role"), F.coalesce(F.col(one.text), F.lit("")).alias("text"))
        gathered = rows.groupBy(F.col(conversation)).agg(F.sort_array(F.collect_list(turn)).alias("__turns"))
        turns = F.transform("__turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return gathered.select(conversation, F.lit(one.name).alias("layout"), turns.alias("turns"))
    present = set(schema_paths(rows.schema))
    array = lambda name, role, text: F.col(name)
    value = lambda p: F.col(p).cast("string") if p in present else F.lit(None).cast("string")
    return rows.select(conversation, F.lit(one.name).alias("layout"), _turns(one, array, value).alias("turns"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chat(conversations: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Replaces ``turns`` by ``formatted`` and ``loss_mask array<struct<segment, start, size>>``.

    ``segment`` counts from 1; ``start`` and ``size`` are code points after the segment's mark.
    """
    header = lambda t: F.concat(F.url_encode(t["role"]), F.lit("\n"))
    body = lambda t: F.concat(header(t), escaped(t["text"]), F.lit(f"{END}\n"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), body(t))), "")
    spans = F.transform("turns", lambda t, i: F.struct((i + 1).alias("segment"), F.length(header(t)).alias("start"), F.length(escaped(t["text"])).alias("size"), t["role"].alias("role")))
    chosen = F.filter(spans, lambda s: s["role"].isin(*trained))
    mask = F.transform(chosen, lambda s: F.struct(s["segment"].alias("segment"), s["start"].alias("start"), s["size"].alias("size")))
    return conversations.withColumns({"formatted": formatted, "loss_mask": mask}).drop("turns")


def read_chat(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` and ``loss_texts``, read back from ``formatted`` and ``loss_mask`` alone."""
    # Segment 0 is what stands before the first mark: nothing.
    segments = formatted.withColumn("__segments", F.split("formatted", r"<\|im_start\|>"))
    head = lambda s: F.substring_index(s, "\n", 1)
    inner = lambda s: F.substr(s, F.length(head(s)) + 2, F.length(s) - F.length(head(s)) - len(END) - 2)
    turns = F.transform(F.slice("__segments", 2, F.greatest(F.size("__segments") - 1, F.lit(0))), lambda s: F.struct(F.url_decode(head(s)).alias("role"), unescaped(inner(s)).alias("text")))
    texts = F.transform("loss_mask", lambda m: unescaped(F.substr(F.get("__segments", m["segment"]), m["start"] + 1, m["size"])))
    return segments.withColumns({"turns": turns, "loss_texts": texts}).drop("__segments")


def digests(read: DataFrame, conversation: str) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of what read_chat returns."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        conversation,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
