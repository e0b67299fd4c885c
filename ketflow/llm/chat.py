"""Chat formatting (operator 5): schema fingerprints select declarative mappings.

A *layout* is known by the fingerprint of its nested field paths.  ``LAYOUTS`` maps
each fingerprint to a declarative description of where roles and texts lie, and
``canonical_turns`` compiles that description into DataFrame expressions.  Two
sources of fingerprints exist: the schema of a DataFrame (one layout for the whole
table) and, for a column of JSON records of mixed layouts, the schema of each
record.  ``format_turns`` renders canonical turns with a template that marks turns
and escapes control strings reversibly, with the loss mask as spans of code points.

Everything is native DataFrame code.  The only shuffle is by conversation; the
running offset (window) and the collection of turns share it.  A conversation is
one output row with one digest, so its turns meet in one task by definition of the
result; the window streams and spills.

Edge cases: null texts and roles are empty; turns of equal number are ordered by
role, then text; rows with a null conversation id form one conversation; an empty
table gives no rows; repeated rows are repeated turns; columns besides the mapped
ones are ignored for layouts given by rows, and make an unknown layout of JSON
records, whose ``layout`` and ``turns`` are null.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- template ---------------------------------------------------------------

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
ESCAPE = "\\"
#: Strings with a meaning to this or to common chat templates; never left intact inside a text.
CONTROL = ("<|", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Double the escape sign and put one behind the first sign of every control string.

    No control string, hence no marker of the template, is left in the result.
    """
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """Exact inverse of ``escape``: an escape sign stands for the sign after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


# --- layouts ----------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record lie.

    kind ``rows``: one row a turn; ``id``/``order``/``role``/``text`` name columns.
    kind ``fields``: fixed roles; ``parts`` lists (role, field), empty fields are skipped if optional.
    kind ``list``: field ``items`` holds elements with ``role`` and ``text`` fields; ``aliases`` renames roles.
    """

    name: str
    kind: str
    paths: tuple[str, ...]
    parts: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    items: str = ""
    role: str = "role"
    text: str = "text"
    id: str = ""
    order: str = ""
    aliases: dict = field(default_factory=dict)


def fingerprint_of(paths) -> str:
    """Hash of the sorted nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Leaf paths of a schema; ``[]`` stands for the elements of an array."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, at + "[]")
    return [at]


_SHAREGPT = {"human": "user", "gpt": "assistant", "system": "system"}
LAYOUTS: tuple[Layout, ...] = (
    Layout("turn_rows", "rows", ("conv_id", "turn", "role", "text"), id="conv_id", order="turn"),
    Layout("prompt_completion", "fields", ("prompt", "completion"), parts=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", "fields", ("prompt", "response"), parts=(("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", "fields", ("question", "answer"), parts=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", "fields", ("instruction", "output"), parts=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", "fields", ("instruction", "input", "output"), parts=(("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    Layout("system_instruction", "fields", ("system", "instruction", "output"), parts=(("system", "system"), ("user", "instruction"), ("assistant", "output")), optional=("system",)),
    Layout("messages", "list", ("messages[].role", "messages[].content"), items="messages", role="role", text="content"),
    Layout("conversations", "list", ("conversations[].from", "conversations[].value"), items="conversations", role="from", text="value", aliases=_SHAREGPT),
)
BY_FINGERPRINT = {fingerprint_of(x.paths): x for x in LAYOUTS}


def layout_of(df: DataFrame) -> Layout:
    """The layout of a DataFrame; extra top-level columns beside a known layout are allowed.

    The exact fingerprint decides; failing that, the one known layout whose paths all
    occur and that uses the most of them.  ``ValueError`` if there is none.
    """
    paths = set(field_paths(df.schema))
    if hit := BY_FINGERPRINT.get(fingerprint_of(paths)):
        return hit
    inside = sorted((x for x in LAYOUTS if set(x.paths) <= paths), key=lambda x: (-len(x.paths), x.name))
    if not inside:
        raise ValueError(f"no layout has the field paths {sorted(paths)}")
    return inside[0]


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _alias(role: Column, aliases: dict) -> Column:
    out = role
    for old, new in aliases.items():
        out = F.when(role == old, F.lit(new)).otherwise(out)
    return out


def _record_turns(layout: Layout, get) -> Column:
    """Array of turns of one record; ``get(path)`` gives a field."""
    if layout.kind == "list":
        return F.transform(get(layout.items), lambda m: _turn(_alias(m[layout.role], layout.aliases), m[layout.text]))
    turns = F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(get(p), F.lit("")).alias("text"), F.lit(p in layout.optional).alias("skip")) for r, p in layout.parts])
    kept = F.filter(turns, lambda t: ~(t["skip"] & (t["text"] == "")))
    return F.transform(kept, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def canonical_turns(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Rows (conv_id, turn, role, text) of a table in any known layout.

    ``id_col`` names the record id of layouts that hold a whole conversation in a row.
    """
    layout = layout_of(df)
    if layout.kind == "rows":
        return df.select(F.col(layout.id).alias("conv_id"), F.col(layout.order).cast("long").alias("turn"), F.coalesce(F.col(layout.role), F.lit("")).alias("role"), F.coalesce(F.col(layout.text), F.lit("")).alias("text"))
    turns = df.select(F.col(id_col).alias("conv_id"), F.posexplode(_record_turns(layout, F.col)).alias("turn", "t"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


_JSON = "ARRAY<STRUCT<role: STRING, text: STRING>>"


def canonical_records(df: DataFrame, json_col: str) -> DataFrame:
    """Add ``layout`` and ``turns`` to rows whose ``json_col`` holds records of mixed layouts.

    Each record's own nested field paths are fingerprinted (the schema of its variant
    with the types erased); unknown or broken records get null in both columns.
    """
    shape = F.schema_of_variant(F.try_parse_json(F.col(json_col)))
    bare = F.regexp_replace(shape, r": (STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DECIMAL\(\d+,\d+\))", "")
    print_of = F.substring(F.sha2(bare, 256), 1, 16)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(_JSON)
    for x in LAYOUTS:
        if x.kind == "rows":
            continue
        fields = sorted({p.split("[]")[0] for p in x.paths})
        if x.kind == "list":
            shape_text = f"OBJECT<{x.items}: ARRAY<OBJECT<{', '.join(sorted((x.role, x.text)))}>>>"
            ddl = f"STRUCT<{x.items}: ARRAY<STRUCT<`{x.role}`: STRING, `{x.text}`: STRING>>>"
        else:
            shape_text = f"OBJECT<{', '.join(fields)}>"
            ddl = "STRUCT<" + ", ".join(f"`{f}`: STRING" for f in fields) + ">"
        mine = print_of == hashlib.sha256(shape_text.encode()).hexdigest()[:16]
        record = F.from_json(F.col(json_col), ddl)
        layout = F.when(mine, F.lit(x.name)).otherwise(layout)
        turns = F.when(mine, _record_turns(x, lambda p, r=record: r[p]).cast(_JSON)).otherwise(turns)
    return df.withColumn("layout", layout).withColumn("turns", turns)


# --- formatting and reading back --------------------------------------------


def format_turns(turns: DataFrame) -> DataFrame:
    """One row a conversation: ``formatted`` and ``loss_spans`` (start, length in code points of each assistant text)."""
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    rows = turns.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
    size = F.char_length("head") + F.char_length("body") + len(END)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(
        "conv_id",
        F.row_number().over(order).alias("k"),
        F.concat("head", "body", F.lit(END)).alias("piece"),
        F.when(
            F.col("role") == LOSS_ROLE,
            F.struct((F.coalesce(F.sum(size).over(before), F.lit(0)) + F.char_length("head")).alias("start"), F.char_length("body").cast("long").alias("length")),
        ).alias("span"),
    )
    all_rows = F.array_sort(F.collect_list(F.struct("k", "piece", "span")))
    return placed.groupBy("conv_id").agg(all_rows.alias("p")).select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("p", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text) parsed from a formatted conversation."""
    quote = lambda s: s.replace("|", r"\|")
    parts = F.filter(F.split(formatted, quote(TURN)), lambda x, i: i > 0)
    fields = F.transform(parts, lambda x: F.split(x, f"{quote(TEXT)}|{quote(END)}"))
    return F.transform(fields, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, derived from the operator's output."""
    back = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def oracle() -> str:
    """DuckDB SQL of the query, from the table's own rows (nothing is formatted but for the length)."""
    esc = "replace({x}, chr(92), chr(92) || chr(92))"
    for c in CONTROL:
        esc = f"replace({esc}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    role, text = esc.replace("{x}", "role"), esc.replace("{x}", "text")
    fixed = len(TURN) + len(TEXT) + len(END)
    return f"""
    WITH r AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*)::BIGINT AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           sum(CASE WHEN role = '{LOSS_ROLE}' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256,
           sum(length({role}) + length({text}) + {fixed})::BIGINT AS formatted_chars
    FROM r GROUP BY conv_id"""
