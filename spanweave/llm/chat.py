"""Chat formatting: schema fingerprints select declarative mappings; DataFrame functions only.

A record is a JSON text in any of the known layouts. The nested field paths that it holds are read from the record itself and
hashed; the hash selects the mapping that turns the record into canonical turns (role, content). Turns are then written in one
template whose marks cannot occur inside an escaped text, with a loss mask over the assistant's texts, and can be read
back exactly.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Fixed template marks: user, assistant, any other role (opened and closed around its name), end of turn.
USER, ASSISTANT, ROLE, ROLE_END, END = "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "</s>"

#: Lists of turns and their two fields; fields that hold a text or such a list; fields that hold a text.
LISTS = {"messages": ("role", "content"), "conversations": ("from", "value"), "turns": ("speaker", "text")}
EITHER = {"prompt": ("role", "content"), "completion": ("role", "content"), "response": ("role", "content")}
TEXTS = ("system", "instruction", "input", "output", "question", "answer")
_NESTED = LISTS | EITHER
#: How records are read that Spark's variant type cannot hold (too long, repeated keys).
_FIELDS = ", ".join([f"`{f}` array<struct<`{a}`:string,`{b}`:string>>" for f, (a, b) in LISTS.items()] + [f"{f} string" for f in (*EITHER, *TEXTS)])
_LONG = "map('maxStringLen', '2147483647')"
#: Layout -> the fields that make its turns, with the role of each (lists bring their own).
_BASE = {
    "messages": (("messages", ""),),
    "conversations": (("conversations", ""),),
    "turns": (("turns", ""),),
    "prompt_completion": (("prompt", "user"), ("completion", "assistant")),
    "prompt_response": (("prompt", "user"), ("response", "assistant")),
    "instruction_output": (("instruction", "user"), ("output", "assistant")),
    "instruction_input_output": (("instruction", "user"), ("input", "user"), ("output", "assistant")),
    "question_answer": (("question", "user"), ("answer", "assistant")),
}
LAYOUTS = _BASE | {f"system_{k}": (("system", "system"), *v) for k, v in _BASE.items()}
#: Names of roles that mean the same.
ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _paths_of(field: str) -> list[list[str]]:
    """The paths that a record may hold for one field: a text, or a list whose turns have both fields, one or none."""
    two = [f"{field}[].{x}" for x in _NESTED.get(field, ())]
    lists = [[f"{field}[]", *some] for n in range(3) for some in itertools.combinations(two, n)] if two else []
    return lists if field in LISTS else [[field], *lists]


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()


def _escape(c: Column) -> Column:
    """A backslash after each of < [ and backslash: no mark can then occur in the text."""
    return F.regexp_replace(c, r"([<\[\\])", r"$1\\")


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])\\", "$1")


#: Fingerprint -> layout.
MAPPINGS = {fingerprint_of([p for x in paths for p in x]): name for name, fields in LAYOUTS.items() for paths in itertools.product(*(_paths_of(f) for f, _ in fields))}


def _text(x: str) -> str:
    """Text of a variant: parts of a list joined (their `text`, or the part itself if it is one), null if null."""
    part = "coalesce(if(schema_of_variant(p) like 'OBJECT%', try_variant_get(p, '$.text', 'string'), try_variant_get(p, '$', 'string')), '')"
    return f"if(schema_of_variant({x}) like 'ARRAY%', array_join(transform(try_variant_get({x}, '$', 'array<variant>'), p -> {part}), ''), try_variant_get({x}, '$', 'string'))"


def _turns_in(field: str) -> str:
    """The list of turns (a, b: role and text, has_a, has_b) under a field; null if it is no list of objects."""
    a, b = _NESTED[field]
    objects = f"transform(try_variant_get(m['{field}'], '$', 'array<variant>'), e -> try_variant_get(e, '$', 'map<string,variant>'))"
    turn = f"o -> named_struct('a', {_text(f'o[{a!r}]')}, 'b', {_text(f'o[{b!r}]')}, 'has_a', map_contains_key(o, '{a}'), 'has_b', map_contains_key(o, '{b}'))"
    out = f"if(schema_of_variant(m['{field}']) like 'ARRAY%' and not exists({objects}, o -> o is null), transform({objects}, {turn}), null)"
    if field in LISTS:
        out = f"coalesce({out}, transform(r.`{field}`, t -> named_struct('a', t.`{a}`, 'b', t.`{b}`, 'has_a', true, 'has_b', true)))"
    return out


def format_chats(records: DataFrame, keys: list[str], record: str = "record", aliases: dict[str, str] | None = None) -> DataFrame:
    """`keys`, fingerprint, layout, problem, formatted, mask (per turn: characters of its opening mark, of its text, and if
    loss counts).

    A key of the record counts as present even if its value is null; a null role or text is empty, a missing role of a
    turn too; an empty list has no turns; a list of content parts is the text of its parts. `prompt`, `completion` and
    `response` may be lists of turns. An empty `input` adds nothing to the instruction. Fields outside the known ones
    are ignored. `problem`: 'null', 'malformed' (no JSON object) or 'unknown' (paths that no mapping has), with layout
    null, formatted and mask empty; else null. `aliases` renames roles (default: none but for the `from`/`value` and
    `speaker` layouts, where ALIASES holds). Rows stay as they are: repeated ones repeat. Keys may have any name.
    """
    inner = [fresh("key") for _ in keys]
    r = records.select(*(F.col(k).alias(x) for k, x in zip(keys, inner, strict=True)), F.col(record).cast("string").alias("rec"), F.try_parse_json(F.col(record).cast("string")).alias("v"))
    r = r.select(*inner, "rec", "v", F.expr("try_variant_get(v, '$', 'map<string,variant>')").alias("m"), F.expr(f"if(v is null, from_json(rec, '{_FIELDS}', {_LONG}), null)").alias("r"))
    r = r.withColumn("present", F.expr(f"if(v is null, map_keys(from_json(rec, 'map<string,string>', {_LONG})), map_keys(m))"))
    r = r.select(
        *inner, "rec", "present", *(F.expr(_turns_in(f)).alias(f"list_{f}") for f in _NESTED),
        *(F.expr(f"coalesce({_text(f'm[{f!r}]')}, r.{f}, '')").alias(f"text_{f}") for f in (*EITHER, *TEXTS)),
    )
    path = []
    for f in (*_NESTED, *TEXTS):
        there = f"array_contains(present, '{f}')"
        if f in _NESTED:
            path.append(f"if({there} and list_{f} is not null, '{f}[]', null)")
            path += [f"if({there} and exists(list_{f}, t -> t.has_{x}), '{f}[].{name}', null)" for x, name in zip("ab", _NESTED[f], strict=True)]
            there += f" and list_{f} is null"
        path.append(f"if({there}, '{f}', null)")
    r = r.withColumn("fingerprint", F.sha2(F.array_join(F.array_sort(F.array_compact(F.array(*map(F.expr, path)))), ","), 256))
    known = F.create_map(*(F.lit(x) for pair in MAPPINGS.items() for x in pair))
    r = r.withColumn("layout", F.try_element_at(known, F.col("fingerprint")))

    def part(f: str, role: str) -> str:
        one = f"array(named_struct('role', '{role}', 'content', {'concat(text_instruction, if(text_input = %r, %r, concat(%r, text_input)))' % ('', '', chr(10) * 2) if f == 'asked' else 'text_' + f if f not in LISTS else repr('')}))"
        return f"coalesce(transform(list_{f}, t -> named_struct('role', coalesce(t.a, if(t.has_a, '', '{role}')), 'content', coalesce(t.b, ''))), {one})" if f in _NESTED else one

    turns = F.expr("cast(array() as array<struct<role:string,content:string>>)")
    for name, fields in LAYOUTS.items():
        if "input" in (f for f, _ in fields):
            fields = [("asked" if f == "instruction" else f, role) for f, role in fields if f != "input"]
        turns = F.when(F.col("layout") == name, F.expr(f"concat({', '.join(part(f, role) for f, role in fields)})")).otherwise(turns)
    named = {True: ALIASES | (aliases or {}), False: aliases or {}}
    informal = F.col("layout").rlike("conversations|turns")

    def renamed(role: Column, also: bool) -> Column:
        out = role
        for a, b in named[also].items():
            out = F.when(role == a, F.lit(b)).otherwise(out)
        return out

    def shaped(t: Column) -> Column:
        role = F.when(informal, renamed(t["role"], True)).otherwise(renamed(t["role"], False))
        return F.struct(role.alias("role"), _escape(t["content"]).alias("text"))

    def opened(t: Column) -> Column:
        other = F.concat(F.lit(ROLE), _escape(t["role"]), F.lit(ROLE_END))
        mark = F.when(t["role"] == "user", F.lit(USER)).when(t["role"] == "assistant", F.lit(ASSISTANT)).otherwise(other)
        return F.struct(mark.alias("open"), t["text"].alias("text"), (t["role"] == "assistant").alias("loss"))

    r = r.withColumn("shaped", F.transform(turns, shaped)).withColumn("opened", F.transform("shaped", opened))
    problem = F.when(F.col("rec").isNull(), "null").when(F.col("present").isNull(), "malformed").when(F.col("layout").isNull(), "unknown")
    return r.select(
        *(F.col(x).alias(k) for k, x in zip(keys, inner, strict=True)), "fingerprint", "layout", problem.alias("problem"),
        F.array_join(F.transform("opened", lambda t: F.concat(t["open"], t["text"], F.lit(END))), "").alias("formatted"),
        F.transform("opened", lambda t: F.struct(F.length(t["open"]).alias("open"), F.length(t["text"]).alias("chars"), t["loss"].alias("loss"))).alias("mask"),
    )


def read_back(formatted: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, formatted, turns (role, text; parsed from `formatted` alone) and loss_text (what stands under the mask), unescaped."""
    pieces = F.split("formatted", END, -1)
    f = formatted.withColumn("pieces", F.slice(pieces, 1, F.size(pieces) - 1))
    role = lambda p: F.when(p.startswith(USER), F.lit("user")).when(p.startswith(ASSISTANT), F.lit("assistant")).otherwise(_unescape(F.regexp_extract(p, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)))
    body = lambda p: F.regexp_replace(p, r"(?s)^(?:\[INST\]|\[/INST\]|\[ROLE\].*?\[/ROLE\])", "")
    under = F.filter(F.arrays_zip("pieces", "mask"), lambda z: z["mask"]["loss"])
    return f.select(
        *keys, "formatted",
        F.transform("pieces", lambda p: F.struct(role(p).alias("role"), _unescape(body(p)).alias("text"))).alias("turns"),
        F.array_join(F.transform(under, lambda z: _unescape(z["pieces"].substr(z["mask"]["open"] + 1, z["mask"]["chars"]))), "").alias("loss_text"),
    )


def records_of_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations stored by turn -> (conv_id, record) in the messages layout, by turn, ties by role, then text.

    A conversation is one row of the output, so its turns are gathered; conversations are bounded by what one row may
    hold. Rows with a null conversation id form one conversation.
    """
    t = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    g = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(t)).alias("t"))
    return g.select("conv_id", F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))).alias("record"))
