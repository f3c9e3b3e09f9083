"""Chat formatting: records of several layouts become canonical turns, then one training text each.

Layouts: a record is a JSON object. The hash of its nested field paths, types left out and fields outside PATHS ignored,
is its fingerprint, and MAPPINGS, a declarative table, says for each known fingerprint which expressions give its turns.
A record of an unknown fingerprint keeps its row, with null turns and the fingerprint to write a mapping for.

Template: a user turn is `<s>[INST] text [/INST]</s>`, an assistant turn `<s>text</s>`, any other `<s>[ROLE] role [/ROLE]text</s>`.
Inside roles and texts a backslash becomes `\\e`, and the first character of a control string `\\l` for `<` and `\\b` for
`[`, so no control string is left and each text can be read back. The loss mask covers the assistant texts.

Defined cases: a null role or text is an empty one; a null or malformed record has null turns; no turns give an empty
text; repeated rows each get a row; an empty table gives no rows. Rows of conversations are put in order of turn, then
role, then text, a null turn first. DataFrame operations alone are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role: string, text: string>"


def _turns(*pairs: tuple[str, str]) -> str:
    """SQL of an array of turns from (role, expression); turns whose text is missing are left out."""
    turns = ", ".join(f"named_struct('role', '{role}', 'text', {text})" for role, text in pairs)
    return f"filter(array({turns}), t -> t.text is not null)"


def _each(path: str, role: str, text: str) -> str:
    return f"transform(variant_get(payload, '$.{path}', 'array<struct<{role}: string, {text}: string>>'), m -> named_struct('role', m.{role}, 'text', m.{text}))"


def _get(path: str) -> str:
    return f"try_variant_get(payload, '$.{path}', 'string')"


def _none(path: str) -> str:
    """No turns of a list that is empty or null; null turns where it holds what no layout describes."""
    return f"case when is_variant_null(try_variant_get(payload, '$.{path}', 'variant')) or size(try_variant_get(payload, '$.{path}', 'array<variant>')) = 0 then array() end"


#: Layouts: the field paths that make the fingerprint, and SQL for the turns. Roles' other names are in ROLES.
MAPPINGS: list[tuple[tuple[str, ...], str]] = [
    (("messages[].content", "messages[].role"), _each("messages", "role", "content")),
    (("messages[].role", "messages[].text"), _each("messages", "role", "text")),
    (("conversations[].from", "conversations[].value"), _each("conversations", "from", "value")),
    (("messages",), _none("messages")),
    (("conversations",), _none("conversations")),
    (("prompt", "response"), _turns(("user", _get("prompt")), ("assistant", _get("response")))),
    (("completion", "prompt"), _turns(("user", _get("prompt")), ("assistant", _get("completion")))),
    (("prompt", "response", "system"), _turns(("system", _get("system")), ("user", _get("prompt")), ("assistant", _get("response")))),
    (("instruction", "output"), _turns(("user", _get("instruction")), ("assistant", _get("output")))),
    (("input", "instruction", "output"), _turns(("user", f"concat_ws('\\n\\n', {_get('instruction')}, nullif({_get('input')}, ''))"), ("assistant", _get("output")))),
    (("answer", "question"), _turns(("user", _get("question")), ("assistant", _get("answer")))),
]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
PATHS = sorted({p for paths, _ in MAPPINGS for p in paths})


def _inside(outer: str) -> Callable[[Column], Column]:
    return lambda name: F.concat(F.lit(f"{outer}[]."), name)


def paths(payload: str = "payload") -> Column:
    """Sorted known field paths of a variant column: names, with [] for array elements, of its top level and one below.

    A field whose value is null or an empty array is named without what it would hold.
    """
    top = F.map_keys(F.expr(f"try_variant_get({payload}, '$', 'map<string, variant>')"))

    def below(name: Column) -> Column:
        found = []
        for outer in sorted({p.split("[]")[0] for p in PATHS if "[]" in p}):
            first = F.expr(f"flatten(transform(try_variant_get({payload}, '$.{outer}', 'array<map<string, variant>>'), m -> map_keys(m)))")
            found.append(F.when(name == outer, F.when(F.size(first) > 0, F.transform(F.array_distinct(first), _inside(outer))).otherwise(F.array(name))))
        return F.coalesce(*found, F.array(name))

    every = F.flatten(F.transform(top, below))
    return F.array_sort(F.filter(F.array_distinct(every), lambda p: p.isin(PATHS)))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.concat_ws("\n", paths))


def canonical(records: DataFrame, payload: str = "payload") -> DataFrame:
    """records with fingerprint and turns, from their JSON column."""
    parsed = records.withColumn("payload", F.try_parse_json(payload))
    parsed = parsed.withColumn("fingerprint", fingerprint(paths()))
    turns = F.lit(None).cast(f"array<{TURN}>")
    for known, sql in reversed(MAPPINGS):
        turns = F.when(F.col("fingerprint") == fingerprint(F.array(*map(F.lit, known))), F.expr(sql).cast(f"array<{TURN}>")).otherwise(turns)
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])

    def clean(t):
        role = F.coalesce(t.role, F.lit(""))
        return F.struct(F.coalesce(names[role], role).alias("role"), F.coalesce(t.text, F.lit("")).alias("text"))

    return parsed.withColumn("turns", turns).withColumn("turns", F.transform("turns", clean)).drop("payload")


def escape(text: Column) -> Column:
    x = F.replace(text, F.lit("\\"), F.lit("\\e"))
    x = F.regexp_replace(x, r"<(?=/?s>)", r"\\l")
    return F.regexp_replace(x, r"\[(?=/?(INST|ROLE)\])", r"\\b")


def unescape(text: Column) -> Column:
    x = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.replace(x, F.lit("\\e"), F.lit("\\"))


def formatted(turns: Column) -> Column:
    """The training text of turns."""

    def one(t):
        text = escape(t.text)
        inner = F.when(t.role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]"))).when(t.role == "assistant", text)
        return F.concat(F.lit("<s>"), F.coalesce(inner, F.concat(F.lit("[ROLE] "), escape(t.role), F.lit(" [/ROLE]"), text)), F.lit("</s>"))

    return F.array_join(F.transform(turns, one), "")


def read_back(text: Column) -> Column:
    """The turns of a training text."""
    pieces = F.filter(F.split(text, "</s>"), lambda p: p != "")

    def one(p):
        body = F.substr(p, F.lit(4))
        user, other = body.startswith("[INST] "), body.startswith("[ROLE] ")
        inner = F.when(user, F.substr(body, F.lit(8), F.length(body) - 15)).when(other, F.substring_index(body, " [/ROLE]", -1)).otherwise(body)
        role = F.when(user, F.lit("user")).when(other, unescape(F.substr(F.substring_index(body, " [/ROLE]", 1), F.lit(8)))).otherwise(F.lit("assistant"))
        return F.struct(role.alias("role"), unescape(inner).alias("text"))

    return F.transform(pieces, one)


def loss_spans(turns: Column) -> Column:
    """(start, end) in the training text, in characters, of each assistant text."""
    pieces = F.transform(turns, lambda t: F.struct((t.role == "assistant").alias("own"), F.length(formatted(F.array(t))).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def add(s, p):
        span = F.struct((s.at + 3).alias("start"), (s.at + p.n - 4).alias("end"))
        return F.struct((s.at + p.n).alias("at"), F.when(p.own, F.concat(s.spans, F.array(span))).otherwise(s.spans).alias("spans"))

    return F.aggregate(pieces, start, add, lambda s: s.spans)


def chat_format(records: DataFrame, payload: str = "payload") -> DataFrame:
    """records without their JSON column, with fingerprint, turns, formatted and loss_spans."""
    out = canonical(records, payload)
    return out.withColumn("formatted", formatted(F.col("turns"))).withColumn("loss_spans", loss_spans(F.col("turns")))


def conversations_as_records(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """A record (key, payload) of the messages layout for each conversation of rows (key, turn, role, text)."""
    empty: Callable[[str], Column] = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.struct("turn", empty("role").alias("role"), empty("text").alias("content"))
    order = F.sort_array(F.collect_list(turn))
    messages = F.transform(order, lambda m: F.struct(m.role.alias("role"), m.content.alias("content")))
    return conversations.groupBy(key).agg(messages.alias("messages")).select(key, F.to_json(F.struct("messages")).alias("payload"))


def digest(done: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the training text and its mask."""
    back = read_back(F.col("formatted"))
    said = F.array_join(F.transform("back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = unescape(F.array_join(F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), s.start + 1, s.end - s.start)), ""))
    done = done.withColumn("back", back).withColumn("loss", loss)
    return done.select(key, F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "fingerprint")
