"""Chat formatting by schema fingerprints.

Records of many layouts lie in one table with the union of their fields. The
nested paths that are not null inside a record are hashed, as far as any layout
names them; that fingerprint selects a declarative mapping from the layout to
canonical turns (role, text). Turns are written with a template whose marks cannot occur in a
text: control strings inside texts are escaped, reversibly. Only DataFrame
functions are used.

Defined results: a null or missing text is an empty text, a null role an empty
role; a record with no known layout has no turns and the fingerprint 0; fields that
no layout names, in a record or inside its lists, change nothing; a
record may have any other columns, which stay; columns with the name of an
added column are replaced; rows are formatted one by one, repeated or not. A whole
conversation is one output string, so its turns meet in one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marks of this template, and strings other templates give a meaning.
TURN, END = "<|turn|>", "<|end|>"
CONTROL = r"(?<=<)(?=\||/?s>|</?SYS>>|<SYS>>)|(?<=\[)(?=/?INST\])"
ESCAPED = r"(?<=[<\[])\\(?=[|/s<I])"
LEARNT_ROLE = "assistant"
TURNS = "array<struct<role:string,text:string>>"
ADDED = ["fingerprint", "formatted", "n_turns", "loss_spans"]


def escape(text: Column) -> Column:
    """Backslashes doubled, and one put inside every control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"\\")


def escape_role(role: Column) -> Column:
    """As `escape`, and on one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, ESCAPED, ""), F.lit("\\\\"), F.lit("\\"))


@dataclass(frozen=True)
class Layout:
    """A layout by the paths that its records hold, and those they may hold; `[]` is a list, empty or not.

    `turns` makes an array of (role, text) from the columns.
    """

    paths: tuple[str, ...]
    turns: Callable[[], Column]
    optional: tuple[str, ...] = ()

    def fingerprints(self) -> list[tuple[str, ...]]:
        """The sets of paths that select this layout."""
        return [tuple(sorted((*self.paths, *more))) for k in range(len(self.optional) + 1)
                for more in combinations(self.optional, k)]


def _turn(role, text) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"),
                    F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def list_layout(column: str, role: str, text: str, required: tuple[str, ...] = ()) -> Layout:
    """A list of turns; a turn may lack its role or text, but for the `required` fields, which some turn holds."""
    field = lambda name: f"{column}[].{name}"
    return Layout((f"{column}[]", *map(field, required)),
                  lambda: F.transform(F.col(column), lambda m: _turn(m[role], m[text])),
                  tuple(field(name) for name in (role, text) if name not in required))


def _of_fields(*pairs: tuple[str, str]) -> Callable[[], Column]:
    return lambda: F.array(*[_turn(role, F.col(field)) for role, field in pairs])


def _of_instruction(answer: str, given: bool) -> Callable[[], Column]:
    asked = lambda: F.concat_ws("\n\n", "instruction", "input") if given else F.col("instruction")
    return lambda: F.array(_turn("user", asked()), _turn("assistant", F.col(answer)))


LAYOUTS = [
    list_layout("messages", "role", "content"),
    list_layout("conversations", "from", "value"),
    list_layout("turns", "speaker", "text"),
    Layout(("completion", "prompt"), _of_fields(("user", "prompt"), ("assistant", "completion"))),
    Layout(("prompt", "response"), _of_fields(("user", "prompt"), ("assistant", "response"))),
    Layout(("prompt", "response", "system"), _of_fields(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout(("instruction", "output"), _of_instruction("output", False)),
    Layout(("input", "instruction", "output"), _of_instruction("output", True)),
]


def held_paths(kind: T.DataType) -> list[tuple[str, Callable[[Column], Column]]]:
    """(path below a value of this type, whether the value holds anything there)."""
    def inside(name: str, holds: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda value: holds(value[name])

    def anywhere(holds: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda value: F.exists(value, lambda item: holds(item))

    if isinstance(kind, T.StructType):
        return [(f".{f.name}{path}", inside(f.name, holds)) for f in kind for path, holds in held_paths(f.dataType)]
    whole = lambda value: value.isNotNull()
    if isinstance(kind, T.ArrayType):
        return [("[]", whole), *[(f"[]{path}", anywhere(holds)) for path, holds in held_paths(kind.elementType) if path]]
    return [("", whole)]


def path_hash(paths: list[Column]) -> Column:
    return F.xxhash64(F.concat_ws("|", *paths))


def canonical(records: DataFrame, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """`records` with the layout's fingerprint and its turns."""
    named = {p for layout in layouts for p in (*layout.paths, *layout.optional)}
    holds = {f"{f.name}{path}": is_held(F.col(f"`{f.name}`")) for f in records.schema
             for path, is_held in held_paths(f.dataType) if f"{f.name}{path}" in named}
    marks = [F.when(holds[p], F.lit(p)) for p in sorted(holds)]
    held = records.withColumn("fingerprint", path_hash(marks) if marks else F.lit(0).cast("long"))
    known = [x for x in layouts if {*x.paths, *x.optional} <= set(holds)]
    chosen = F.lit(None).cast(TURNS)
    for layout in known:
        own = [F.col("fingerprint") == path_hash([F.lit(p) for p in paths]) for paths in layout.fingerprints()]
        chosen = F.when(reduce(lambda a, b: a | b, own), layout.turns().cast(TURNS)).otherwise(chosen)
    held = held.withColumn("turns", chosen)
    return held.withColumn("fingerprint", F.when(F.col("turns").isNotNull(), F.col("fingerprint")).otherwise(0)) \
        .withColumn("turns", F.coalesce("turns", F.array().cast(TURNS)))


def formatted(records: DataFrame, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """`records` with the formatted text and the spans under the loss mask.

    A span is (turn, start, length) in code points from the mark that opens the turn.
    """
    held = canonical(records, layouts)
    opened = lambda t: F.concat(F.lit(TURN), escape_role(t["role"]), F.lit("\n"))
    written = held.withColumn("turns_", F.transform("turns", lambda t: F.struct(
        opened(t).alias("head"), escape(t["text"]).alias("text"), (t["role"] == LEARNT_ROLE).alias("learnt"))))
    spans = F.transform("turns_", lambda t, i: F.struct(
        t["learnt"].alias("learnt"), i.alias("turn"), F.length(t["head"]).alias("start"), F.length(t["text"]).alias("length")))
    added = {
        "formatted": F.array_join(F.transform("turns_", lambda t: F.concat(t["head"], t["text"], F.lit(END))), ""),
        "n_turns": F.size("turns_").cast("long"),
        "loss_spans": F.transform(F.filter(spans, lambda s: s["learnt"]),
                                  lambda s: F.struct(s["turn"], s["start"], s["length"])),
    }
    kept = [F.col(f"`{c}`") for c in records.columns if c not in ADDED]
    return written.select(*kept, "fingerprint", *[e.alias(n) for n, e in added.items()])


def read_back(output: DataFrame) -> DataFrame:
    """`output` with the turns found in the formatted text, and the text under the loss mask, both unescaped."""
    pieces = F.filter(F.split("formatted", r"(?=<\|turn\|>)"), lambda p: p != "")
    held = output.withColumn("pieces_", pieces)
    body = lambda p: F.substring(p, F.lit(len(TURN) + 1), F.length(p) - len(TURN) - len(END))
    parsed = F.transform("pieces_", lambda p: F.struct(
        unescape_role(F.substring_index(body(p), "\n", 1)).alias("role"),
        unescape(F.substring(body(p), F.length(F.substring_index(body(p), "\n", 1)) + 2, F.length(p))).alias("text")))
    learnt = F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("pieces_")[s["turn"]], s["start"] + 1, s["length"])))
    return held.withColumn("parsed", parsed).withColumn("learnt", F.array_join(learnt, "")).drop("pieces_")


def by_conversation(rows: DataFrame) -> DataFrame:
    """(conv_id, messages) of a table with a row per turn, in order of turn, then role and text."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("messages")).select(
        "conv_id", F.transform("messages", lambda m: F.struct(m["role"], m["content"])).alias("messages"))


def in_layouts(conversations: DataFrame) -> DataFrame:
    """The same conversations in the eight layouts, as far as their shape allows, as one table.

    An instruction with a blank line becomes an instruction and an input.
    """
    roles = F.transform("messages", lambda m: m["role"])
    like = lambda *names: roles == F.array(*map(F.lit, names))
    said = lambda i: F.get("messages", F.lit(i))["content"]
    blank = F.instr(said(0), "\n\n")
    turn = F.pmod("conv_id", F.lit(12))
    pick = F.when(like("system", "user", "assistant"), "system").when(
        ~like("user", "assistant"), F.element_at(F.array(*map(F.lit, ["messages", "from", "speaker"])), (turn % 3 + 1).cast("int"))
    ).when(turn % 3 == 0, "completion").when(turn % 3 == 1, "prompt").when(blank > 0, "input").otherwise("instruction")
    rows = conversations.withColumn("layout_", F.when(turn.isNull(), "messages").otherwise(pick))
    only = lambda names, value: F.when(F.col("layout_").isin(names), value)
    renamed = lambda role, text: F.transform(
        "messages", lambda m: F.struct(m["role"].alias(role), m["content"].alias(text)))
    answer = F.element_at("messages", -1)["content"]
    return rows.select(
        "conv_id", only(["messages"], F.col("messages")).alias("messages"),
        only(["from"], renamed("from", "value")).alias("conversations"),
        only(["speaker"], renamed("speaker", "text")).alias("turns"),
        only(["system"], said(0)).alias("system"),
        only(["system", "prompt", "completion"], F.when(F.col("layout_") == "system", said(1)).otherwise(said(0))).alias("prompt"),
        only(["system", "prompt"], answer).alias("response"), only(["completion"], answer).alias("completion"),
        only(["instruction", "input"], F.when(F.col("layout_") == "input", F.substring(said(0), F.lit(1), blank - 1))
             .otherwise(said(0))).alias("instruction"),
        only(["input"], F.substring(said(0), blank + 2, F.length(said(0)))).alias("input"),
        only(["instruction", "input"], answer).alias("output"))


def digests(output: DataFrame) -> DataFrame:
    """What `read_back` finds, as digests."""
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(output).select(
        "conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
