"""Chat layouts told apart by what each record holds."""

from pyspark.sql import functions as F

from cellhour.llm import chat


def turns_of(out):
    return {r.id: [(t.role, t.text) for t in r.parsed] for r in chat.read_back(out).collect()}


def test_fields_that_no_layout_names_lose_nothing(spark):
    item = "struct<role:string,content:string,name:string>"
    rows = [(1, [("user", "hi", None), ("assistant", "ho", None)]), (2, [("user", "hi", "Ann")]),
            (3, [("user", None, None)]), (4, [(None, None, None), (None, "x", None)]), (5, []), (6, None),
            (1, [("user", "hi", None), ("assistant", "ho", None)])]
    out = chat.formatted(spark.createDataFrame(rows, f"id long, messages array<{item}>"))
    assert turns_of(out) == {1: [("user", "hi"), ("assistant", "ho")], 2: [("user", "hi")], 3: [("user", "")],
                             4: [("", ""), ("", "x")], 5: [], 6: []}
    assert {r.id for r in out.where("fingerprint = 0").collect()} == {6} and out.count() == len(rows)


def test_two_layouts_in_one_column(spark):
    item = "struct<role:string,content:string,from:string,value:string>"
    layouts = [*chat.LAYOUTS, chat.list_layout("messages", "from", "value", ("from",))]
    rows = [(1, [("user", "hi", None, None)]), (2, [(None, None, "human", "hi"), (None, None, "gpt", None)])]
    out = chat.formatted(spark.createDataFrame(rows, f"id long, messages array<{item}>"), layouts)
    assert turns_of(out) == {1: [("user", "hi")], 2: [("human", "hi"), ("gpt", "")]}


def test_conversations_take_all_eight_layouts_and_come_back(spark):
    said = {(i, shape): turns for i in range(12) for shape, turns in enumerate([
        [("user", "a\n\nb\n\n" if i % 2 else "a"), ("assistant", "c")],
        [("system", "s"), ("user", ""), ("assistant", "c")], [("user", "only")],
        [("user", "a"), ("assistant", ""), ("user", "b"), ("assistant", "\n\n")]])}
    rows = [(i + 12 * shape, t, role, text) for (i, shape), turns in said.items() for t, (role, text) in enumerate(turns)]
    rows += [(None, 0, "user", None), (99, 0, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.in_layouts(chat.by_conversation(table)))
    found = {r.conv_id: [(t.role, t.text) for t in r.parsed] for r in chat.read_back(out).collect()}
    assert found == {i + 12 * shape: turns for (i, shape), turns in said.items()} | {None: [("user", "")], 99: [("", "")]}
    # both fields of a turn empty is a layout's own fingerprint as well; none is unknown
    assert out.select("fingerprint").distinct().count() == 8 and out.where("fingerprint = 0").isEmpty()
    assert chat.formatted(chat.in_layouts(chat.by_conversation(table.where(F.lit(False))))).isEmpty()
