"""Records in JSON values of any shape, by a walk over VARIANT, level by level.

A node is JSON text. An object that fits a shape gives a record, and nothing is looked for inside it; of
other objects and of lists, the objects and lists among the children are the nodes of the next level, in
the order in which they are written. A value that Spark does not show as the rules ask (a fraction, or an object where
a text is looked for) makes its node an odd one, which is given back unread, with its place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.records import ASSISTANT_ROLES, CONVERSATION_INSTRUCTION, QUESTION_INSTRUCTION, USER_ROLES
from ..operators.splits import ANSWER_FIELDS, QUESTION_FIELDS
from ..session import materialized

# Field names.
MESSAGE_ROLE, MESSAGE_TEXT = ("role", "from", "speaker"), ("content", "text", "value")
INPUT_FIELDS, CATEGORY_FIELDS = ("input", "context"), ("category", "type")
PARTS = ("instruction", "input", "response", "category")
#: Names that a shape asks for, in lower case.
ASKED = tuple(dict.fromkeys(("instruction", *INPUT_FIELDS, *ANSWER_FIELDS, *CATEGORY_FIELDS, *QUESTION_FIELDS)))
PLAIN = ("STRING", "BIGINT", "BOOLEAN", "VOID")


def _kind_and_text(value: Column) -> Column:
    """Of a variant; both are null where there is no value."""
    return F.struct(F.schema_of_variant(value).alias("kind"), F.try_variant_get(value, "$", "string").alias("text"))


def _shown(value: Column) -> Column:
    """A plain value as text: null as null, booleans with a capital."""
    return F.when(value["kind"] == "BOOLEAN", F.initcap(value["text"])).otherwise(value["text"])


def _first(fields: Column, names: tuple[str, ...]) -> Column:
    """The first of the fields, in the order of the names, that is not blank; of fields of one name the last counts."""
    one = lambda n: F.try_element_at(F.filter(fields, lambda f: f["name"] == n), F.lit(-1))["shown"]
    return F.coalesce(*[F.nullif(one(n), F.lit("")) for n in names], F.lit(""))


def _said(message: Column, names: tuple[str, ...]) -> Column:
    """Of a message's map: the first of the values that is there and neither empty, false nor zero; and whether one of them is not plain."""
    return F.transform(F.array(*[F.lit(n) for n in names]), lambda n: _kind_and_text(F.try_element_at(message, n)))


def _true(values: Column) -> Column:
    """The first of _said()'s values that Python takes for true, as text with single spaces."""
    empty = lambda v: (v["text"] == "") | ((v["kind"] == "BOOLEAN") & (v["text"] == "false")) | ((v["kind"] == "BIGINT") & (v["text"] == "0"))
    return T.collapse(F.get(F.transform(F.filter(values, lambda v: v["text"].isNotNull() & ~empty(v)), _shown), F.lit(0)))


def _odd(values: Column) -> Column:
    return F.exists(values, lambda v: v["kind"].isNotNull() & ~v["kind"].isin(*PLAIN))


def _expressions() -> list[tuple[str, Column]]:
    """Columns that follow from json, each of those before it; they are built once for a walk, as the same for every level."""
    written, items = F.from_json("json", "map<string,string>"), F.from_json("json", "array<string>")
    entries = F.struct(F.when(F.col("_v.map").isNotNull(), F.map_entries(written)).alias("entries"), F.when(F.col("_v.list").isNotNull(), items).alias("items"))
    value = F.parse_json("json")
    parsed = F.struct(F.try_variant_get(value, "$", "map<string,variant>").alias("map"), F.try_variant_get(value, "$", "array<variant>").alias("list"))
    asked = F.filter("_e.entries", lambda e: F.lower(e["key"]).isin(*ASKED))
    fields = F.transform(asked, lambda e: F.struct(F.lower(e["key"]).alias("name"), _kind_and_text(F.try_element_at("_v.map", e["key"])).alias("value")))
    told = F.transform(F.try_variant_get(F.try_element_at("_v.map", F.lit("messages")), "$", "array<variant>"), lambda m: F.try_variant_get(m, "$", "map<string,variant>"))
    told = F.transform(F.filter(told, lambda m: m.isNotNull()), lambda m: F.struct(_said(m, MESSAGE_ROLE).alias("role"), _said(m, MESSAGE_TEXT).alias("text")))

    # Conversations: what users say, and the last reply after the first of it.
    turns = F.transform("_f.told", lambda m: F.struct(F.lower(_true(m["role"])).alias("role"), _true(m["text"]).alias("text")))
    plain = F.transform("_f.fields", lambda f: F.struct(f["name"].alias("name"), T.collapse(_shown(f["value"])).alias("shown")))
    odd = F.exists("_f.told", lambda m: _odd(m["role"]) | _odd(m["text"]))
    odd = F.coalesce(odd, F.lit(False)) | F.coalesce(_odd(F.transform("_f.fields", lambda f: f["value"])), F.lit(False))
    known = F.filter(turns, lambda m: (m["text"] != "") & m["role"].isin(*USER_ROLES, *ASSISTANT_ROLES))
    known = F.transform(known, lambda m: F.struct(m["role"].isin(*USER_ROLES).alias("user"), m["text"].alias("text")))
    start = F.array_position(F.transform("_g.turns", lambda t: t["user"]), True)
    replies = F.transform(F.filter("_g.turns", lambda t, i: ~t["user"] & (i + 1 > start) & (start > 0)), lambda t: t["text"])
    users = F.transform(F.filter("_g.turns", lambda t: t["user"]), lambda t: t["text"])
    values = {"instruction": ("instruction",), "input": INPUT_FIELDS, "response": ANSWER_FIELDS, "category": CATEGORY_FIELDS, "question": QUESTION_FIELDS}
    told_parts = F.struct(replies.alias("replies"), users.alias("users"), *[_first(F.col("_g.fields"), names).alias(n) for n, names in values.items()])
    p = lambda n: F.col(f"_p.{n}")
    parts = lambda *c: F.struct(*[x.alias(n) for n, x in zip(PARTS, c, strict=True)])
    record = (
        F.when(F.size(p("replies")) > 0, parts(F.lit(CONVERSATION_INSTRUCTION), F.array_join(p("users"), "\n\n"), F.element_at(p("replies"), -1), F.lit("conversation")))
        .when((p("instruction") != "") & (p("response") != ""), parts(*[p(n) for n in PARTS]))
        .when((p("question") != "") & (p("response") != ""), parts(F.lit(QUESTION_INSTRUCTION), p("question"), p("response"), F.lit("question_answer")))
    )

    # Children that are objects or lists.
    nested = lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull() | F.try_variant_get(v, "$", "array<variant>").isNotNull()
    child = lambda i, step, json, is_nested: F.struct(i.cast("long").alias("place"), step.alias("step"), F.when(is_nested, json).alias("json"))
    dot = F.when(F.col("where") != "", ".").otherwise("")
    of_map = F.transform("_e.entries", lambda e, i: child(i, F.concat(dot, e["key"]), e["value"], nested(F.try_element_at("_v.map", e["key"]))))
    of_list = F.transform("_e.items", lambda x, i: child(i, F.concat(F.lit("["), i, F.lit("]")), x, nested(F.get("_v.list", i))))
    children = F.filter(F.coalesce(of_map, of_list), lambda c: c["json"].isNotNull())
    found = F.struct(F.when(~F.col("_g.odd"), record).alias("record"), F.col("_g.odd").alias("odd"))
    return [
        ("_v", parsed), ("_e", entries), ("_f", F.struct(fields.alias("fields"), told.alias("told"))), ("_g", F.struct(known.alias("turns"), plain.alias("fields"), odd.alias("odd"))),
        ("_p", told_parts), ("_r", found), ("children", F.when(F.col("_r.record").isNull() & ~F.col("_r.odd"), children)),
    ]


def _shapes(nodes: DataFrame, expressions: list[tuple[str, Column]]) -> DataFrame:
    """nodes (json the last column) with record (parts, or null), odd, and children (place, step, json) of a node that has neither."""
    rows = nodes
    for name, value in expressions:
        rows = T.once(rows, name, value)
    return rows.select(*nodes.columns[:-1], F.when(F.col("_r.odd"), F.col("json")).alias("json"), "_r.odd", "_r.record", "children")


def walk(roots: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, odd nodes) of JSON texts. roots: the key columns, where (what stands before a path) and json.

    Both have the keys, place (an array that sorts as the nodes are written) and where (keys and
    [numbers] on the way, joined by dots); records have PARTS, odd nodes and roots that are no JSON their json.
    """
    level = roots.select(*keys, "where", F.array().cast("array<bigint>").alias("place"), "json")
    level = materialized(level)
    is_json = F.try_parse_json("json").isNotNull()
    columns = [*keys, "where", "place", "json"]
    odd, found, expressions = [level.filter(~is_json)], [], _expressions()
    level = level.filter(is_json)
    while True:
        shaped = materialized(_shapes(level.select(*columns), expressions))
        found.append(shaped.filter("record is not null").select(*keys, "where", "place", *[F.col(f"record.{p}").alias(p) for p in PARTS]))
        odd.append(shaped.filter("odd").select(*columns))
        below = shaped.filter("children is not null").select(*keys, "where", "place", F.explode("children").alias("_c"))
        if below.isEmpty():
            return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, odd)
        level = below.select(*keys, F.concat("where", "_c.step").alias("where"), F.concat("place", F.array("_c.place")).alias("place"), "_c.json")
