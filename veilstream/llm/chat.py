"""Tool-call linking, in DataFrame functions alone.

Calls and results are joined by (conversation, call id). A call may depend on other calls of its conversation; its level is
one more than the highest of those, so ascending (level, turn) is a topological order. Levels are found for
all conversations at once, by pointer doubling; calls that never get one stand behind a cycle. Arguments are
validated against the fields of their tool, nested objects, array items and allowed values too, and a call is serialised as canonical JSON: keys sorted at every
depth, no white space, numbers as JSON numbers.

No conversation of unbounded size is gathered in one row: joins are by call id, and only small graphs meet (see ``levels``).

Defined results: a call without a result is ``unanswered``; a result without a call is ``orphan`` and has no level; calls and results
that repeat an id in a conversation count once, the first turn's (then the least) stays, with ``copies`` telling how
many there were; null arguments and text that is no JSON object are invalid; unknown tools are
invalid; dependencies on calls that don't exist are ignored; calls of a conversation without an id are linked to nothing and have no level; in
``link_turns``, calls and results without an id or that are no JSON object, calls that are not closed, and user and assistant messages
without a turn are ``unlinked``, a row for each; empty tables give no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.session import materialise

#: JSON kinds of a field; a variant's type name starts with one of the words.
KINDS = {
    "string": ["STRING"],
    "integer": ["BIGINT"],
    "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"],
    "boolean": ["BOOLEAN"],
    "array": ["ARRAY"],
    "object": ["OBJECT"],
    "null": ["VOID"],
}

#: Dependencies of calls with several, in a conversation that is solved in one row.
GRAPH_EDGES = 600

CALL = r"(?s)<tool_call>(.*?)</tool_call>"


def canonical_json(text: Column) -> Column:
    """A JSON text with sorted keys and no white space; null if it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def calls_from_markup(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of chat messages (conv_id, turn, role, text).

    A call is ``<tool_call>{"id", "name", "arguments", "depends_on"}</tool_call>`` in any message; a result is a message of
    role tool with ``{"tool_call_id", "content"}``.
    """
    found = messages.select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("body"))
    field = lambda f: F.get_json_object("body", f"$.{f}")
    calls = found.select("conv_id", "turn", field("id").alias("call_id"), field("name").alias("name"), field("arguments").alias("arguments"), F.from_json(field("depends_on"), "array<string>").alias("depends_on"))
    tools = messages.where("role = 'tool'").select("conv_id", "turn", F.col("text").alias("body"))
    results = tools.select("conv_id", "turn", field("tool_call_id").alias("call_id"), field("content").alias("content"))
    return calls.where("call_id is not null"), results.where("call_id is not null")


def markup_of_turns(messages: DataFrame) -> DataFrame:
    """Messages in markup: every user turn as a call of the tool ``reply``, every assistant turn as the tool's result for the turn before it.

    A call depends on the call two turns earlier. Some calls are faulty: turns that leave 4 when divided by 10 lack the text, and
    those that leave 6 when divided by 8 give a number as text.
    """
    key = lambda shift: F.concat(F.lit("call-"), (F.col("turn") - shift).cast("string"))
    asked = messages.where("role = 'user' and turn is not null")
    told = lambda n: F.to_json(F.struct("turn", F.when(F.col("turn") % 10 != 4, F.col("text")).alias("text"), n.alias("n_chars")))
    arguments = F.when(F.col("turn") % 8 == 6, told(F.length("text").cast("string"))).otherwise(told(F.length("text")))
    body = F.concat(F.lit('{"id":"'), key(0), F.lit('","name":"reply","arguments":'), arguments, F.lit(',"depends_on":["'), key(2), F.lit('"]}'))
    # A text may hold the end of a call; in JSON the sign can be written otherwise.
    call = F.concat(F.lit("<tool_call>"), F.replace(body, F.lit("<"), F.lit("\\u003c")), F.lit("</tool_call>"))
    said = messages.where("role = 'assistant' and turn is not null")
    result = F.to_json(F.struct(key(1).alias("tool_call_id"), F.col("text").alias("content")))
    return asked.select("conv_id", "turn", "role", call.alias("text")).unionByName(said.select("conv_id", "turn", F.lit("tool").alias("role"), result.alias("text")))


def unlinked(messages: DataFrame) -> DataFrame:
    """One row for everything that has no key to be linked by, as link_tool_calls gives them.

    Errors: ``no object`` (a call or result that is no JSON object), ``no id`` (an object without one), ``not closed`` (a
    call without its end) and ``no turn`` (a user or assistant message). ``json`` has what was found, as ``body``.
    """
    is_object = F.coalesce(F.regexp_extract(F.schema_of_variant(F.try_parse_json("body")), r"^[A-Z]+", 0) == "OBJECT", F.lit(False))
    error = F.when(is_object, "no id").otherwise("no object")
    at = ["conv_id", "turn"]
    calls = messages.select(*at, F.explode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("body"))
    calls = calls.where(F.get_json_object("body", "$.id").isNull()).withColumn("error", error)
    results = messages.where("role = 'tool'").select(*at, F.col("text").alias("body"))
    results = results.where(F.get_json_object("body", "$.tool_call_id").isNull()).withColumn("error", error)
    rest = messages.select(*at, F.regexp_extract(F.regexp_replace("text", CALL, ""), r"(?s)<tool_call>(.*)", 0).alias("body"))
    turnless = messages.where("role in ('user', 'assistant') and turn is null").select(*at, F.col("text").alias("body"), F.lit("no turn").alias("error"))
    rows = calls.unionByName(results).unionByName(rest.where("body <> ''").withColumn("error", F.lit("not closed"))).unionByName(turnless)
    return rows.select(
        "conv_id", F.lit(None).cast("string").alias("call_id"), "turn", F.lit(None).cast("long").alias("level"), F.lit("unlinked").alias("status"),
        F.array("error").alias("errors"), F.lit(False).alias("valid"), F.to_json(F.struct("body")).alias("json"), F.lit(1).cast("long").alias("copies"),
    )


def _once(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each (conv_id, call_id): the least by turn and then by the fields."""
    least = df.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", *fields)).alias("x"), F.count("*").alias("copies"))
    return least.select("conv_id", "call_id", "x.*", "copies")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of the calls (conv_id, call_id, depends_on) that stand behind no cycle.

    Calls with one dependency form chains; they find the head of their chain (a call with no dependency or several)
    by doubling their pointers, so a chain of n calls takes log2(n) rounds. What is left is a graph of the calls with several
    dependencies alone: of a conversation with up to GRAPH_EDGES of these dependencies it is solved in one row, so the number of jobs doesn't
    grow with its depth; a larger one takes a round for each layer of such calls. Every round is written.
    """
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("needs"))
    edges = materialise(edges.join(calls.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"]), "needs")
    wants = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("needs").alias("only"))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    state = calls.select("conv_id", "call_id").join(wants, ["conv_id", "call_id"], "left").select(
        "conv_id", "call_id", F.when(one, F.col("only")).otherwise(F.col("call_id")).alias("head"), one.cast("long").alias("far"),
        (~one).alias("done"), F.col("n").isNull().alias("free"),
    )
    state, open_calls = materialise(state, "heads"), None
    while True:
        left = state.where("not done").count()
        # A round that settles no call leaves only those behind a cycle.
        if not left or left == open_calls:
            break
        open_calls = left
        at = state.select("conv_id", F.col("call_id").alias("head"), F.col("head").alias("up"), F.col("far").alias("more"), F.col("done").alias("settled"))
        moved = state.where("not done").join(at, ["conv_id", "head"]).select("conv_id", "call_id", F.col("up").alias("head"), (F.col("far") + F.col("more")).alias("far"), F.col("settled").alias("done"), "free")
        state = materialise(state.where("done").unionByName(moved), "heads")

    settled = state.where("done")
    known = settled.where("free").select("conv_id", F.col("call_id").alias("head"), F.lit(0).cast("long").alias("level"))
    several = settled.where("head = call_id and not free").select("conv_id", "call_id")
    if not several.isEmpty():
        known = materialise(known, "levels")
        reach = state.select("conv_id", F.col("call_id").alias("needs"), F.when(F.col("done"), F.col("head")).alias("head"), (F.col("far") + 1).alias("far"))
        todo = edges.join(several, ["conv_id", "call_id"], "left_semi").join(reach, ["conv_id", "needs"])
        todo = materialise(todo.join(known, ["conv_id", "head"], "left"), "several")
        sizes = todo.groupBy("conv_id").agg(F.count("*").alias("n"))
        small = _levels_in_rows(todo.join(sizes.where(F.col("n") <= GRAPH_EDGES), "conv_id", "left_semi"))
        known = materialise(known.unionByName(small), "levels")
        large = sizes.where(F.col("n") > GRAPH_EDGES)
        if not large.isEmpty():
            known = known.unionByName(_levels_in_rounds(todo.join(large, "conv_id", "left_semi")))
    return settled.join(known, ["conv_id", "head"]).select("conv_id", "call_id", (F.col("level") + F.col("far")).alias("level"))


def _levels_in_rows(todo: DataFrame) -> DataFrame:
    """conv_id, head, level of the calls of todo (conv_id, call_id, head, far, level of the head if known), each conversation's in one row.

    As many passes over the row as it has calls reach every call that stands behind no cycle.
    """
    needs = F.collect_list(F.struct("head", "far", "level")).alias("needs")
    rows = todo.groupBy("conv_id", "call_id").agg(needs).groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "needs")).alias("calls"))
    rows = rows.withColumn("names", F.transform("calls", lambda c: c["call_id"]))
    placed = F.transform("calls", lambda c: F.transform(c["needs"], lambda n: F.struct(F.array_position("names", n["head"]).cast("int").alias("at"), n["far"].alias("far"), n["level"].alias("level"))))
    rows = rows.withColumn("graph", placed)

    def one(needs, levels):
        level = lambda n: F.coalesce(n["level"], F.get(levels, n["at"] - 1)) + n["far"]
        return F.aggregate(needs, F.lit(0).cast("long"), lambda most, n: F.when(most.isNotNull() & level(n).isNotNull(), F.greatest(most, level(n))))

    none = F.transform("names", lambda _: F.lit(None).cast("long"))
    found = F.aggregate(F.sequence(F.lit(1), F.size("names")), none, lambda levels, _: F.transform("graph", lambda needs: one(needs, levels)))
    told = rows.select("conv_id", F.inline(F.arrays_zip(F.col("names").alias("head"), found.alias("level"))))
    return told.where("level is not null")


def _levels_in_rounds(todo: DataFrame) -> DataFrame:
    """The same for conversations of any size: a round of joins for each layer of calls with several dependencies."""
    todo, out = materialise(todo, "several"), None
    while True:
        tried = todo.groupBy("conv_id", "call_id").agg(F.max(F.col("level") + F.col("far")).alias("found"), F.sum(F.col("level").isNull().cast("int")).alias("missing"))
        fresh = materialise(tried.where("missing = 0").select("conv_id", F.col("call_id").alias("head"), F.col("found").alias("now")), "levels")
        done = fresh.select("conv_id", "head", F.col("now").alias("level"))
        out = done if out is None else out.unionByName(done)
        if fresh.isEmpty():
            return out
        left = todo.join(fresh.select("conv_id", F.col("head").alias("call_id")), ["conv_id", "call_id"], "left_anti")
        todo = materialise(left.join(fresh, ["conv_id", "head"], "left").withColumn("level", F.coalesce("level", "now")).drop("now"), "several")


#: Between the steps of a path; ITEM is the step into an array.
STEP, ITEM = "\x01", "[]"


def _rules(fields: dict, parent: str = "") -> list[tuple]:
    """(path, parent, name, kinds, required, allowed values as JSON, whether other fields are unknown) of every field, nested ones too.

    A field is (kind, required) and, as a third, what is inside: fields for an object, the item's field for an array, the allowed values for others.
    """
    out = []
    for name, (kind, required, *inside) in sorted(fields.items()):
        path = f"{parent}{STEP}{name}"
        inside = inside[0] if inside else None
        allowed = [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in inside] if isinstance(inside, list) else None
        out.append((path, parent, path[1:].replace(STEP, "."), KINDS[kind], required, allowed, isinstance(inside, dict)))
        if isinstance(inside, dict):
            out += _rules(inside, path)
        elif isinstance(inside, tuple):
            out += _rules({ITEM: (inside[0], False, *inside[2:])}, path)
    return out


RULE = "struct<path:string,parent:string,field:string,kinds:array<string>,required:boolean,allowed:array<string>,closed:boolean>"


def tool_schemas(spark: SparkSession, tools: dict[str, dict[str, tuple]]) -> DataFrame:
    """One row for each tool: name, and a rule for each of its fields, nested ones too."""
    return spark.createDataFrame([(name, _rules(fields)) for name, fields in sorted(tools.items())], f"name string, fields array<{RULE}>")


def schema_depth(schemas: DataFrame) -> int:
    """Steps of the longest path of the tools' fields."""
    deepest = F.max(F.aggregate("fields", F.lit(0), lambda acc, f: F.greatest(acc, F.length(f["path"]) - F.length(F.replace(f["path"], F.lit(STEP), F.lit(""))))))
    return schemas.agg(deepest.alias("x")).first().x or 0


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def with_errors(rows: DataFrame, depth: int) -> DataFrame:
    """rows with ``errors`` of column arguments against column fields, sorted: missing, wrong type, not an allowed value, unknown field.

    Arguments are opened step by step, ``depth`` steps deep, and only where the tool says what is inside. Numbers of instances are compared, so a
    field that one of several array items lacks is missing.
    """
    kind = "array<struct<path:string,value:variant>>"
    inside = lambda e: F.exists("fields", lambda f: f["parent"] == e["path"])
    step = lambda e, name, v: F.struct(F.concat(e["path"], F.lit(STEP), name).alias("path"), v.alias("value"))

    def children(e):
        fields = F.transform(F.map_entries(F.variant_get(e["value"], "$", "map<string,variant>")), lambda kv: step(e, kv["key"], kv["value"]))
        items = F.transform(F.variant_get(e["value"], "$", "array<variant>"), lambda v: step(e, F.lit(ITEM), v))
        return F.coalesce(F.when(inside(e) & (_kind(e["value"]) == "OBJECT"), fields).when(inside(e) & (_kind(e["value"]) == "ARRAY"), items), F.array().cast(kind))

    root = F.try_parse_json("arguments")
    rows = rows.withColumn("__root", root).withColumn("__level0", F.array(F.struct(F.lit("").alias("path"), F.col("__root").alias("value"))).cast(kind))
    for i in range(depth):
        rows = rows.withColumn(f"__level{i + 1}", F.flatten(F.transform(f"__level{i}", children)))
    rows = rows.withColumn("__all", F.concat(*[F.col(f"__level{i}") for i in range(depth + 1)]))
    at = lambda path: F.filter("__all", lambda e: e["path"] == path)
    objects = lambda path: F.size(F.filter("__all", lambda e: (e["path"] == path) & (_kind(e["value"]) == "OBJECT")))

    def told(f):
        values = at(f["path"])
        missing = F.when(f["required"] & (F.size(values) < objects(f["parent"])), F.concat(F.lit("missing "), f["field"]))
        wrong = F.when(F.exists(values, lambda e: ~F.array_contains(f["kinds"], _kind(e["value"]))), F.concat(F.lit("type of "), f["field"]))
        value = F.when(f["allowed"].isNotNull() & F.exists(values, lambda e: ~F.array_contains(f["allowed"], F.to_json(e["value"]))), F.concat(F.lit("value of "), f["field"]))
        return F.array(missing, F.coalesce(wrong, value))

    known = F.transform("fields", lambda f: f["path"])
    closed = F.concat(F.array(F.lit("")), F.transform(F.filter("fields", lambda f: f["closed"]), lambda f: f["path"]))
    parent = lambda e: F.regexp_replace(e["path"], rf"(?s){STEP}[^{STEP}]*$", "")
    strange = F.filter("__all", lambda e: (e["path"] != "") & ~F.array_contains(known, e["path"]) & F.array_contains(closed, parent(e)))
    extra = F.transform(strange, lambda e: F.concat(F.lit("unknown "), F.translate(F.substring(e["path"], F.lit(2), F.length(e["path"])), STEP, ".")))
    found = F.array_sort(F.array_distinct(F.filter(F.concat(F.flatten(F.transform("fields", told)), extra), lambda x: x.isNotNull())))
    is_object = F.coalesce(_kind(F.col("__root")) == "OBJECT", F.lit(False))
    errors = F.when(~is_object, F.array(F.lit("no object"))).when(F.col("fields").isNull(), F.array(F.lit("unknown tool"))).otherwise(found)
    return rows.withColumn("errors", errors).drop("__root", "__all", *[f"__level{i}" for i in range(depth + 1)])


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, call_id, turn, level, status, errors, valid, json, copies of every call, and of every result without one."""
    calls = materialise(_once(calls, ["name", "arguments", "depends_on"]), "calls")
    results = _once(results, ["content"]).select("conv_id", "call_id", F.col("turn").alias("answered"), "content", F.lit(True).alias("has_result"), F.col("copies").alias("answers"))
    ordered = calls.join(levels(calls), ["conv_id", "call_id"], "left")
    joined = ordered.withColumn("has_call", F.lit(True)).join(results, ["conv_id", "call_id"], "full").join(schemas, "name", "left")
    status = F.when(F.col("has_call").isNull(), "orphan").when(F.col("has_result").isNull(), "unanswered").otherwise("linked")
    judged = with_errors(joined.withColumn("status", status), schema_depth(schemas))
    rows = judged.withColumn("errors", F.when(F.col("has_call"), F.col("errors")).otherwise(F.array().cast("array<string>")))
    body = F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), F.col("name"), F.col("content").alias("result"))
    return rows.select(
        "conv_id", "call_id", F.coalesce("turn", "answered").alias("turn"), "level", "status", "errors",
        (F.col("has_call").isNotNull() & (F.size("errors") == 0)).alias("valid"), F.to_json(body).alias("json"),
        F.coalesce("copies", "answers").alias("copies"),
    )


#: The tool of markup_of_turns.
TURN_TOOLS = {"reply": {"turn": ("integer", True), "text": ("string", True), "n_chars": ("integer", False)}}


def link_turns(messages: DataFrame) -> DataFrame:
    """Markup calls of a table of conversations and its turns as markup calls, linked, and what has no key; ids of its own calls get the prefix ``tool-``."""
    asked, said = calls_from_markup(markup_of_turns(messages))
    marked, answered = calls_from_markup(messages)
    prefix = F.concat(F.lit("tool-"), "call_id")
    marked = marked.withColumns({"call_id": prefix, "depends_on": F.transform("depends_on", lambda x: F.concat(F.lit("tool-"), x))})
    linked = link_tool_calls(asked.unionByName(marked), said.unionByName(answered.withColumn("call_id", prefix)), tool_schemas(messages.sparkSession, TURN_TOOLS))
    return linked.unionByName(unlinked(messages))


def chat_digest(linked: DataFrame) -> DataFrame:
    return linked.select("conv_id", "call_id", "turn", F.col("level").cast("long").alias("level"), "status", F.array_join("errors", ",").alias("errors"), "valid", "json", "copies")


def chat_sql() -> str:
    """link_turns in DuckDB SQL for conversations that hold no markup of their own."""
    return """
WITH RECURSIVE c AS (SELECT conv_id, turn, 'call-' || turn AS call_id, min(text) AS text, count(*) AS copies FROM conversations WHERE role = 'user' AND turn IS NOT NULL GROUP BY conv_id, turn),
r AS (SELECT conv_id, turn AS answered, 'call-' || (turn - 1) AS call_id, min(text) AS content, count(*) AS answers FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY conv_id, turn),
l AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
    UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.answered) AS turn, l.level AS level,
    CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.answered IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
    CASE WHEN c.turn IS NULL THEN '' ELSE concat_ws(',', CASE WHEN c.turn % 10 = 4 OR c.text IS NULL THEN 'missing text' END, CASE WHEN c.turn % 8 = 6 AND c.text IS NOT NULL THEN 'type of n_chars' END) END AS errors,
    c.turn IS NOT NULL AND c.text IS NOT NULL AND c.turn % 10 <> 4 AND c.turn % 8 <> 6 AS valid, coalesce(c.copies, r.answers) AS copies,
    '{' || concat_ws(',', CASE WHEN c.turn IS NOT NULL THEN '"arguments":{' || concat_ws(',', '"n_chars":' || CASE WHEN c.turn % 8 = 6 THEN '"' || length(c.text) || '"' ELSE length(c.text)::VARCHAR END,
            CASE WHEN c.turn % 10 <> 4 THEN '"text":' || to_json(c.text) END, '"turn":' || c.turn) || '}' END,
        '"id":"' || coalesce(c.call_id, r.call_id) || '"', CASE WHEN c.turn IS NOT NULL THEN '"name":"reply"' END, '"result":' || to_json(r.content)) || '}' AS json
FROM c LEFT JOIN l ON l.conv_id = c.conv_id AND l.turn = c.turn FULL JOIN r ON r.conv_id = c.conv_id AND r.call_id = c.call_id"""
