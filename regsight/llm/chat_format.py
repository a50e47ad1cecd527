"""Chat formatting: link tool calls to their results, order, validate, serialise.

All native expressions. Calls and results meet in a hash join on conversation
and identifier (results are reduced per identifier first, with map-side
combine): identifiers such as ``call_0`` come again in other conversations.
The order is topological over ``depends_on``: a call's level is the longest way
to a call without dependencies. Arguments are checked against the tools'
schemas and written as canonical JSON (keys sorted, no blanks, numbers in
shortest form).

A conversation is never gathered into one row: each call, and each result
without a call, is a row of its own, so no conversation is too long.

Defined results (``status``): ``answered``, ``unanswered``, ``orphan`` (a result
whose identifier no call of its conversation has, or null), ``cyclic`` (calls on
or behind a cycle of dependencies, level null), ``message`` (a row of another
role, or the text beside embedded calls). Calls of a conversation that share an
identifier each keep a row with the shared result and ``n_same`` > 1; of several
results the earliest by (turn, content) is linked, and each further one is a row
of status ``duplicate_result`` where ``further`` asks for them. Dependencies on
identifiers unknown in the conversation are ignored. Null conversations are one.
Null arguments are invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regsight.session import scratch_path

#: JSON schema type -> pattern of the variant type that satisfies it
TYPES = {"string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)",
         "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID"}
MAX_TOOLS = 10_000

#: tool name -> parameter -> (type, required); the tools of plain conversations
CONVERSATION_TOOLS = {
    "reply": {"prompt": ("string", True), "turn": ("integer", True)},
    "configure": {"instructions": ("string", True), "turn": ("integer", True)},
}

_EMBEDDED = ("struct<tool_calls:array<struct<id:string,depends_on:array<string>,"
             "function:struct<name:string,arguments:string>>>,tool_call_id:string,content:string>")


def _identifier(conv: Column, turn: Column) -> Column:
    return F.concat(conv.cast("string"), F.lit(":"), turn.cast("string"))


def events(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Messages as events: ``kind`` (call, result, message), ``id``, ``conv``, ``turn``,
    ``tool``, ``arguments`` (JSON text), ``depends_on``, ``content``.

    A message whose text is a JSON object with ``tool_calls`` gives one call
    per entry, and a message where it has a ``content`` beside them; one of role ``tool`` with ``tool_call_id`` is a result. Any other
    ``user`` message is a call of ``reply``, a ``system`` message one of
    ``configure``, named by conversation and turn and depending on the calls one
    and two turns before; an ``assistant`` message is the result of the call one
    turn before. Rows of other roles are messages.
    """
    m = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    own, before = _identifier(F.col("conv"), F.col("turn")), _identifier(F.col("conv"), F.col("turn") - 1)
    parsed = F.when(F.col("content").rlike(r"\A\s*\{"), F.from_json("content", _EMBEDDED))
    m = m.withColumn("j", parsed)
    has_calls = F.coalesce(F.size(F.col("j.tool_calls")) > 0, F.lit(False))
    is_result = ~has_calls & (F.col("role") == "tool") & F.col("j.tool_call_id").isNotNull()
    plain_call = F.col("role").isin("user", "system")
    text_name = F.when(F.col("role") == "system", "instructions").otherwise("prompt")
    quoted = F.expr("substring(to_json(struct(content as v)), 6, length(to_json(struct(content as v))) - 6)")
    arguments = F.concat(F.lit('{"'), text_name, F.lit('":'), quoted, F.lit(',"turn":'),
                         F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"))
    depends = F.filter(F.array(before, _identifier(F.col("conv"), F.col("turn") - 2)), lambda x: x.isNotNull())
    none = F.lit(None).cast("string")
    no_deps = F.array().cast("array<string>")

    def event(kind, ident, tool, args, deps, content):
        return F.struct(F.lit(kind).alias("kind"), ident.alias("id"), tool.alias("tool"), args.alias("arguments"),
                        deps.alias("depends_on"), content.alias("content"))

    embedded = F.transform(F.col("j.tool_calls"), lambda c: event(
        "call", c["id"], c["function"]["name"], c["function"]["arguments"],
        F.coalesce(c["depends_on"], no_deps), none))
    tool = F.when(F.col("role") == "system", "configure").otherwise("reply")
    one = (F.when(is_result, event("result", F.col("j.tool_call_id"), none, none, no_deps,
                                   F.coalesce(F.col("j.content"), F.lit(""))))
           .when(plain_call, event("call", own, tool, arguments, depends, none))
           .when(F.col("role") == "assistant", event("result", before, none, none, no_deps, F.col("content")))
           .otherwise(event("message", own, none, none, no_deps, F.col("content"))))
    beside = F.filter(F.array(event("message", own, none, none, no_deps, F.col("j.content"))),
                      lambda e: F.length(e["content"]) > 0)
    every = F.when(has_calls, F.concat(embedded, beside)).otherwise(F.array(one))
    return m.select("conv", "turn", F.explode(every).alias("e")) \
        .select("conv", "turn", "e.*")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


IMPLIED_LEAST = 16


def _without_implied(edges: DataFrame) -> DataFrame:
    """Edges (``id``, ``on``) without those that a way of two edges implies.

    In a graph without cycles the longest ways stay. An edge to w is only implied by
    one to a v of greater identifier (by length, then text): the greatest of the
    dependencies that lead to a cycle is then never left out, so what is on or
    behind a cycle stays so. Calls of more than ``IMPLIED_LEAST`` dependencies imply
    nothing; that costs rounds, not results.
    """
    degree = _stored(edges.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "chat-degree")
    several = edges.join(degree.filter("n > 1").select("id"), "id", "left_semi")
    if several.isEmpty():
        return edges
    short = edges.join(degree.filter(F.col("n") <= IMPLIED_LEAST).select("id"), "id", "left_semi") \
        .select(F.col("id").alias("via"), "on")
    ways = several.select("id", F.col("on").alias("via")).filter("id <> via").join(short, "via")
    implied = ways.filter(F.struct(F.length("via"), "via") > F.struct(F.length("on"), "on")).select("id", "on")
    return _stored(edges.join(implied, ["id", "on"], "left_anti"), "chat-edges")


def topological_levels(calls: DataFrame) -> DataFrame:
    """``id`` and ``level`` of calls (``id``, ``depends_on``); ids on or behind a cycle are missing.

    A dependency that another dependency of the call has itself is no longer way
    and is left out first, so consecutive turns, each on the two before, are a chain.
    Calls of one dependency form chains, and a long conversation is one long
    chain: each such call finds the call its chain starts from, and the
    distance to it, by pointer doubling, in rounds as the logarithm of its length. Calls
    of several dependencies that remain are then resolved in rounds over those
    starts, as many as the longest way over such calls.
    """
    ids = _stored(calls.filter("id is not null").select("id").distinct(), "chat-ids")
    edges = _stored(calls.filter("id is not null").select("id", F.explode("depends_on").alias("on")).distinct()
                    .join(ids.withColumnRenamed("id", "on"), "on", "left_semi").select("id", "on"), "chat-edges")
    edges = _without_implied(edges)
    known = _stored(ids.join(edges, "id", "left_anti").select("id", F.lit(0).cast("long").alias("level")),
                    "chat-roots")
    degree = edges.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("on").alias("ptr"))
    chain = _stored(degree.filter("n = 1").select("id", "ptr", F.lit(1).cast("long").alias("dist"),
                                                  F.lit(True).alias("moved")), "chat-chain")
    for _ in range(int(chain.count()).bit_length() + 1):
        ahead = chain.select(F.col("id").alias("ptr"), F.col("ptr").alias("far"), F.col("dist").alias("more"))
        chain = _stored(chain.drop("moved").join(ahead, "ptr", "left").select(
            "id", F.coalesce("far", "ptr").alias("ptr"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"),
            F.col("far").isNotNull().alias("moved")), "chat-chain")
        if chain.filter("moved").isEmpty():
            break
    chain = chain.filter("not moved").select("id", "ptr", "dist")  # the others run into a cycle
    several = edges.join(degree.filter("n > 1").select("id"), "id", "left_semi")
    left = _stored(several.join(chain.select(F.col("id").alias("on"), "ptr", "dist"), "on", "left")
                   .select("id", F.coalesce("ptr", "on").alias("on"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist")),
                   "chat-open")
    ready, reached = known, []
    while not left.isEmpty():
        hit = left.join(ready.withColumnRenamed("id", "on"), "on")
        reached.append(_stored(hit.select("id", (F.col("level") + F.col("dist")).alias("level")), "chat-reached"))
        left = _stored(left.join(ready.select(F.col("id").alias("on")), "on", "left_anti"), "chat-open")
        so_far = reached[0] if len(reached) == 1 else _stored(reached[0].unionByName(reached[1]), "chat-reached")
        reached = [so_far]
        ready = _stored(so_far.groupBy("id").agg(F.max("level").alias("level")).join(left, "id", "left_anti")
                        .join(known, "id", "left_anti"), "chat-ready")
        if ready.isEmpty():
            break
        known = _stored(known.unionByName(ready), "chat-known")
    behind = chain.join(known.withColumnRenamed("id", "ptr"), "ptr") \
        .select("id", (F.col("level") + F.col("dist")).alias("level"))
    return known.unionByName(behind).select("id", F.col("level").cast("int").alias("level"))


def _errors(arguments: Column, params: Column) -> Column:
    """Messages on arguments that break a tool's schema (array of name, type, pattern, required)."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    given = F.transform(F.map_entries(F.from_json(F.when(is_object, arguments), "map<string,variant>")),
                        lambda e: F.struct(e["key"].alias("key"), F.schema_of_variant(e["value"]).alias("type")))
    keys = F.transform(given, lambda g: g["key"])
    missing = F.transform(F.filter(params, lambda p: p["required"] & ~F.array_contains(keys, p["name"])),
                          lambda p: F.concat(F.lit("missing "), p["name"]))
    wrong = F.flatten(F.transform(params, lambda p: F.transform(
        F.filter(given, lambda g: (g["key"] == p["name"]) & ~F.regexp_like(g["type"], p["pattern"])),
        lambda g: F.concat(g["key"], F.lit(" is not "), p["type"]))))
    unknown = F.transform(F.array_except(keys, F.transform(params, lambda p: p["name"])),
                          lambda k: F.concat(F.lit("unknown "), k))
    return (F.when(params.isNull(), F.array(F.lit("unknown tool")))
            .when(~is_object, F.array(F.lit("arguments are not an object")))
            .otherwise(F.array_sort(F.concat(missing, wrong, unknown))))


def _key(ident: Column) -> Column:
    """An identifier within its conversation; null for a null one."""
    conv = F.col("conv").cast("string")
    return F.concat(F.coalesce(F.concat(F.length(conv), F.lit(":"), conv), F.lit("")), F.lit(":"), ident)


def format_calls(happenings: DataFrame, tools: dict[str, dict[str, tuple[str, bool]]], *,
                 further: bool = False) -> DataFrame:
    """One row per call, orphan result and message of ``events`` rows, and with
    ``further`` per result after the first of its call (else only counted).

    Columns: ``conv_id``, ``turn``, ``call_id``, ``tool``, ``status``, ``level``,
    ``n_results``, ``n_same``, ``valid``, ``errors`` and ``json``, the canonical
    record of the call with its result.
    """
    if len(tools) > MAX_TOOLS:
        raise ValueError(f"{len(tools)} tools; at most {MAX_TOOLS}")
    spark = happenings.sparkSession
    all_events = _stored(happenings.select(
        "*", _key(F.col("id")).alias("key"), F.monotonically_increasing_id().alias("row")), "chat-events")
    calls = all_events.filter("kind = 'call'")
    results = all_events.filter("kind = 'result'")
    schema = spark.createDataFrame(
        [(t, [(p, kind, TYPES[kind], need) for p, (kind, need) in sorted(ps.items())]) for t, ps in tools.items()],
        "tool string, params array<struct<name:string,type:string,pattern:string,required:boolean>>")
    linked = results.filter("id is not null").groupBy("key").agg(
        F.min(F.struct("turn", "content", "row")).alias("first"), F.count(F.lit(1)).alias("n_results"))
    same = calls.filter("id is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n_same"))
    graph = calls.select(F.col("key").alias("id"), F.transform("depends_on", _key).alias("depends_on"))
    levels = _stored(topological_levels(graph).withColumnRenamed("id", "key").join(same, "key"), "chat-levels")
    cyclic = same.join(levels, "key", "left_anti").select("key", F.lit(None).cast("int").alias("level"), "n_same")
    nodes = levels.unionByName(cyclic).join(linked, "key", "left")
    rows = (calls.join(nodes, "key", "left").join(F.broadcast(schema), "tool", "left")
            .withColumn("errors", _errors(F.col("arguments"), F.col("params"))))
    status = (F.when(F.col("id").isNotNull() & F.col("level").isNull(), "cyclic")
              .when(F.col("first").isNull(), "unanswered").otherwise("answered"))
    rows = rows.select("conv", "turn", "id", "tool", status.alias("status"),
                       F.when(F.col("id").isNull(), 0).otherwise(F.col("level")).alias("level"),
                       F.coalesce("n_results", F.lit(0)).alias("n_results"),
                       F.coalesce("n_same", F.lit(1)).alias("n_same"), (F.size("errors") == 0).alias("valid"),
                       "errors", F.try_parse_json("arguments").alias("args"),
                       F.when(F.try_parse_json("arguments").isNull(), F.col("arguments")).alias("raw"),
                       F.col("first.content").alias("result"))
    no_errors = F.array().cast("array<string>")

    def loose(part, status):
        return part.select("conv", "turn", "id", "tool", F.lit(status).alias("status"),
                           F.lit(None).cast("int").alias("level"), F.lit(0).cast("long").alias("n_results"),
                           F.lit(0).cast("long").alias("n_same"), F.lit(None).cast("boolean").alias("valid"),
                           no_errors.alias("errors"), F.try_parse_json(F.lit(None).cast("string")).alias("args"),
                           F.lit(None).cast("string").alias("raw"), F.col("content").alias("result"))

    # a null identifier is in no join and stays an orphan
    orphans = results.join(same.select("key"), "key", "left_anti")
    rows = rows.unionByName(loose(orphans, "orphan")) \
        .unionByName(loose(all_events.filter("kind = 'message'"), "message"))
    if further:
        several = linked.filter("n_results > 1").join(same, "key", "left_semi").select("key", "first.row")
        later = results.join(several.select("key"), "key", "left_semi").join(several, ["key", "row"], "left_anti")
        rows = rows.unionByName(loose(later, "duplicate_result"))
    record = F.to_json(F.struct(F.col("args").alias("arguments"), F.col("conv").cast("string").alias("conversation"),
                                "errors", "id", "level", F.col("raw").alias("raw_arguments"), "result", "status",
                                "tool", "turn"))
    return rows.select(F.col("conv").alias("conv_id"), "turn", F.col("id").alias("call_id"), "tool", "status", "level",
                       "n_results", "n_same", "valid", F.array_join("errors", "; ").alias("errors"),
                       record.alias("json"))
