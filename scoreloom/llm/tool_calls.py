"""Tool calls linked to their results, in order, checked and written as canonical JSON.

DataFrame operations only. Calls and results meet by a hash join on the
conversation and the call's identifier. Calls of a conversation depend on
one another through the identifiers their arguments name; a call's depth is
the longest chain of calls it depends on, found by doubling jumps along single
needs and by peeling calls with several. (depth, turn, call_id) is a
topological order.
Arguments are checked against the tool's schema. JSON is canonical: keys
sorted, no blanks, nulls written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import drop_scratch, materialise, release, scratch

KEY = ["conv_id", "call_id"]
#: Tools whose schemas are broadcast: some KB each.
BROADCAST_TOOLS = 1_000
#: Patterns of argument values by schema type, as text.
TYPE_PATTERNS = {
    "integer": r"^-?(0|[1-9][0-9]*)$",
    "number": r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$",
    "boolean": r"^(true|false)$",
    "string": r"(?s)^.*$",
}


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each call with its result: adds result_turn, content, n_results and status.

    ``calls`` has conv_id, call_id, turn, name and arguments (map of text);
    ``results`` has conv_id, call_id, turn and content. Of several results of
    one call the earliest counts (the smallest content of one turn), and
    n_results tells how many there are. Status is ``linked``, ``unanswered``,
    ``early`` (the result comes before the call) or ``unnamed`` (a null
    conversation or identifier links with nothing). Of several calls under one
    identifier the earliest keeps it and the others are ``repeated``; rows that are equal in
    turn, name and arguments are the same call, and share its status.
    """
    answered = (
        results.where("conv_id is not null and call_id is not null")
        .groupBy(*KEY)
        .agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
        .select(*KEY, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")
    )
    firsts = calls.groupBy(*KEY).agg(F.min(F.struct("turn", "name", "args_text")).alias("first"))
    same = F.struct("turn", "name", "args_text") == F.col("first")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    rows = calls.join(firsts, KEY, "left").join(answered, KEY, "left")
    status = (
        F.when(~named, "unnamed")
        .when(~same, "repeated")
        .when(F.col("n_results").isNull(), "unanswered")
        .when(F.col("result_turn") < F.col("turn"), "early")
        .otherwise("linked")
    )
    return rows.withColumn("status", status).withColumn("n_results", F.coalesce("n_results", F.lit(0)).cast("long")).drop("first")


def depths(calls: DataFrame, uses: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): the longest chain of calls that each call depends on.

    ``uses`` has conv_id, call_id and needs. A use of an unknown call, or of
    itself, counts as none. Calls on a cycle, or that depend on one, have
    depth -1.

    Calls with one need are jumped over first, so a chain of n calls takes
    log2(n) rounds (see :func:`jumps`). What is left are calls with several
    needs, whose needs are then calls of that kind or calls that wait for
    nothing; they are peeled, one round for each such call on the longest
    chain.
    """
    spark = calls.sparkSession
    ids = calls.where("conv_id is not null and call_id is not null").select(*KEY).distinct()
    edges = uses.where("call_id <> needs").select(*KEY, "needs").distinct()
    edges = edges.join(ids, KEY, "left_semi").join(ids.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi")
    ids = materialise(ids.join(edges.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("needs").alias("one")), KEY, "left"), "calls-ids")
    ends = jumps(ids.where("n = 1").select(*KEY, F.col("one").alias("to")))
    forks = ids.where("n > 1").select(*KEY)
    done = scratch(spark, "calls-depths")
    ids.where("n is null").select(*KEY, F.lit(0).cast("long").alias("depth")).write.parquet(f"{done}/round=0")
    if not forks.isEmpty():
        # Needs of calls with several, by the end of the chain that each need is on.
        over = ends.select("conv_id", F.col("call_id").alias("needs"), "to", "steps", "open")
        wide = edges.join(forks, KEY, "left_semi").join(over, ["conv_id", "needs"], "left")
        wide = wide.select(*KEY, F.coalesce("to", "needs").alias("needs"), F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce("open", F.lit(False)).alias("open"))
        _peel(wide, done)
    placed = spark.read.schema(ids.select(*KEY, F.lit(0).cast("long").alias("depth")).schema).parquet(f"{done}/*")
    chained = ends.where("not open").join(placed.select("conv_id", F.col("call_id").alias("to"), "depth"), ["conv_id", "to"]).select(*KEY, (F.col("depth") + F.col("steps")).alias("depth"))
    return ids.select(*KEY).join(placed.unionByName(chained), KEY, "left").select(*KEY, F.coalesce("depth", F.lit(-1)).alias("depth"))


def jumps(pointers: DataFrame) -> DataFrame:
    """(conv_id, call_id, to, steps, open): where chains of single needs end, by doubling.

    ``pointers`` has conv_id, call_id and to, one row a call. In each round a
    call whose ``to`` has a pointer of its own takes that one's end, so the
    distance doubles. Rows that stay open for good are on a cycle or lead to
    one: while any other row is open, each round closes some. The joined side
    has one row a call, so no conversation is a hot key.
    """
    known = pointers.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("more"))
    at = materialise(
        pointers.join(known, ["conv_id", "to"], "left").select(*KEY, "to", F.lit(1).cast("long").alias("steps"), F.col("more").isNotNull().alias("open")), "calls-jumps"
    )
    n_open = at.where("open").count()
    while n_open:
        far = at.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"), F.col("open").alias("still"))
        moved = at.where("open").join(far, ["conv_id", "to"]).select(*KEY, F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("open"))
        nxt = materialise(at.where("not open").unionByName(moved), "calls-jumps")
        drop_scratch(at)
        at, before, n_open = nxt, n_open, nxt.where("open").count()
        if n_open == before:
            break
    return at


def _peel(wide: DataFrame, done: str) -> None:
    """Place the calls of ``wide`` (conv_id, call_id, needs, steps, open) round by round, into folders below ``done``.

    A call is placed when all its needs are, one above the largest of their
    depth and the steps to them. Open needs are never placed.
    """
    spark, r = wide.sparkSession, 0
    edges = materialise(wide.withColumn("d", F.lit(None).cast("long")), "calls-uses")
    while True:
        fresh = spark.read.parquet(f"{done}/round={r}")
        told = fresh.select("conv_id", F.col("call_id").alias("needs"), F.col("depth").alias("found"))
        nxt = edges.join(told, ["conv_id", "needs"], "left").withColumn("d", F.coalesce("d", F.when(~F.col("open"), F.col("found") + F.col("steps"))))
        nxt = materialise(nxt.join(fresh.select(*KEY), KEY, "left_anti").select(*KEY, "needs", "steps", "open", "d"), "calls-uses")
        drop_scratch(edges)
        edges, r = nxt, r + 1
        ready = edges.groupBy(*KEY).agg(F.max("d").alias("top"), F.count("*").alias("n"), F.count("d").alias("known")).where("n = known")
        ready.select(*KEY, (F.col("top") + 1).alias("depth")).write.parquet(f"{done}/round={r}")
        if spark.read.schema("depth long").parquet(f"{done}/round={r}").isEmpty():
            drop_scratch(edges)
            return
        release(spark)


def quoted(text: Column) -> Column:
    """A text as a JSON string, or null."""
    array = F.to_json(F.array(text), {"ignoreNullFields": "false"})
    return F.substring(array, F.lit(2), F.length(array) - 2)


def _typed(kind: Column, value: Column) -> Column:
    """Whether a value's text is of a schema type; null is of none."""
    out = F.lit(False)
    for name, pattern in TYPE_PATTERNS.items():
        out = F.when(kind == name, value.rlike(pattern)).otherwise(out)
    out = out & ((kind != "number") | (F.abs(value.try_cast("double")) < float("inf")))
    for name in ("object", "array"):
        out = F.when(kind == name, F.schema_of_variant(F.try_parse_json(value)).startswith(name.upper() + "<")).otherwise(out)
    return F.coalesce(value.isNotNull() & out, F.lit(False))


def canonical(kind: Column, value: Column) -> Column:
    """A well-typed value as JSON, one spelling a value.

    Whole numbers below 10^15 have digits alone, other numbers the shortest
    form of their double with a small e; objects have sorted keys and no
    blanks. Integers beyond that keep their digits.
    """
    number = value.try_cast("double")
    short = F.lower(F.regexp_replace(number.cast("string"), r"\.0(E|$)", "$1"))
    plain = F.when((F.abs(number) < 1e15) & (number == F.floor(number)), number.cast("long").cast("string")).otherwise(short)
    return (
        F.when(kind == "number", plain)
        .when((kind == "integer") & (value == "-0"), F.lit("0"))
        .when(kind.isin("object", "array"), F.to_json(F.try_parse_json(value)))
        .when(kind.isin("integer", "boolean"), value)
        .otherwise(quoted(value))
    )


def check(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """``calls`` with problems, a sorted array of texts, and args_json.

    ``tools`` has name, arg, type (integer, number, boolean, string, object or
    array), required and, if there is such a column, allowed (an array of the
    values that may come, null for any). Problems are ``unknown tool``,
    ``unknown: arg``, ``missing: arg`` (required, and absent or null),
    ``type: arg`` and ``value: arg`` (well-typed, but not allowed). A null map
    has no arguments. Well-typed values are written as :func:`canonical`
    says, all else as strings.
    """
    allowed = F.col("allowed") if "allowed" in tools.columns else F.lit(None).cast("array<string>").alias("allowed")
    schemas = tools.select("name", "arg", "type", "required", allowed).groupBy("name").agg(
        F.map_from_entries(F.sort_array(F.collect_set(F.struct("arg", F.struct("type", "required", "allowed"))))).alias("schema")
    )
    args = F.coalesce("arguments", F.expr("map_from_arrays(array(), array())").cast("map<string,string>"))
    rows = calls.join(F.broadcast(schemas) if schemas.count() <= BROADCAST_TOOLS else schemas, "name", "left").withColumn("__args", args)
    entries, schema = F.map_entries("__args"), F.col("schema")
    unknown = F.transform(F.filter(entries, lambda e: ~F.map_contains_key(schema, e["key"])), lambda e: F.concat(F.lit("unknown: "), e["key"]))
    wrong = F.transform(
        F.filter(entries, lambda e: F.map_contains_key(schema, e["key"]) & e["value"].isNotNull() & ~_typed(schema[e["key"]]["type"], e["value"])),
        lambda e: F.concat(F.lit("type: "), e["key"]),
    )
    barred = F.transform(
        F.filter(entries, lambda e: F.map_contains_key(schema, e["key"]) & _typed(schema[e["key"]]["type"], e["value"]) & ~F.array_contains(schema[e["key"]]["allowed"], e["value"])),
        lambda e: F.concat(F.lit("value: "), e["key"]),
    )
    missing = F.transform(
        F.filter(F.map_entries(schema), lambda e: e["value"]["required"] & F.element_at(F.col("__args"), e["key"]).isNull()),
        lambda e: F.concat(F.lit("missing: "), e["key"]),
    )
    problems = F.when(schema.isNull(), F.array(F.lit("unknown tool"))).otherwise(F.array_sort(F.concat(unknown, missing, wrong, barred)))

    def one(e: Column) -> Column:
        kind = F.coalesce(F.when(schema.isNotNull(), F.element_at(schema, e["key"])["type"]), F.lit("string"))
        said = F.when(e["value"].isNull(), F.lit("null")).when(_typed(kind, e["value"]), canonical(kind, e["value"])).otherwise(quoted(e["value"]))
        return F.concat(quoted(e["key"]), F.lit(":"), said)

    as_json = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), one), ","), F.lit("}"))
    return rows.withColumn("problems", problems).withColumn("args_json", as_json).drop("schema", "__args")


def tool_calls(calls: DataFrame, results: DataFrame, tools: DataFrame, uses: DataFrame) -> DataFrame:
    """One row for each row of ``calls``: linked, ordered, checked and as canonical JSON.

    Columns: conv_id, call_id, turn, name, status, result_turn, n_results,
    depth, problems and json (arguments, id, name and result, in that order).
    Inputs as in :func:`link`, :func:`check` and :func:`depths`; other columns
    are ignored. Null identifiers, names, arguments and contents are kept as
    nulls; depth is null where an identifier is.
    """
    named = calls.select("conv_id", "call_id", "turn", "name", "arguments")
    checked = check(named, tools).withColumn("args_text", F.col("args_json"))
    linked = link(checked, results.select("conv_id", "call_id", "turn", "content"))
    rows = linked.join(depths(named, uses), KEY, "left")
    json = F.concat(
        F.lit('{"arguments":'), "args_json", F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"result":'), quoted(F.col("content")), F.lit("}")
    )
    return rows.select("conv_id", "call_id", "turn", "name", "status", "result_turn", "n_results", "depth", "problems", json.alias("json"))


# --- the driver's conversations -------------------------------------------

#: Tools of the registered query: name, argument, type, required.
TOOLS = [
    ("ask", "query", "string", True),
    ("ask", "turn", "integer", True),
    ("ask", "chars", "integer", False),
    ("ask", "after", "string", False),
    ("explain", "query", "string", True),
    ("explain", "turn", "integer", True),
    ("explain", "chars", "integer", False),
    ("explain", "after", "string", True),
]
LONG_CHARS = 250


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, uses) of plain conversations (conv_id, turn, role, text).

    A user's turn is a call named by its length, whose result is the
    assistant's next turn, and which builds on the user's turn before. Turns
    of other roles are neither and make no row.
    """
    user, assistant = turns.where("role = 'user'"), turns.where("role = 'assistant'")
    ident = lambda back: F.concat(F.lit("t"), (F.col("turn") - back).cast("string"))
    pairs = [F.lit("query"), F.col("text"), F.lit("turn"), F.col("turn").cast("string"), F.lit("chars"), F.length("text").cast("string")]
    args = F.when(F.col("turn") >= 2, F.create_map(*pairs, F.lit("after"), ident(2))).otherwise(F.create_map(*pairs))
    calls = user.select(
        "conv_id", ident(0).alias("call_id"), "turn", F.when(F.coalesce(F.length("text"), F.lit(0)) > LONG_CHARS, "explain").otherwise("ask").alias("name"), args.alias("arguments")
    )
    results = assistant.select("conv_id", ident(1).alias("call_id"), "turn", F.col("text").alias("content"))
    uses = user.where("turn >= 2").select("conv_id", ident(0).alias("call_id"), ident(2).alias("needs"))
    return calls, results, uses
