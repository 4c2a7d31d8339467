"""Chat formatting: tool calls linked to their results, ordered, checked and serialised."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialise

#: JSON type of a schema and the variant types that satisfy it.
TYPES = {
    "string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN",
    "object": "OBJECT.*", "array": "ARRAY.*",
}
CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,after:string>>, tool_call_id string, content string"
#: What one turn of a plain conversation asks of the next.
REPLY = {"reply": {"text": ("string", True)}}


def tool_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results written as JSON in ``text``.

    An assistant message may be ``{"tool_calls": [{"id", "name", "arguments", "after"}]}``,
    a tool message ``{"tool_call_id", "content"}``. Other texts, null ones too, hold none.
    """
    held = messages.where(F.col("role").isin("assistant", "tool")).select(
        "conv_id", "turn", "role", F.from_json("text", CALLS).alias("j")
    )
    calls = held.where("role = 'assistant'").select("conv_id", "turn", F.explode("j.tool_calls").alias("c")).select(
        "conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"),
        F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"),
    )
    results = held.where("role = 'tool' and j.tool_call_id is not null").select(
        "conv_id", "turn", F.col("j.tool_call_id").alias("call_id"), F.col("j.content").alias("content")
    )
    return calls, results


def message_lines(messages: DataFrame) -> DataFrame:
    """A line for every message that is no call or result, and for the text beside calls.

    The columns are those of ``format_chat``. Repeated rows come out as often as they came in.
    """
    j = F.from_json("text", CALLS)
    held = messages.select(
        "conv_id", "turn", "role", "text", j["content"].alias("content"),
        F.coalesce((F.col("role") == "assistant") & (F.size(j["tool_calls"]) > 0), F.lit(False)).alias("calls"),
        F.coalesce((F.col("role") == "tool") & j["tool_call_id"].isNotNull(), F.lit(False)).alias("result"),
    )
    held = held.where(~F.col("result") & (~F.col("calls") | F.col("content").isNotNull()))
    return plain_lines(held.withColumn("text", F.when(F.col("calls"), F.col("content")).otherwise(F.col("text"))))


def plain_lines(held: DataFrame) -> DataFrame:
    """A line of its own for every row, with its role, turn and text."""
    none, zero = F.lit(None), F.lit(0).cast("long")
    return held.select(
        "conv_id", none.cast("string").alias("call_id"), "turn", none.cast("long").alias("depth"),
        F.lit("message").alias("status"), zero.alias("n_calls"), zero.alias("n_results"), none.cast("boolean").alias("valid"),
        canonical(content=F.col("text"), role=F.col("role"), turn=F.col("turn")).alias("line"),
        none.cast("long").alias("use"),
    )


def by_use(rows: DataFrame, *content: str) -> DataFrame:
    """``rows`` with the how-manieth use of its identifier, in turn order, put before ``call_id``.

    Rows equal in turn and ``content`` are one use. Made as ``use:call_id``, or ``use``
    alone for a null identifier.
    """
    order = Window.partitionBy("conv_id", "call_id").orderBy("turn", *content)
    use = F.dense_rank().over(order).cast("string")
    return rows.withColumn("call_id", F.concat(use, F.coalesce(F.concat(F.lit(":"), F.col("call_id")), F.lit(""))))


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A user turn as a call of ``reply``, the assistant's next turn as its result.

    Turn t has the identifier ``t``; it comes after the call of turn t - 2.
    """
    user = messages.where("role = 'user'")
    calls = user.select(
        "conv_id", "turn", F.col("turn").cast("string").alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("text"))).alias("arguments"),
        (F.col("turn") - 2).cast("string").alias("after"), "text",
    )
    results = messages.where("role = 'assistant'").select(
        "conv_id", "turn", (F.col("turn") - 1).cast("string").alias("call_id"), F.col("text").alias("content")
    )
    return calls, results


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row for each conversation and identifier, its first call beside its first result.

    A hash join on both keys. Each side is first reduced to the least (turn, content) of
    an identifier, with the number it stands for, so repeated identifiers never
    multiply. ``status``: linked, no_result, or no_call. Null identifiers or
    conversations match nothing but themselves.
    """
    first_calls = calls.groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "name", "arguments", "after")).alias("call"), F.count("*").alias("n_calls")
    )
    first_results = results.groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("n_results")
    )
    a, b = first_calls.alias("a"), first_results.alias("b")
    joined = a.join(
        b.hint("shuffle_hash"),
        F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("a.call_id").eqNullSafe(F.col("b.call_id")),
        "full",
    )
    status = F.when(F.col("result").isNull(), "no_result").when(F.col("call").isNull(), "no_call").otherwise("linked")
    return joined.select(
        F.coalesce("a.conv_id", "b.conv_id").alias("conv_id"),
        F.coalesce("a.call_id", "b.call_id").alias("call_id"),
        "call",
        "result",
        F.coalesce("n_calls", F.lit(0).cast("long")).alias("n_calls"),
        F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
        status.alias("status"),
    )


def depths(linked: DataFrame) -> DataFrame:
    """``linked`` with ``depth``: how many calls have to come before it.

    Ordering by depth is a topological order, as a call's ``after`` names one call
    before it. Each round doubles the distance looked back, so chains take a
    logarithm of their length; what is still open when the distance passes the number
    of calls runs in a circle and has a null depth. An unknown ``after`` counts as none.
    """
    ids = materialise(linked.select("conv_id", "call_id", F.col("call.after").alias("back")).where("conv_id is not null and call_id is not null"))
    known = ids.select("conv_id", F.col("call_id").alias("back"), F.lit(1).alias("known"))
    state = ids.join(known, ["conv_id", "back"], "left").select(
        "conv_id", "call_id", F.when(F.col("known") == 1, F.col("back")).alias("back"),
        F.coalesce("known", F.lit(0)).cast("long").alias("depth"),
    )
    state = materialise(state)
    reach, most = 1, ids.count()
    while not (open_ones := state.where("back is not null")).isEmpty() and reach <= most:
        step = state.select("conv_id", F.col("call_id").alias("back"), F.col("back").alias("further"), F.col("depth").alias("more"))
        ahead = open_ones.join(step, ["conv_id", "back"]).select(
            "conv_id", "call_id", F.col("further").alias("back"), (F.col("depth") + F.col("more")).alias("depth")
        )
        state = materialise(state.where("back is null").unionByName(ahead))
        reach *= 2
    found = state.select("conv_id", "call_id", F.when(F.col("back").isNull(), F.col("depth")).alias("depth"), F.lit(True).alias("ordered"))
    out = linked.join(found, ["conv_id", "call_id"], "left")
    return out.withColumn("depth", F.when(F.col("ordered").isNull(), F.lit(0).cast("long")).otherwise(F.col("depth"))).drop("ordered")


def valid(name: Column, arguments: Column, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> Column:
    """Whether the arguments are an object of the named tool's schema.

    ``schemas`` maps a tool to its fields, each a JSON type and whether it is required.
    An unknown tool or text that is no JSON object is not valid; fields that the
    schema does not name are allowed, a null counts as missing.
    """
    parsed = F.try_parse_json(arguments)
    verdict = F.lit(False)
    for tool, fields in schemas.items():
        good = F.schema_of_variant(parsed).startswith("OBJECT")
        for field, (kind, required) in fields.items():
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            shape = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
            good = good & (shape.rlike(f"^({TYPES[kind]})$") | (F.lit(not required) & (shape == "VOID")))
        verdict = F.when(name == tool, F.coalesce(good, F.lit(False))).otherwise(verdict)
    return verdict


def canonical(**fields: Column) -> Column:
    """JSON object with its names in order, without spaces, nulls written out."""
    parts = [v.alias(k) for k, v in sorted(fields.items())]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def format_calls(
    calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]
) -> DataFrame:
    """Linked, ordered and checked calls, one row each, with their canonical JSON.

    A conversation is not gathered into one row or task: its lines are put in order by
    (``conv_id``, ``depth``, ``turn``, ``call_id``).
    """
    return as_lines(depths(link(calls, results)), schemas)


def as_lines(rows: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]], *more: str) -> DataFrame:
    """Rows of ``depths`` with their verdict and canonical JSON, and the columns ``more``."""
    arguments = F.try_parse_json(F.col("call.arguments"))
    return rows.select(
        "conv_id",
        "call_id",
        F.coalesce("call.turn", "result.turn").alias("turn"),
        "depth",
        "status",
        "n_calls",
        "n_results",
        F.when(F.col("call").isNotNull(), valid(F.col("call.name"), F.col("call.arguments"), schemas)).alias("valid"),
        canonical(
            arguments=arguments, call_id=F.col("call_id"), depth=F.col("depth"), name=F.col("call.name"),
            result=F.col("result.content"),
        ).alias("line"),
        *more,
    )


def format_chat(messages: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> DataFrame:
    """Lines of all ``messages``: tool calls written as JSON (see ``tool_messages``) and plain texts of any role.

    An identifier used again in later turns is a call of its own each time, numbered by
    ``use``, and takes its results in turn order; ``after`` names a first use. A plain
    message has the status ``message`` and its role, turn and content in its line.
    """
    calls, results = tool_messages(messages)
    linked = uses_as_lines(by_use(calls, "name", "arguments", "after"), by_use(results, "content"), schemas)
    return linked.unionByName(message_lines(messages))


def uses_as_lines(
    calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]
) -> DataFrame:
    """Lines of calls and results by ``by_use``, each with its identifier again and its ``use``."""
    calls = calls.withColumn("after", F.concat(F.lit("1:"), F.col("after")))
    rows = depths(link(calls, results))
    use = F.regexp_extract("call_id", r"^\d+", 0)
    own = F.when(F.length("call_id") > F.length(use), F.expr("substring(call_id, instr(call_id, ':') + 1)"))
    rows = materialise(rows.withColumns({"use": use.cast("long"), "call_id": own}))
    return as_lines(rows, schemas, "use")


def format_turns(messages: DataFrame) -> DataFrame:
    """Lines of a plain conversation: each user turn linked to its reply, and every other message.

    Texts of one turn and role that differ are uses of their own, met by their replies in
    the order of the texts; equal ones are one, counted. Messages of any other role, null
    too, have the status ``message``. So ``n_calls``, ``n_results`` and the lines of
    messages add up to the rows of ``messages``.
    """
    calls, results = turns_as_calls(messages)
    linked = uses_as_lines(by_use(calls, "text").drop("text"), by_use(results, "content"), REPLY)
    others = messages.where(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)))
    return linked.unionByName(plain_lines(others))
