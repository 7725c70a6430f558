"""Tool-call linking with DataFrame functions alone.

Calls and results are hash-joined by conversation and call id; calls are ordered topologically by the calls
they come after, arguments are validated against schemas, and each call is written as canonical JSON: keys in
order, no blanks, nulls kept.

A call's level is the length of the longest chain of calls before it. Along calls that come after one other
alone, pointers double their reach each round; calls that come after several are levelled once all before them
are. Each round is a table in the shared folder. Calls in or behind a circle have no level. (level, seq, call_id) is an order of a conversation's calls.

Of calls that repeat an id the first by seq (ties: by arguments) is the call, the others are `duplicate` and
have no result. The first result by seq (ties: by content) counts. Status is `linked`, `unanswered`, `cyclic`
or `duplicate`. Violations list arguments that are no JSON object (`not an object`), `missing:x`, `type:x` and
`unknown:x`, sorted, and `after:x` for named calls that do not exist; a tool without schema is
`unknown tool`. Nulls: calls without conversation or call id link with nothing; null arguments are no object.
Results without a call are left out. Empty tables give no rows; extra columns are not read, so their names
cannot clash.

Only the first calls of an id are joined by it, so that both sides of every such join have one row a key;
repeats of an id, and calls without one, pass beside the joins. Which call is the first comes from a partial
aggregate and is joined back by row, so that an id that holds a third of all rows lands in no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, stored

BROADCAST_SCHEMAS = 10_000
#: Variant types by JSON schema type.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<.*", "object": "^OBJECT<.*"}


def levels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of edges(conv_id, call_id, dep): (conv_id, call_id, level) of calls behind others, and the calls in or behind circles."""
    edges = stored(edges.select("conv_id", "call_id", "dep").distinct(), "edges")
    degree = stored(edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("dep").alias("dep")), "degree")

    # calls behind one other: pointers double their reach until they stand on a call behind none or several
    chain = stored(degree.where("n = 1").select("conv_id", "call_id", F.col("dep").alias("top"), F.lit(1).cast("bigint").alias("steps"), F.lit(True).alias("moving")), "chain")
    rounds = chain.count().bit_length() + 1
    for _ in range(rounds):
        ahead = chain.select("conv_id", F.col("call_id").alias("top"), F.col("top").alias("next"), F.col("steps").alias("more"))
        step = chain.join(ahead, ["conv_id", "top"], "left")
        chain, last = stored(step.select("conv_id", "call_id", F.coalesce("next", "top").alias("top"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moving")), "chain"), chain
        discarded(last)
        if chain.where("moving").isEmpty():
            break

    # calls behind several: a round for each of these on the longest way
    several = degree.where("n > 1").select("conv_id", "call_id")
    onto = chain.select("conv_id", F.col("call_id").alias("dep"), "top", "steps", "moving")
    hops = edges.join(several, ["conv_id", "call_id"], "left_semi").join(onto, ["conv_id", "dep"], "left")
    hops = hops.select("conv_id", "call_id", F.coalesce("top", "dep").alias("top"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), F.coalesce("moving", F.lit(False)).alias("lost"))
    held = hops.join(several.select("conv_id", F.col("call_id").alias("top"), F.lit(True).alias("open")), ["conv_id", "top"], "left")
    hops = stored(held.select("conv_id", "call_id", "top", "steps", "lost", F.col("open").isNotNull().alias("waits")), "hops")
    known, count = stored(several.withColumn("level", F.lit(0).cast("bigint")).where("false"), "known"), 0
    while not hops.isEmpty():
        seen = hops.join(known.select("conv_id", F.col("call_id").alias("top"), "level"), ["conv_id", "top"], "left")
        ready = seen.groupBy("conv_id", "call_id").agg(F.max(F.col("lost") | (F.col("waits") & F.col("level").isNull())).alias("blocked"), F.max(F.coalesce("level", F.lit(0)) + F.col("steps")).alias("level"))
        known, last = stored(ready.where("NOT blocked").select("conv_id", "call_id", "level"), "known"), known
        discarded(last)
        if (new := known.count()) == count:
            break
        count = new

    base = chain.join(known.select("conv_id", F.col("call_id").alias("top"), "level"), ["conv_id", "top"], "left").join(several.select("conv_id", F.col("call_id").alias("top"), F.lit(True).alias("open")), ["conv_id", "top"], "left")
    lost = F.col("moving") | (F.col("open").isNotNull() & F.col("level").isNull())
    single = base.select("conv_id", "call_id", F.when(~lost, F.coalesce("level", F.lit(0)) + F.col("steps")).alias("level"))
    every = stored(single.unionByName(several.join(known, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "level")), "levels")
    return every.where("level IS NOT NULL"), every.where("level IS NULL").select("conv_id", "call_id")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row a call.

    calls(conv_id, call_id, seq, name, arguments: JSON, after: ids), results(conv_id, call_id, seq, content) and
    schemas(name, param, kind, required) give conv_id, call_id, seq, name, level, status, n_results, result,
    violations and json.
    """
    key = ["conv_id", "call_id"]
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = stored(calls.select("conv_id", "call_id", "seq", "name", "arguments", "after").withColumn("row", F.monotonically_increasing_id()), "calls")
    first = calls.where(named).groupBy(*key).agg(F.min(F.struct("seq", "arguments", "row")).alias("w")).select(F.col("w.row").alias("row"), F.lit(True).alias("first"))
    calls = stored(calls.join(first, "row", "left").withColumn("first", F.when(named, F.coalesce("first", F.lit(False))).otherwise(True)), "calls")
    answers = results.groupBy(*key).agg(F.count("*").alias("n_results"), F.min(F.struct("seq", "content")).alias("answer"))
    wanted = calls.where(F.col("first") & named).select("conv_id", "call_id", F.explode("after").alias("dep")).where("dep IS NOT NULL")
    known = calls.where(F.col("first") & named).select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("known"))
    wanted = stored(wanted.join(known, ["conv_id", "dep"], "left"), "after")
    level, circles = levels(wanted.where("known"))
    lost = wanted.where("known IS NULL").groupBy(*key).agg(F.sort_array(F.collect_set(F.concat(F.lit("after:"), "dep"))).alias("lost"))
    params = schemas.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("param", "kind", "required"))).alias("params"))
    if schemas.count() <= BROADCAST_SCHEMAS:  # else a shuffled join
        params = F.broadcast(params)
    found = calls.where(F.col("first") & named).select("row", *key)
    sides = (answers, level, circles.withColumn("circle", F.lit(True)), lost)
    for side in sides:
        found = found.join(side.hint("shuffle_hash"), key, "left")
    alone = calls.where(~(F.col("first") & named))
    out = calls.where(F.col("first") & named).join(found.drop(*key), "row")
    for f in out.schema.fields[len(calls.columns) :]:
        alone = alone.withColumn(f.name, F.lit(None).cast(f.dataType))
    out = out.unionByName(alone).withColumn("args", F.try_parse_json("arguments")).withColumn("given", F.expr("try_variant_get(args, '$', 'map<string,variant>')"))
    out = out.join(params, "name", "left")
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    missing = F.transform(F.filter("params", lambda p: F.coalesce(p["required"], F.lit(False)) & ~F.map_contains_key("given", p["param"])), lambda p: F.concat(F.lit("missing:"), p["param"]))
    wrong = F.filter("params", lambda p: F.map_contains_key("given", p["param"]) & ~F.coalesce(F.rlike(F.schema_of_variant(F.element_at("given", p["param"])), F.coalesce(F.element_at(kind, p["kind"]), F.lit("."))), F.lit(False)))
    wrong = F.transform(wrong, lambda p: F.concat(F.lit("type:"), p["param"]))
    unknown = F.transform(F.array_except(F.map_keys("given"), F.transform("params", lambda p: p["param"])), lambda x: F.concat(F.lit("unknown:"), x))
    none = F.expr("cast(array() as array<string>)")
    checked = (
        F.when(F.col("params").isNull(), F.array(F.lit("unknown tool"))).when(F.col("given").isNull(), F.array(F.lit("not an object"))).otherwise(F.sort_array(F.concat(missing, wrong, unknown)))
    )
    status = F.when(~F.col("first"), "duplicate").when(F.col("circle"), "cyclic").when(F.col("n_results").isNotNull(), "linked").otherwise("unanswered")
    out = out.withColumns(
        {
            "status": status,
            "level": F.when(F.col("first") & F.col("circle").isNull(), F.coalesce("level", F.lit(0)).cast("bigint")),
            "violations": F.concat(checked, F.when(F.col("first"), F.coalesce("lost", none)).otherwise(none)),
            "n_results": F.when(F.col("first"), F.coalesce("n_results", F.lit(0))).otherwise(0).cast("long"),
            "result": F.when(F.col("first"), F.col("answer.content")),
        }
    )
    whole = F.to_json(F.struct(F.col("args").alias("arguments"), "call_id", "level", "name", "result", "status"), {"ignoreNullFields": "false"})
    return out.select("conv_id", "call_id", "seq", "name", "level", "status", "n_results", "result", "violations", whole.alias("json"))


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results out of plain turns: a user's turn calls the tool `reply`, after the call two turns before; the assistant's next turn is its result."""
    name = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - back).cast("string"))
    calls = turns.where("role = 'user'").select(
        "conv_id", name(0).alias("call_id"), F.col("turn").alias("seq"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"), F.when(F.col("turn") >= 2, F.array(name(2))).alias("after")
    )
    results = turns.where("role = 'assistant'").select("conv_id", name(1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return calls, results
