"""Tool-call linking, in DataFrame functions only: join calls and results by identifier, order them, validate, write canonical JSON.

Calls and results of equal identifiers are first reduced to one row each (the smallest canonical JSON, with counts), so the hash join
is one to one however often an identifier repeats. A call names the calls whose results it needs by `{"$ref": "<id>"}` values among
its arguments; levels follow by pointer doubling along chains and by rounds where calls need several others, on checkpointed rows. Within a conversation (level, turn, call_id) is a topological order; results directly follow their calls.
Arguments are checked against a table of schemas (tool, field, type, required). Canonical JSON has its keys sorted and no spaces.

Defined results: a null id: the call stands alone, unlinked ("missing_id"). Arguments that are null or not a JSON object:
"bad_arguments". Repeated calls or results: one row, n_calls and n_results tell how many. A call without result: "no_result"; a
result without call: "no_call". Needs that never appear: "unknown_reference"; calls in or after a cycle: level null and "cycle".
Empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbridge.llm.shared import table
from symbridge.operators.components import checkpointed

#: JSON types of a schema, as Spark names a variant's type.
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}

MESSAGE = "tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string, content string"
#: Most schema fields, which bounds what is broadcast.
MOST_FIELDS = 10_000
REFERENCE = r'"\$ref"\s*:\s*"([^"\\]*)"'


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and no spaces; null if it is not JSON."""
    return F.to_json(F.try_parse_json(json))


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls: conv_id, turn, call_id, name, arguments; results: conv_id, turn, call_id, content) of logged messages.

    Messages are (conv_id, turn, role, text); a text is a JSON object with tool_calls, or of role "tool" with tool_call_id and content.
    """
    read = messages.select("conv_id", "turn", "role", F.from_json("text", MESSAGE).alias("m"))
    calls = read.select("conv_id", "turn", F.explode("m.tool_calls").alias("c")).select("conv_id", "turn", F.col("c.id").alias("call_id"), "c.name", "c.arguments")
    results = read.where("role = 'tool' AND m.tool_call_id IS NOT NULL").select("conv_id", "turn", F.col("m.tool_call_id").alias("call_id"), "m.content")
    return calls, results


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a plain chat: what the system or the user says calls on the model, and the turn after answers it.

    A call needs the answer of the exchange before it, which its arguments name.
    """
    call_id = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    before = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 2).cast("string"))
    answered = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    known = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), call_id)
    rest = F.col("role") == "assistant"
    text = F.struct(F.when(F.col("turn") >= 2, F.struct(before.alias("$ref"))).alias("after"), F.col("text").alias("text"), F.col("turn").cast("long").alias("turn"))
    calls = conversations.where(~F.coalesce(rest, F.lit(False))).select("conv_id", "turn", known.alias("call_id"), F.col("role").alias("name"), F.to_json(text).alias("arguments"))
    results = conversations.where(rest).select("conv_id", "turn", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), answered).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def levels(needs: DataFrame, calls: DataFrame) -> DataFrame:
    """(call_id, level): 0 without needs, else one more than the largest level needed; no row in or after a cycle.

    needs is (call_id, needed), both among calls. Chains of calls with one need each are shortened by pointer doubling, which leaves the
    calls with none (level 0) or several; those are placed by rounds, each taking the calls whose needs all have levels.
    """
    needs = checkpointed(needs.distinct())
    number = needs.groupBy("call_id").count()
    chain = checkpointed(needs.join(number.where("count = 1").select("call_id"), "call_id").select("call_id", F.col("needed").alias("at"), F.lit(1).alias("far")))
    doublings = chain.count().bit_length()
    for _ in range(doublings):  # what is not at an end of its chain by then is in or after a cycle
        ahead = chain.select(F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("far").alias("more"))
        step = checkpointed(chain.join(ahead, "at", "left").select("call_id", F.coalesce("next", "at").alias("at"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("moved")))
        chain = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    placed = calls.select("call_id").join(number, "call_id", "left_anti").select("call_id", F.lit(0).alias("level"))
    several = needs.join(number.where("count > 1").select("call_id"), "call_id").join(chain.withColumnRenamed("call_id", "needed"), "needed", "left")
    unmet = checkpointed(several.select("call_id", F.coalesce("at", "needed").alias("at"), (F.coalesce("far", F.lit(0)) + 1).alias("far"), F.lit(None).cast("int").alias("level")))
    rounds, done = [checkpointed(placed)], None
    while not unmet.isEmpty():
        done = rounds[-1]
        met = unmet.join(done.select(F.col("call_id").alias("at"), F.col("level").alias("found")), "at", "left").select("call_id", "at", "far", F.coalesce("level", F.col("found") + F.col("far")).alias("level"))
        met = checkpointed(met)
        ready = checkpointed(met.groupBy("call_id").agg(F.max("level").alias("level"), F.every(F.col("level").isNotNull()).alias("all")).where("all").select("call_id", "level"))
        if ready.isEmpty():
            break
        unmet = checkpointed(met.join(ready.select("call_id"), "call_id", "left_anti"))
        rounds.append(ready)
    anchors = reduce(DataFrame.unionAll, rounds)
    return anchors.unionAll(chain.join(anchors.withColumnRenamed("call_id", "at"), "at").select("call_id", (F.col("level") + F.col("far")).alias("level")))


def invalid(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(call_id, errors): the sorted faults of each call's arguments; calls is (call_id, name, arguments), schemas (tool, field, type, required)."""
    if schemas.limit(MOST_FIELDS + 1).count() > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} schema fields")
    fields = schemas.groupBy(F.col("tool").alias("name")).agg(F.sort_array(F.collect_list(F.struct("field", "type", "required"))).alias("fields"))
    value = calls.select("call_id", "name", F.try_parse_json("arguments").alias("value")).join(F.broadcast(fields), "name", "left")  # at most MOST_FIELDS fields
    rows = value.select("call_id", "fields", "value", F.regexp_extract(F.coalesce(F.schema_of_variant("value"), F.lit("")), r"^(\w*)", 1).alias("kind"))
    each = rows.where("fields IS NOT NULL AND kind = 'OBJECT'").select("call_id", F.try_variant_get("value", F.lit("$"), "map<string,variant>").alias("held"), F.explode("fields").alias("f"))
    got = each.select("call_id", "f.*", F.try_element_at("held", F.col("f.field")).alias("got"))
    typed = got.select("call_id", "field", "type", "required", F.regexp_extract(F.coalesce(F.schema_of_variant("got"), F.lit("VOID")), r"^(\w+)", 1).alias("kind"))
    fits = reduce(Column.__or__, [(F.col("type") == t) & F.col("kind").isin(kinds) for t, kinds in TYPES.items()])
    fault = F.when(F.col("kind") == "VOID", F.when(F.col("required"), F.concat(F.lit("missing:"), F.col("field")))).when(~fits, F.concat(F.lit("type:"), F.col("field")))
    faults = typed.select("call_id", fault.alias("error")).where("error IS NOT NULL")
    bad = rows.where("kind <> 'OBJECT'").select("call_id", F.lit("bad_arguments").alias("error"))
    unknown = rows.where("fields IS NULL").select("call_id", F.lit("unknown_tool").alias("error"))
    return faults.unionAll(bad).unionAll(unknown).groupBy("call_id").agg(F.sort_array(F.collect_set("error")).alias("faults"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per identifier, and one per call or result without: conv_id, turn, call_id, name, level, n_calls, n_results, valid, errors, canonical."""
    call = F.struct(canonical(F.col("arguments")).alias("canon"), "arguments", F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "name")
    answer = F.struct("content", F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"))
    one = checkpointed(calls.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(call).alias("c"), F.count("*").alias("n_calls")).select("call_id", "c.*", "n_calls"))
    answers = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(answer).alias("r"), F.count("*").alias("n_results"))
    refs = one.select("call_id", F.explode(F.array_distinct(F.regexp_extract_all("canon", F.lit(REFERENCE), F.lit(1)))).alias("needed"))
    known = refs.join(one.select(F.col("call_id").alias("needed"), F.lit(True).alias("known")), "needed", "left")
    lost = known.where("known IS NULL").select("call_id", F.lit("unknown_reference").alias("lost")).distinct()
    placed = levels(known.where("known").select("call_id", "needed"), one)
    linked = one.join(answers, "call_id", "full").join(placed, "call_id", "left").join(invalid(one, schemas), "call_id", "left").join(lost, "call_id", "left")
    no_id = (
        calls.where("call_id IS NULL").select(F.col("call_id").cast("string").alias("call_id"), call.alias("c"), F.lit(1).cast("long").alias("n_calls")).select("call_id", "c.*", "n_calls", F.lit(None).cast(linked.schema["r"].dataType).alias("r"), F.lit(None).cast("long").alias("n_results"))
        .unionByName(results.where("call_id IS NULL").select(F.col("call_id").cast("string").alias("call_id"), answer.alias("r"), F.lit(1).cast("long").alias("n_results")), allowMissingColumns=True)
        .select("*", F.lit(0).alias("level"), F.array().cast("array<string>").alias("faults"), F.lit("missing_id").alias("lost"))
    )
    called = F.col("n_calls").isNotNull()
    more = F.array(
        F.when(~called, "no_call"), F.when(F.col("n_results").isNull(), "no_result"), F.col("lost"), F.when(called & F.col("level").isNull(), "cycle"),
    )
    errors = F.concat(F.coalesce("faults", F.array().cast("array<string>")), F.array_compact(more))
    whole = F.to_json(F.struct(F.try_parse_json("canon").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("r.content").alias("result")))
    return linked.unionByName(no_id).select(
        F.coalesce("conv_id", "r.conv_id").alias("conv_id"), F.coalesce("turn", "r.turn").alias("turn"), "call_id", "name", "level",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        (F.size(errors) == 0).alias("valid"), F.array_join(errors, ",").alias("errors"), whole.alias("canonical"),
    )


def exchange_schemas(spark: SparkSession) -> DataFrame:
    """The schemas of exchanges()."""
    fields = [("text", "string", True), ("turn", "integer", True), ("after", "object", False)]
    return spark.createDataFrame([(tool, *f) for tool in ("system", "user") for f in fields], "tool string, field string, type string, required boolean")


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(*exchanges(table(spark, sf_dir, "conversations")), exchange_schemas(spark))


ORACLE = """
WITH RECURSIVE said AS (SELECT *, conv_id || ':' || turn AS call_id FROM conversations WHERE role <> 'assistant'),
answers AS (SELECT conv_id || ':' || (turn - 1) AS call_id, conv_id, turn, text FROM conversations WHERE role = 'assistant'),
placed(conv_id, turn, level) AS (
    SELECT conv_id, turn, 0 FROM said s WHERE turn < 2 OR NOT EXISTS (SELECT 1 FROM said b WHERE b.conv_id = s.conv_id AND b.turn = s.turn - 2)
    UNION ALL SELECT s.conv_id, s.turn, p.level + 1 FROM placed p JOIN said s ON s.conv_id = p.conv_id AND s.turn = p.turn + 2
)
SELECT CAST(coalesce(s.conv_id, a.conv_id) AS VARCHAR) AS conv_id, coalesce(s.turn, a.turn) AS turn, coalesce(s.call_id, a.call_id) AS call_id, s.role AS name, p.level AS level,
    CAST(s.call_id IS NOT NULL AS BIGINT) AS n_calls, CAST(a.call_id IS NOT NULL AS BIGINT) AS n_results,
    s.call_id IS NOT NULL AND a.call_id IS NOT NULL AND (s.turn < 2 OR b.call_id IS NOT NULL) AS valid,
    concat_ws(',', CASE WHEN s.call_id IS NULL THEN 'no_call' END, CASE WHEN a.call_id IS NULL THEN 'no_result' END, CASE WHEN s.turn >= 2 AND b.call_id IS NULL THEN 'unknown_reference' END) AS errors,
    '{' || concat_ws(',',
        CASE WHEN s.call_id IS NOT NULL THEN '"arguments":{' || concat_ws(',', CASE WHEN s.turn >= 2 THEN '"after":{"$ref":"' || s.conv_id || ':' || (s.turn - 2) || '"}' END, '"text":' || CAST(to_json(s.text) AS VARCHAR), '"turn":' || s.turn) || '}' END,
        '"id":"' || coalesce(s.call_id, a.call_id) || '"', '"name":"' || s.role || '"', '"result":' || CAST(to_json(a.text) AS VARCHAR)) || '}' AS canonical
FROM said s FULL JOIN answers a ON s.call_id = a.call_id
LEFT JOIN placed p ON p.conv_id = s.conv_id AND p.turn = s.turn
LEFT JOIN said b ON b.conv_id = s.conv_id AND b.turn = s.turn - 2
"""
