"""Tool-call linking: calls and results meet in a hash join by identifier, are put into topological order, have their
arguments checked against schemas, and are written as canonical JSON (sorted keys, no spaces, no escapes beyond what JSON needs).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftnet.llm.common import spool

#: Turns of a conversation that one task ranks.
BLOCK_TURNS = 4096
#: The schema of the exchange that a user turn and the assistant turn after it make.
REPLY = {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}
SCHEMAS = {"reply": REPLY}
CALLS = "conv_id long, turn long, call_id string, tool string, arguments string, needs array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def escaped(text: str) -> str:
    """Lone surrogates, which no UTF-8 text can hold, as escapes of six characters."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def refuse(word: str):
    raise ValueError(f"{word} is no JSON")


def finite(number: str) -> float:
    value = float(number)
    return value if math.isfinite(value) else refuse(number)


def parsed(arguments: str):
    """A JSON value; ValueError for all that is none, such as NaN, numbers beyond the range and nesting beyond what Python can hold."""
    try:
        value = json.loads(arguments, parse_constant=refuse, parse_float=finite)
        canonical(value)  # what can be read may still be too deep to write
    except RecursionError:
        raise ValueError("nested too deeply") from None
    return value


def of_type(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, (int, float) if kind == "number" else int) and not isinstance(value, bool)
    return isinstance(value, TYPES[kind])


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a JSON schema: type, enum, required, properties, additionalProperties, items, lengths and bounds."""
    out = []
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(of_type(value, k) for k in kinds):
            return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list):
        out += [e for k, x in enumerate(value) for e in violations(x, schema.get("items", {}), f"{at}[{k}]")]
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if len(value) < schema.get(low, 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get(high, len(value)):
            out.append(f"{at}: too long")
    if of_type(value, "number"):
        if value < schema.get("minimum", value):
            out.append(f"{at}: too small")
        if value > schema.get("maximum", value):
            out.append(f"{at}: too large")
    return out


def checking(schemas: dict[str, dict]):
    def judge(tool, arguments, lost) -> tuple[object, list[str]]:
        errors = [f"needs {i}: unknown" for i in lost or []]
        try:
            value = parsed(arguments) if arguments is not None else None
        except ValueError:
            return arguments, ["$: not JSON", *errors]
        if tool not in schemas:
            return value, [f"tool {tool}: unknown", *errors]
        return value, violations(value, schemas[tool]) + errors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, texts = [], [], []
            for r in batch.to_pylist():
                rest = {"id": r["call_id"], "name": r["tool"], "needs": r["needs"] or [], "result": r["content"]}
                try:
                    value, found = (None, []) if r["status"] == "orphan" else judge(r["tool"], r["arguments"], r["lost"])
                    text = canonical({"arguments": value} | rest)
                except RecursionError:  # read and written by itself, but too deep within a schema or the whole object
                    found, text = ["$: not JSON"], canonical({"arguments": r["arguments"]} | rest)
                valid.append(not found and r["status"] == "linked")
                errors.append(escaped("; ".join(found)))
                texts.append(text)
            keep = ("conv_id", "call_id", "tool", "turn", "place", "n_results", "status")
            added = [pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(n)) for n in keep), *added], names=[*keep, "valid", "errors", "json"])

    return run


def topological_places(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, call_id, base, hops, cyclic: ordering by (base, hops) puts each call behind all that it needs.

    The order of turns holds wherever references point back. Calls that need a later one move right behind it, round by round;
    each round settles at least one forward reference, so calls that still move after as many rounds as there are
    forward references lie on a cycle or behind one.
    """
    nodes = calls.select("conv_id", "call_id", F.col("turn").alias("base"), F.lit(0).cast("long").alias("hops"))
    rounds = None
    moved = None
    while True:
        own = edges.join(nodes, ["conv_id", "call_id"])
        needed = nodes.select("conv_id", F.col("call_id").alias("need"), F.struct("base", F.col("hops").alias("hops")).alias("after"))
        late = own.join(needed, ["conv_id", "need"]).filter(F.struct("base", "hops") <= F.col("after"))
        moved = spool(late.groupBy("conv_id", "call_id").agg(F.max("after").alias("after"), F.count("*").alias("n")), "late-calls")
        n = moved.agg(F.sum("n")).first()[0] or 0
        rounds = n + 1 if rounds is None else rounds - 1
        if n == 0 or rounds <= 0:
            break
        joined = nodes.join(moved, ["conv_id", "call_id"], "left")
        nodes = spool(joined.select("conv_id", "call_id", F.coalesce("after.base", "base").alias("base"), F.coalesce(F.col("after.hops") + 1, "hops").alias("hops")), "placed-calls")
    lost, n, before = moved.select("conv_id", "call_id"), int(n > 0), 0
    while n > before:  # all that needs a call on a cycle, the rest of the cycle included
        behind = edges.join(lost.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"]).select("conv_id", "call_id")
        lost = spool(lost.unionByName(behind).distinct(), "cyclic-calls")
        before, n = n, lost.count()
    return nodes.join(lost.withColumn("cyclic", F.lit(True)), ["conv_id", "call_id"], "left")


def ranked(rows: DataFrame) -> DataFrame:
    """rows with place: 1, 2, ... within the conversation by base, hops, call_id; a long conversation is ranked in blocks of turns."""
    cut = rows.withColumn("block", F.floor(F.col("base") / BLOCK_TURNS))
    sizes = cut.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("conv_id", "block").orderBy("base", "hops", "call_id")
    return cut.withColumn("k", F.row_number().over(within)).join(starts, ["conv_id", "block"]).withColumn("place", F.col("start") + F.col("k")).drop("block", "k", "start", "base", "hops")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict] = SCHEMAS) -> DataFrame:
    """conv_id, call_id, tool, turn, place, n_results, status, valid, errors, json: a row for each call and each result without a call.

    calls has the columns CALLS, results RESULTS; other columns are ignored. Of calls with the same identifier in a conversation the earliest
    holds, of results the earliest. status: linked, early (its result stands before it), open (no result), cyclic, or orphan
    (a result without a call; turn is the result's, place is null). valid: linked, of a known tool, with arguments that
    keep the schema and references to calls that exist. Arguments that are no JSON (NaN, infinite or endless numbers and too deep nesting included) are
    kept as a string; of repeated keys in an object the last holds, and lone surrogates are written as escapes. Rows without conv_id or call_id identify nothing and are left out; null
    turns count as -1; a null in needs is ignored; empty inputs give an empty result.
    """
    named = lambda df: df.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").withColumn("turn", F.coalesce("turn", F.lit(-1).cast("long")))
    rest = F.struct("turn", "tool", "arguments", "needs")
    calls = named(calls).groupBy("conv_id", "call_id").agg(F.min(rest).alias("c")).select("conv_id", "call_id", "c.*")
    calls = spool(calls.withColumn("needs", F.array_sort(F.array_distinct(F.array_compact(F.coalesce("needs", F.array().cast("array<string>")))))), "calls")
    found = named(results).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    wanted = calls.select("conv_id", "call_id", F.explode("needs").alias("need"))
    edges = spool(wanted.join(calls.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("known")), ["conv_id", "need"], "left"), "edges")
    places = ranked(topological_places(calls, edges.filter("known").select("conv_id", "call_id", "need")))
    lost = edges.filter("known IS NULL").groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("need")).alias("lost"))
    both = calls.join(places, ["conv_id", "call_id"]).join(lost, ["conv_id", "call_id"], "left").join(found, ["conv_id", "call_id"], "full_outer")
    status = F.when(F.col("place").isNull(), "orphan").when(F.col("cyclic"), "cyclic").when(F.col("n_results").isNull(), "open").when(F.col("r.turn") < F.col("turn"), "early").otherwise("linked")
    rows = both.select("conv_id", "call_id", "tool", F.coalesce("turn", "r.turn").alias("turn"), "place", F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"), status.alias("status"), "arguments", "needs", "lost", F.col("r.content").alias("content"))
    return rows.mapInArrow(checking(schemas), "conv_id long, call_id string, tool string, turn long, place long, n_results long, status string, valid boolean, errors string, json string")


def exchanges(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of chats without tools: each user turn calls `reply` and needs the user turn two before, the next assistant turn is its result.

    turns needs conv_id, turn, role, text. The identifier is conv_id-turn. A null text makes an empty prompt or result.
    """
    at = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    text = F.coalesce("text", F.lit(""))
    users = turns.filter("role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL")
    arguments = F.to_json(F.struct(text.alias("prompt"), "turn"))
    calls = users.select("conv_id", "turn", at(F.col("turn")).alias("call_id"), F.lit("reply").alias("tool"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, F.array(at(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("needs"))
    replies = turns.filter("role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL")
    return calls, replies.select("conv_id", "turn", at(F.col("turn") - 1).alias("call_id"), text.alias("content"))


EXCHANGES_SQL = """WITH calls AS (SELECT conv_id, turn, concat(conv_id, '-', turn) AS call_id, min(coalesce(text, '')) AS prompt FROM conversations WHERE role = 'user' GROUP BY ALL),
results AS (SELECT conv_id, turn, concat(conv_id, '-', turn - 1) AS call_id, min(coalesce(text, '')) AS content, count(*) AS n_results FROM conversations WHERE role = 'assistant' GROUP BY ALL),
placed AS (SELECT c.*, CASE WHEN c.turn >= 2 THEN concat(c.conv_id, '-', c.turn - 2) END AS need, CAST(row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS BIGINT) AS place,
  c.turn >= 2 AND NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2) AS lost FROM calls c)
SELECT coalesce(p.conv_id, r.conv_id) AS conv_id, coalesce(p.call_id, r.call_id) AS call_id, CASE WHEN p.conv_id IS NOT NULL THEN 'reply' END AS tool, coalesce(p.turn, r.turn) AS turn, place,
  coalesce(n_results, 0) AS n_results, CASE WHEN p.conv_id IS NULL THEN 'orphan' WHEN r.conv_id IS NULL THEN 'open' ELSE 'linked' END AS status,
  coalesce(p.conv_id IS NOT NULL AND r.conv_id IS NOT NULL AND NOT lost AND prompt != '', FALSE) AS valid,
  CASE WHEN p.conv_id IS NULL THEN '' ELSE concat_ws('; ', CASE WHEN prompt = '' THEN '$.prompt: too short' END, CASE WHEN lost THEN concat('needs ', need, ': unknown') END) END AS errors,
  concat('{"arguments":', CASE WHEN p.conv_id IS NULL THEN 'null' ELSE concat('{"prompt":', CAST(to_json(prompt) AS VARCHAR), ',"turn":', p.turn, '}') END, ',"id":"', coalesce(p.call_id, r.call_id), '","name":', CASE WHEN p.conv_id IS NULL THEN 'null' ELSE '"reply"' END,
    ',"needs":[', CASE WHEN need IS NOT NULL THEN concat('"', need, '"') ELSE '' END, '],"result":', CASE WHEN r.conv_id IS NULL THEN 'null' ELSE CAST(to_json(content) AS VARCHAR) END, '}') AS json
FROM placed p FULL OUTER JOIN results r ON p.conv_id = r.conv_id AND p.call_id = r.call_id"""
