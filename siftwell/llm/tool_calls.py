"""Operator 6: chat formatting with tool-call linking.

An assistant message may hold calls, <tool_call>{"id", "name", "arguments", "depends_on"}</tool_call>; a message of any
role results, <tool_result>{"id", "content"}</tool_result>; a system message the tools' schemas,
<tools>[{"name", "parameters"}]</tools>. Calls and results of a conversation are hash-joined by identifier, calls are put
in topological order of what they depend on (depends_on, and {"$ref": id} within arguments), their arguments validated
against the schemas, and each message is serialised as canonical JSON: keys sorted, no spaces, letters as they are.

No step gathers a conversation: messages, calls and results are rows, joined and summed by key, so a conversation of any
length is spread out. Only one message's own calls meet in one row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from fractions import Fraction
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, lean, read, scratch, settled

CALL, RESULT, TOOLS = (re.compile(rf"<{t}>(.*?)</{t}>", re.S) for t in ("tool_call", "tool_result", "tools"))

HALVES = re.compile("[\ud800-\udfff]")

PARSED = (
    "row_key long, conv_id long, turn long, role string, content string, "
    "calls array<struct<no:int,id:string,name:string,arguments:string,deps:array<string>>>, results array<struct<no:int,id:string,content:string>>, tools array<struct<no:int,name:string,schema:string,entry:string>>, bad array<string>"
)


def canonical(value) -> str:
    """Letters stand as they are, but for halves of surrogate pairs, which UTF-8 doesn't have: these stay escapes."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return HALVES.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def references(value) -> set[str]:
    if isinstance(value, dict):
        own = {value["$ref"]} if isinstance(value.get("$ref"), str) else set()
        return own.union(*(references(v) for v in value.values()))
    return set().union(*(references(v) for v in value)) if isinstance(value, list) else set()


def load(text: str):
    """A JSON value; numbers that JSON doesn't have (NaN), or that are too large for a float, are errors."""

    def refuse(name: str):
        raise ValueError(name)

    def finite(digits: str) -> float:
        x = float(digits)
        return x if abs(x) < float("inf") else refuse(digits)

    return json.loads(text, parse_constant=refuse, parse_float=finite)


def name_of(value) -> str:
    out = value if isinstance(value, str) else canonical(value)
    if HALVES.search(out):
        raise ValueError("half of a surrogate pair in a name")
    return out


def parse_message(text: str) -> tuple[str, list[dict], list[dict], list[dict], list[str]]:
    """The text without markup, its calls, results and tools, and the blocks, or tools of a block, that can't be read.

    no is a block's place in the text.
    """
    calls, results, tools, bad = [], [], [], []
    readable = (ValueError, KeyError, TypeError, AttributeError, RecursionError)
    for pattern, out in ((CALL, calls), (RESULT, results), (TOOLS, tools)):
        for found in pattern.finditer(text):
            no = found.start()
            try:
                value = load(found[1])
                if out is calls:
                    arguments = value.get("arguments", {})
                    deps = {name_of(d) for d in value.get("depends_on") or []} | {name_of(d) for d in references(arguments)}
                    name = name_of(value["id"])
                    out.append({"no": no, "id": name, "name": name_of(value["name"]), "arguments": canonical(arguments), "deps": sorted(deps - {name})})
                elif out is results:
                    out.append({"no": no, "id": name_of(value["id"]), "content": canonical(value.get("content"))})
                else:
                    for k, t in enumerate(value if isinstance(value, list) else [value]):
                        try:
                            out.append({"no": no + k, "name": name_of(t["name"]), "schema": canonical(t.get("parameters", {})), "entry": canonical(t)})
                        except readable:
                            bad.append(canonical(t))
            except readable:
                bad.append(found[0])
    for pattern in (CALL, RESULT, TOOLS):
        text = pattern.sub("", text)
    return text, calls, results, tools, bad


TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
#: Keywords that can't be judged here; what has one and breaks nothing else is unchecked.
UNCHECKED = frozenset("format contentEncoding contentMediaType contentSchema unevaluatedItems unevaluatedProperties $dynamicRef $recursiveRef".split())


def every(answers) -> bool | None:
    """False where one is, else None (unchecked) where one is, else True."""
    answers = list(answers)
    return False if False in answers else None if None in answers else True


def some(answers) -> bool | None:
    answers = list(answers)
    return True if True in answers else None if None in answers else False


def opposite(answer: bool | None) -> bool | None:
    return None if answer is None else not answer


def matches(pattern: str, text: str) -> bool | None:
    """Whether the pattern is found in text; None for one that Python can't read."""
    try:
        return re.search(pattern, text) is not None
    except (re.error, TypeError, RecursionError):
        return None


def target(root, ref) -> tuple[bool, object]:
    """Whether a $ref is to a place in root, and what is there."""
    if not isinstance(ref, str) or not (ref == "#" or ref.startswith("#/")):
        return False, None
    for step in ref.split("/")[1:]:
        step = unquote(step).replace("~1", "/").replace("~0", "~")
        if isinstance(root, dict) and step in root:
            root = root[step]
        elif isinstance(root, list) and step.isdigit() and int(step) < len(root):
            root = root[int(step)]
        else:
            return False, None
    return True, root


def valid(value, schema) -> bool | None:
    """Whether value keeps to a JSON Schema; None (unchecked) where that hangs on a keyword of UNCHECKED, a $ref to
    elsewhere or without end, a pattern that Python can't read, or a malformed keyword."""
    try:
        return judge(value, schema, schema)
    except (RecursionError, TypeError, ValueError, AttributeError, ArithmeticError):
        return None


def judge(value, schema, root) -> bool | None:
    if isinstance(schema, bool):
        return schema
    if not isinstance(schema, dict):
        return None
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return True  # another call's result, known only when it ran

    def at(v, part) -> bool | None:
        return judge(v, part, root)

    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    kinds = schema.get("type")
    if kinds is not None:
        for kind in kinds if isinstance(kinds, list) else [kinds]:
            if kind == "number" and number or kind == "integer" and number and value == value // 1 or kind in TYPES and isinstance(value, TYPES[kind]):
                break
        else:
            return False
    listed = schema.get("enum", [value])
    if isinstance(listed, list) and same(value) not in map(same, listed) or "const" in schema and same(value) != same(schema["const"]):
        return False
    out: list[bool | None] = [None] if UNCHECKED.intersection(schema) or not isinstance(listed, list) else []
    if "$ref" in schema:
        found, there = target(root, schema["$ref"])
        out.append(at(value, there) if found else None)
    if "allOf" in schema:
        out.append(every(at(value, x) for x in schema["allOf"]))
    if "anyOf" in schema:
        out.append(some(at(value, x) for x in schema["anyOf"]))
    if "oneOf" in schema:
        each = [at(value, x) for x in schema["oneOf"]]
        out.append(False if each.count(True) > 1 else None if None in each else True in each)
    if "not" in schema:
        out.append(opposite(at(value, schema["not"])))
    if "if" in schema:
        holds, yes, no = at(value, schema["if"]), at(value, schema.get("then", True)), at(value, schema.get("else", True))
        out.append(yes if holds else no if holds is False else yes if yes == no else None)
    if number:
        out.append(schema.get("minimum", value) <= value <= schema.get("maximum", value))
        for name, ordered in (("exclusiveMinimum", lambda x: x < value), ("exclusiveMaximum", lambda x: value < x)):
            x = schema.get(name, False)
            if x is True:  # draft 4: the limit itself is out
                x = schema.get(name.replace("exclusiveM", "m"), False)
            out.append(x is False or ordered(x))
        if "multipleOf" in schema:
            out.append(Fraction(str(value)) % Fraction(str(schema["multipleOf"])) == 0)
    if isinstance(value, str):
        out.append(schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)))
        if "pattern" in schema:
            out.append(matches(schema["pattern"], value))
    if isinstance(value, list):
        out.append(schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)))
        items = schema.get("items", True)
        first, others = (items, schema.get("additionalItems", True)) if isinstance(items, list) else (schema.get("prefixItems", []), items)
        out += [at(v, x) for v, x in zip(value, first, strict=False)] + [at(v, others) for v in value[len(first) :]]
        if schema.get("uniqueItems"):
            out.append(len(set(map(same, value))) == len(value))
        if "contains" in schema:
            each = [at(v, schema["contains"]) for v in value]
            sure, most = each.count(True), len(each) - each.count(False)
            low, high = schema.get("minContains", 1), schema.get("maxContains", len(value))
            out.append(False if most < low or sure > high else True if sure >= low and most <= high else None)
    if isinstance(value, dict):
        known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        out.append(schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)))
        required = schema.get("required", [])
        out += [k in value for k in required] if isinstance(required, list) else [None]
        for k, v in value.items():
            hits = {p: matches(p, k) for p in patterns}
            out += [at(v, known[k])] if k in known else []
            out += [at(v, patterns[p]) if hit else None for p, hit in hits.items() if hit is not False]
            if k not in known and all(hit is False for hit in hits.values()):
                out.append(at(v, schema.get("additionalProperties", True)))
        if "propertyNames" in schema:
            out += [at(k, schema["propertyNames"]) for k in value]
        for name in ("dependentRequired", "dependentSchemas", "dependencies"):
            for k, x in schema.get(name, {}).items():
                if k in value:
                    out += [y in value for y in x] if isinstance(x, list) else [at(value, x)]
    return every(out)


def same(value) -> str:
    """As canonical, but 1.0 is 1."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else int(v) if isinstance(v, float) and v == int(v) else v

    return canonical(plain(value))


def parsed(messages: DataFrame) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = pa.list_(pa.struct([("no", pa.int32()), ("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("deps", pa.list_(pa.string()))]))
        result = pa.list_(pa.struct([("no", pa.int32()), ("id", pa.string()), ("content", pa.string())]))
        tool = pa.list_(pa.struct([("no", pa.int32()), ("name", pa.string()), ("schema", pa.string()), ("entry", pa.string())]))
        for batch in batches:
            rows = [parse_message(t) for t in batch.column("text").to_pylist()]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), call, result, tool, pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_key", "conv_id", "turn", "role")), *made], ["row_key", "conv_id", "turn", "role", "content", "calls", "results", "tools", "bad"])

    messages = settled(messages)
    arrow_limits(messages.sparkSession)
    rows = messages.select(F.monotonically_increasing_id().alias("row_key"), F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return scratch(rows.mapInArrow(lean(parse), PARSED), "messages")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, id and level of each call that isn't on or behind a cycle: 0 without dependencies, else one more than
    the deepest of them. Dependencies on calls that the conversation lacks don't count. A round per level."""
    nodes = calls.select("conv_id", "id")
    wanted = calls.select("conv_id", "id", F.explode("deps").alias("dep"))
    edges = scratch(wanted.join(nodes.withColumnRenamed("id", "dep"), ["conv_id", "dep"], "left_semi").select("conv_id", "id", "dep").distinct(), "call-edges")
    left, out, level = nodes, None, 0
    while True:
        ready = left.join(edges, ["conv_id", "id"], "left_anti").select("conv_id", "id")
        more = not edges.isEmpty()
        ready = scratch(ready, "call-level") if more else ready
        part = ready.withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
        if not more or ready.isEmpty():
            return out
        left = scratch(left.join(ready, ["conv_id", "id"], "left_anti"), "calls-left")
        edges = scratch(edges.join(ready.withColumnRenamed("id", "dep"), ["conv_id", "dep"], "left_anti").select("conv_id", "id", "dep"), "call-edges")
        level += 1


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, n_calls, n_linked, n_valid, n_orphans, n_bad and json of every message.

    Within a conversation the first call of an identifier holds it, by turn, row and place; later ones are duplicates,
    linked to nothing. Of several results the first after the call holds; one before its call, or without one, is an orphan.
    Blocks that can't be read stay in the JSON, under unreadable. A call without a schema counts as valid; one whose
    schema can't be judged in full doesn't, and is null under valid in the JSON. A call's status in
    the JSON is linked, pending (no result), duplicate or cycle. Null texts and roles are empty; messages with a null
    conv_id form a conversation of their own each, so nothing in them is linked. Rows that repeat are all kept.
    """
    rows = parsed(messages)
    place = F.struct("turn", "row_key", "x.no")
    calls = rows.select("row_key", "conv_id", "turn", F.explode("calls").alias("x")).select("row_key", "conv_id", "x.*", place.alias("place"))
    first = calls.where("conv_id IS NOT NULL").groupBy("conv_id", "id").agg(F.min("place").alias("place"), F.min_by("deps", "place").alias("deps"))
    answers = rows.select("row_key", "conv_id", "turn", F.explode("results").alias("x")).select("row_key", "conv_id", F.col("x.id").alias("id"), F.col("x.content").alias("content"), place.alias("at"))
    answers = answers.join(first.select("conv_id", "id", "place"), ["conv_id", "id"], "left")
    after = F.col("place").isNotNull() & (F.col("at") > F.col("place"))
    results = answers.where(after).groupBy("conv_id", "id").agg(F.min_by("content", "at").alias("result"))
    schemas = rows.where("conv_id IS NOT NULL").select("row_key", "conv_id", "turn", F.explode("tools").alias("x")).groupBy("conv_id", F.col("x.name").alias("name")).agg(F.min_by("x.schema", place).alias("schema"))
    found = calls.join(first.select("conv_id", "id", "place", F.lit(True).alias("holds")), ["conv_id", "id", "place"], "left")
    found = found.join(levels(first), ["conv_id", "id"], "left").join(results, ["conv_id", "id"], "left").join(schemas, ["conv_id", "name"], "left")
    status = F.when(F.col("conv_id").isNotNull() & F.col("holds").isNull(), "duplicate").when(F.col("conv_id").isNotNull() & F.col("level").isNull(), "cycle").when(F.col("result").isNotNull(), "linked").otherwise("pending")
    found = found.withColumn("status", status)
    mine = found.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("level", F.lit(1 << 30)).alias("level"), "no", "id", "name", "arguments", "deps", "status", F.when(F.col("status") == "linked", F.col("result")).alias("result"), "schema"))).alias("linked"))
    orphans = answers.where(~F.coalesce(after, F.lit(False))).groupBy("row_key").agg(F.count("*").alias("n_orphans"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n_valid, n_linked = [], [], []
            for role, content, linked, results, tools, bad in zip(*(batch.column(c).to_pylist() for c in ("role", "content", "linked", "results", "tools", "bad")), strict=True):
                message: dict = {"role": role, "content": content}
                good = 0
                for c in linked or []:
                    arguments = load(c["arguments"])
                    ok = c["schema"] is None or valid(arguments, load(c["schema"]))
                    good += ok is True
                    entry = {"id": c["id"], "name": c["name"], "arguments": arguments, "depends_on": c["deps"], "status": c["status"], "valid": ok}
                    if c["result"] is not None:
                        entry["result"] = load(c["result"])
                    message.setdefault("tool_calls", []).append(entry)
                for r in results or []:
                    message.setdefault("tool_results", []).append({"id": r["id"], "content": load(r["content"])})
                for t in tools or []:
                    message.setdefault("tools", []).append(load(t["entry"]))
                if bad:
                    message["unreadable"] = bad
                out.append(canonical(message))
                n_valid.append(good)
                n_linked.append(sum(c["status"] == "linked" for c in linked or []))
            counts = [len(c or []) for c in batch.column("linked").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role")), *(pa.array(x, pa.int64()) for x in (counts, n_linked, n_valid)), batch.column("n_orphans"), pa.array([len(x or []) for x in batch.column("bad").to_pylist()], pa.int64()), pa.array(out, pa.string())], ["conv_id", "turn", "role", "n_calls", "n_linked", "n_valid", "n_orphans", "n_bad", "json"])

    whole = rows.join(mine, "row_key", "left").join(orphans, "row_key", "left").withColumn("n_orphans", F.coalesce("n_orphans", F.lit(0)))
    return whole.select("conv_id", "turn", "role", "content", "linked", "results", "tools", "bad", "n_orphans").mapInArrow(lean(write), "conv_id long, turn long, role string, n_calls long, n_linked long, n_valid long, n_orphans long, n_bad long, json string")


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "conversations"))


#: The derived calls' tool takes numbers up to this.
DERIVED_MOST = 1000


def derived_messages(messages: DataFrame) -> DataFrame:
    """Messages with calls made from a table that has none: each assistant turn calls a tool with its text's length, and
    depends on the call two turns before; each user turn gives the result of the turn before; each conversation has a
    system turn -1 with the tool's schema."""
    turn = F.col("turn").cast("string")
    arguments = F.struct(F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    call = F.to_json(F.struct(F.concat(F.lit("c"), turn).alias("id"), F.lit("measure").alias("name"), arguments.alias("arguments"), F.array(F.concat(F.lit("c"), (F.col("turn") - 2).cast("string"))).alias("depends_on")))
    result = F.to_json(F.struct(F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("id"), F.col("turn").alias("content")))
    text = F.when(F.col("role") == "assistant", F.concat(F.lit("<tool_call>"), call, F.lit("</tool_call>"))).when(F.col("role") == "user", F.concat(F.lit("<tool_result>"), result, F.lit("</tool_result>"))).otherwise(F.col("text"))
    schema = {"type": "object", "properties": {"n": {"type": "integer", "maximum": DERIVED_MOST}}, "required": ["n"]}
    tools = f"<tools>{json.dumps([{'name': 'measure', 'parameters': schema}])}</tools>"
    system = messages.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("bigint").alias("turn"), F.lit("system").alias("role"), F.lit(tools).alias("text"))
    return messages.select("conv_id", "turn", "role", text.alias("text")).unionByName(system)


def tool_calls_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linking over calls that are made from conversations, whose own texts hold none."""
    linked = link(derived_messages(read(spark, sf_dir, "conversations")))
    return linked.select("conv_id", "turn", "role", "n_calls", "n_linked", "n_valid", "n_orphans")


DERIVED_ORACLE = f"""
WITH m AS (SELECT conv_id, turn, role, coalesce(length(text), 0) AS n FROM conversations)
SELECT m.conv_id, m.turn, m.role, (m.role = 'assistant')::BIGINT AS n_calls, (m.role = 'assistant' AND u.turn IS NOT NULL)::BIGINT AS n_linked, (m.role = 'assistant' AND m.n <= {DERIVED_MOST})::BIGINT AS n_valid, (m.role = 'user' AND a.turn IS NULL)::BIGINT AS n_orphans
FROM m LEFT JOIN m u ON u.conv_id = m.conv_id AND u.turn = m.turn + 1 AND u.role = 'user' LEFT JOIN m a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1 AND a.role = 'assistant'
UNION ALL SELECT DISTINCT conv_id, -1, 'system', 0, 0, 0, 0 FROM m
"""
