"""Chat formatting with tool calls: calls and results are joined by identifier, ordered, validated and serialised.

Calls (conv_id, call_id, turn, name, arguments as JSON) and results (conv_id, call_id, turn, content) are hash-joined
by conversation and identifier. A call depends on the calls whose identifiers stand as ``"$ref:<call_id>"`` among its
argument values (not inside nested ones); ``level`` is one more than the largest level of those, so sorting by (conv_id, level, turn, call_id)
is a topological order. Arguments are checked against the tool's schema, and each call is written as canonical JSON:
keys sorted, no white space, equal numbers alike (1e2, 100.0 and 100 are 100). Integers of up to 38 digits stay exact.

Everything is built-in expressions. Nothing gathers a conversation in one row or task: an identifier that occurs often
is aggregated before the join, and levels come from joins on identifiers. Chains of single references are walked by
doubling, so a conversation of any length takes a logarithmic number of rounds; calls with several references take one
round per level of such calls.

Defined cases: a call or result without conversation or identifier is linked to nothing: such calls are ``unanswered``,
such results ``orphan``. Of several calls with one identifier the first by (turn, name, arguments) counts, of several
results likewise; ``n_calls`` and ``n_results`` say how many there were. References to unknown calls are violations
and put no order on a call; calls on a cycle of references, or behind one, have a null level. Arguments that are no
JSON object are violations. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.common import table, words_of
from cartlens.session import checkpointed

# A schema: per tool, the arguments with their JSON type, whether they are required, and bounds (numbers or lengths).
SCHEMAS = {
    "answer": {
        "prompt": {"type": "STRING", "required": True, "min": 1},
        "turn": {"type": "BIGINT", "required": True, "min": 0},
        "words": {"type": "BIGINT", "required": True, "min": 1, "max": 4096},
        "context": {"type": "STRING", "required": False},
    },
    "configure": {
        "prompt": {"type": "STRING", "required": True, "min": 1},
        "turn": {"type": "BIGINT", "required": True, "min": 0, "max": 0},
        "words": {"type": "BIGINT", "required": True, "min": 1},
    },
}
REFERENCE = "$ref:"


def _object(arguments: Column) -> Column:
    """The arguments as a variant, null unless they are a JSON object."""
    parsed = F.try_parse_json(arguments)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


# Strings of a JSON text, once escaped signs are out of the way, and what is written differently for equal numbers.
_STRING = '"[^"]*"'
_LOOSE = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def canonical_json(text: Column) -> Column:
    """``text``, JSON as ``to_json`` writes it, with every number outside of strings in one form."""
    # Escaped signs become control characters, which JSON texts never hold as they are.
    masked = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    strings = F.regexp_extract_all(masked, F.lit(_STRING), F.lit(0))
    between = F.transform(F.split(masked, _STRING, -1), _numbers)
    joined = F.array_join(F.zip_with(between, strings, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    plain = F.replace(F.replace(joined, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.when(text.rlike(r"[0-9](?:\.[0-9]|[eE][+-]?[0-9])|-0"), plain).otherwise(text)


def _numbers(piece: Column) -> Column:
    """A piece of JSON without strings, its numbers in one form."""

    def one(token: Column) -> Column:
        value = token.cast("double")
        digits = token.try_cast("decimal(38,18)")
        short = F.regexp_replace(F.regexp_replace(digits.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        big = token.try_cast("decimal(38,0)")
        return (
            F.when(~token.rlike("[.eE]") & (value != 0), token)
            .when(digits.cast("double") == value, F.when(value == 0, "0").otherwise(short))
            .when(big.cast("double") == value, big.cast("string")).otherwise(token)
        )

    found = F.transform(F.regexp_extract_all(piece, F.lit(_LOOSE), F.lit(0)), one)
    return F.array_join(F.zip_with(F.split(piece, _LOOSE, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _violations(schemas: dict[str, dict[str, dict]]) -> Column:
    """The sorted violations of a call (columns name, arguments as ``args``) against the schemas of the tools."""
    checks, known = [], None
    for tool, fields in sorted(schemas.items()):
        here = F.col("name") == tool
        known = here if known is None else known | here
        for field, rule in sorted(fields.items()):
            # The path is a literal of the schema, not of the data.
            value = F.try_variant_get("args", f"$['{field}']", "variant")
            kind = F.schema_of_variant(value)
            absent = value.isNull() | (kind == "VOID")
            wrong = ~absent & (kind != rule["type"])
            if rule.get("required"):
                checks.append(F.when(here & absent, F.lit(f"{field}: missing")))
            checks.append(F.when(here & wrong, F.lit(f"{field}: type")))
            measure = F.try_variant_get("args", f"$['{field}']", "string")
            measure = F.char_length(measure) if rule["type"] == "STRING" else measure.cast("double")
            if "min" in rule:
                checks.append(F.when(here & ~absent & ~wrong & (measure < rule["min"]), F.lit(f"{field}: below min")))
            if "max" in rule:
                checks.append(F.when(here & ~absent & ~wrong & (measure > rule["max"]), F.lit(f"{field}: above max")))
    fields_of = F.map_from_arrays(
        F.array(*[F.lit(t) for t in sorted(schemas)]),
        F.array(*[F.array(*[F.lit(f) for f in sorted(schemas[t])]) for t in sorted(schemas)]),
    )
    keys = F.json_object_keys(F.to_json("args"))
    extra = F.transform(
        F.filter(keys, lambda k: ~F.array_contains(fields_of[F.col("name")], k)), lambda k: F.concat(k, F.lit(": unknown"))
    )
    listed = F.array_sort(F.concat(F.array_compact(F.array(*checks)), F.coalesce(extra, F.array().cast("array<string>"))))
    return (
        F.when(F.col("args").isNull(), F.array(F.lit("arguments: no object")))
        .when(F.coalesce(known, F.lit(False)), listed)
        .otherwise(F.array(F.lit("name: unknown tool")))
    )


def _first(rows: DataFrame, keys: list[str], order: list[str], n: str) -> DataFrame:
    """One row per key, the smallest by ``order``, with the number of rows; aggregated before the shuffle."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_one"), F.count(F.lit(1)).alias(n)).select(
        *keys, "_one.*", n
    )


def _chains(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, at, steps, open) of the calls with exactly one reference: where their chain ends.

    ``at`` is the first call down the chain that has no reference or several, ``steps`` how far away it is. Every round
    doubles the distance looked ahead, so the rounds follow the logarithm of the longest chain; ``open`` marks chains
    that never end, as they run into a cycle.
    """
    hops = checkpointed(edges.where("n = 1").select(
        "conv_id", "call_id", F.col("needs").alias("at"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("open")
    ))
    total, reach = hops.count(), 1
    while total:
        ahead = hops.select(
            "conv_id", F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more")
        )
        hops = checkpointed(hops.drop("open").join(ahead, ["conv_id", "at"], "left").select(
            "conv_id", "call_id", F.coalesce("next", "at").alias("at"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("open"),
        ))
        if reach >= total or hops.where("open").isEmpty():
            break
        reach *= 2
    return hops


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that can be ordered; ``edges`` (conv_id, call_id, needs) are references.

    Chains of single references are walked by doubling. Calls with several references are then placed in the round
    after the last of the calls their chains end at; each round works on those that are not placed yet.
    """
    key = ["conv_id", "call_id"]
    edges = checkpointed(edges.distinct())
    counted = checkpointed(edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("needs")))
    chains = _chains(counted)
    ends = chains.select("conv_id", F.col("call_id").alias("needs"), "at", "steps", "open")
    # A reference into a chain that never ends has a null end, which no placed call equals.
    waiting = checkpointed(
        edges.join(counted.where("n > 1").select(*key), key, "left_semi").join(ends, ["conv_id", "needs"], "left")
        .select(
            *key, F.when(F.coalesce("open", F.lit(False)), None).otherwise(F.coalesce("at", "needs")).alias("at"),
            (F.coalesce("steps", F.lit(0)) + 1).cast("long").alias("steps"), F.lit(None).cast("long").alias("level"),
        )
    )
    done = [checkpointed(calls.join(counted, key, "left_anti").select(*key, F.lit(0).cast("long").alias("level")))]
    while not waiting.isEmpty():
        below = done[-1].select("conv_id", F.col("call_id").alias("at"), F.col("level").alias("below"))
        known = checkpointed(waiting.join(below, ["conv_id", "at"], "left").select(
            *key, "at", "steps", F.coalesce("level", F.col("below") + F.col("steps")).alias("level")
        ))
        now = checkpointed(
            known.groupBy(*key).agg(F.max("level").alias("level"), F.max(F.col("level").isNull()).alias("_waits"))
            .where("NOT _waits").select(*key, "level")
        )
        if now.isEmpty():
            break  # what is left is on a cycle or behind one
        done.append(now)
        waiting = checkpointed(known.join(now, key, "left_anti"))
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    below = placed.select("conv_id", F.col("call_id").alias("at"), F.col("level").alias("below"))
    chained = chains.where("NOT open").join(below, ["conv_id", "at"])
    return placed.unionByName(chained.select(*key, (F.col("below") + F.col("steps")).alias("level")))


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, dict]] | None = None) -> DataFrame:
    """One row per identified call, per call without identifier, and per result without call."""
    key = ["conv_id", "call_id"]
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments")
    results = results.select("conv_id", "call_id", "turn", "content")
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    asked = _first(calls.where(whole), key, ["turn", "name", "arguments"], "n_calls")
    answers = _first(
        results.where(whole).withColumnRenamed("turn", "result_turn"), key, ["result_turn", "content"], "n_results"
    )
    anonymous = calls.where(~whole).withColumn("n_calls", F.lit(1).cast("long"))
    both = asked.join(answers, key, "full_outer").unionByName(anonymous, allowMissingColumns=True).unionByName(
        results.where(~whole).withColumnRenamed("turn", "result_turn").withColumn("n_results", F.lit(1).cast("long")),
        allowMissingColumns=True,
    )
    both = checkpointed(both.withColumn("args", _object(F.col("arguments")))
                        .withColumn("arguments", canonical_json(F.to_json("args"))).drop("args"))
    # The calls that a call refers to, among those of its conversation.
    values = F.map_values(F.from_json("arguments", "map<string,string>"))
    refs = (
        both.where(F.col("n_calls").isNotNull() & whole & F.col("arguments").contains(REFERENCE))
        .select(*key, F.explode(F.array_distinct(F.filter(values, lambda v: v.startswith(REFERENCE)))).alias("ref"))
        .select(*key, F.expr(f"substring(ref, {len(REFERENCE) + 1})").alias("needs"))
    )
    known = both.where(F.col("n_calls").isNotNull() & whole).select(*key)
    edges = checkpointed(
        refs.join(known.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("there")),
                  ["conv_id", "needs"], "left")
    )
    place = levels(known, edges.where("there").select(*key, "needs"))
    dangling = edges.where("there IS NULL").groupBy(*key).agg(F.count(F.lit(1)).alias("n_dangling"))
    placed = both.join(place, key, "left").join(dangling, key, "left").withColumn("args", F.try_parse_json("arguments"))
    found = _violations(SCHEMAS if schemas is None else schemas)
    found = F.when(F.col("n_dangling") > 0, F.array_append(found, F.lit("reference: unknown call"))).otherwise(found)
    is_call = F.col("n_calls").isNotNull()
    placed = placed.withColumn("violations", F.when(is_call, found)).withColumn(
        "status",
        F.when(~is_call, "orphan").when(F.col("n_results").isNull(), "unanswered")
        .when(F.col("result_turn") < F.col("turn"), "early").otherwise("linked"),
    )
    # Keys in order: arguments (their keys are sorted already), id, name, result; null ones are left out, as in to_json.
    rest = F.to_json(F.struct(F.col("call_id").alias("id"), "name", F.col("content").alias("result")))
    body = F.concat(
        F.lit('"arguments":'), F.coalesce("arguments", F.lit("null")),
        F.when(rest == "{}", F.lit("")).otherwise(F.concat(F.lit(","), rest.substr(F.lit(2), F.length(rest) - 2))),
    )
    return placed.select(
        "conv_id", "call_id", "turn", "result_turn", "name", "level", "status",
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.when(is_call, F.size("violations") == 0).alias("valid"), F.array_join("violations", "; ").alias("violations"),
        F.concat(F.lit("{"), body, F.lit("}")).alias("json"),
    )


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain turns: a user turn calls ``answer``, a system turn ``configure``, and an assistant
    turn is the result of the turn before it. A user turn after the first pair refers to the call two turns earlier."""
    turn = F.col("turn")
    call_id = F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    asked = conversations.where(F.col("role").isin("user", "system")).select(
        "conv_id", F.when(F.col("conv_id").isNotNull() & turn.isNotNull(), call_id).alias("call_id"), "turn", "role", "text"
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    earlier = F.concat(F.lit(REFERENCE), F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), (turn - 2).cast("string")))
    arguments = F.to_json(F.struct(
        F.size(words_of(text)).cast("long").alias("words"), turn.cast("long").alias("turn"), text.alias("prompt"),
        F.when((F.col("role") == "user") & (turn >= 2), earlier).alias("context"),
    ))
    calls = asked.select(
        "conv_id", "call_id", "turn", F.when(F.col("role") == "user", "answer").otherwise("configure").alias("name"),
        arguments.alias("arguments"),
    )
    of = F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), (turn - 1).cast("string"))
    results = conversations.where(F.col("role") == "assistant").select(
        "conv_id", F.when(F.col("conv_id").isNotNull() & turn.isNotNull(), of).alias("call_id"), "turn",
        F.col("text").alias("content"),
    )
    return calls, results


def linked_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the turns of all conversations as linked, ordered, validated calls in canonical JSON."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return linked(*turns_as_calls(turns))


SQL = """
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, text AS raw FROM conversations),
asked AS (
  SELECT conv_id, 'call-' || conv_id || '-' || turn AS call_id, turn,
    CASE role WHEN 'user' THEN 'answer' ELSE 'configure' END AS name,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, text,
    CASE WHEN role = 'user' AND turn >= 2 THEN 'call-' || conv_id || '-' || (turn - 2) END AS needs
  FROM c WHERE role IN ('user', 'system')
),
j AS (
  SELECT *, '{' || CASE WHEN needs IS NOT NULL THEN '"context":' || CAST(to_json('$ref:' || needs) AS VARCHAR) || ',' ELSE '' END
    || '"prompt":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || ',"words":' || words || '}' AS arguments
  FROM asked
),
calls AS (
  SELECT conv_id, call_id, count(*) AS n_calls, min({'turn': turn, 'name': name, 'arguments': arguments, 'words': words,
    'text': text, 'needs': needs}) AS one FROM j GROUP BY ALL
),
k AS (SELECT conv_id, call_id, n_calls, one.turn AS turn, one.name AS name, one.arguments AS arguments, one.words AS words,
  one.text AS text, one.needs AS needs FROM calls),
results AS (
  SELECT conv_id, call_id, count(*) AS n_results, min({'turn': turn, 'content': raw}) AS one
  FROM (SELECT conv_id, 'call-' || conv_id || '-' || (turn - 1) AS call_id, turn, raw FROM c WHERE role = 'assistant')
  GROUP BY ALL
),
r AS (SELECT conv_id, call_id, n_results, one.turn AS result_turn, one.content AS content FROM results),
depth AS (
  WITH RECURSIVE d AS (
    SELECT k.conv_id, k.call_id, 0 AS level FROM k LEFT JOIN k p ON p.conv_id = k.conv_id AND p.call_id = k.needs
    WHERE p.call_id IS NULL
    UNION ALL
    SELECT k.conv_id, k.call_id, d.level + 1 FROM k JOIN d ON d.conv_id = k.conv_id AND k.needs = d.call_id
  ) SELECT * FROM d
),
v AS (
  SELECT k.*, list_sort(list_filter([
      CASE WHEN length(text) < 1 THEN 'prompt: below min' END,
      CASE WHEN turn < 0 THEN 'turn: below min' END,
      CASE WHEN name = 'configure' AND turn > 0 THEN 'turn: above max' END,
      CASE WHEN words < 1 THEN 'words: below min' END,
      CASE WHEN name = 'answer' AND words > 4096 THEN 'words: above max' END], lambda x: x IS NOT NULL))
    || CASE WHEN needs IS NOT NULL AND NOT EXISTS (
         SELECT 1 FROM k p WHERE p.conv_id = k.conv_id AND p.call_id = k.needs) THEN ['reference: unknown call'] ELSE [] END AS bad
  FROM k
)
SELECT coalesce(v.conv_id, r.conv_id) AS conv_id, coalesce(v.call_id, r.call_id) AS call_id, v.turn, r.result_turn, v.name,
  CAST(depth.level AS BIGINT) AS level,
  CASE WHEN v.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered'
    WHEN r.result_turn < v.turn THEN 'early' ELSE 'linked' END AS status,
  coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
  CASE WHEN v.call_id IS NOT NULL THEN len(bad) = 0 END AS valid, array_to_string(bad, '; ') AS violations,
  '{"arguments":' || coalesce(arguments, 'null') || ',"id":' || CAST(to_json(coalesce(v.call_id, r.call_id)) AS VARCHAR)
    || CASE WHEN v.name IS NOT NULL THEN ',"name":"' || v.name || '"' ELSE '' END
    || CASE WHEN content IS NOT NULL THEN ',"result":' || CAST(to_json(content) AS VARCHAR) ELSE '' END || '}' AS json
FROM v FULL JOIN r ON v.conv_id = r.conv_id AND v.call_id = r.call_id
LEFT JOIN depth ON depth.conv_id = v.conv_id AND depth.call_id = v.call_id
"""
