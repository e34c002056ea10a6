"""Tool-call linking and chat formatting (DataFrame functions only).

Calls and their results are hash-joined by conversation and call id (calls
without an id are never answered).  A call may name earlier calls whose
results it uses.  Calls are put in a topological order: every call starts at its own
turn, and a call that does not stand behind all it depends on stands directly
behind the last of them.  In a transcript whose calls refer backwards only, no
round is needed.  In the other conversations chains of calls with one dependency
each are shortened by pointer doubling (log n rounds for n calls); then each round
places the calls of several dependencies all of which have their place.  Calls that
are left on or behind a cycle keep their turn and are marked.

Arguments are parsed as JSON and validated against their tool's schema: the
required fields are there, no field is unknown, and each field has a listed
type.  ``link_tool_calls`` gives one canonical JSON object per call, and
``chat_messages`` one per message, whatever its role: keys sorted, no
white space, arguments and results nested in it.  Messages stay rows of their
own, in the order of ``(position, bump)``, so a conversation of any length is
never gathered in one place.

Edge cases: null or malformed arguments are invalid and stand as null in the
JSON; an unknown tool is invalid; of several results of one call the earliest
turn counts (then the smallest text); several calls with one id are each
answered; dependencies on unknown ids are ignored; null texts are null in the
JSON; repeated rows come out as often as they came; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import checkpointed

#: Tool name -> field -> (accepted types as ``schema_of_variant`` names them, required).
Schemas = dict[str, dict[str, tuple[tuple[str, ...], bool]]]


def valid_arguments(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether the arguments (variant) fit the schema of the tool of that name."""
    keys = F.expr("json_object_keys(to_json(arguments))") if not isinstance(arguments, Column) else F.json_object_keys(F.to_json(arguments))
    out = F.lit(False)
    for tool, fields in schemas.items():
        ok = F.size(F.array_except(keys, F.array(*map(F.lit, fields)))) == 0
        for key, (kinds, required) in fields.items():
            value = F.try_variant_get(arguments, f"$.{key}", "variant")
            ok = ok & F.coalesce(F.schema_of_variant(value).isin(*kinds), F.lit(not required))
        out = F.when(name == tool, ok).otherwise(out)
    return F.coalesce(F.when(keys.isNotNull(), out), F.lit(False))


def _later(*keys: Column) -> Column:
    """The last of several (position, bump) places; nulls do not count."""
    return F.greatest(*keys) if len(keys) > 1 else keys[0]


def _behind(position: str, bump: str, steps: Column | int) -> Column:
    return F.struct(F.col(position).alias("position"), (F.col(bump) + steps).cast("int").alias("bump"))


def _jumps(single: DataFrame) -> DataFrame:
    """Calls of one dependency with the first call up their chain that has none or several.

    ``single``: conv_id, call_id, up, position.  Gives ``up``, the number of ``steps`` to
    it and the last place that the calls between ask for; pointers double, so a
    chain of n calls takes log n rounds.  A chain that ends nowhere runs into a
    circle: its calls come out with a null ``up``.
    """
    longest = single.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    inner = single.select("conv_id", F.col("call_id").alias("up"), F.lit(True).alias("more"))
    place = F.struct(F.col("position"), F.lit(0).alias("bump")).alias("place")
    now = checkpointed(single.select("conv_id", "call_id", "up", F.lit(1).alias("steps"), place).join(inner, ["conv_id", "up"], "left"))
    reach = 1
    while reach <= longest and not now.filter("more").isEmpty():
        a, b = now.alias("a"), now.alias("b")
        far = _later(F.col("a.place"), F.when(F.col("b.place").isNotNull(), _behind("b.place.position", "b.place.bump", F.col("a.steps"))))
        doubled = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.up") == F.col("b.call_id")) & F.col("a.more"), "left")
        now = checkpointed(
            doubled.select(
                "a.conv_id",
                F.coalesce("b.up", "a.up").alias("up"),
                "a.call_id",
                (F.col("a.steps") + F.coalesce("b.steps", F.lit(0))).alias("steps"),
                F.coalesce(far, F.col("a.place")).alias("place"),
                F.when(F.col("b.call_id").isNotNull(), F.col("b.more")).alias("more"),
            )
        )
        reach *= 2
    return now.withColumn("up", F.when(F.col("more").isNull(), F.col("up"))).drop("more")


def topological_order(calls: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id``, ``position``, ``bump``, ``cyclic`` of distinct calls ``conv_id``, ``call_id``, ``turn``, ``after`` (array of ids)."""
    nodes = calls.filter("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("turn").alias("position"))
    nodes = nodes.select("conv_id", "call_id", "position", F.lit(0).alias("bump"))
    edges = calls.select("conv_id", F.col("call_id").alias("to"), F.explode("after").alias("from")).distinct()
    ends = nodes.select("conv_id", "call_id", "position")
    edges = edges.join(ends.select("conv_id", F.col("call_id").alias("to"), F.col("position").alias("p_to")), ["conv_id", "to"])
    edges = edges.join(ends.select("conv_id", F.col("call_id").alias("from"), F.col("position").alias("p_from")), ["conv_id", "from"])
    edges = checkpointed(edges)
    # only what hangs on an edge that points at an earlier or equal turn can move
    wrong = edges.filter("p_from >= p_to").select("conv_id").distinct()
    if wrong.isEmpty():
        return nodes.withColumn("cyclic", F.lit(False))
    wrong = checkpointed(wrong)
    edges = checkpointed(edges.join(wrong, "conv_id", "left_semi").select("conv_id", "from", "to"))
    moving = checkpointed(nodes.join(wrong, "conv_id", "left_semi"))
    placed = nodes.join(wrong, "conv_id", "left_anti").withColumn("cyclic", F.lit(False))

    counts = checkpointed(edges.groupBy("conv_id", F.col("to").alias("call_id")).agg(F.count(F.lit(1)).alias("deps"), F.min("from").alias("up")))
    single = moving.join(counts.filter("deps = 1"), ["conv_id", "call_id"]).select("conv_id", "call_id", "up", "position")
    jumps = _jumps(checkpointed(single))
    # calls of none or several dependencies wait for the ends of the chains that lead to them
    rest = checkpointed(moving.join(counts.filter("deps = 1"), ["conv_id", "call_id"], "left_anti"))
    several = edges.join(counts.filter("deps > 1").select("conv_id", F.col("call_id").alias("to")), ["conv_id", "to"], "left_semi")
    chains = jumps.select("conv_id", F.col("call_id").alias("from"), "up", "steps", "place")
    several = several.join(chains, ["conv_id", "from"], "left").select(
        "conv_id",
        "to",
        F.coalesce("up", "from").alias("from"),  # a chain out of a circle is a call that never gets its place
        (F.coalesce("steps", F.lit(0)) + 1).alias("steps"),
        F.when(F.col("place").isNotNull(), _behind("place.position", "place.bump", 1)).alias("place"),
    )
    several = checkpointed(several)
    waiting, done, rounds = rest, [], 0
    while True:
        # calls whose dependencies all have their place
        blocked = several.select("conv_id", F.col("to").alias("call_id")).distinct()
        ready = checkpointed(waiting.join(blocked, ["conv_id", "call_id"], "left_anti"))
        if ready.isEmpty():
            break
        done.append(ready)
        rounds += 1
        if rounds % 16 == 0:  # the union stays short however many rounds there are
            done = [checkpointed(_union(done))]
        ends = ready.select("conv_id", F.col("call_id").alias("from"), F.col("position").alias("p"), F.col("bump").alias("b"))
        met = several.join(ends, ["conv_id", "from"]).select("conv_id", F.col("to").alias("call_id"), _later(_behind("p", "b", F.col("steps")), F.col("place")).alias("key"))
        least = met.groupBy("conv_id", "call_id").agg(F.max("key").alias("key"))
        waiting = waiting.join(ready.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").join(least, ["conv_id", "call_id"], "left")
        key = _later(F.struct("position", "bump"), F.col("key"))
        waiting = checkpointed(waiting.select("conv_id", "call_id", key.alias("key")).select("conv_id", "call_id", "key.position", "key.bump"))
        several = checkpointed(several.join(ends.select("conv_id", "from"), ["conv_id", "from"], "left_anti"))
    ordered = checkpointed(_union(done)) if done else rest.limit(0)
    stuck = waiting.select("conv_id", "call_id").join(moving, ["conv_id", "call_id"]).select(*moving.columns, F.lit(True).alias("cyclic"))
    ends = ordered.select("conv_id", F.col("call_id").alias("up"), F.col("position").alias("p"), F.col("bump").alias("b"))
    behind = jumps.join(ends, ["conv_id", "up"], "left").join(moving.select("conv_id", "call_id", F.col("position").alias("own")), ["conv_id", "call_id"])
    cyclic = F.col("p").isNull() & F.col("b").isNull()
    key = _later(F.col("place"), _behind("p", "b", F.col("steps")))
    behind = behind.select("conv_id", "call_id", F.when(~cyclic, key).alias("key"), "own", cyclic.alias("cyclic"))
    behind = behind.select("conv_id", "call_id", F.when(F.col("cyclic"), F.col("own")).otherwise(F.col("key.position")).alias("position"), F.coalesce("key.bump", F.lit(0)).alias("bump"), "cyclic")
    return placed.unionByName(ordered.withColumn("cyclic", F.lit(False))).unionByName(stuck).unionByName(behind)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _linked(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """The calls with their answer, place, parsed arguments and validity."""
    first = F.min(F.struct("turn", "content"))
    answers = results.filter("call_id is not null").groupBy("conv_id", "call_id").agg(first.alias("answer"))
    order = topological_order(calls)
    linked = calls.join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(order, ["conv_id", "call_id"], "left")
    linked = linked.withColumn("parsed", F.try_parse_json("arguments"))
    return linked.withColumn("valid", valid_arguments(F.col("name"), F.col("parsed"), schemas))


def _call() -> Column:
    return F.struct(
        F.col("parsed").alias("arguments"),
        F.col("call_id").alias("id"),
        F.col("name").alias("name"),
        F.col("answer.content").alias("result"),
    )


def _place() -> list[Column]:
    return [
        F.coalesce("position", "turn").alias("position"),
        F.coalesce("bump", F.lit(0)).alias("bump"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
    ]


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call with its result, place, validity and canonical JSON.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), after
    (array of call ids).  ``results``: conv_id, turn, call_id, content.
    """
    return _linked(calls, results, schemas).select(
        "conv_id",
        "turn",
        "call_id",
        "name",
        F.col("answer").isNotNull().alias("answered"),
        F.col("answer.turn").alias("answer_turn"),
        "valid",
        *_place(),
        F.to_json(_call(), {"ignoreNullFields": "false"}).alias("json"),
    )


def chat_messages(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per message of any role, with its place and canonical JSON.

    ``messages``: conv_id, turn, role, text, and of messages that call a tool
    call_id, name, arguments (JSON text) and after (array of call ids); of
    messages that answer one, answers (call id).  A message is a call if it has a
    name.  An answer to no call of its conversation names none.
    """
    calls = messages.filter("name is not null")
    others = messages.filter("name is null")
    results = others.filter("answers is not null").select("conv_id", "turn", F.col("answers").alias("call_id"), F.col("text").alias("content"))
    linked = _linked(calls, results, schemas).select(
        "conv_id",
        "turn",
        "role",
        "call_id",
        "name",
        F.col("answer").isNotNull().alias("answered"),
        F.col("answer.turn").alias("answer_turn"),
        F.lit(None).cast("string").alias("answers"),
        "valid",
        *_place(),
        F.to_json(_message(_call(), F.lit(None).cast("string")), {"ignoreNullFields": "false"}).alias("json"),
    )
    known = calls.filter("call_id is not null").select("conv_id", F.col("call_id").alias("answers"), F.lit(True).alias("known")).distinct()
    # the rows that answer nothing have no key and stay out of the join
    answering = others.filter("answers is not null").join(known, ["conv_id", "answers"], "left")
    answering = answering.withColumn("answers", F.when(F.col("known"), F.col("answers")))
    columns = ["conv_id", "turn", "role", "text", "answers"]
    plain = others.filter("answers is null").select(*columns).union(answering.select(*columns)).select(
        "conv_id",
        "turn",
        "role",
        F.lit(None).cast("string").alias("call_id"),
        F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("boolean").alias("answered"),
        F.lit(None).cast("long").alias("answer_turn"),
        "answers",
        F.lit(None).cast("boolean").alias("valid"),
        F.col("turn").alias("position"),
        F.lit(0).alias("bump"),
        F.lit(False).alias("cyclic"),
        F.to_json(_message(F.lit(None).cast("string"), F.col("answers")), {"ignoreNullFields": "false"}).alias("json"),
    )
    return linked.unionByName(plain)


def _message(call: Column, answers: Column) -> Column:
    return F.struct(answers.alias("answers"), call.alias("call"), F.col("text").alias("content"), F.col("role").alias("role"), F.col("turn").alias("turn"))


def turns_as_messages(messages: DataFrame) -> DataFrame:
    """A plain transcript as input of ``chat_messages``; every row stays.

    A user turn is a call of the tool ``reply`` with its first line as prompt and
    the other lines, if any, as ``rest``.  Where length and turn add up to a
    multiple of 8 it uses the call two turns later, at one more the call two turns
    before.  An assistant turn answers the call directly before it.
    """
    def call_id(turn: Column) -> Column:
        return F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))

    text, turn = F.col("text"), F.col("turn")
    line = F.instr(text, "\n")
    prompt = F.when(line > 0, F.substring_index(text, "\n", 1)).otherwise(text)
    rest = F.when(line > 0, F.substr(text, line + 1))
    k = F.pmod(F.length("text") + turn, F.lit(8))
    after = F.when(k == 0, F.array(call_id(turn + 2))).when(k == 1, F.array(call_id(turn - 2))).otherwise(F.array().cast("array<string>"))
    user = F.col("role") == "user"
    return messages.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(user, call_id(turn)).alias("call_id"),
        F.when(user, F.lit("reply")).alias("name"),
        F.when(user, F.to_json(F.struct(prompt.alias("prompt"), rest.alias("rest"), turn.alias("turn")))).alias("arguments"),
        F.when(user, after).alias("after"),
        F.when(F.col("role") == "assistant", call_id(turn - 1)).alias("answers"),
    )
