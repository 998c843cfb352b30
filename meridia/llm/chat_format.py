r"""Chat formatting from an event log. DataFrame operations only.

A log is partitioned by conversation and ordered by sequence number; the events of a message are folded into its final
text, the messages of a conversation are ordered and rendered. Event kinds: ``message`` (a whole text), ``delta`` (text to
append), ``edit`` (a text that replaces what there is), ``regenerate`` (what there is goes; deltas follow).

Template: every turn is ``<s>``, a head by role, the text, a tail by role, ``</s>``. Users are held by ``[INST] `` and
`` [/INST]``, system turns by ``<<SYS>>`` and ``<</SYS>>``, assistants by nothing; any other role (a null one too: empty)
is named, escaped, in ``[ROLE]`` and ``[/ROLE]``. Inside texts a backslash becomes two and every control string gets one
after its first character, so no control string of a text is left and unescaping (drop each backslash, keep what
follows it) restores the text.

Defined results: a null text is empty; a null conversation id is a conversation of its own; rows that repeat a turn are
turns of their own, ordered by role and text; an empty log gives an empty result; other columns are never looked at. The query adds
the probe's two turns to conversation -1: where the table has one of that number, they are turns of it, by their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<s>", "</s>"
#: Head and tail of a turn by role.
FRAMES = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("", "")}
NAMED = ("[ROLE]", "[/ROLE]")
#: What must not appear inside a text, longest first.
CONTROLS = ("<</SYS>>", "<<SYS>>", "[/INST]", "[/ROLE]", "[INST]", "[ROLE]", "</s>", "<s>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events_of(rows: DataFrame) -> DataFrame:
    """A finished table (conv_id, turn, role, text) as a log with one ``message`` event a row."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.col("turn").cast("long")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(turn.alias("turn"), role.alias("role"), F.sha2(text, 256).alias("of")).alias("message"), turn.alias("seq"), F.lit("message").alias("kind"), role.alias("role"), text.alias("text"))


def fold(log: DataFrame) -> DataFrame:
    """(conv_id, message, seq, kind, role, text) -> (conv_id, message, role, text, copies): final messages.

    copies counts ``message`` events of the same number and content, so rows that repeat a turn stay turns of their own.
    """
    log = log.repartition("conv_id")  # one shuffle serves both groupings
    resets = F.max(F.when(F.col("kind").isin("message", "edit", "regenerate"), F.col("seq")))
    parts = F.array_sort(F.collect_list(F.struct("seq", F.when(F.col("kind") == "regenerate", 0).when(F.col("kind") == "delta", 2).otherwise(1).alias("rank"), F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.coalesce("text", F.lit(""))).alias("text"))))
    one = log.groupBy("conv_id", "message").agg(resets.alias("reset"), parts.alias("parts"), F.max_by("role", F.struct(F.col("role").isNotNull(), "seq")).alias("role"), F.count_if(F.col("kind") == "message").alias("copies"))
    live = F.filter("parts", lambda p: F.col("reset").isNull() | (p["seq"] >= F.col("reset")))
    # events that share the number of the reset: only its first text counts, deltas follow
    whole = F.filter(live, lambda p: p["rank"] < 2)
    text = F.concat(F.coalesce(F.try_element_at(F.transform(whole, lambda p: p["text"]), F.lit(1)), F.lit("")), F.array_join(F.transform(F.filter(live, lambda p: p["rank"] == 2), lambda p: p["text"]), ""))
    return one.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.greatest(F.col("copies"), F.lit(1)).cast("int").alias("copies"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): the text of a conversation and its pieces in order, each with whether the loss counts it."""
    head, tail = F.concat(F.lit(NAMED[0]), escape(F.col("role")), F.lit(NAMED[1])), F.lit("")
    for role, (a, b) in FRAMES.items():
        head, tail = F.when(F.col("role") == role, F.lit(a)).otherwise(head), F.when(F.col("role") == role, F.lit(b)).otherwise(tail)
    turn = F.struct("message", F.concat(F.lit(TURN), head).alias("head"), escape(F.col("text")).alias("body"), F.concat(tail, F.lit(END)).alias("tail"), (F.col("role") == "assistant").alias("loss"), "copies")
    ordered = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    turns = F.flatten(F.transform("turns", lambda t: F.array_repeat(t, t["copies"])))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    mask = F.flatten(F.transform(turns, lambda t: F.array(piece(t["head"], F.lit(False)), piece(t["body"], t["loss"]), piece(t["tail"], F.lit(False)))))
    return ordered.select("conv_id", mask.alias("mask")).select("conv_id", F.array_join(F.transform("mask", lambda p: p["text"]), "").alias("formatted"), "mask")


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    bodies = F.transform(F.filter(F.split(formatted, END), lambda x: F.length(x) > 0), lambda x: F.substr(x, F.lit(len(TURN) + 1)))

    def read(body: Column) -> Column:
        role, text = F.lit("assistant"), body
        cut = lambda a, b: F.substr(body, F.lit(len(a) + 1), F.length(body) - len(a) - len(b))
        for name in ("user", "system"):
            a, b = FRAMES[name]
            own = F.startswith(body, F.lit(a)) & F.endswith(body, F.lit(b))
            role, text = F.when(own, F.lit(name)).otherwise(role), F.when(own, cut(a, b)).otherwise(text)
        own = F.startswith(body, F.lit(NAMED[0]))
        close = F.instr(body, NAMED[1])
        role = F.when(own, F.substr(body, F.lit(len(NAMED[0]) + 1), close - len(NAMED[0]) - 1)).otherwise(role)
        text = F.when(own, F.substr(body, close + len(NAMED[1]))).otherwise(text)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(bodies, read)


def query(conversations: DataFrame) -> DataFrame:
    """Digests, read back from the formatted text and its loss mask, of all conversations and of conversation -1."""
    spark = conversations.sparkSession
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    done = render(fold(events_of(conversations.select(*columns).unionByName(extra))))
    loss = F.array_join(F.transform(F.filter("mask", lambda p: p["loss"]), lambda p: p["text"]), "")
    done = done.select("conv_id", parse(F.col("formatted")).alias("turns"), unescape(loss).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def escaped(x: str) -> str:
        x = rf"replace({x}, '\', '\\')"
        for c in CONTROLS:
            x = f"replace({x}, {q(c)}, {q(c[0] + chr(92) + c[1:])})"
        return x

    frame = f"length({escaped('role')}) + {len(NAMED[0]) + len(NAMED[1])}"
    for role, (a, b) in FRAMES.items():
        frame = f"CASE WHEN role = {q(role)} THEN {len(a) + len(b)} ELSE {frame} END"
    return rf"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    e AS (SELECT *, length({escaped('text')}) + {frame} + {len(TURN) + len(END)} AS chars FROM c)
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, sha256(text))) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(chars)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id"""


SQL = _sql()
