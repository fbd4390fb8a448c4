"""Chat formatting from an event log, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

OPEN, MIDDLE, CLOSE = "<turn>", "<text>", "</turn>\n"
#: Kinds of events. ``message`` opens a message; the others change the newest message of the same msg_id.
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    """Write backslash as \\b and < as \\l, so that no control string is left in a text."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages from (conv_id, seq, msg_id, kind, role, text) events: one row per message.

    Events of a (conv_id, msg_id) are sorted by seq, then kind's place in ``KINDS``, role and text. A ``message``
    event opens a message with its text; so does the first event of a msg_id, whatever its kind. ``delta`` appends, ``edit``
    and ``regenerate`` replace all text so far. The role is that of the opening event. Null or unknown kind:
    ``message``. Null text or role: empty. Null ids form groups of their own; null seq comes first.

    Returns conv_id, seq (of the opening event), ord (place among messages opened by the same group), role, text.
    """
    kind = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int"), F.lit(1))
    kind = F.when(kind == 0, 1).otherwise(kind)
    event = F.struct("seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    groups = events.groupBy("conv_id", "msg_id").agg(F.sort_array(F.collect_list(event)).alias("ev"))
    at = F.sequence(F.lit(1), F.size("ev"))
    groups = groups.withColumn("starts", F.filter(at, lambda i: (i == 1) | (F.element_at("ev", i)["kind"] == 1)))

    def close(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("ev") + 1)
        return F.slice("ev", i, end - i)

    messages = groups.select("conv_id", F.posexplode(F.transform("starts", close)).alias("ord", "part"))
    resets = F.filter(F.sequence(F.lit(1), F.size("part")), lambda i: (i == 1) | (F.element_at("part", i)["kind"] != 2))
    live = F.slice("part", F.array_max(resets), F.size("part") - F.array_max(resets) + 1)
    text = F.array_join(F.transform(live, lambda e: e["text"]), "")
    return messages.select("conv_id", F.col("part")[0]["seq"].alias("seq"), "ord", F.col("part")[0]["role"].alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted and loss, the (start, length) spans of assistant texts in it.

    Each turn is ``<turn>`` role ``<text>`` text ``</turn>`` and a line feed; role and text are escaped. Turns go
    by seq, then ord, role and text (null seq first); repeated messages are repeated turns. Null role or text: as empty, spans of length 0
    included. Null conv_id is a conversation of its own. Offsets count code points from 0. Empty input: no rows.
    """
    rows = messages.withColumn("r", escape(F.col("role"))).withColumn("t", escape(F.col("text")))
    size = F.length("r") + F.length("t") + len(OPEN + MIDDLE + CLOSE)
    before = W.Window.partitionBy("conv_id").orderBy("seq", "ord", "role", "text").rowsBetween(W.Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)) + len(OPEN + MIDDLE) + F.length("r"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("at").cast("long").alias("start"), F.length("t").cast("long").alias("length")))
    by_conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "ord", "role", "text"))).alias("turns"), F.sort_array(F.collect_list(span)).alias("loss"))
    piece = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(CLOSE))
    return by_conv.select("conv_id", F.array_join(F.transform("turns", piece), "").alias("formatted"), "loss")


def read_back(rendered: DataFrame) -> DataFrame:
    """The turns of rendered conversations, unescaped: conv_id, formatted, loss, turns (role, text) in order. A null or empty ``formatted``
    has null or no turns."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    part = F.transform(pieces, lambda p: F.split(F.substring(p, len(OPEN) + 1, F.length(p)), MIDDLE))
    turns = F.transform(part, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))
    return rendered.select("conv_id", "formatted", "loss", turns.alias("turns"))


def learned() -> Column:
    """The texts under the loss mask, in order: ``formatted`` sliced at the spans of ``loss`` and unescaped."""
    return F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def summary(rendered: DataFrame) -> DataFrame:
    """Sizes and hashes of rendered conversations: what was said is read back by turns, what is learned by the loss mask."""
    back = read_back(rendered)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(learned(), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def log_of(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as an event log in which every row opens a message."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.col("turn").alias("msg_id"), F.lit("message").alias("kind"), "role", "text")


#: How far apart the events of one streamed message lie in the log's sequence.
STEP = 1


def streamed_log(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as the log of a chat service whose folded messages are these rows.

    A user's row is one ``message``. An assistant's, by a hash of conversation and turn, comes whole, in three parts (``message`` and two
    ``delta``), as a draft that is corrected (``message``, ``edit``) or as an attempt that is streamed and thrown away (``message``,
    ``delta``, ``regenerate``). Events of a message lie at turn, turn + 1 and turn + 2, so those of neighbouring turns are interleaved.
    Every row is a message of its own, however often it occurs; rows without a turn come whole. Null text stays null.
    """
    text = F.coalesce("text", F.lit(""))
    third = F.floor(F.length(text) / 3).cast("int")
    part = lambda first, size: F.substr(text, first, size)
    event = lambda i, kind, said: F.struct((F.col("turn") + i * STEP).alias("seq"), F.lit(kind).alias("kind"), said.alias("said"))
    whole = F.array(F.struct(F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.col("text").alias("said")))
    parts = F.array(event(0, "message", part(F.lit(1), third)), event(1, "delta", part(third + 1, third)), event(2, "delta", part(2 * third + 1, F.length(text))))
    edited = F.array(event(0, "message", F.concat(F.lit("Draft: "), part(F.lit(1), F.lit(20)))), event(1, "edit", text))
    redone = F.array(event(0, "message", part(F.lit(1), F.lit(20))), event(1, "delta", F.lit(" and so on")), event(2, "regenerate", text))
    way = F.when((F.col("role") == "assistant") & F.col("turn").between(-(1 << 62), 1 << 62), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)))
    log = conversations.withColumn("msg_id", F.monotonically_increasing_id())
    log = log.withColumn("event", F.explode(F.when(way == 1, parts).when(way == 2, edited).when(way == 3, redone).otherwise(whole)))
    return log.select("conv_id", "event.seq", "msg_id", "event.kind", "role", F.col("event.said").alias("text"))


def op5_format_chats(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return summary(render(fold(streamed_log(rows.unionByName(extra)))))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(role, '\', '\b'), '<', '\l')) + length(replace(replace(text, '\', '\b'), '<', '\l')) + 20 AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
