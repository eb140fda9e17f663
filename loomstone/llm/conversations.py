"""Conversations rebuilt from message rows, and only those that are whole.

Rows that lack a usable identifier are joined to their conversation as connected
components by alternating large-star and small-star joins: rows with an odd
spelling of a chat id through that spelling, and rows without any id through
reply and quote links, where a table of links is given. Rows with a clean id need
no join. Then turns are ordered and each conversation is validated. No step
gathers a conversation in one task: turns are found and ranked hour by hour, and
verdicts are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.components import connected_components
from loomstone.session import cut

# Spellings of the roles, and what notes of a failed reply are about.
ROLES = {
    "user": ["user", "human", "customer", "prompter", "client", "person", "usr", "u"],
    "assistant": ["assistant", "ai", "bot", "model", "chatbot", "agent", "gpt", "asst"],
    "system": ["system", "sys", "developer"],
}
FAILURE = "error|fail|abort|stopp|empty|no ?(?:output|reply|response|answer|content|text|tokens?)|time[d -]?out|cancel|interrupt|exceed|unavailable|missing|blank|null|undefined|nothing"
REPEAT_SECONDS = 5
_CODES = ["user", "assistant", "system"]
_USER, _ASSISTANT, _SYSTEM = 1, 2, 3
_GAP, _HOUR = REPEAT_SECONDS * 1_000_000, 3_600_000_000

_OUTER = r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$"
_NOTE = rf"(?i)^(?:[\[<({{*_]+[^\]>)}}]{{0,100}}(?:{FAILURE})[^\]>)}}]{{0,100}}[\]>)}}*_]+\.?|(?:error|exception|failed|failure|fatal)\s*[:(\-](?:\s*[^\s.,;!?]+){{0,8}}?\s*(?:{FAILURE})(?:\s*[^\s.,;!?]+){{0,5}}|(?:generation|request|reply|response) (?:failed|aborted|timed out|stopped)(?:\s*[^\s.,;!?]+){{0,5}})$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _OUTER, "")


def clean_role(role: Column) -> Column:
    """user, assistant or system, in any spelling; else null."""
    name = F.lower(F.regexp_replace(role, r"(?U)[^\p{L}]+", ""))
    known = F.when(F.lit(False), F.lit(""))
    for clean, spellings in ROLES.items():
        known = known.when(name.isin(spellings), F.lit(clean))
    return F.when(F.regexp_replace(role, r"(?U)[\s:*#<>|\[\]\p{Cf}]+", "").rlike(r"^\p{L}+$"), known)


def micros(time: Column) -> Column:
    """Epoch time in microseconds, whether it was stored in seconds, milli-, micro- or nanoseconds; null if there is none."""
    t = F.when(F.isnan(time), None).otherwise(time)
    seconds = F.when(F.abs(t) >= 1e17, t / 1e9).when(F.abs(t) >= 1e14, t / 1e6).when(F.abs(t) >= 1e11, t / 1e3).otherwise(t)
    return F.round(seconds * 1_000_000).cast("bigint")


def failed(content: Column) -> Column:
    """Null, blank, or only a note that generation failed or gave nothing."""
    bare = trimmed(content)
    return content.isNull() | (bare == "") | bare.rlike(_NOTE)


def _key(chat: Column) -> Column:
    return F.lower(trimmed(chat))


def _node(spelling: Column) -> Column:
    """The node of a clean id (c, which sorts first), or of an odd spelling (s)."""
    return F.when(spelling == _key(spelling), F.concat(F.lit("c"), spelling)).otherwise(F.concat(F.lit("s"), spelling))


def _placed(rows: DataFrame, found: DataFrame, linked: bool) -> DataFrame:
    """Rows with the conversation of their node. Only links can bring clean ids together; without them those are left as they are."""
    known = rows.where("node is not null")
    if linked:
        return known.join(found, "node", "left").withColumn("conv", F.coalesce("conv", F.when(~F.col("node").startswith("m"), F.col("node")))).where("conv is not null").drop("node")
    clean = known.where(F.col("node").startswith("c")).withColumn("conv", F.col("node"))
    other = known.where(F.col("node").startswith("s")).join(found, "node")
    return clean.unionByName(other.select(clean.columns)).drop("node")


def rebuild(messages: DataFrame, chats: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``chat_id`` (as spelt in ``chats``), ``turn_no`` from 1, ``message_id``, ``role`` and ``content`` of the turns of each whole conversation.

    ``links`` (``message_id``, ``refers_to``) may name replies and quotes of rows
    without a chat id; without it such rows belong to no conversation. A
    conversation is dropped if its chat is unknown, a row lacks a time or a
    readable role, a content is null, blank or a failure note, or its turns aren't
    an optional system turn and then user and assistant in alternation, ending
    with assistant. Equal times are ordered by id; a row that repeats role and
    content of an earlier one within REPEAT_SECONDS is the same turn, reported by
    its least id. Chats exported twice count once; if several spellings of an id
    are in ``chats``, the least is reported. Other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    rows = messages.select(
        F.col("id").cast("bigint").alias("message_id"),
        F.col("chat_id").cast("string").alias("spelling"),
        clean_role(F.col("role")).alias("role"),
        micros(F.col("created_at").cast("double")).alias("t"),
        failed(F.col("content")).alias("failed"),
        F.xxhash64(trimmed(F.col("content"))).alias("h"),
        F.length(trimmed(F.col("content"))).alias("m"),
    ).withColumn("node", _node(F.col("spelling")))
    named = chats.where("id is not null").select(F.col("id").cast("string").alias("spelling")).distinct().withColumn("node", _node(F.col("spelling")))
    odd = messages.select(F.col("chat_id").cast("string").alias("spelling")).distinct().unionByName(named.select("spelling")).where(_node(F.col("spelling")).startswith("s"))
    edges = odd.select(_node(F.col("spelling")).alias("a"), F.concat(F.lit("c"), _key(F.col("spelling"))).alias("b"))
    if links is not None:
        edges = edges.unionByName(_link_edges(rows, links))
        rows = rows.withColumn("node", F.coalesce("node", F.concat(F.lit("m"), F.col("message_id").cast("string"))))
    found = connected_components(edges, "a", "b")
    found = cut(found.select("node", F.col("component").alias("conv")))
    chat_of = _placed(named, found, links is not None).groupBy("conv").agg(F.min("spelling").alias("chat_id"))
    code = F.array_position(F.array(*map(F.lit, _CODES)), F.col("role")).cast("byte")  # null where the role is
    slim = cut(_placed(rows, found, links is not None).select("conv", "message_id", code.alias("role"), "t", "failed", "h", "m"))
    bad = F.col("failed") | F.col("role").isNull() | F.col("t").isNull()
    sound = (
        slim.groupBy("conv")
        .agg(F.max(bad).alias("bad"), F.count_if(F.col("role") == _USER).alias("users"), F.count_if(F.col("role") == _ASSISTANT).alias("assistants"))
        .where("not bad and users > 0 and assistants > 0")
        .select("conv")
    )
    timed = slim.drop("failed").withColumn("hour", F.floor(F.col("t") / _HOUR)).join(sound, "conv", "left_semi")
    # by chat and hour, so that no later step puts a chat into one task
    turns = cut(_turns(timed.repartition("conv", "hour")))
    ranked = _ranked(turns.repartition("conv", "hour"))
    whole = (
        ranked.groupBy("conv")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("role") == _SYSTEM).alias("systems"),
            F.count_if((F.col("role") == _SYSTEM) & (F.col("rank") == 1)).alias("first"),
            F.count_if(F.col("role") != F.when(F.col("rank") % 2 == 1, _USER).otherwise(_ASSISTANT)).alias("plain"),
            F.count_if((F.col("rank") > 1) & (F.col("role") != F.when(F.col("rank") % 2 == 0, _USER).otherwise(_ASSISTANT))).alias("shifted"),
        )
        .where("(systems = 0 and plain = 0 and n % 2 = 0) or (systems = 1 and first = 1 and shifted = 0 and n % 2 = 1 and n > 1)")
        .select("conv")
    )
    kept = ranked.join(whole.join(chat_of, "conv"), "conv")
    return kept.select("chat_id", F.col("rank").cast("int").alias("turn_no"), "message_id", F.element_at(F.array(*map(F.lit, _CODES)), F.col("role").cast("int")).alias("role"))


def with_content(turns: DataFrame, messages: DataFrame) -> DataFrame:
    """The turns of ``rebuild`` with their contents, outer spacing left out."""
    texts = messages.select(F.col("id").cast("bigint").alias("message_id"), trimmed(F.col("content")).alias("content"))
    return turns.join(texts.dropDuplicates(["message_id"]), "message_id")


def _link_edges(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Edges of rows without an id: to the rows they refer to, and to those that refer to them."""
    link = links.select(F.col("message_id").cast("bigint").alias("message_id"), F.col("refers_to").cast("bigint").alias("target")).where("message_id is not null and target is not null")
    loose = rows.where("spelling is null").select("message_id")
    homes = rows.where("spelling is not null").select(F.col("message_id").alias("target"), F.col("node").alias("home"))
    own = link.join(loose, "message_id").join(homes, "target", "left")
    forward = own.select(F.concat(F.lit("m"), F.col("message_id").cast("string")).alias("a"), F.coalesce("home", F.concat(F.lit("m"), F.col("target").cast("string"))).alias("b"))
    back = link.join(loose.withColumnRenamed("message_id", "target"), "target").join(homes.withColumnRenamed("target", "message_id"), "message_id")
    return forward.unionByName(back.select(F.concat(F.lit("m"), F.col("target").cast("string")).alias("a"), F.col("home").alias("b")))


def _islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key that follow one another within REPEAT_SECONDS, as one: least id, first and last time."""
    near = Window.partitionBy(*keys).orderBy("t")
    starts = rows.withColumn("new", F.coalesce((F.col("t") - F.lag("until").over(near) > _GAP).cast("int"), F.lit(1)))
    numbered = starts.withColumn("island", F.sum("new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("message_id").alias("message_id"), F.min("t").alias("t"), F.max("until").alias("until")).drop("island")


def _turns(rows: DataFrame) -> DataFrame:
    """One row for each turn. Repeats are joined within an hour; only what touches the hour's edge is then joined across hours."""
    keys = ["conv", "role", "h", "m"]
    equal = rows.groupBy(*keys, "hour", "t").agg(F.min("message_id").alias("message_id")).withColumn("until", F.col("t"))
    within = _islands(equal, [*keys, "hour"])
    edge = (F.col("t") - F.col("hour") * _HOUR <= _GAP) | ((F.col("hour") + 1) * _HOUR - F.col("until") <= _GAP)
    columns = ["conv", "role", "message_id", "t"]
    joined = _islands(within.where(edge), keys)
    return within.where(~edge).select(columns).unionByName(joined.select(columns)).withColumn("hour", F.floor(F.col("t") / _HOUR))


def _ranked(turns: DataFrame) -> DataFrame:
    """Place of each turn in its conversation: turns of earlier hours plus place within the hour."""
    per_hour = turns.groupBy("conv", "hour").agg(F.count(F.lit(1)).alias("own"))
    earlier = Window.partitionBy("conv").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_hour.select("conv", "hour", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv", "hour").orderBy("t", "message_id")
    placed = turns.withColumn("place", F.row_number().over(within)).join(offsets, ["conv", "hour"])
    return placed.select("conv", "role", "message_id", (F.col("place") + F.col("before")).alias("rank"))
