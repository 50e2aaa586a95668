"""Multi-party dialogues, rendered once from the place of each participant. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.runtime import small, table

#: Messages in a row at most: a rendering is given in consecutive parts of so many.
PART_MESSAGES = 512
#: The order of the messages of a conversation.
ORDER = ("has_turn", "turn_no", "digest", "role")
END = "<|im_end|>\n"


def _opening(role: Column, perspective: Column) -> Column:
    return F.when(role == perspective, F.lit("<|im_start|>assistant\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), role, F.lit("\n")))


def _ordered(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in the order of ``keys``, dealt out by range: ``row`` follows that order, ``task`` is its range."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return table(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("task", F.shiftright("row", 33).cast("int")))


def _with_earlier(ordered: DataFrame, group: list[str], **values: str) -> DataFrame:
    """Add the sums of ``values`` over the earlier rows of a group. A task reads the rows of one range, or one row of each."""
    ranges = Window.partitionBy(*group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*group, "task").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda value, window: F.coalesce(F.sum(value).over(window), F.lit(0))
    totals = ordered.groupBy(*group, "task").agg(*[F.sum(v).alias(f"__{k}") for k, v in values.items()])
    totals = totals.select(*group, "task", *[before(f"__{k}", ranges).alias(f"__{k}") for k in values])
    added = ordered.join(totals, [*group, "task"]).withColumns({k: before(v, within) + F.col(f"__{k}") for k, v in values.items()})
    return added.drop(*[f"__{k}" for k in values])


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("\u0000", role, text)))


def _in_parts(rows: DataFrame, part_messages: int) -> DataFrame:
    """conv_id, part, messages, perspective and the code point of the rendering at which the part starts, from rows of messages."""
    rows = rows.withColumn("digest", _digest(F.col("role"), F.col("text")))
    rows = rows.withColumn("has_turn", F.col("turn").isNotNull()).withColumn("turn_no", F.coalesce("turn", F.lit(0)))
    slim = rows.select("conv", *ORDER, F.length("text").alias("n_text")).dropDuplicates(["conv", *ORDER])
    # Length where the role is another participant's; as the assistant's it is shorter by the role and a line end.
    length = F.length(_opening(F.col("role"), F.lit(None))) + F.col("n_text") + len(END)
    slim = slim.withColumn("length", length.cast("long")).withColumn("one", F.lit(1)).drop("n_text")
    slim = _with_earlier(_ordered(slim, "conv", *ORDER), ["conv"], at="length", one_before="one")
    slim = table(slim.withColumn("part", F.floor(F.col("one_before") / part_messages).cast("long")))

    people = small(table(slim.select("conv", F.col("role").alias("perspective")).distinct()))
    parts = slim.groupBy("conv", "part").agg(F.min("at").alias("at"))
    own = slim.groupBy("conv", "part", F.col("role").alias("perspective")).agg(F.count("*").alias("own"))
    starts = parts.join(people, "conv").join(own, ["conv", "part", "perspective"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    starts = _with_earlier(_ordered(starts, "conv", "perspective", "part"), ["conv", "perspective"], own_before="own")
    shorter = F.length(_opening(F.col("perspective"), F.lit(None))) - F.length(_opening(F.col("perspective"), F.col("perspective")))
    starts = starts.select("conv", "part", "perspective", (F.col("at") - F.col("own_before") * shorter).alias("start"))

    whole = rows.dropDuplicates(["conv", *ORDER]).join(slim.select("conv", *ORDER, "part"), ["conv", *ORDER])
    message = F.struct("turn", "digest", "role", "text")
    grouped = whole.groupBy("conv", "part").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(message)).alias("messages"))
    return grouped.join(starts, ["conv", "part"]).select("conv_id", "part", "messages", "perspective", "start")


def rotate_perspectives(conversations: DataFrame, part_messages: int = PART_MESSAGES) -> DataFrame:
    """conv_id, perspective, part, n_messages, rendered, mask_spans, n_masked.

    For every participant (distinct role) of a conversation all its messages are rendered in the order
    of their turns, that participant as ``assistant`` and each other one as ``user`` with its name.
    mask_spans lists the ``start:end`` code points of that rendering that are learned: the texts and
    end marks of the assistant; n_masked is their sum.

    Equal turns are ordered by the MD5 of role and text. A row that repeats as a whole is one
    message. Null text is empty, a null role is ``unknown``, a null turn comes first, and rows
    without conv_id are one conversation; an empty table gives none. So that no row grows with its
    conversation, the ordered messages are cut into consecutive parts of ``part_messages``, numbered
    from 0: ``rendered`` and mask_spans joined in the order of part are those of the whole
    conversation, as the spans count from its beginning. Columns other than the four are not read.

    A conversation of at most ``part_messages`` rows is one part and is collected as it is. Of all
    others, order, cuts and lengths come from rows without texts, sorted by range over all
    conversations; a text is dealt out once to drop repeats and once to its part. Which way a
    conversation goes does not change its rows.
    """
    rows = conversations.select(
        F.col("conv_id"),
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    longer = table(rows.groupBy("conv").count().filter(F.col("count") > part_messages).select("conv"))
    several = small(longer)
    message = F.struct("turn", "role", "text")
    grouped = rows.join(several, "conv", "left_anti").groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.collect_list(message).alias("messages"))
    with_digest = lambda m: F.struct(m["turn"].alias("turn"), _digest(m["role"], m["text"]).alias("digest"), m["role"].alias("role"), m["text"].alias("text"))
    grouped = grouped.withColumn("messages", F.sort_array(F.transform(F.array_distinct("messages"), with_digest)))
    perspective = F.explode(F.array_distinct(F.transform("messages", lambda m: m["role"])))
    turned = grouped.select("conv_id", F.lit(0).cast("long").alias("part"), "messages", perspective.alias("perspective"), F.lit(0).cast("long").alias("start"))
    if not longer.isEmpty():
        turned = turned.unionByName(_in_parts(rows.join(several, "conv", "left_semi"), part_messages))

    end = F.lit(END)
    me = F.col("perspective")
    rendered = F.array_join(F.transform("messages", lambda m: F.concat(_opening(m["role"], me), m["text"], end)), "")

    def step(state: Column, m: Column) -> Column:
        begin = state["at"] + F.length(_opening(m["role"], me))
        stop = begin + F.length(m["text"]) + F.length(end) - 1
        span = F.concat_ws(":", begin.cast("string"), stop.cast("string"))
        mine = m["role"] == me
        return F.struct(
            (stop + 1).cast("long").alias("at"),
            F.when(mine, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
            (state["n"] + F.when(mine, stop - begin).otherwise(F.lit(0))).cast("long").alias("n"),
        )

    start = F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("long").alias("n"))
    walked = F.aggregate("messages", start, step)
    return turned.select(
        "conv_id", "perspective", "part", F.size("messages").cast("long").alias("n_messages"), rendered.alias("rendered"), walked.alias("walked")
    ).select("conv_id", "perspective", "part", "n_messages", "rendered", F.array_join("walked.spans", ",").alias("mask_spans"), F.col("walked.n").alias("n_masked"))


ORACLE_SQL = f"""
WITH d AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), m AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(0) || text), role) - 1 AS k FROM d
), p AS (
  SELECT DISTINCT conv_id AS pid, role AS perspective FROM m
), r AS (
  SELECT conv_id, perspective, k, role = perspective AS mine, text,
    CASE WHEN role = perspective THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || role || chr(10) END AS opening
  FROM m JOIN p ON conv_id IS NOT DISTINCT FROM pid
), s AS (
  SELECT *, sum(length(opening) + length(text) + 11) OVER (PARTITION BY conv_id, perspective ORDER BY k) AS stop FROM r
)
SELECT conv_id, perspective, k // {PART_MESSAGES} AS part, count(*) AS n_messages,
  string_agg(opening || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered,
  coalesce(string_agg(CASE WHEN mine THEN CAST(CAST(stop - 11 - length(text) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop - 1 AS BIGINT) AS VARCHAR) END,
    ',' ORDER BY k), '') AS mask_spans,
  CAST(sum(CASE WHEN mine THEN length(text) + 10 ELSE 0 END) AS BIGINT) AS n_masked
FROM s GROUP BY conv_id, perspective, k // {PART_MESSAGES}
"""
