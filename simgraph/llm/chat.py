"""Chat formatting from every participant's point of view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from simgraph.llm.state import prepare

#: Messages of one row: the rendering of a longer dialogue is the concatenation of its parts' rows.
PART = 1024
#: Turn values that are counted together before they are ordered.
SPAN = 4096
SYSTEM = "system"


def _head(role: Column, speaker: Column) -> Column:
    named = F.concat(F.lit("<|user name="), role, F.lit("|>\n"))
    return F.when(role == SYSTEM, F.lit("<|system|>\n")).when(role == speaker, F.lit("<|assistant|>\n")).otherwise(named)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with nth: the place of each message in its dialogue by turn, role and text, from 0.

    Messages are counted by dialogue and turn before anything is ordered, and
    turns by SPAN of them, so no window holds a long dialogue's texts; those
    with one turn of one dialogue are ordered together.
    """
    of = [F.col("_conv").eqNullSafe(F.col("c")), F.col("_alone").eqNullSafe(F.col("a")), F.col("turn") == F.col("t")]
    turns = rows.groupBy(F.col("_conv").alias("c"), F.col("_alone").alias("a"), F.col("turn").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    turns = turns.withColumn("s", F.floor(F.col("t") / SPAN))
    spans = turns.groupBy("c", "a", "s").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c", "a").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col("c").alias("c2"), F.col("a").alias("a2"), F.col("s").alias("s2"), before.alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("c", "a", "s").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("inside", inside).join(spans, F.col("c").eqNullSafe(F.col("c2")) & F.col("a").eqNullSafe(F.col("a2")) & (F.col("s") == F.col("s2")))
    turns = turns.select("c", "a", "t", (F.col("base") + F.col("inside")).alias("first"))
    place = F.row_number().over(Window.partitionBy("_conv", "_alone", "turn").orderBy("role", "text"))
    return rows.withColumn("place", place).join(turns, of[0] & of[1] & of[2]).withColumn("nth", F.col("first") + F.col("place") - 1).drop("c", "a", "t", "first", "place")


def perspectives(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART) -> DataFrame:
    """conv, part, speaker, n_messages, rendered and masks: one row for every participant and every ``part`` messages of a dialogue.

    The speaker's messages are the assistant's, the system's stay, all others
    are users with their names. masks: [start, end) code points of the
    speaker's texts in ``rendered``; the model is trained on these alone.
    Messages are ordered by turn, then role and text, so ties and repeated rows
    have one order. Every participant of the dialogue gets every part, silent
    there or not: the parts' renderings in order are the whole dialogue's. A
    null role is ``unknown``, a null text empty, a null turn 0; ``<|`` in roles
    and texts becomes ``< |``. Messages with no conversation form a dialogue
    for each turn, role and text. Dialogues without a participant (only system
    messages) give no row.
    """
    prepare(messages.sparkSession)
    plain = lambda c, empty: F.replace(F.coalesce(F.col(c), F.lit(empty)), F.lit("<|"), F.lit("< |"))
    rows = messages.select(
        F.col(conv).alias("_conv"), F.coalesce(F.col(turn), F.lit(0)).alias("turn"), plain(role, "unknown").alias("role"), plain(text, "").alias("text")
    )
    alone = F.when(F.col("_conv").isNull(), F.xxhash64("turn", "role", "text"))
    rows = rows.withColumn("_alone", alone)
    numbered = _numbered(rows).withColumn("part", F.floor(F.col("nth") / part).cast("long"))
    told = numbered.groupBy("_conv", "_alone", "part").agg(F.array_sort(F.collect_list(F.struct("nth", "role", "text"))).alias("told"))
    speakers = rows.where(F.col("role") != SYSTEM).select(F.col("_conv").alias("c"), F.col("_alone").alias("a"), F.col("role").alias("speaker")).distinct()
    each = told.join(speakers, F.col("_conv").eqNullSafe(F.col("c")) & F.col("_alone").eqNullSafe(F.col("a")))
    parts = F.transform("told", lambda m: F.struct(_head(m.role, F.col("speaker")).alias("head"), m.text.alias("body"), (m.role == F.col("speaker")).alias("own")))
    each = each.withColumn("parts", parts)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("masks"))

    def step(acc: Column, p: Column) -> Column:
        first = acc.at + F.length(p.head)
        last = first + F.length(p.body)
        span = F.struct(first.cast("long").alias("start"), last.cast("long").alias("end"))
        return F.struct((last + 1).cast("long").alias("at"), F.when(p.own, F.array_append(acc.masks, span)).otherwise(acc.masks).alias("masks"))

    masks = F.aggregate("parts", start, step, lambda acc: acc.masks)
    rendered = F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit("\n"))), "")
    return each.select(F.col("_conv").alias(conv), "part", "speaker", F.size("told").cast("long").alias("n_messages"), rendered.alias("rendered"), masks.alias("masks"))
