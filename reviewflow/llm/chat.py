"""Chat formatting: each dialogue rendered from every participant's perspective.

In a perspective the chosen speaker is the assistant, every other participant is
a user named by its own name, and system turns stay system turns. Masks give the
code points that a model is trained on: the assistant's words and its end marks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
# Fixed marks of the format.
BEGIN, END, NAME, LINE = "<|im_start|>", "<|im_end|>", " name=", "\n"


def perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, n_turns, text, mask_starts, mask_ends, trained_chars.

    One row per dialogue and participant, however long the dialogue is. A
    participant is a role other than ``system``; a turn whose role is null is a user
    without a name and no participant. Turns are in order of turn (null last), role
    (null last) and text; a null text is empty, and repeated rows are repeated turns.
    conv_id may be of any type that can be compared; a row without one belongs to no
    other row and is a dialogue of its own, so that no group of them is collected. In
    texts and names ``<|`` is written ``<\\|``, so that no text can imitate a mark.
    Other columns are not read; a dialogue without participants has no rows.

    Turns are shuffled once, by dialogue; offsets are running sums over its sorted
    rows, which can spill. Only the text of one result row is held at a time.
    """
    safe = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("<|"), F.lit("<\\|"))
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), safe("text").alias("text")
    )
    role, who = F.col("role"), F.col("speaker")
    named = rows.where("conv_id IS NOT NULL")
    speakers = named.where(role != SYSTEM).select("conv_id", role.alias("speaker")).distinct()
    told = (
        F.when(role == SYSTEM, F.lit(SYSTEM)).when(role == who, F.lit("assistant")).when(role.isNull(), F.lit("user"))
        .otherwise(F.concat(F.lit("user" + NAME), safe("role")))
    )
    head, body = F.concat(F.lit(BEGIN), told, F.lit(LINE)), F.concat(F.col("text"), F.lit(END))

    def rendered(seen: DataFrame) -> DataFrame:
        seen = seen.select(
            "conv_id", "speaker", "turn", "role", "text", F.concat(head, body, F.lit(LINE)).alias("piece"),
            F.length(body).alias("size"), F.coalesce(role == who, F.lit(False)).alias("trained"),
        )
        return seen.withColumn("length", F.length("piece"))

    order = Window.partitionBy("conv_id", "speaker").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), "text")
    placed = rendered(named.join(speakers, "conv_id")).select(
        "conv_id", "speaker", "piece", "size", "trained", F.row_number().over(order).alias("no"),
        (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(LINE)).cast("int").alias("stop"),
    )
    place = F.struct("no", (F.col("stop") - F.col("size")).alias("start"), "stop")
    joined = placed.groupBy("conv_id", "speaker").agg(
        F.sort_array(F.collect_list(F.struct("no", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("trained"), place))).alias("masks"),
        F.sum(F.when(F.col("trained"), F.col("size"))).alias("trained_chars"),
    ).select(
        "conv_id", "speaker", F.size("pieces").alias("n_turns"), F.array_join("pieces.piece", "").alias("text"),
        F.col("masks.start").alias("mask_starts"), F.col("masks.stop").alias("mask_ends"), "trained_chars",
    )
    stop = F.col("length") - len(LINE)
    alone = rendered(rows.where(F.col("conv_id").isNull() & (role != SYSTEM)).withColumn("speaker", role)).select(
        "conv_id", "speaker", F.lit(1).alias("n_turns"), F.col("piece").alias("text"), F.array(stop - F.col("size")).alias("mask_starts"),
        F.array(stop).alias("mask_ends"), F.col("size").cast("long").alias("trained_chars"),
    )
    return joined.unionByName(alone)
