"""Chat formatting by perspective rotation, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turn numbers of one dialogue that one row renders; a longer dialogue goes on in further rows.
TURNS_PER_ROW = 1 << 14
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text",
    narrators: tuple[str, ...] = ("system",), turns_per_row: int = TURNS_PER_ROW,
) -> DataFrame:
    """Renders every dialogue once per participant: that one as assistant, the others as named users.

    A row per dialogue, participant and part: ``part`` (0 first; part p holds turns p*16,384 and up),
    ``rendered``, ``n_turns``, ``n_own``, ``mask`` (spans ``start:end`` of code points in ``rendered``,
    comma-joined, that the loss covers: the participant's texts with their end mark) and
    ``mask_chars``. Narrators (the system) keep their role, are masked out and have no perspective of
    their own.

    A dialogue's part is a fixed range of turn numbers, so no row and no task gathers a dialogue
    without bound, and participants are found by a partial aggregation. Parts of a dialogue put one
    after another are its rendering. Order inside a part: turn, then speaker, then text (ties cannot
    depend on the layout of the input); null turns come first, in part 0. Null texts count as empty,
    texts may be long; null and empty speakers are called ``unknown``. A row with no conv_id is a
    dialogue of its own. Marks inside texts and speakers' names are broken by a space after their
    ``<``, and line ends in names are shown as a space, so neither can end its turn. A dialogue of
    narrators only gives no row; an empty table gives none; other columns are not read.
    """

    def unmarked(c):
        for mark in (OPEN, CLOSE):
            c = F.replace(c, F.lit(mark), F.lit(mark.replace("<", "< ", 1)))
        return c

    rows = turns.select(
        F.col(conv_col).alias("_conv"),
        F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id()).otherwise(-1).alias("_solo"),
        F.floor(F.coalesce(F.col(turn_col), F.lit(0)) / F.lit(turns_per_row)).cast("long").alias("part"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.when(F.trim(F.col(speaker_col)) != "", F.trim(F.col(speaker_col))), F.lit("unknown")).alias("who"),
            unmarked(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    keys = ["_conv", "_solo"]
    same = F.col("a._conv").eqNullSafe(F.col("b._conv")) & (F.col("a._solo") == F.col("b._solo"))
    parts = rows.groupBy(*keys, "part").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    who = rows.where(~F.col("t.who").isin(*narrators)).select(*keys, F.col("t.who").alias("participant")).distinct()
    both = parts.alias("a").join(who.alias("b"), same).select("a._conv", "a.part", "a.ts", "b.participant")

    def segment(t):
        mine = t["who"] == F.col("participant")
        shown = unmarked(F.regexp_replace(t["who"], r"[\r\n]+", " "))
        head = (
            F.when(mine, F.lit(f"{OPEN}assistant\n"))
            .when(t["who"].isin(*narrators), F.concat(F.lit(OPEN), shown, F.lit("\n")))
            .otherwise(F.concat(F.lit(f"{OPEN}user name="), shown, F.lit("\n")))
        )
        return F.struct(mine.alias("mine"), F.length(head).alias("head"), F.concat(head, t["text"], F.lit(f"{CLOSE}\n")).alias("s"))

    spans = F.aggregate(
        "segs",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).alias("chars")),
        lambda acc, g: F.struct(
            (acc["at"] + F.length(g["s"])).alias("at"),
            F.when(
                g["mine"],
                F.concat(acc["spans"], F.array(F.concat_ws(":", acc["at"] + g["head"], acc["at"] + F.length(g["s"]) - 1))),
            ).otherwise(acc["spans"]).alias("spans"),
            (acc["chars"] + F.when(g["mine"], F.length(g["s"]) - 1 - g["head"]).otherwise(0)).alias("chars"),
        ),
    )
    return (
        both.withColumn("segs", F.transform("ts", segment))
        .withColumn("m", spans)
        .select(
            F.col("_conv").alias(conv_col), "participant", "part",
            F.array_join(F.transform("segs", lambda g: g["s"]), "").alias("rendered"),
            F.size("segs").cast("long").alias("n_turns"),
            F.size(F.filter("segs", lambda g: g["mine"])).cast("long").alias("n_own"),
            F.array_join("m.spans", ",").alias("mask"),
            F.col("m.chars").cast("long").alias("mask_chars"),
        )
    )
