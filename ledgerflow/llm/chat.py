"""Multi-party chat formatting by perspective rotation.

Every participant of a conversation becomes the assistant once: their turns
are rendered as the assistant's, everyone else's as a named user's, and the
loss mask covers exactly the assistant's words and end marks. A system turn
is an instruction, not a participant; it is rendered as such and never
masked in. Built from DataFrame functions only.

A conversation's rows are numbered in order, and ``window`` consecutive rows
are a part, so that a conversation of any length, and any number of rows with
null or repeated turn numbers, is a set of bounded examples. A later part
begins with its context: the system turns of part 0, then the last ``lead``
rows before it. Context is rendered, never masked in. What a later part still
lacks are older rows, system turns after part 0 among them. A part is rendered
for the participants who speak in it: for others there is nothing to learn,
and renderings for all would grow with speakers times parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import small, stored
from ledgerflow.operators.windows import prefix_sums

WINDOW = 256
LEAD = 16                      # rows before a part that are its lead-in
MAX_LISTED = 300_000           # rows of a broadcast list of conversations
SYSTEM = "system"
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _safe(c: Column) -> Column:
    """Text that cannot be taken for a mark."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def _name(role: Column) -> Column:
    return F.regexp_replace(_safe(role), r"\s+", "_")


def _parts(once: DataFrame, window: int, lead: int) -> DataFrame:
    """(conv_id, part, own, row, role, text) of conversations with several parts:
    each part's own rows, its lead-in, and the system turns of part 0. Rows are
    numbered by ``prefix_sums``, which cuts a hot conversation by ranges."""
    order = [F.col(c).asc() for c in ("turn", "role", "text")]
    rows = prefix_sums(once, ["conv_id"], order, out="row").withColumn("part", F.floor(F.col("row") / window))
    told = (F.col("role") == SYSTEM) & (F.col("part") == 0)
    led = (F.col("row") % window >= window - lead) & ~told
    use = F.struct(F.col("part").alias("part"), F.lit(True).alias("own"))
    then = F.struct((F.col("part") + 1).alias("part"), F.lit(False).alias("own"))
    used = (rows.withColumn("use", F.explode(F.when(led, F.array(use, then)).otherwise(F.array(use))))
            .select("conv_id", "use.part", "use.own", "row", "role", "text"))
    later = rows.filter("part > 0").select(F.col("conv_id").alias("later_id"), F.col("part").alias("later")).distinct()
    first = rows.filter(told)
    carried = first.join(later, first["conv_id"].eqNullSafe(later["later_id"])).select(
        "conv_id", F.col("later").alias("part"), F.lit(False).alias("own"), "row", "role", "text")
    return used.unionByName(carried)


def examples(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text", window: int = WINDOW, lead: int = LEAD) -> DataFrame:
    """One row per conversation, part and participant who speaks in it: conv_id,
    part, perspective, n_turns, n_context, text, mask, n_masked.

    mask lists the code point spans (start, end) of ``text`` to learn from.
    Turns are ordered by number, then role, then text; a turn recorded twice
    (same number, role and text) counts once. A null turn number comes first
    (as -1); a null role is the participant "unknown"; a null text is empty; a
    null conversation id is a conversation. n_turns counts the part's own turns,
    n_context those before them. An empty table gives an empty result; other
    columns are ignored. Conversations' rows are counted when this is called.
    """
    rows = turns.select(turns[id_col].alias("conv_id"), F.coalesce(turns[turn_col].cast("long"), F.lit(-1).cast("long"))
                        .alias("turn"), F.coalesce(turns[role_col], F.lit("unknown")).alias("role"),
                        F.coalesce(turns[text_col], F.lit("")).alias("text"))

    def distinct(df: DataFrame) -> DataFrame:
        return df.groupBy("conv_id", "turn", "role", "text").agg(F.lit(1).alias("one")).drop("one")

    def whole(df: DataFrame) -> DataFrame:
        return distinct(df).select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(True).alias("own"),
                                   F.col("turn").alias("row"), "role", "text")

    # narrow: conversations with more rows than a part
    large = stored(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > window)
                   .select(F.col("conv_id").alias("large_id")), "chat-large")
    n_large = large.count()
    if n_large:
        large = small(large, n_large, MAX_LISTED)
        same = rows["conv_id"].eqNullSafe(large["large_id"])
        used = whole(rows.join(large, same, "left_anti")).unionByName(
            _parts(distinct(rows.join(large, same, "left_semi")), window, lead))
    else:
        used = whole(rows)
    talks = used.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("row", "role", "text", "own"))).alias("turns"))
    talks = talks.withColumn("speakers", F.array_sort(F.array_distinct(F.transform(F.filter(
        "turns", lambda t: t["own"] & (t["role"] != SYSTEM)), lambda t: t["role"]))))
    seen = talks.withColumn("perspective", F.explode("speakers"))

    def rendered(t: Column) -> Column:
        mine = t["role"] == F.col("perspective")
        head = (F.when(mine, F.lit(f"{BEGIN}assistant\n"))
                .when(t["role"] == SYSTEM, F.lit(f"{BEGIN}system\n"))
                .otherwise(F.concat(F.lit(f"{BEGIN}user name="), _name(t["role"]), F.lit("\n"))))
        body = F.concat(_safe(t["text"]), F.lit(END))
        return F.struct((mine & t["own"]).alias("mine"), head.alias("head"), body.alias("body"),
                        F.char_length(head).cast("long").alias("skip"),
                        F.char_length(body).cast("long").alias("length"))

    parts = seen.withColumn("parts", F.transform("turns", rendered))
    empty = F.lit(None).cast("array<struct<start:bigint,end:bigint>>")
    walked = F.aggregate(
        "parts", F.struct(F.lit(0).cast("long").alias("at"),
                          F.coalesce(empty, F.array()).alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + p["skip"] + p["length"] + 1).alias("at"),
            F.when(p["mine"], F.concat(s["spans"], F.array(F.struct(
                (s["at"] + p["skip"]).alias("start"), (s["at"] + p["skip"] + p["length"]).alias("end")))))
            .otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    n_turns = F.size(F.filter("turns", lambda t: t["own"])).cast("long")
    out = parts.select("conv_id", "part", "perspective", n_turns.alias("n_turns"),
                       (F.size("turns") - n_turns).alias("n_context"), text.alias("text"), walked.alias("mask"))
    return out.withColumn("n_masked", F.aggregate(
        "mask", F.lit(0).cast("long"), lambda s, m: s + m["end"] - m["start"]))
