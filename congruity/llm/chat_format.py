"""Chat formatting into budgeted, turn-aligned windows with a loss mask.

Running sums of turn tokens deal the turns of a conversation out to windows: a
turn belongs to the window in which its last token falls, so no turn is cut.
Windows after the first repeat the system turn and the last turns before them;
repeated turns carry no loss. All steps are DataFrame operations. Running sums
are taken in two levels, within ranges of rows and over one row a range, so that
a conversation of any length is spread over tasks.

A turn is written ``<s>[INST]role[/INST]text</s>``. In roles and texts a backslash
is doubled, and one is put behind the first character of what would read as
markup; dropping one backslash of each restores them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

#: The template's control strings.
OPEN, ROLE_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: Tokens of a window, of repeated history in it, and of a turn's markup.
BUDGET, HISTORY, MARKUP = 1024, 256, 4


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"(<(?=/?s>)|\[(?=/?INST\]))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(\\)|([<\[])\\", "$1$2")


def estimated_tokens(text: Column) -> Column:
    """An estimate of a text's tokens: four bytes to a token."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def format_chats(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, count: Callable[[Column], Column] = estimated_tokens) -> DataFrame:
    """One row per window: conv_id, window_id, formatted, turns (array of struct
    position, start, length, repeated, loss; start and length in code points of
    ``formatted`` and of the turn's escaped text).

    Rows of a conversation go by turn, nulls first; ties by role, then by a hash
    of the text. Null roles and texts are empty; repeated rows are turns of their
    own; rows of a null conv_id are one conversation. Half the budget is the
    stride, so a window stays within the budget where no turn of it exceeds half
    of the budget less history and system turn; a longer turn is kept whole.
    Extra columns are ignored; an empty table gives an empty result.
    """
    stride = budget // 2
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "tokens": count(F.col("text")) + MARKUP})
    order = ["conv_id", "turn", "role", "tie"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The written table fixes which rows a range holds; the ids ascend within it.
    dealt = staged(dealt.withColumns({"at": F.monotonically_increasing_id(), "range": F.spark_partition_id()}))

    within = Window.partitionBy("conv_id", "range").orderBy("at")
    rows = dealt.withColumns({"upto": F.sum("tokens").over(within), "nth": F.row_number().over(within).cast("long")})
    sums = dealt.groupBy("conv_id", "range").agg(F.sum("tokens").alias("all_tokens"), F.count(F.lit(1)).alias("all_turns"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv_id").alias("c"),
        F.col("range").alias("r"),
        F.coalesce(F.sum("all_tokens").over(before), F.lit(0)).alias("before"),
        F.coalesce(F.sum("all_turns").over(before), F.lit(0)).alias("turns_before"),
    )
    rows = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r"))).withColumns(
        {"end": F.col("before") + F.col("upto"), "position": F.col("turns_before") + F.col("nth") - 1}
    )
    rows = rows.withColumn("window_id", F.floor((F.col("end") - 1) / stride)).select("conv_id", "window_id", "position", "role", "text", "tokens", "end")

    system = rows.filter("role = 'system'").groupBy("conv_id").agg(F.min_by(F.struct("position", "text", "window_id"), "position").alias("s"))
    own = rows.select("conv_id", "window_id", "position", "role", "text", F.lit(False).alias("repeated"))
    # A turn whose start lies in the last tokens of its window is the history of the next.
    close = (F.col("window_id") + 1) * stride - (F.col("end") - F.col("tokens")) <= history
    again = rows.filter(close).select("conv_id", (F.col("window_id") + 1).alias("window_id"), "position", "role", "text", F.lit(True).alias("repeated"))

    written = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ROLE_END), escape(F.col("text")), F.lit(CLOSE))
    one = F.struct("position", "repeated", "role", written.alias("written"), F.length(escape(F.col("text"))).alias("length"))
    windows = (
        own.unionByName(again)
        .groupBy("conv_id", "window_id")
        .agg(F.array_sort(F.collect_list(one)).alias("parts"), F.min(F.when(~F.col("repeated"), F.col("position"))).alias("first_own"))
        .filter("first_own IS NOT NULL")
    )
    system = system.select(
        F.col("conv_id").alias("c"),
        F.col("s.position").alias("system_at"),
        F.struct(
            F.col("s.position").alias("position"),
            F.lit(True).alias("repeated"),
            F.lit("system").alias("role"),
            F.concat(F.lit(OPEN + "system" + ROLE_END), escape(F.col("s.text")), F.lit(CLOSE)).alias("written"),
            F.length(escape(F.col("s.text"))).alias("length"),
        ).alias("system"),
    )
    joined = windows.join(system, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    lacks = F.col("system").isNotNull() & (F.col("system_at") < F.col("first_own")) & ~F.exists("parts", lambda p: p["position"] == F.col("system_at"))
    parts = F.when(lacks, F.concat(F.array("system"), F.col("parts"))).otherwise(F.col("parts"))
    joined = joined.select("conv_id", "window_id", parts.alias("parts"))
    # Where each turn's text starts: a running sum over the parts of one window.
    ends = F.aggregate("parts", F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p["written"]))))
    joined = joined.withColumn("ends", ends)
    spans = F.transform(
        "parts",
        lambda p, i: F.struct(
            p["position"].alias("position"),
            (F.get("ends", i + 1) - F.lit(len(CLOSE)) - p["length"]).alias("start"),
            p["length"].alias("length"),
            p["repeated"].alias("repeated"),
            (~p["repeated"] & (p["role"] == "assistant")).alias("loss"),
        ),
    )
    return joined.select("conv_id", "window_id", F.array_join(F.transform("parts", lambda p: p["written"]), "").alias("formatted"), spans.alias("turns"))


def read_turns(windows: DataFrame) -> DataFrame:
    """conv_id, window_id, and as arrays what the formatted text itself says of its
    turns: role, text, with repeated and loss from the mask."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    cut = F.transform(
        F.arrays_zip(pieces.alias("piece"), F.col("turns").alias("mask")),
        lambda z: F.struct(
            unescape(F.substring_index(F.substr(z["piece"], F.lit(len(OPEN) + 1)), ROLE_END, 1)).alias("role"),
            unescape(F.substr(F.substr(z["piece"], F.lit(len(OPEN) + 1)), F.locate(ROLE_END, F.substr(z["piece"], F.lit(len(OPEN) + 1))) + F.lit(len(ROLE_END)))).alias("text"),
            z["mask"]["repeated"].alias("repeated"),
            z["mask"]["loss"].alias("loss"),
        ),
    )
    return windows.select("conv_id", "window_id", cut.alias("turns"), F.length("formatted").cast("long").alias("n_chars"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Per conversation of written windows: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    The digests need a conversation's text in one place; what is grouped is one
    row a window, with its turns already joined.
    """
    rows = read_turns(spark.read.parquet(path))
    new = F.filter("turns", lambda t: ~t["repeated"])
    rows = rows.select(
        "conv_id",
        "n_chars",
        F.size(new).alias("n"),
        F.struct(
            "window_id",
            F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("told"),
            F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "").alias("loss"),
        ).alias("w"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("w"))
    told, loss = F.array_join("w.told", ""), F.array_join("w.loss", "")
    return grouped.select("conv_id", "n_turns", F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
