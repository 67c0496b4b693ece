"""Chat formatting: cumulative-snapshot collapse, then rendering; DataFrame functions only.

A log often keeps a conversation again after each turn. The hash of a conversation's prefix up to a turn is the sum of
its turns' hashes, each taken over place, role and text under two seeds, so prefixes roll forward by addition. A
conversation whose whole hash is a proper prefix of another's is dropped by an anti-join, and of equal ones the least id
stays. A turn's hash depends on its place, so that sums over different orders differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Turns are summed in blocks of so many places first, so that a conversation of any length is dealt to many tasks.
BLOCK_TURNS = 256
#: Digits of a sum of signed 64-bit hashes.
_SUM = "decimal(38,0)"


def _turns(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One row per conversation and turn: rows, and two sums of row hashes. Null roles and texts are distinct from empty ones."""
    of = [F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)), F.col(role_col).isNull(), F.col(role_col), F.col(text_col).isNull(), F.col(text_col)]
    hashes = [F.sum(F.xxhash64(F.lit(seed), *of).cast(_SUM)).cast(_SUM).alias(name) for name, seed in (("h1", 11), ("h2", 29))]
    return df.groupBy(F.col(id_col).alias("c"), of[0].alias("t")).agg(F.count("*").alias("n"), *hashes)


def collapse(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conversation ids that stay: those that are no proper prefix of another, and of equal ones the least id.

    A conversation is its rows by turn; rows of one turn are a multiset, rows with a null turn come before the first,
    rows with a null id are one conversation that is never dropped nor drops another. Empty tables give an empty one.
    """
    turns = keep(_turns(df.filter(F.col(id_col).isNotNull()), id_col, turn_col, role_col, text_col).withColumn("k", F.floor(F.col("t") / BLOCK_TURNS)), "turns")
    blocks = turns.groupBy("c", "k").agg(F.sum("n").alias("n"), F.sum("h1").cast(_SUM).alias("h1"), F.sum("h2").cast(_SUM).alias("h2"))
    before = Window.partitionBy("c").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast(_SUM)
    offsets = blocks.select("c", "k", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), *(F.coalesce(F.sum(h).over(before).cast(_SUM), none).alias(f"{h}_0") for h in ("h1", "h2")))
    inside = Window.partitionBy("c", "k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rolled = turns.select("c", "k", "t", F.sum("n").over(inside).alias("n"), *(F.sum(h).over(inside).cast(_SUM).alias(h) for h in ("h1", "h2")))
    prefixes = rolled.join(offsets, ["c", "k"]).select("c", (F.col("n") + F.col("n0")).alias("n"), *((F.col(h) + F.col(f"{h}_0")).cast(_SUM).alias(h) for h in ("h1", "h2")))
    whole = turns.groupBy("c").agg(F.sum("n").alias("n"), F.sum("h1").cast(_SUM).alias("h1"), F.sum("h2").cast(_SUM).alias("h2"))
    kept = whole.groupBy("n", "h1", "h2").agg(F.min("c").alias("c"))
    # Every prefix hash with the most rows of a conversation that has it; a longer one than itself makes it proper.
    longest = prefixes.join(whole.select("c", F.col("n").alias("all")), "c").filter("n < all").select("n", "h1", "h2").distinct()
    return kept.join(longest, ["n", "h1", "h2"], "left_anti").select(F.col("c").alias(id_col))


def render(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, turn, role, rendered: `<|role|>`, a line feed, the text and `<|end|>`; the turn's place stays in `turn`.

    One row per turn: a conversation's whole text is its rows in order, and may be longer than any one row should be.
    Marks inside a text lose their first bar, so that it can't forge a turn. Null texts are empty, null roles `user`.
    """
    role = F.coalesce(F.trim(F.lower(F.col(role_col))), F.lit("user"))
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"<\|(\w+)\|>", "<$1|>")
    return df.select(id_col, turn_col, role.alias("role"), F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>")).alias("rendered"))


def format_chats(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Collapse, then render what stays."""
    ids = collapse(df, id_col, turn_col, role_col, text_col)
    some = df.select(id_col, turn_col, role_col, text_col)
    return render(some.join(ids, id_col, "left_semi").union(some.filter(F.col(id_col).isNull())), id_col, turn_col, role_col, text_col)
