"""Chat formatting: cumulative snapshots of a conversation collapse to the longest one, which is rendered.

Logs often hold a conversation again after each turn. Every turn gets the hash of all turns up to it
(an exclusive-or of hashes of position, role and text, kept as a running window aggregate, twice with
different salts). A conversation whose last hash is the hash of a shorter prefix of another one goes
(anti-join); of equal ones the smallest conv_id stays. DataFrame functions only: no Python runs on
the executors, and no conversation is held in memory before it is rendered.

Defined cases: a null role is ``unknown`` and a null text is empty, both for equality and in the result;
turns are ordered by (turn, role, text), nulls first; a row that repeats (turn, role, text) within its
conversation counts once; rows with a null conv_id form one conversation of that id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def rolled_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text, the prefix hashes a and b, and whether the turn is the last."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    again = F.lag("text").over(order).isNotNull() & F.lag("turn").over(order).eqNullSafe(F.col("turn")) & (F.lag("role").over(order) == F.col("role")) & (F.lag("text").over(order) == F.col("text"))
    once = turns.withColumn("again", again).where("not again").drop("again").withColumn("pos", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return once.select(
        "conv_id",
        "pos",
        "role",
        "text",
        F.bit_xor(F.xxhash64("pos", "role", "text")).over(so_far).alias("a"),
        F.bit_xor(F.xxhash64(F.lit("second"), "text", "pos", "role")).over(so_far).alias("b"),
        F.lead("pos").over(order).isNull().alias("last"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that are no proper prefix of another one."""
    ends = turns.where("last").groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.max("pos").alias("n_turns"), F.count("*").alias("n_copies"))
    prefixes = turns.where("not last").select("a", "b").distinct()
    return ends.join(prefixes, ["a", "b"], "left_anti").select("conv_id", "n_turns", "n_copies")


def render(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row for each chosen conversation: conv_id, n_turns, n_copies and the rendered text."""
    same = turns["conv_id"].eqNullSafe(chosen["conv_id"])
    piece = F.concat(F.lit(OPEN), "role", F.lit(MIDDLE), "text", F.lit(CLOSE))
    kept = turns.join(chosen, same).select(chosen["conv_id"], "n_turns", "n_copies", F.struct("pos", piece.alias("piece")).alias("p"))
    whole = kept.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return whole.select("conv_id", "n_turns", "n_copies", F.array_join(F.col("p.piece"), "").alias("rendered"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Rendered maximal conversations of a table (conv_id, turn, role, text)."""
    turns = materialize(rolled_turns(conversations), "turns")
    return render(turns, maximal_conversations(turns))


ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT conv_id, turn, role, text, row_number() OVER w AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) = 1 AS last,
        string_agg(md5(role || chr(31) || text), '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS pre
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT md5(pre) AS h, min(conv_id) AS conv_id, max(pos) AS n_turns, count(*) AS n_copies FROM p WHERE last GROUP BY md5(pre)),
m AS (SELECT conv_id, n_turns, n_copies FROM e WHERE h NOT IN (SELECT md5(pre) FROM p WHERE NOT last))
SELECT m.conv_id, m.n_turns::INTEGER AS n_turns, m.n_copies, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM m JOIN p ON p.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY ALL
"""
