"""Chat formatting in budgeted windows, with DataFrame operations only.

Template: ``### role<:> text</turn>`` and a line end per turn. In roles and texts a backslash is put
behind every ``<``, ``#`` and backslash, so none of the control strings can occur in them, and taking
those backslashes out again restores them exactly.

Tokens of a turn are counted by the pre-token rule of byte-level tokenizers, in SQL expressions:
contractions, words, numbers, other characters and white space with the space before them, one token
for every six letters, three digits or four other characters begun, and four for the template.

Windows: prefix sums of turn tokens cut the turns after the system turn into spans of at most
``budget - system - history`` tokens, never inside a turn (a longer turn is a span of its own, and
its window is marked ``over_budget``). A window holds the system turn, as much of the turns before
its span as fits ``history`` tokens and ``history_turns`` turns, and its span. The loss mask covers
the texts of assistant turns in the span alone, so repeated targets are masked once and only once.

A conversation is one row of turns. Its prefix sums are folded in blocks of ``BLOCK`` turns, and each
window takes its own turns out of the row before windows become rows, so time and memory are in
proportion to the conversation's text; that is bounded by Spark's limit of 2 GB for a row.

Turns are ordered by (turn, role, text), null turns first; null roles and texts are empty; repeated
rows are turns of their own; a null conv_id is a conversation. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET, HISTORY, HISTORY_TURNS = 1024, 192, 2
OPEN, MIDDLE, CLOSE = "### ", "<:> ", "</turn>\n"
#: Turns that one step of the outer fold takes.
BLOCK = 256
#: What counts as a token: pre-tokens, cut where they are long.
PIECES = r"'(?:s|t|re|ve|m|ll|d)|\x20?\p{L}{1,6}|\x20?\p{N}{1,3}|\x20?[^\x20\x09-\x0D\p{L}\p{N}]{1,4}|[\x20\x09-\x0D]+"
FRAME = 4


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<#\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<#\\])\\", "$1")


def windows(convs: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """Rows (conv_id, window, formatted, loss, repeated, tokens, over_budget).

    ``loss`` holds spans (start, end) in code points of ``formatted``; ``repeated`` counts the turns
    at the window's start that an earlier window has shown already.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = convs.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text")).alias("t"))
    told = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def piece(t: Column) -> Column:
        role, text = escaped(t["role"]), escaped(t["text"])
        return F.struct(
            t["role"].alias("role"),
            F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE)).alias("said"),
            (F.length(role) + len(OPEN + MIDDLE)).alias("from"),
            (F.regexp_count(t["text"], F.lit(PIECES)) + FRAME).cast("long").alias("tokens"),
        )

    shown = told.select("conv_id", F.transform("turns", piece).alias("p"))
    system = F.when(F.col("p")[0]["role"] == "system", 1).otherwise(0)
    n = F.size("p")
    cap = F.greatest(F.lit(1), F.lit(budget - history) - F.when(system == 1, F.col("p")[0]["tokens"]).otherwise(0))
    cut = shown.select("conv_id", "p", system.alias("s"), n.alias("n"), cap.alias("cap"))

    # The running prefix sum opens a span wherever the sum since the last opening passes the cap. Blocks
    # of turns are folded one by one, so that the list of openings is copied per block and not per turn.
    long, none = F.lit(0).cast("long"), F.array().cast("array<int>")
    cut = cut.withColumn("tokens", F.transform("p", lambda t: t["tokens"]))

    def step(a: Column, i: Column) -> Column:
        total = a["sum"] + F.get("tokens", i)
        opens = (i == F.col("s")) | (total - a["base"] > F.col("cap"))
        return F.struct(
            total.alias("sum"),
            F.when(opens, a["sum"]).otherwise(a["base"]).alias("base"),
            F.when(opens, F.concat(a["starts"], F.array(i))).otherwise(a["starts"]).alias("starts"),
        )

    def block(a: Column, first: Column) -> Column:
        turns = F.sequence(first, F.least(F.col("n") - 1, first + (BLOCK - 1)))
        begin = F.struct(a["sum"].alias("sum"), a["base"].alias("base"), none.alias("starts"))
        return F.aggregate(turns, begin, step, lambda x: F.struct(x["sum"].alias("sum"), x["base"].alias("base"), F.concat(a["starts"], x["starts"]).alias("starts")))

    firsts = F.when(F.col("n") > F.col("s"), F.sequence(F.col("s"), F.col("n") - 1, F.lit(BLOCK))).otherwise(none)
    found = F.aggregate(firsts, F.struct(long.alias("sum"), long.alias("base"), none.alias("starts")), block, lambda a: a["starts"])
    spans = cut.select("conv_id", "p", "s", "n", "tokens", F.when(F.size(found) == 0, F.array("s")).otherwise(found).alias("starts"))

    def window(a: Column, k: Column) -> Column:
        """The turns of the span that begins at ``a``, with the system turn and history before them."""
        sizes = [F.coalesce(F.get("tokens", a - j), long) for j in range(1, history_turns + 1)]
        back = F.lit(0)
        for j in range(history_turns, 0, -1):  # the most turns of the history that fit
            fits = (a - j >= F.col("s")) & (sum(sizes[1:j], sizes[0]) <= history)
            back = F.when(fits, F.greatest(back, F.lit(j))).otherwise(back)
        h = F.when(k == 0, 0).otherwise(back)
        end = F.coalesce(F.get("starts", k + 1), F.col("n"))
        return F.struct(
            k.alias("window"),
            F.when(k == 0, 0).otherwise(F.col("s") + h).alias("repeated"),
            F.concat(F.slice("p", F.lit(1), F.col("s")), F.slice("p", a - h + 1, end - a + h)).alias("held"),
        )

    made = spans.select("conv_id", F.explode(F.transform("starts", window)).alias("w"))
    chosen = made.select("conv_id", "w.window", "w.repeated", "w.held")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def mark(a: Column, t: Column) -> Column:
        size = F.length(t["said"])
        span = F.struct((a["at"] + t["from"]).alias("start"), (a["at"] + size - len(CLOSE)).alias("end"))
        target = (a["i"] >= F.col("repeated")) & (t["role"] == "assistant")
        return F.struct((a["at"] + size).alias("at"), (a["i"] + 1).alias("i"), F.when(target, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    tokens = F.aggregate("held", F.lit(0).cast("long"), lambda x, t: x + t["tokens"])
    return chosen.select(
        "conv_id",
        "window",
        F.array_join(F.transform("held", lambda t: t["said"]), "").alias("formatted"),
        F.aggregate("held", zero, mark, lambda a: a["spans"]).alias("loss"),
        "repeated",
        tokens.alias("tokens"),
        (tokens > budget).alias("over_budget"),
    )


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: turns, their digest, and the text under the mask."""
    pieces = F.split("formatted", CLOSE)  # the last piece is what follows the last turn: nothing
    fresh = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - 1 - F.col("repeated"))

    def turn(p: Column) -> Column:
        at = F.instr(p, MIDDLE)
        role = F.substring(p, F.lit(len(OPEN) + 1), at - 1 - len(OPEN))
        return F.concat(unescaped(role), F.lit("\n"), unescaped(F.substring(p, at + len(MIDDLE), F.length(p))), F.lit("\n"))

    loss = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    part = made.select(
        "conv_id",
        F.struct("window", F.size(fresh).alias("turns"), F.array_join(F.transform(fresh, turn), "").alias("told"), F.array_join(loss, "").alias("loss"), F.length("formatted").alias("size")).alias("w"),
    )
    whole = part.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    text = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    total = lambda c: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[c])
    return whole.select(
        "conv_id",
        total("turns").alias("n_turns"),
        F.sha2(text("told"), 256).alias("turns_sha256"),
        F.length(text("loss")).cast("long").alias("loss_chars"),
        F.sha2(text("loss"), 256).alias("loss_sha256"),
        total("size").alias("formatted_chars"),
        F.size("w").cast("long").alias("n_windows"),
    )


#: DuckDB SQL for the query's rows: digests of the source rows, and the windows by a recursive prefix sum.
ORACLE_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, role, text FROM {conversations}
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM c
), u AS (
  SELECT conv_id, role, text, i, CAST(len(regexp_extract_all(text, '{pieces}')) AS BIGINT) + 4 AS tok,
    16 + length(role) + length(text) + length(regexp_replace(role || text, '[^<#\\]', '', 'g')) AS size FROM t
), v AS (
  SELECT u.*, CASE WHEN h.role = 'system' THEN 1 ELSE 0 END AS s, greatest(1, 832 - CASE WHEN h.role = 'system' THEN h.tok ELSE 0 END) AS cap,
    CASE WHEN h.role = 'system' THEN h.size ELSE 0 END AS system_size FROM u JOIN (SELECT conv_id, role, tok, size FROM u WHERE i = 0) h ON u.conv_id = h.conv_id
), r AS (
  SELECT conv_id, i, tok AS total, CAST(0 AS BIGINT) AS base, 0 AS win FROM v WHERE i = s
  UNION ALL
  SELECT v.conv_id, v.i, r.total + v.tok, CASE WHEN r.total + v.tok - r.base > v.cap THEN r.total ELSE r.base END, r.win + CASE WHEN r.total + v.tok - r.base > v.cap THEN 1 ELSE 0 END
  FROM r JOIN v ON v.conv_id = r.conv_id AND v.i = r.i + 1
), w AS (
  SELECT conv_id, win, min(i) AS a FROM r GROUP BY conv_id, win
), again AS (
  SELECT w.conv_id, x.system_size + CASE WHEN x.tok <= 192 AND x.i >= x.s THEN x.size + CASE WHEN y.i >= y.s AND x.tok + y.tok <= 192 THEN y.size ELSE 0 END ELSE 0 END AS size
  FROM w JOIN v x ON x.conv_id = w.conv_id AND x.i = w.a - 1 LEFT JOIN v y ON y.conv_id = w.conv_id AND y.i = w.a - 2 WHERE w.win > 0
), repeats AS (
  SELECT conv_id, sum(size) AS size, count(*) AS n FROM again GROUP BY conv_id
), told AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss, sum(size) AS size FROM v GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(told.size + coalesce(repeats.size, 0) AS BIGINT) AS formatted_chars, 1 + coalesce(repeats.n, 0) AS n_windows
FROM told LEFT JOIN repeats USING (conv_id)
""".replace("{pieces}", PIECES.replace("'", "''"))
