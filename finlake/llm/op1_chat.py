"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written ``### <role>: <text></turn>\\n``; inside roles and texts
``\\``, ``<``, ``###`` and (roles only) ``:`` are escaped as ``\\s``, ``\\l``,
``\\h`` and ``\\c``, so no text can end a turn or begin one, and replacing back in
the order l, h, c, s restores it.

A turn costs a quarter of its escaped bytes, rounded up, and TURN_TOKENS, or a
quarter of the bytes of its head and end where a long role makes them more. A
prefix sum of costs puts each turn into the window that its start falls in,
windows being STRIDE tokens apart; so a window holds whole turns, of less than
STRIDE tokens before its last turn. Later windows repeat the conversation's
leading system turn and the turns that began at most HISTORY tokens before the
window's first (HISTORY < STRIDE, so only from the window before). The loss
mask covers the text of assistant turns in the window they belong to; repeated
ones are masked out, so each target counts once.

BUDGET holds all. A window that would cost more is cut: its turns go on into the
same window while they cost at most BUDGET less the system turn and HISTORY, and
each cut repeats the system turn and as much of the history as fits. A turn that
does not fit beside the system turn stands in a window of its own, without
system turn and history. A turn (or system turn, which is then not repeated)
above BUDGET by itself is such a window too, kept whole and marked ``over``; no
other window costs more than BUDGET. ``window`` is the start of the window's
first own turn.

Turns are ordered by turn (null first), then role and text. Null texts and
roles are empty. Prefix sums go by blocks of turns and then over the blocks, so
a conversation with a third of all rows is not one task's, unless its rows share
one turn (or have none): rows of one turn stay in one block, which Spark sorts with
spilling. A digest of a whole conversation needs it in one row. Rows without a conv_id are left out;
repeated rows are turns of their own. Extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tokens: window stride, most repeated history, and a turn's own marks.
STRIDE, HISTORY, TURN_TOKENS = 1024, 384, 6
BUDGET = 2048
#: Values of ``turn`` that share a block of the prefix sum.
BLOCK_TURNS = 256

ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("###", "\\h"))
TAIL = "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    for plain, safe in ESCAPES + (((":", "\\c"),) if role else ()):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES + ((":", "\\c"),)):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, window, formatted, repeated (turns that lead the window and belong to another), loss: (start, length) in code points, tokens, over (tokens above BUDGET)."""
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62))).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    head = F.concat(F.lit("### "), escape(F.col("role"), role=True), F.lit(": "))
    rows = rows.withColumns({"head": head, "body": escape(F.col("text"))})
    marks = F.greatest(F.lit(TURN_TOKENS), F.ceil((F.octet_length("head") + len(TAIL)) / 4))
    rows = rows.withColumns({"cost": F.ceil(F.octet_length("body") / 4) + marks, "block": F.floor(F.col("turn") / BLOCK_TURNS)})
    # Prefix sums: within blocks of turns, then over the blocks.
    before = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("cost").over(before), F.lit(0)))
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("cost").alias("cost"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("cost").over(earlier), F.lit(0)).alias("base"))
    rows = rows.join(blocks, ["conv_id", "block"]).select("conv_id", "role", "head", "body", "cost", (F.col("base") + F.col("own")).alias("start"))
    # Every turn costs something, so only the first starts at 0.
    rows = rows.withColumns({"window": F.floor(F.col("start") / STRIDE), "leads": (F.col("start") == 0) & (F.col("role") == "system")})
    # Where the next window begins, if there is one right after.
    windows = rows.groupBy("conv_id", "window").agg(F.min("start").alias("begins"))
    nexts = windows.select("conv_id", (F.col("window") - 1).alias("window"), F.col("begins").alias("next_begins"))
    rows = rows.join(nexts, ["conv_id", "window"], "left")
    again = (F.col("next_begins") - F.col("start") <= HISTORY) & ~F.col("leads")
    turn = ("conv_id", "role", "head", "body", "cost", "start", "leads")
    parts = rows.select(
        *turn,
        F.explode(F.when(again, F.array(F.struct("window", F.lit(False).alias("repeated")), F.struct((F.col("window") + 1).alias("window"), F.lit(True).alias("repeated")))).otherwise(F.array(F.struct("window", F.lit(False).alias("repeated"))))).alias("w"),
    ).select(*turn, "w.*")
    systems = rows.where(F.col("leads") & (F.col("cost") <= BUDGET)).select(*turn).join(windows.where("window > 0").select("conv_id", "window"), "conv_id")
    parts = parts.unionByName(systems.withColumn("repeated", F.lit(True)))
    piece = F.struct(
        "start", "cost", "leads", "repeated", (F.col("role") == "assistant").alias("target"), F.length("head").alias("head"), F.length("body").alias("body"),
        F.concat("head", "body", F.lit(TAIL)).alias("text"),
    )
    cells = parts.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(piece)).alias("turns"), F.sum("cost").alias("all"), F.sum(F.when(F.col("leads"), F.col("cost")).otherwise(0)).alias("lead"))
    # Starts of windows: the first own turn's, and where a window is cut.
    own = F.filter("turns", lambda x: ~x["repeated"])
    cells = cells.select("conv_id", "turns", "lead", F.when(F.col("all") <= BUDGET, F.slice(F.transform(own, lambda x: x["start"]), 1, 1)).otherwise(_cuts(own, F.col("lead"))).alias("cuts"))
    cells = cells.select("conv_id", "turns", "lead", "cuts", F.posexplode("cuts").alias("n", "window"))
    cells = cells.select("conv_id", "window", "turns", F.when(F.col("window") == 0, 0).otherwise(F.col("lead")).alias("lead"), F.coalesce(F.get("cuts", F.col("n") + 1), F.lit(2**62)).alias("ends"))
    inside = lambda x: (x["start"] >= F.col("window")) & (x["start"] < F.col("ends"))
    cells = cells.withColumn("left", BUDGET - F.col("lead") - _total(F.filter("turns", inside)))
    history = lambda x: (x["start"] < F.col("window")) & (F.col("window") - x["start"] <= F.least(F.lit(HISTORY), F.col("left")))
    cells = cells.select("conv_id", "window", F.filter("turns", lambda x: inside(x) | ((F.col("left") >= 0) & (x["leads"] | history(x)))).alias("turns"))
    return cells.select(
        "conv_id", "window",
        F.array_join(F.transform("turns", lambda x: x["text"]), "").alias("formatted"),
        F.size(F.filter("turns", lambda x: x["start"] < F.col("window"))).cast("long").alias("repeated"),
        _loss(F.col("turns"), F.col("window")).alias("loss"), _total(F.col("turns")).alias("tokens"), (_total(F.col("turns")) > BUDGET).alias("over"),
    )


def _total(turns: Column) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda n, x: n + x["cost"])


def _cuts(own: Column, lead: Column) -> Column:
    """Starts of the windows that ``own`` turns are cut into; at most STRIDE / TURN_TOKENS and one turns come here."""

    def step(a: Column, x: Column) -> Column:
        # Only the leading turn leaves nothing spent in an open window.
        fits = F.when(a["spent"] > 0, a["spent"] + x["cost"] <= BUDGET - HISTORY - lead).otherwise(lead + x["cost"] <= BUDGET) & (F.size(a["cuts"]) > 0)
        cost = F.when(x["leads"], 0).otherwise(x["cost"])
        return F.struct(F.when(fits, a["spent"] + cost).otherwise(cost).alias("spent"), F.when(fits, a["cuts"]).otherwise(F.concat(a["cuts"], F.array(x["start"]))).alias("cuts"))

    return F.aggregate(own, F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<bigint>").alias("cuts")), step, lambda a: a["cuts"])


def _loss(turns: Column, window: Column) -> Column:
    def step(a: Column, x: Column) -> Column:
        mask = F.struct((a["at"] + x["head"]).alias("start"), x["body"].alias("length"))
        return F.struct((a["at"] + F.length(x["text"])).alias("at"), F.when(x["target"] & (x["start"] >= window), F.concat(a["loss"], F.array(mask))).otherwise(a["loss"]).alias("loss"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:int>>").alias("loss"))
    return F.aggregate(turns, zero, step, lambda a: a["loss"])


def read_back(formatted: DataFrame) -> DataFrame:
    """The windows with ``turns`` (role, text) that belong to them, and ``targets``: the texts under the loss mask."""
    marked = F.filter(F.split("formatted", TAIL), lambda x: x != "")
    own = F.slice(marked, F.col("repeated") + 1, F.greatest(F.size(marked) - F.col("repeated"), F.lit(0)))
    return formatted.select(
        "conv_id", "window", "formatted",
        F.transform(own, lambda x: F.struct(unescape(F.substring_index(F.substr(x, F.lit(5)), ": ", 1)).alias("role"), unescape(F.substr(x, F.instr(x, ": ") + 2)).alias("text"))).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"]))).alias("targets"),
    )


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7: texts that look like marks of the template."""
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text")
    )


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(planted(spark))
    windows = read_back(format_chats(turns))
    whole = windows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum(F.length("formatted")).alias("formatted_chars"))
    all_turns = F.flatten(F.transform("w", lambda x: x["turns"]))
    digest = F.array_join(F.transform(all_turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.flatten(F.transform("w", lambda x: x["targets"])), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return whole.select("conv_id", F.size(all_turns).cast("long").alias("n_turns"), sha(digest).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"), "formatted_chars")


QUERIES = {"op1_chat": op1_chat}


def _sql_escape(x: str, role: bool = False) -> str:
    for plain, safe in ESCAPES + (((":", "\\c"),) if role else ()):
        x = f"replace({x}, '{plain}', '{safe}')"
    return x


ORACLE = {
    "op1_chat": rf"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)
), t AS (
  SELECT conv_id, coalesce(turn, -4611686018427387904) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c WHERE conv_id IS NOT NULL
), e AS (
  SELECT *, length('### ' || {_sql_escape("role", True)} || ': ') + length({_sql_escape("text")}) + length('</turn>' || chr(10)) AS chars,
    (strlen({_sql_escape("text")}) + 3) // 4 + {TURN_TOKENS} AS cost FROM t
), p AS (
  SELECT *, row_number() OVER w AS place, sum(cost) OVER w - cost AS start FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
), k AS (SELECT *, start // {STRIDE} AS win FROM p
), b AS (SELECT conv_id, win, min(start) AS begins FROM k GROUP BY ALL
), h AS (
  SELECT k.conv_id, sum(k.chars) AS chars FROM k JOIN b ON b.conv_id = k.conv_id AND b.win = k.win + 1
  WHERE b.begins - k.start <= {HISTORY} AND NOT (k.place = 1 AND k.role = 'system') GROUP BY ALL
), s AS (
  SELECT k.conv_id, sum(k.chars) AS chars FROM k JOIN b ON b.conv_id = k.conv_id AND b.win > 0 WHERE k.place = 1 AND k.role = 'system' GROUP BY ALL
), o AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars FROM k GROUP BY ALL
)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  (o.chars + coalesce(h.chars, 0) + coalesce(s.chars, 0))::BIGINT AS formatted_chars
FROM o LEFT JOIN h USING (conv_id) LEFT JOIN s USING (conv_id)
"""
}
