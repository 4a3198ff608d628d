"""Format reply trees as conversations with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._registry import keep, query, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Control strings of common chat templates; a backslash after the first character breaks them.
CONTROL = (r"(<)(\||/?s>|</?SYS>>)", r"(\[)(/?INST\])")


def escape(text: Column) -> Column:
    """Break control strings inside a text; :func:`unescape` gives the text back."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for pattern in CONTROL:
        out = F.regexp_replace(out, pattern, r"$1\\$2")
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _key(col: Column) -> Column:
    """A join key that takes null for a value."""
    return F.when(col.isNull(), "n").otherwise(F.concat(F.lit("v"), col.cast("string")))


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Root-to-leaf paths of the reply trees, the best ``branches`` of each conversation.

    ``messages``: ``conv_id, node, parent, role, text, score``. Self-joins
    double the reach of every node's pointer towards the root (1, 2, 4, ...
    replies up), adding depth and score on the way, so a chain of n replies
    takes log2(n) joins and a node never carries its whole path. Leaves are
    ranked by the sum of scores on their path (higher first, null as 0), then
    by node; the nodes on a chosen path are found by going through the same
    pointers again.

    A parent that is null or missing makes a root. A null conversation is one
    conversation; rows without a node are left out; rows that repeat a node
    count once, the first by parent, role and text. Messages whose parents run
    in a circle have no root and are left out.

    Returns ``conv_id, leaf, branch, place, role, text``, place from 0.
    """
    rows = messages.filter("node is not null").select(
        "conv_id", _key(F.col("conv_id")).alias("conv"), "node", "parent", "role", "text",
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    first = Window.partitionBy("conv", "node").orderBy("parent", "role", "text")
    rows = keep(rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n"), "chat-rows")
    nodes = rows.select("conv", "node", "parent", "score")
    ids = nodes.select(F.col("conv").alias("c"), F.col("node").alias("up"))
    reach = keep(
        nodes.join(ids, (F.col("conv") == F.col("c")) & (F.col("parent") == F.col("up")), "left").select(
            "conv", "node", "up", F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")
        ), "chat-reach",
    )
    rooted, active = reach.filter("up is null"), reach.filter("up is not null")
    parents = active.select("conv", F.col("up").alias("node")).distinct()
    levels, left = [], active.count()
    while left:
        levels.append(active)
        # Nodes that have met their root are only looked up, so a few long chains cost little.
        far = rooted.unionByName(active).select(
            F.col("conv").alias("c"), F.col("node").alias("n"), F.col("up").alias("further"),
            F.col("depth").alias("d"), F.col("total").alias("t"),
        )
        reach = keep(
            active.join(far, (F.col("conv") == F.col("c")) & (F.col("up") == F.col("n"))).select(
                "conv", "node", F.col("further").alias("up"), (F.col("depth") + F.col("d")).alias("depth"),
                (F.col("total") + F.col("t")).alias("total"),
            ), "chat-reach",
        )
        rooted, active = rooted.unionByName(reach.filter("up is null")), reach.filter("up is not null")
        before, left = left, active.count()
        if left == before:
            break  # circles only
    rooted = keep(rooted.select("conv", "node", "depth", "total"), "chat-rooted")
    best = Window.partitionBy("conv").orderBy(F.desc("total"), "node")
    chosen = (
        rooted.join(parents, ["conv", "node"], "left_anti")
        .withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= branches)
        .select("conv", F.col("node").alias("leaf"), "branch", "node")
    )
    for level in levels:
        chosen = keep(chosen, "chat-path")
        hop = level.select("conv", "node", "up")
        chosen = chosen.unionByName(
            chosen.join(hop, ["conv", "node"]).select("conv", "leaf", "branch", F.col("up").alias("node"))
        )
    placed = chosen.join(rooted.select("conv", "node", "depth"), ["conv", "node"])
    return placed.join(rows.select("conv", "node", "conv_id", "role", "text"), ["conv", "node"]).select(
        "conv_id", "conv", "leaf", "branch", (F.col("depth") - 1).alias("place"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )


def format_paths(paths: DataFrame, trained: str = "assistant") -> DataFrame:
    """One formatted conversation per path: ``conv_id, leaf, branch, formatted, loss_mask``.

    The loss mask lists the texts of the ``trained`` role: turn, start inside
    the turn, start inside the conversation, length, all in code points. A
    conversation is one value, so its turns meet in one task.
    """
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    turns = paths.withColumn("body", escape(F.col("text"))).withColumn("head", head).withColumn(
        "piece", F.concat("head", "body", F.lit(END))
    )
    before = Window.partitionBy("conv", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    span = F.when(
        F.col("role") == trained,
        F.struct(
            F.col("place").alias("turn"), F.length("head").cast("long").alias("turn_start"),
            (F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"),
        ),
    )
    grouped = turns.groupBy("conv", "leaf", "branch").agg(
        F.first("conv_id").alias("conv_id"),
        F.array_sort(F.collect_list(F.struct("place", "piece", span.alias("span")))).alias("t"),
    )
    return grouped.select(
        "conv_id", "leaf", "branch", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and trained text, read from the formatted text and its mask: adds ``turns`` and ``loss_text``."""
    pieces = F.split("formatted", r"<\|end\|>\n")
    body = F.slice(pieces, 1, F.size(pieces) - 1)
    turns = F.transform(
        "pieces",
        lambda p: F.struct(
            unescape(F.substring(F.split(p, r"<\|text\|>")[0], len(TURN) + 1, 2**31 - 1)).alias("role"),
            unescape(F.split(p, r"<\|text\|>")[1]).alias("text"),
        ),
    )
    spans = F.transform(
        "loss_mask",
        lambda s: unescape(F.substr(F.get("pieces", s["turn"].cast("int")), s["turn_start"] + 1, s["length"])),
    )
    return formatted.withColumn("pieces", body).withColumn("turns", turns).withColumn(
        "loss_text", F.array_join(spans, "")
    ).drop("pieces")


def linear_replies(conversations: DataFrame) -> DataFrame:
    """Conversations in turn order as reply trees: every turn answers the one before.

    Rows with one turn number follow each other by role and text; a null turn
    comes first.
    """
    conv = _key(F.col("conv_id"))
    order = Window.partitionBy(conv).orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(
        "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
        F.lit(0.0).alias("score"),
    )


def _sql_escape(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for pattern in CONTROL:
        out = f"regexp_replace({out}, '{pattern}', '\\1\\\\\\2', 'g')"
    return out


ORACLE = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum({len(TURN) + len(TEXT) + len(END)} + length({_sql_escape("role")}) + length({_sql_escape("text")})) AS formatted_chars
  FROM m GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""


@query("op5_chat", ORACLE)
def op5_chat(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = read_back(format_paths(reply_paths(linear_replies(rows))))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
