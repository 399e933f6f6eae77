"""Chat formatting of reply trees.

A tree's messages name their parents. Root-to-leaf paths are enumerated by iterative self-joins with pointer doubling: round k
joins each message's 2**k-th ancestor with that ancestor's own, and each path found so far with the ancestors of its messages,
so a path of n messages takes log2(n) rounds. Branches are ranked by the sum of their messages' scores, and each chosen path is
written as one conversation.

Messages that answer each other in a circle have no root: the smallest of each circle is taken for one. Circles are found by the
doubling itself, as ancestors that are still there after as many steps as there are messages.

Template: ``<s>[ROLE]role[/ROLE]text</s>`` for each turn, with ``[INST] ... [/INST]`` around a user's text. Inside roles and
texts a backslash is doubled, and one is put after the first character of a control string (``<s>``, ``</s>``, ``[INST]``,
``[/INST]``, ``[ROLE]``, ``[/ROLE]``), so no control string is left; reading removes every escaping backslash.
All on DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_TURN = r"(?s)<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>"
PLANTED = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"(<(?=/?s>)|\[(?=/?(?:INST|ROLE)\]))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _jumps(parents: DataFrame, n: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Each message's 2**k-th ancestors (tree, node, far), one table for each k, and what is left after ``n`` steps and more (only
    messages in or below a circle have so many ancestors). A table has a row a message at most."""
    jump, out, steps = parents, [], 1
    while not jump.isEmpty():
        if steps >= n:
            return out, jump
        out.append(jump)
        near, ahead = jump.alias("near"), jump.select(F.col("tree").alias("t"), F.col("node").alias("p"), F.col("far").alias("farther"))
        jump = cut(near.join(ahead, F.col("near.tree").eqNullSafe(F.col("t")) & (F.col("near.far") == F.col("p"))).select("near.tree", "near.node", F.col("farther").alias("far")))
        steps *= 2
    return out, None


def _opened(parents: DataFrame, endless: DataFrame, n: int) -> DataFrame:
    """The parents without that of the smallest message of each circle."""
    circle = cut(endless.select(F.col("tree").alias("t"), F.col("far").alias("c")).distinct())  # so many steps up, all are in a circle
    least = cut(parents.join(circle, parents["tree"].eqNullSafe(circle["t"]) & (parents["node"] == circle["c"]), "left_semi").withColumn("least", F.least("node", "far")))
    steps = 1
    while steps < n:  # the least of the next 2**k messages round the circle
        ahead = least.select(F.col("tree").alias("t"), F.col("node").alias("p"), F.col("far").alias("farther"), F.col("least").alias("other"))
        near = least.alias("near")
        least = cut(near.join(ahead, F.col("near.tree").eqNullSafe(F.col("t")) & (F.col("near.far") == F.col("p"))).select("near.tree", "near.node", F.col("farther").alias("far"), F.least("near.least", "other").alias("least")))
        steps *= 2
    roots = least.where("node = least").select(F.col("tree").alias("t"), F.col("node").alias("p"))
    return cut(parents.join(roots, parents["tree"].eqNullSafe(roots["t"]) & (parents["node"] == roots["p"]), "left_anti"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every message on every root-to-leaf path; up counts from 0 at the leaf.

    messages: tree, node, parent; (tree, node) tells messages apart, and messages whose node is null are left out. A parent that
    is null or isn't there makes a root, and so does the smallest node of a circle of replies. Trees may be null.
    """
    known = cut(messages.where(F.col("node").isNotNull()).select("tree", "node", "parent").distinct())
    real = known.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    linked = known.join(real, known["tree"].eqNullSafe(real["t"]) & (known["parent"] == real["p"]), "left_semi")
    parents, n = cut(linked.select("tree", "node", F.col("parent").alias("far"))), known.count()
    jumps, endless = _jumps(parents, n)
    if endless is not None:
        parents = _opened(parents, endless, n)
        jumps, _ = _jumps(parents, n)
    inner = parents.select(F.col("tree").alias("t"), F.col("far").alias("p")).distinct()
    leaves = known.join(inner, known["tree"].eqNullSafe(inner["t"]) & (known["node"] == inner["p"]), "left_anti")
    found = cut(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")).distinct())
    for k, jump in enumerate(jumps):
        ahead = jump.select(F.col("tree").alias("t"), F.col("node").alias("p"), "far")
        more = found.join(ahead, found["tree"].eqNullSafe(ahead["t"]) & (found["node"] == ahead["p"])).select("tree", "leaf", F.col("far").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        found = cut(found.unionByName(more))
    return found


def format_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """One row for each chosen path: tree, leaf, rank (1 the best), score, formatted, loss_spans (code points of ``formatted``
    that assistants wrote, end exclusive).

    messages: tree, node, parent, role, text, score; they are read several times, so the caller writes what is costly to make.
    Null roles and texts are empty, null scores 0. ``branches`` paths of each tree are chosen, by the sum of their scores, ties by
    the leaf; None chooses all. A path is written in one row, so its texts together must fit a row (2 GB).
    """
    scored = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    every = paths(messages)
    ranked = (
        every.join(scored, every["tree"].eqNullSafe(scored["t"]) & (every["node"] == scored["n"]))
        .groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    )
    best = cut(ranked if branches is None else ranked.where(F.col("rank") <= branches))
    chosen = best.select(F.col("tree").alias("bt"), F.col("leaf").alias("bl"), "rank", "score")
    places = every.join(chosen, every["tree"].eqNullSafe(F.col("bt")) & (every["leaf"] == F.col("bl"))).select("tree", "leaf", "node", "up", "rank", "score")
    empty = F.lit("")
    role, text = escape(F.coalesce("role", empty)), escape(F.coalesce("text", empty))
    user = F.coalesce(F.col("role") == "user", F.lit(False))
    written = messages.select(
        F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"),
        F.concat(F.lit("<s>[ROLE]"), role, F.lit("[/ROLE]"), F.when(user, "[INST]").otherwise("")).alias("head"), text.alias("body"), F.when(user, "[/INST]</s>").otherwise("</s>").alias("tail"),
    )
    path = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    before = F.coalesce(F.sum(F.length("head") + F.length("body") + F.length("tail")).over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = places.join(written, places["tree"].eqNullSafe(written["t"]) & (places["node"] == written["n"])).withColumn("start", before + F.length("head"))
    piece = F.struct((-F.col("up")).alias("o"), F.concat("head", "body", "tail").alias("piece"), "loss", "start", (F.col("start") + F.length("body")).alias("end"))
    grouped = pieces.groupBy("tree", "leaf", "rank", "score").agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return grouped.select("tree", "leaf", "rank", "score", F.array_join("turns.piece", "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: array of (role, text)."""
    roles, bodies = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1)), F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2))
    return F.zip_with(roles, bodies, lambda r, b: F.struct(unescape(r).alias("role"), unescape(F.regexp_replace(b, r"(?s)^\[INST\](.*)\[/INST\]$", "$1")).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def threads(conversations: DataFrame) -> DataFrame:
    """Conversations as trees: each turn answers the one before. Null turns come first; turns that tie are ordered by role and
    text, null first; repeats stay. Only conv_id, turn, role and text are read."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    rows = conversations.select(F.col("conv_id").alias("tree"), "role", "text", node.alias("node"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op1(conversations: DataFrame) -> DataFrame:
    """Contract columns of the chat query, over the given conversations and conversation -7. Turns that the table itself has in
    a conversation -7 are of one conversation with the added ones."""
    spark = conversations.sparkSession
    kinds = {f.name: f.dataType for f in conversations.schema.fields}
    planted = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text")
    )
    made = format_trees(cut(threads(conversations.select("conv_id", "turn", "role", "text").unionByName(planted))))
    read = made.select(F.col("tree").alias("conv_id"), "formatted", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


_ESCAPED = r"replace(replace(replace(replace(replace(replace(replace({}, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '[ROLE]', '[\ROLE]'), '[/ROLE]', '[\/ROLE]')"
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
e AS (SELECT *, length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + length('<s>[ROLE][/ROLE]</s>') + CASE WHEN role = 'user' THEN length('[INST][/INST]') ELSE 0 END AS chars FROM c),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars) AS chars FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
