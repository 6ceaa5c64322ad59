"""Chat formatting of reply trees.

A message names its parent. Iterative self-joins double the reach of every
pointer (parent, grandparent, 4th, 8th ancestor ...), adding up scores on the
way, so a path of n messages takes log2(n) rounds; each round is stored. The
leaves' path scores rank the branches of a tree, and for the chosen leaves the
same pointer tables list the whole root-to-leaf path. Each path becomes one
conversation:

    <|im_start|>role\\ntext<|im_end|>\\n

Inside roles and texts ``\\`` is doubled and ``<|`` becomes ``<\\|`` (in roles a line
end becomes ``\\n``), so a control string in a text is never one in the output,
and the way back is exact. ``loss_spans`` are the (start, length) code points of the
assistant texts in the formatted string.

Only SQL functions. Defined cases: null text, null role: empty; a null or unknown
parent: a root; messages that only lead in circles belong to no path; of rows that
repeat a node id one counts, in conversations by turn every row does; null tree
ids are one tree (kept as the smallest long); an empty table gives an empty result. A conversation is one
value of the result, so it must fit in one row; only its pointers are joined."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage

NO_ID = -(1 << 63)
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The way back. ``escape`` doubles every run of backslashes, so exactly
    one of them between ``<`` and ``|`` is its own."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    r"""Line ends come back first: ``\n`` after an even run of backslashes."""
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def chains(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """Linear conversations as reply trees: node (place in the order), parent
    (the place before; null for the first) and a score of 0 are added."""
    place = F.row_number().over(Window.partitionBy(tree).orderBy(*order)).cast("long")
    return rows.withColumn("node", place).withColumn("parent", F.nullif(F.col("node") - 1, F.lit(0))).withColumn("score", F.lit(0.0))


def chosen_paths(messages: DataFrame, per_tree: int | None = None) -> DataFrame:
    """messages(tree, node, parent, score) with unique nodes in a tree and non-null
    trees -> (tree, leaf, rank, node, depth): every message of each chosen
    root-to-leaf path, depth counted up from the leaf. Branches are ranked by the
    sum of scores (then by leaf); per_tree=None takes all."""
    ids = stage(messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "nodes")
    known = ids.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    first = ids.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), "score")
    # jumps[k]: up = the 2^k-th ancestor where there is one, score = that of the 2^k messages from the
    # node on; ended: nodes whose pointer has left the root, with the score of their whole path
    reached = stage(first, "jump")
    jumps, ended = [reached.filter("up is not null")], [reached.filter("up is null")]
    now = jumps[0].count()
    while now:
        at_level = reduce(DataFrame.unionAll, [jumps[-1], *ended])
        above = at_level.select("tree", F.col("node").alias("up"), F.col("up").alias("further"), F.col("score").alias("more"))
        wider = stage(jumps[-1].join(above, ["tree", "up"]).select(
            "tree", "node", F.col("further").alias("up"), (F.col("score") + F.col("more")).alias("score")), "jump")
        ended.append(wider.filter("up is null"))
        jumps.append(wider.filter("up is not null"))
        before, now = now, jumps[-1].count()
        if now == before:  # only circles are left
            break
    totals = reduce(DataFrame.unionAll, ended).select("tree", F.col("node").alias("leaf"), F.col("score").alias("total"))
    parents = jumps[0].select("tree", F.col("up").alias("leaf")).distinct()
    leaves = totals.join(parents, ["tree", "leaf"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))
    ranked = leaves.select("tree", "leaf", rank.alias("rank"))
    paths = ranked if per_tree is None else ranked.filter(F.col("rank") <= per_tree)
    paths = paths.select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("depth"))
    for k in reversed(range(len(jumps))):  # every message so far, and the one 2^k above it
        further = F.struct(F.col("up").alias("node"), (F.col("depth") + (1 << k)).alias("depth"))
        both = F.filter(F.array(F.struct("node", "depth"), further), lambda x: x["node"].isNotNull())
        paths = (paths.join(jumps[k].select("tree", "node", "up"), ["tree", "node"], "left")
                 .select("tree", "leaf", "rank", F.explode(both).alias("x")).select("tree", "leaf", "rank", "x.node", "x.depth"))
    return paths


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans): each chosen path as one conversation."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = paths.join(messages.select("tree", "node", role.alias("role"), text.alias("text")), ["tree", "node"])
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    path = Window.partitionBy("tree", "leaf").orderBy(F.desc("depth"))
    sized = turns.select("tree", "leaf", "rank", "depth", head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("learn")).withColumn(
        "at", F.coalesce(F.sum(F.char_length("head") + F.char_length("body") + len(END)).over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    turn = F.struct((-F.col("depth")).alias("place"), F.concat("head", "body", F.lit(END)).alias("turn"), "learn",
                    (F.col("at") + F.char_length("head")).cast("int").alias("start"), F.char_length("body").alias("length"))
    grouped = sized.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    formatted = F.array_join(F.transform("turns", lambda t: t["turn"]), "")
    return grouped.select("tree", "leaf", "rank", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text)."""
    parts = F.filter(F.split(formatted, "<\\|im_start\\|>"), lambda p: p != "")

    def turn(p):
        cut = F.instr(p, "\n")
        return F.struct(unescape_role(F.substr(p, F.lit(1), cut - 1)).alias("role"),
                        unescape(F.substr(p, cut + 1, F.char_length(p) - cut - len(END))).alias("text"))

    return F.transform(parts, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def format_trees(messages: DataFrame, per_tree: int | None = None) -> DataFrame:
    """messages(tree, node, parent, score, role, text) -> the chosen paths as
    conversations. Of rows that repeat a node the one with the least parent,
    role and text counts."""
    tree = F.coalesce(F.col("tree").cast("long"), F.lit(NO_ID))
    nth = F.row_number().over(Window.partitionBy("tree", "node").orderBy("parent", "role", "text", "score"))
    kept = messages.select(tree.alias("tree"), "node", "parent", "score", "role", "text").filter("node is not null")
    return _format(kept.withColumn("nth", nth).filter("nth = 1").drop("nth"), per_tree)


def _format(messages: DataFrame, per_tree: int | None) -> DataFrame:
    kept = stage(messages, "messages")
    return format_paths(chosen_paths(kept, per_tree), kept).withColumn("tree", F.nullif("tree", F.lit(NO_ID)))


def format_conversations(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text), ordered by turn (then role and text; null
    first), as reply trees with one branch each. Every row is a turn of its own."""
    slim = rows.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("tree"), "turn", "role", "text")
    linear = chains(slim, "tree", [F.col("turn"), F.col("role"), F.col("text")])
    return _format(linear.select("tree", "node", "parent", "score", "role", "text"), None)


def digest(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    all read back from the formatted strings and their masks."""
    back = conversations.select("tree", "formatted", read_back(F.col("formatted")).alias("turns"),
                                masked_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
