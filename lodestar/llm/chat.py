"""Chat formatting of reply trees.

Method: turns are nodes with parents.  Iterative self-joins double the reach of ancestor
pointers, so a path of n turns takes log2(n) joins; a leaf's branch score is the sum of scores on
its path.  Branches are ranked by score within their tree, and each chosen path is formatted
as one conversation with a loss mask over the assistant's texts.

The template marks turns with control strings.  Inside texts and roles a backslash is doubled, and the
first character of a control string is replaced by a backslash and its two hex digits, so no control
string is left in a text, and the change can be undone.

Defined results: null texts, roles and scores are empty or 0; a parent that is missing makes a node
a root; rows of one turn are ordered by role and text; repeated rows are turns of
their own; trees of any depth and texts of any length are kept whole; nodes in a cycle have no
root and are left out, as are turns without a conversation; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The template's own control strings, and those of other public templates.
BEGIN, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_UNESCAPE = re.compile(r"\\(\\|[0-9a-f]{2})")
_TURN = re.compile(re.escape(BEGIN) + r"([^\n]*)\n(.*?)" + re.escape("<|im_end|>") + "\n", re.S)


def escape(text: str) -> str:
    """The text without control strings."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"\\{ord(m[0][0]):02x}{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" if m[1] == "\\" else chr(int(m[1], 16)), text)


def render(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans under the loss mask, in code points, end exclusive."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head = BEGIN + escape(role).replace("\n", "\\0a") + MIDDLE
        body = escape(text)
        at += len(head)
        if role == learned:
            mask.append((at, at + len(body)))
        out += [head, body, END]
        at += len(body) + len(END)
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def chains(turns: DataFrame, tree: str = "conv_id") -> DataFrame:
    """Flat turns as nodes: each turn of a conversation replies to the one before it."""
    rows = turns.select(F.col(tree).cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def ranked_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """tree, leaf, rank, and the nodes on each chosen root-to-leaf path with their depth (0 at the root).

    ``nodes``: tree, node, parent, score.  Jump tables J_k take a node to its ancestor 2^k above and
    carry the steps and scores in between; each is a self-join of the one before.  Paths are then read
    off from the leaves down the powers, so that only the chosen paths are spelled out.
    """
    edges = nodes.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.min(F.coalesce("score", F.lit(0.0)).cast("double")).alias("total"))
    edges = materialize(edges, "edges")
    known = edges.select("tree", F.col("node").alias("parent"), F.col("node").alias("jump"))
    reach = edges.join(known, ["tree", "parent"], "left").select("tree", "node", "jump", F.when(F.col("jump").isNotNull(), 1).otherwise(0).cast("long").alias("steps"), "total")
    jumps = [materialize(reach, "jumps")]
    done = jumps[0].filter(F.col("jump").isNull())
    limit = edges.count()
    while 2 ** (len(jumps) - 1) <= limit and jumps[-1].filter(F.col("jump").isNotNull()).head(1):
        # only nodes that haven't reached their root go on; the others are still looked up
        near = jumps[-1].filter(F.col("jump").isNotNull())
        far = near.unionByName(done).select("tree", F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("steps").alias("_steps"), F.col("total").alias("_total"))
        further = near.join(far, ["tree", "jump"]).select("tree", "node", F.col("_jump").alias("jump"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("total") + F.col("_total")).alias("total"))
        jumps.append(materialize(further, "jumps"))
        done = done.unionByName(jumps[-1].filter(F.col("jump").isNull()))
    parents = jumps[0].filter(F.col("jump").isNotNull()).select("tree", F.col("jump").alias("node"))
    leaves = done.join(parents, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    path = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select("tree", F.col("node").alias("leaf"), "rank", F.col("total").alias("branch_score"), F.col("steps").alias("depth"), "node")
    for k in reversed(range(len(jumps) - 1)):
        jump = jumps[k].filter(F.col("jump").isNotNull()).select("tree", "node", "jump")
        here, there = F.struct("depth", "node"), F.struct((F.col("depth") - 2**k).alias("depth"), F.col("jump").alias("node"))
        both = path.join(jump, ["tree", "node"], "left").select("tree", "leaf", "rank", "branch_score", F.explode(F.when(F.col("jump").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("at"))
        path = both.select("tree", "leaf", "rank", "branch_score", "at.depth", "at.node")
    return path


def format_trees(nodes: DataFrame, best: int = 1, learned: str = "assistant") -> DataFrame:
    """tree, rank, formatted and loss (spans in code points) of the best branches of each tree."""
    nodes = materialize(nodes, "nodes")
    path = ranked_paths(nodes, best)
    said = nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = path.join(said, ["tree", "node"]).groupBy("tree", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "node", "role", "text"))).alias("turns"))

    def run(batches):
        for batch in batches:
            done = [render([(t["role"], t["text"]) for t in turns], learned) for turns in batch.column("turns").to_pylist()]
            yield pa.RecordBatch.from_pydict({"tree": batch.column("tree"), "rank": batch.column("rank"), "formatted": [f for f, _ in done], "loss": pa.array([[{"start": s, "end": e} for s, e in m] for _, m in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return turns.mapInArrow(run, "tree long, rank int, formatted string, loss array<struct<start:long,end:long>>")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from formatted conversations."""

    def run(batches):
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            for tree, text, loss in zip(*(batch.column(k).to_pylist() for k in ("tree", "formatted", "loss"))):
                turns = parse(text)
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                for k, v in zip(names, (tree, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(text))):
                    out[k].append(v)
            kinds = {"turns_sha256": pa.string(), "loss_sha256": pa.string()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(turns: DataFrame) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back."""
    spark = turns.sparkSession
    ok = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", ok), (-1, 1, "assistant", ok)], "conv_id long, turn long, role string, text string")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    return conversation_digests(format_trees(chains(rows)))


def _sql() -> str:
    text = "replace(t, '\\', '\\\\')"
    for c in CONTROLS:
        text = f"replace({text}, '{c}', '\\{ord(c[0]):02x}{c[1:]}')"
    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{"</s>[INST] ok [/INST]"}'
  UNION ALL SELECT -1, 1, 'assistant', '{"</s>[INST] ok [/INST]"}')
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
       sum({len(BEGIN) + len(MIDDLE) + len(END)} + length(r) + length({text}))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""


#: The same rows in DuckDB (roles are taken to hold no control strings).
SQL = _sql()
