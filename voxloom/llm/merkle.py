"""A Merkle tree over a table: a manifest of the whole dataset, and proofs that a row belongs to it.

The leaves of each language, in order of doc_id, are hashed in runs of eight
until one digest is left, its subroot; the subroots, in order of language, are
hashed likewise to the root. The tree is stored as records from a digest to its
children, so that equal subtrees are stored once.

Proofs descend from the root: at each step a node's digest is looked up among
the records, the digit of the leaf's place chooses a child, and the children
beside it join the path. Leaves below one node share its steps, so a step costs
as many rows as the tree has nodes there. Reversed, the path's steps fold a leaf
up to the root.

``leaves``, ``build`` and ``paths`` are of use by themselves: a manifest may be
kept, and paths asked for some leaves only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .common import written

FANOUT = 8
#: Levels that one grouping of nodes makes: 8 ** 3 digests come together at most.
STEPS = 3
#: Levels of the largest tree: 8 ** 21 leaves.
HIGHEST = 21
_PATH = "array<struct<left: string, right: string>>"


def _digest(parts: list[Column]) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(text: Column) -> Column:
    """H of doc_id, source, lang, n_chars and ``text``: each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    values = [F.col(c).cast("string") for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return _digest([F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def tampered_text() -> Column:
    """Text with A-Z in lower case where 3 divides the crc32 of doc_id; others, rows without doc_id and null texts as they are."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower).otherwise(F.col("text"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, branch (the language as a key that sorts null first), leaf and tampered leaf, with rank (by doc_id, null first, then by leaf) and total within the branch.

    What else ``docs`` has isn't read; repeated rows are leaves each.
    """
    branch = F.coalesce(F.concat(F.lit(":"), "lang"), F.lit(""))
    made = written(docs.select("doc_id", branch.alias("branch"), leaf_digest(F.col("text")).alias("leaf"), leaf_digest(tampered_text()).alias("changed")), "leaves")
    return written(ranked(made, ["branch"], ["doc_id", "leaf"]), "ranks")


def height(total: Column) -> Column:
    """Levels above ``total`` leaves: 0 for one."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(HIGHEST - 1)), F.lit(0), lambda h, k: F.when(total > F.pow(F.lit(float(FANOUT)), k.cast("double")), h + 1).otherwise(h))


def _runs(digests: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / FANOUT).cast("int")), lambda i: F.slice(digests, i * FANOUT + 1, F.lit(FANOUT)))


def build(nodes: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """From leaves (branch, rank, digest, height): records (node, children), and branch, digest of each branch's top.

    Each round groups 8 ** 3 digests and hashes three levels of them in place.
    """
    tops, records, level = [], [], nodes.select("branch", F.col("rank").alias("at"), "digest", "height")
    for k in range(rounds + 1):
        base = k * STEPS
        tops.append(level.where(F.col("height") == base).select("branch", "digest"))
        if k == rounds:
            break
        chunk = F.shiftright("at", 3 * STEPS)
        lists = F.array_sort(F.collect_list(F.struct("at", "digest")))
        grouped = level.where(F.col("height") > base).groupBy("branch", "height", chunk.alias("at")).agg(F.transform(lists, lambda x: x["digest"]).alias("l0"))
        for step in range(1, STEPS + 1):
            grouped = grouped.withColumn(f"r{step}", F.when(F.col("height") >= base + step, _runs(f"l{step - 1}"))).withColumn(f"l{step}", F.transform(f"r{step}", lambda r: F.sha2(F.concat_ws("", r), 256)))
        made = written(grouped.drop("l0"), "nodes")
        for step in range(1, STEPS + 1):
            records.append(made.select(F.explode(F.arrays_zip(F.col(f"l{step}").alias("node"), F.col(f"r{step}").alias("children"))).alias("x")).select("x.node", "x.children"))
            if step < STEPS:
                tops.append(made.where(F.col("height") == base + step).select("branch", F.element_at(f"l{step}", 1).alias("digest")))
        level = made.where(F.col("height") >= base + STEPS).select("branch", "at", F.element_at(f"l{STEPS}", 1).alias("digest"), "height")
    first = nodes.select(F.lit("").alias("node"), F.array(F.lit("")).alias("children")).limit(0)
    for part in records:
        first = first.unionByName(part)
    top = tops[0]
    for part in tops[1:]:
        top = top.unionByName(part)
    return first.groupBy("node").agg(F.first("children").alias("children")), top


def descend(state: DataFrame, records: DataFrame, rounds: int, stop: int, wanted: DataFrame | None = None) -> DataFrame:
    """Descends from tops (branch, at, digest, height, path) until ``stop`` levels are left: the same columns, a row for each node reached.

    With ``wanted`` (branch, rank and height of leaves) only nodes above its
    leaves are reached, else all.
    """
    for step in range(1, rounds + 1):
        found = state.join(records, (F.col("digest") == F.col("node")) & (F.col("height") > stop), "left")
        inside = F.transform("children", lambda c, k: F.struct(k.alias("k"), c.alias("digest"), F.concat_ws("", F.slice("children", F.lit(1), k)).alias("left"), F.concat_ws("", F.slice("children", k + 2, F.lit(FANOUT))).alias("right")))
        opened = found.withColumn("x", F.explode_outer(inside))
        more = lambda new, old: F.when(F.col("x").isNotNull(), new).otherwise(F.col(old)).alias(old)
        path = F.concat("path", F.array(F.struct(F.col("x.left").alias("left"), F.col("x.right").alias("right"))))
        state = opened.select("branch", more(F.col("at") * FANOUT + F.col("x.k"), "at"), more(F.col("x.digest"), "digest"), more(F.col("height") - 1, "height"), more(path, "path"))
        if wanted is not None:
            above = F.call_function("shiftright", F.col("rank"), 3 * F.greatest(F.col("height") - step, F.least("height", F.lit(stop))))
            asked = wanted.select(F.col("branch").alias("b"), above.alias("a")).distinct()
            state = state.join(asked, (F.col("branch") == F.col("b")) & (F.col("at") == F.col("a")), "left_semi")
    return state


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the steps of its path, from the root down."""
    return F.aggregate(F.reverse(path), leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def _highest(frame: DataFrame) -> int:
    return frame.agg(F.max("height")).first()[0] or 0


def manifest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Null columns count as ``-`` in a leaf; rows without doc_id come first in
    their language; repeated rows have neighbouring leaves; a table without rows
    gives none.
    """
    rows = leaves(docs).withColumn("height", height(F.col("total")))
    highest = _highest(rows)
    records, tops = build(rows.select("branch", "rank", F.col("leaf").alias("digest"), "height"), -(-highest // STEPS))
    records, branches = written(records, "records"), rows.select("branch", "height").distinct()
    tops = ranked(tops.join(branches, "branch").withColumn("whole", F.lit("")), ["whole"], ["branch"])
    tops = written(tops.withColumn("upper", height(F.col("total"))), "tops")
    upper = tops.agg(F.max("upper")).first()[0] or 0
    over, root = build(tops.select(F.col("whole").alias("branch"), "rank", "digest", F.col("upper").alias("height")), -(-upper // STEPS))
    none = F.array().cast(_PATH)
    start = root.join(tops.groupBy(F.col("whole").alias("branch")).agg(F.max("upper").alias("height")), "branch").select("branch", F.lit(0).cast("long").alias("at"), "digest", "height", none.alias("path"))
    found = descend(start, over, upper, 0).select(F.col("at").alias("rank"), "path")
    begun = tops.join(found, "rank").select("branch", F.lit(0).cast("long").alias("at"), "digest", "height", "path", "whole")
    begun = written(begun, "subroots")
    near = descend(begun.drop("whole"), records, highest - 1, 1)
    parents = near.join(records, (F.col("digest") == F.col("node")) & (F.col("height") > 0), "left").select("branch", "at", "height", "path", F.coalesce("children", F.array("digest")).alias("children"))
    parent = F.when(F.col("height") > 0, F.shiftright("rank", 3)).otherwise(F.lit(0))
    placed = rows.select("doc_id", "branch", "leaf", "changed", "rank", parent.alias("at")).join(parents, ["branch", "at"])
    digit = F.pmod("rank", F.lit(FANOUT)).cast("int")
    step = F.struct(F.concat_ws("", F.slice("children", F.lit(1), digit)).alias("left"), F.concat_ws("", F.slice("children", digit + 2, F.lit(FANOUT))).alias("right"))
    path = F.when(F.col("height") > 0, F.concat("path", F.array(step))).otherwise(F.col("path"))
    proof = F.sha2(F.concat_ws("", F.transform(F.reverse("path"), lambda s: F.concat(s["left"], s["right"]))), 256)
    proved = placed.select("doc_id", "branch", "leaf", "changed", path.alias("path"))
    folded = proved.select("doc_id", "branch", "leaf", proof.alias("proof_sha256"), fold(F.col("changed"), F.col("path")).alias("folded_root"))
    known = begun.select("branch", "whole", F.col("digest").alias("subroot")).join(root.select(F.col("branch").alias("whole"), F.col("digest").alias("root")), "whole")
    return folded.join(known, "branch").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
