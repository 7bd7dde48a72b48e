"""Merkle manifest of a dataset: leaves, trees per group, inclusion proofs, verification.

Every row is a leaf, the SHA-256 of its length-prefixed fields.  The leaves of
a group, in order, are the bottom of a tree in which every ``arity``
consecutive nodes become their hash; the roots of the groups are the bottom of
one more tree.  A row's proof is the list of its siblings, level by level.

Sibling-shift self-joins: at every level each node computes the indices of its
siblings (index XOR 1 in a binary tree, else slot offsets 1 .. arity-1, taken
around within the run) and fetches them by an equijoin on (tree, index).  Rows
in slot zero then hold the whole run and emit the parent.  Nodes of all trees
climb together; a tree is done when its node zero has no sibling.

Proofs go down again: each node's proof is its own siblings and its parent's
proof, so every level is joined once with the one below it, ``arity`` times its
size.  All levels together have at most 1 + 1/(arity-1) rows a document.

Scale: texts are read once, in the scan that makes the leaves; after that only
digests (32 bytes), indices and proofs travel.  Join keys are (tree, index),
unique at each level, so a group that holds a third of all rows is spread like
any other; numbering is a range-partitioned sort in which it spans several
partitions.  Levels are written to the shared folder, which cuts the lineage.

Defined results: null fields are ``-``; the null group comes first, as do null
order keys; rows with equal order keys stand in order of their leaves, so
repeated rows are leaves of their own with proofs of their own; a group of one
row has its leaf as root; one group has its root as the root of all; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import n_groups, stored
from chatlake.plans.numbering import with_row_index

#: Rows of a level that one task writes.
TASK_ROWS = 50_000

#: The fields of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    """SHA-256 of a text, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(col) -> Column:
    return F.lower(F.hex(F.col(col) if isinstance(col, str) else col))


def leaf_of(fields: list[Column]) -> Column:
    """Digest of length-prefixed fields, null as ``-``."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return digest(F.concat(*parts))


def fold(node: str, proof: str) -> Column:
    """Root that a node (32 bytes) and its proof lead to."""
    return F.aggregate(proof, F.col(node), lambda h, s: F.unhex(F.sha2(F.concat(
        hexed(s["left"]), hexed(h), hexed(s["right"])).cast("binary"), 256)))


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """One level: every node with the digests to its left and right in its run."""
    slot, out = F.pmod("idx", F.lit(arity)), nodes
    for k in range(1, arity):
        at = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + F.pmod(slot + k, F.lit(arity))
        other = nodes.select("tree", F.col("idx").alias("__at"), F.col("h").alias(f"__s{k}"))
        out = out.withColumn("__at", at).join(other, ["tree", "__at"], "left")
    empty = F.lit(b"")

    def side(wraps: bool) -> Column:
        return F.concat(*[F.coalesce(F.when((slot + k >= arity) == F.lit(wraps), F.col(f"__s{k}")), empty)
                          for k in range(1, arity)])

    out = out.withColumns({"left": side(True), "right": side(False)})
    out = out.drop("__at", *[f"__s{k}" for k in range(1, arity)])
    lone = (F.col("idx") == 0) & (F.length("right") == 0)
    return out.withColumn("lone", lone)


def grow(nodes: DataFrame, arity: int = 3) -> list[DataFrame]:
    """Levels of all trees from their bottom nodes (tree, idx, h, ...).

    Each level has left and right (digests of the siblings) and ``lone`` (this
    node is its tree's root).  Further columns stay on the bottom level.
    """
    levels, rows = [], nodes.count()
    while True:
        level = stored(_siblings(nodes, arity).coalesce(n_groups(rows, TASK_ROWS)), f"merkle{len(levels)}")
        levels.append(level)
        heads = level.where((F.pmod("idx", F.lit(arity)) == 0) & ~F.col("lone"))
        rows = heads.count()
        if not rows:
            return levels
        nodes = heads.select("tree", F.floor(F.col("idx") / arity).cast("long").alias("idx"),
                             digest(F.concat(hexed("h"), hexed("right"))).alias("h"))


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """(tree, h) of every tree."""
    return reduce(DataFrame.unionByName, [x.where("lone").select("tree", "h") for x in levels])


def with_proofs(levels: list[DataFrame], top: DataFrame, arity: int = 3) -> DataFrame:
    """The bottom level with ``proof``, an array of (left, right), and the columns of ``top``.

    ``top``: (tree, above, ...): what follows a tree's own proof, and columns
    that all nodes of the tree are to have.
    """
    extra = [c for c in top.columns if c not in ("tree", "above")]
    own = F.struct("left", "right")
    known = None
    for no in range(len(levels) - 1, -1, -1):
        level = levels[no]
        here = level.where("lone").join(top, "tree").withColumn("proof", F.col("above")).drop("above")
        if known is not None:
            parents = known.select("tree", F.col("idx").alias("__up"), F.col("proof").alias("__above"), *extra)
            below = (level.where(~F.col("lone")).withColumn("__up", F.floor(F.col("idx") / arity).cast("long"))
                     .join(parents, ["tree", "__up"])
                     .withColumn("proof", F.concat(F.array(own), F.col("__above"))).drop("__up", "__above"))
            here = here.unionByName(below)
        if no:
            tasks = n_groups(level.count(), TASK_ROWS)
            known = stored(here.select("tree", "idx", "proof", *extra).coalesce(tasks), f"proof{no}")
        else:  # left to whoever reads it
            known = here
    return known.drop("left", "right", "lone")


def manifest(rows: DataFrame, group: Column, order: list[Column], leaf: Column, arity: int = 3,
             keep: dict[str, Column] | None = None) -> DataFrame:
    """Every row's leaf with subroot, root (32 bytes each) and proof; ``keep`` names further columns."""
    keep = dict(keep or {})
    # Null first, then the bytes of the value.
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))
    leaves = stored(rows.select(tree.alias("tree"), F.struct(*order).alias("order"), leaf.alias("h"),
                                *[c.alias(k) for k, c in keep.items()]), "leaves")
    bottom = with_row_index(leaves, ["order", "h", *keep], name="idx", partition_by=["tree"]).drop("order")
    levels = grow(bottom, arity)
    groups = with_row_index(roots_of(levels), ["tree"], name="idx").select(
        F.lit("").alias("tree"), "idx", "h", F.col("tree").alias("of"))
    upper = grow(groups, arity)
    root = roots_of(upper).select(F.lit("").alias("tree"), F.col("h").alias("root"),
                                  F.expr("cast(array() as array<struct<left:binary,right:binary>>)").alias("above"))
    top = with_proofs(upper, root, arity).select(
        F.col("of").alias("tree"), F.col("h").alias("subroot"), "root", F.col("proof").alias("above"))
    return with_proofs(levels, stored(top, "subroots"), arity)


def document_manifest(docs: DataFrame, arity: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, and the leaf of the tampered row.

    ``tampered``: the leaf after deleting the line feeds of the text, where
    crc32 of the decimal doc_id is even; else the leaf itself.
    """
    fields = {c: F.col(c) for c in FIELDS}
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.lit(False))
    hit = hit & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    cut = leaf_of(list({**fields, "text": F.translate("text", "\n", "")}.values()))
    # Null where nothing changes, so only changed rows are hashed twice.
    return manifest(docs, F.col("source"), [F.col("doc_id")], leaf_of(list(fields.values())), arity,
                    keep={"doc_id": F.col("doc_id"), "cut": F.when(hit, cut)}).withColumnRenamed("h", "leaf").withColumn(
        "tampered", F.coalesce("cut", "leaf")).drop("tree", "idx", "cut")


def verify(rows: DataFrame, node: str = "leaf") -> DataFrame:
    """``rows`` with folded_root (from ``node`` and proof) and verified."""
    return rows.withColumn("folded_root", fold(node, "proof")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def proof_text(proof: str) -> Column:
    """All siblings of a proof as one hex text, in order."""
    return F.concat_ws("", F.transform(proof, lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))))
