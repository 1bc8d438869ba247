"""Merkle manifest of a dataset: a digest for every row, source and table, and a proof that a row belongs to them.

Every row is a leaf: the SHA-256 of its fields. The leaves of a source stand in order of their ids; every FANOUT
consecutive ones become the digest of their concatenation, and so on until one digest is left, the source's subroot.
The subroots in order of their sources make up the root in the same way.

Slot pivot: a level is one grouping by parent, where conditional aggregates spread the children over FANOUT columns, one
for each slot. The columns concatenated hash to the parent; the columns without a child's own are its siblings. Proofs
are handed down from the top, level by level, joined by parent (at most FANOUT rows each), so a hot source costs no
more than many small ones. Places are numbered in ranges (see `numbering`). The text is read once, for the leaves.

Defined cases: a null field counts as `-`, so it differs from an empty one; null sources are a source of their own and
come first; a null id comes first in its source; rows of one id are ordered by their leaf, and equal rows are
leaves of their own; a source of one row has its leaf as subroot, a table of one source has its subroot as root; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import stored
from sluiceway.llm.numbering import numbered

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """`-` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    written = value.cast("string")
    return F.when(written.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def beside(kids: Column, slot: Column, fanout: int) -> Column:
    """The digests left and right of a slot's own."""
    return F.struct(
        F.array_join(F.slice(kids, F.lit(1), slot), "").alias("left"),
        F.array_join(F.slice(kids, slot + 2, F.lit(fanout)), "").alias("right"))


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest leads to along a path of siblings."""
    return F.aggregate(path, digest, lambda up, step: F.sha2(F.concat(step["left"], up, step["right"]), 256))


def path_digest(path: Column) -> Column:
    """One digest for a path: its siblings from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def parents(nodes: DataFrame, fanout: int, carried: Sequence[str] = ()) -> DataFrame:
    """One row for each run of `fanout` nodes: its own digest, the digests of its `kids`, and how many its tree has."""
    slot = F.pmod("pos", F.lit(fanout))

    def spread(name: str) -> list[Column]:
        return [F.max(F.when(slot == j, F.col(name))).alias(f"{name}_{j}") for j in range(fanout)]

    def together(name: str) -> Column:
        return F.array(*[F.col(f"{name}_{j}") for j in range(fanout)])

    runs = nodes.groupBy("tree", F.col("n").alias("below"), F.expr(f"pos div {fanout}").alias("pos")).agg(*spread("digest"), *[c for name in carried for c in spread(name)])
    listed = runs.select("tree", "below", "pos", F.array_compact(together("digest")).alias("kids"), *[together(name).alias(name) for name in carried])
    return listed.select(
        "tree", "pos", "below", F.ceil(F.col("below") / fanout).cast("long").alias("n"), "kids", *carried,
        # A leaf that is alone in its tree is its top.
        F.when(F.col("below") == 1, F.element_at("kids", 1)).otherwise(F.sha2(F.array_join("kids", ""), 256)).alias("digest"))


def levels(leaves: DataFrame, fanout: int, label: str) -> list[DataFrame]:
    """The runs of all trees, from the leaves' parents to the tops."""
    made = [stored(parents(leaves, fanout, ["leaf"]), f"{label}-runs")]
    widest = made[0].agg(F.max("n")).first()[0] or 0
    while widest > 1:
        made.append(stored(parents(made[-1].where("n > 1"), fanout), f"{label}-runs"))
        widest = -(-widest // fanout)
    return made


def tops(made: list[DataFrame]) -> DataFrame:
    found = [level.where("n = 1").select("tree", "digest") for level in made]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def handed_down(made: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """(leaf, digest, subroot, root, path) for every leaf, given (tree, root, path) of the tops."""
    upper = None
    for level in reversed(made):
        reached = level.where("n = 1").join(above, "tree").withColumn("subroot", F.col("digest"))
        if upper is not None:
            over = upper.select("tree", F.col("pos").alias("run"), F.col("kids").alias("row"), "subroot", "root", "path")
            under = level.where("n > 1").withColumn("run", F.expr(f"pos div {fanout}")).join(over, ["tree", "run"])
            step = beside(F.col("row"), F.pmod("pos", F.lit(fanout)).cast("int"), fanout)
            reached = reached.unionByName(under.withColumn("path", F.concat(F.array(step), "path")).drop("run", "row"))
        upper = reached
    listed = upper.select("below", "kids", "subroot", "root", "path", F.posexplode(F.arrays_zip("kids", F.slice("leaf", F.lit(1), F.size("kids")).alias("leaf"))).alias("slot", "own"))
    step = beside(F.col("kids"), F.col("slot"), fanout)
    return listed.select(
        F.col("own.leaf").alias("leaf"), F.col("own.kids").alias("digest"), "subroot", "root",
        F.when(F.col("below") == 1, F.col("path")).otherwise(F.concat(F.array(step), "path")).alias("path"))


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: Sequence[str] = FIELDS, beside_leaf: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, subroot, root, path) for every row; `path` holds the siblings from the leaf to the root.

    `beside_leaf` names more expressions over the rows, which come out as columns of their own."""
    more = beside_leaf or {}
    # A prefix keeps null apart from empty and the order by UTF-8 bytes.
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    leaves = stored(docs.select(
        tree.alias("tree"), leaf_digest([F.col(f) for f in fields]).alias("digest"),
        F.struct(F.col(id_col).cast("long").alias("id"), *[v.alias(k) for k, v in more.items()]).alias("leaf")), "leaves")
    made = levels(numbered(leaves, "tree", [F.col("leaf.id").asc_nulls_first(), F.col("digest")], "placed-leaves"), fanout, "leaf")
    heads = stored(tops(made).select(F.lit("").alias("tree"), "digest", F.struct(F.col("tree").alias("source")).alias("leaf")), "subroots")
    crown = levels(numbered(heads, "tree", [F.col("leaf.source")], "placed-subroots"), fanout, "subroot")
    root = tops(crown).select("tree", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    above = stored(handed_down(crown, root, fanout).select(F.col("leaf.source").alias("tree"), "root", "path"), "subroot-paths")
    return handed_down(made, above, fanout).select(
        F.col("leaf.id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "path", *[F.col(f"leaf.{k}").alias(k) for k in more])


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tamper_check(docs: DataFrame, every: int = 5, fanout: int = FANOUT) -> DataFrame:
    """The manifest's digests, and whether each row still leads to the root after some rows' texts were lower-cased
    (those whose id's CRC-32 `every` divides; a row with a null id is left as it is)."""
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(every)) == 0, F.lit(False))
    changed = F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    seen = leaf_digest([changed if f == "text" else F.col(f) for f in FIELDS])
    proofs = manifest(docs, beside_leaf={"seen": seen}, fanout=fanout)
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), folded(F.col("seen"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
