"""Merkle manifest of a dataset: a tree of threes for each group of rows, and one over the groups' roots.

Only every few levels are stored (checkpoints): leaves, and then the tops of aligned subtrees of ``3 ** every`` nodes, one row a subtree.
A proof is extracted from the top down: each stored subtree meets the siblings above its top, regenerates its interior nodes from
its stored descendants, hands the siblings to the nodes below and drops the interior again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoloom.operators.segments import numbered
from mnemoloom.session import stage

#: Children of a node, and levels between two stored ones.
FAN, EVERY = 3, 4
#: Subtrees that are worked on at once in a task.
BATCH = 500
PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
PATH_DDL = "key string, block long, subroot string, root string, path array<struct<left: string, right: string>>"
NODES_DDL = "key string, idx long, digest string, top boolean"
PROOFS = [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())]
PROOFS_DDL = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 in hex of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value as text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.encode(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), "UTF-8"), 256)


def subtrees(nodes: DataFrame, width: int, columns: list[str]) -> DataFrame:
    """One stored row for each aligned subtree: its nodes' ``columns`` as arrays, in order; ``width`` nodes at most."""
    inner = F.struct((F.col("idx") % width).alias("slot"), *columns)
    rows = nodes.groupBy("key", F.floor(F.col("idx") / width).alias("block")).agg(F.array_sort(F.collect_list(inner)).alias("nodes"))
    return stage(rows.select("key", "block", *(F.col(f"nodes.{c}").alias(c) for c in columns)), "merkle-subtrees")


def interior(digests: list[str], block: int, width: int) -> list[list[str]]:
    """The levels of a subtree from its stored nodes up to its top; a key's only subtree ends where one node is left."""
    levels, most = [digests], EVERY_OF[width]
    while len(levels) <= most and (len(levels[-1]) > 1 or block > 0 or len(digests) == width):
        below = levels[-1]
        levels.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return levels


EVERY_OF = {FAN**k: k for k in range(1, 11)}


def siblings(levels: list[list[str]], slot: int) -> list[tuple[str, str]]:
    """(left, right) siblings of a subtree's node, level by level up to its top."""
    out = []
    for below in levels[:-1]:
        at = slot // FAN * FAN
        out.append(("".join(below[at:slot]), "".join(below[slot + 1 : at + FAN])))
        slot //= FAN
    return out


def _sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            yield batch.slice(start, BATCH).to_pylist()


def forest(leaves: DataFrame, columns: list[str], width: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stored subtrees of each stored level, from the leaves up, and for each level the nodes above it (``top``: a key's root).

    ``leaves`` has key, idx, digest and other ``columns`` to keep with the leaves. A round handles ``3 ** every`` nodes a row, so there are
    as many rounds as the largest key has stored levels.
    """

    def up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _sliced(batches):
            tops = [interior(r["digest"], r["block"], width)[-1][0] for r in rows]
            alone = [r["block"] == 0 and len(r["digest"]) < width for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["key"] for r in rows], pa.string()), pa.array([r["block"] for r in rows], pa.int64()), pa.array(tops, pa.string()), pa.array(alone, pa.bool_())], names=["key", "idx", "digest", "top"])

    levels, above = [subtrees(leaves, width, ["digest", *columns])], []
    while True:
        nodes = stage(levels[-1].select("key", "block", "digest").mapInArrow(up, NODES_DDL), "merkle-nodes")
        above.append(nodes)
        rest = nodes.where("not top")
        if rest.isEmpty():
            return levels, above
        levels.append(subtrees(rest, width, ["digest"]))


def paths(levels: list[DataFrame], above: list[DataFrame], tops: DataFrame, width: int) -> DataFrame:
    """(key, block, subroot, root, path) of each stored subtree of leaves; ``tops`` has that for each key's root, its block unused."""

    def down(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _sliced(batches):
            out: list[list] = [[] for _ in range(5)]
            for r in rows:
                tree = interior(r["digest"], r["block"], width)
                for slot in range(len(r["digest"])):
                    path = [{"left": a, "right": b} for a, b in siblings(tree, slot)] + r["path"]
                    for column, x in zip(out, (r["key"], r["block"] * width + slot, r["subroot"], r["root"], path), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.string(), PATH), strict=True)], names=["key", "block", "subroot", "root", "path"])

    found = None
    for k in range(len(levels) - 1, -1, -1):
        ends = above[k].where("top").select("key", F.col("idx").alias("block")).join(tops.drop("block"), "key")
        parents = ends if found is None else ends.unionByName(found)
        if k == 0:
            return parents
        found = stage(levels[k].join(parents, ["key", "block"]).mapInArrow(down, PATH_DDL), "merkle-paths")
    raise AssertionError


def merkle_proofs(docs: DataFrame, candidate: Column | None = None, id_col: str = "doc_id", group_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", text_col: str = "text", every: int = EVERY) -> DataFrame:
    """Per row: doc_id, leaf, subroot (of its group), root, proof_sha256, folded_root, verified.

    A leaf is the digest of id, group, language, number of characters and text. Within a group leaves ascend by id (null first), then by
    their digest, then by the candidate's (one that agrees first); every three consecutive nodes become their digest until one is left, the subroot. Subroots, ordered by group (null first,
    bytewise), give the root likewise. proof_sha256 digests the siblings on the way to the root; folded_root is what the row gives with
    these siblings, and ``verified`` whether it is the root. ``candidate`` is a Column over ``docs`` with the text to prove (by default the
    row's own): a text that differs gives another leaf and doesn't verify.

    Defined cases: nulls in any column are leaves with ``-``; a group of one row has its leaf as subroot; rows that repeat are leaves each, and
    stand side by side; extra columns are ignored; an empty table gives no rows.

    Scale: texts are hashed where they are read and never move. A leaf is some 200 bytes; leaves move twice, by range of (group, id) for
    their numbers and by subtree. A subtree is one row of ``3 ** every`` nodes at most, so no group is ever held together, and stored
    levels shrink by that factor. Paths are kept for subtrees only.
    """
    if not 1 <= every <= 8:
        raise ValueError("every must be 1 to 8")
    width = FAN**every
    fields = [F.col(id_col), F.col(group_col), F.col(lang_col), F.col(chars_col)]
    own = F.col(text_col).cast("string")
    key = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    given = own if candidate is None else candidate
    rows = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("doc_id"), leaf_digest([*fields, own]).alias("digest"), F.when(~given.eqNullSafe(own), leaf_digest([*fields, given])).alias("proved"))
    leaves = numbered(stage(rows, "merkle-leaves"), "key", ["doc_id", "digest", "proved"])
    levels, above = forest(leaves, ["doc_id", "proved"], width)
    subroots = above[0].where("top")
    for nodes in above[1:]:
        subroots = subroots.unionByName(nodes.where("top"))
    named = stage(subroots.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest"), "merkle-subroots")
    over, over_above = forest(numbered(named, "key", ["name"]), ["name"], width)
    nothing = F.array().cast("array<struct<left: string, right: string>>")
    root = over_above[-1].where("top").select("key", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), nothing.alias("path"))
    above_groups = paths(over, over_above, root, width)

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The path of each group's subroot."""
        for some in _sliced(batches):
            out: list[list] = [[] for _ in range(5)]
            for r in some:
                tree = interior(r["digest"], r["block"], width)
                for slot, (name, top) in enumerate(zip(r["name"], r["digest"], strict=True)):
                    path = [{"left": a, "right": b} for a, b in siblings(tree, slot)] + r["path"]
                    for column, x in zip(out, (name, 0, top, r["root"], path), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.string(), PATH), strict=True)], names=["key", "block", "subroot", "root", "path"])

    def prove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _sliced(batches):
            out: list[list] = [[] for _ in PROOFS]
            for r in some:
                tree = interior(r["digest"], r["block"], width)
                upper = [(x["left"], x["right"]) for x in r["path"]]
                tail = "".join(a + b for a, b in upper)
                for slot, (doc, leaf, other) in enumerate(zip(r["doc_id"], r["digest"], r["proved"], strict=True)):
                    inner = siblings(tree, slot)
                    node = other or leaf
                    for a, b in (*inner, *upper):
                        node = digest(a + node + b)
                    proof = digest("".join(a + b for a, b in inner) + tail)
                    for column, x in zip(out, (doc, leaf, r["subroot"], r["root"], proof, node, node == r["root"]), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(out, PROOFS, strict=True)], names=[n for n, _ in PROOFS])

    tops = stage(over[0].join(above_groups, ["key", "block"]).mapInArrow(groups, PATH_DDL), "merkle-groups")
    return levels[0].join(paths(levels, above, tops, width), ["key", "block"]).mapInArrow(prove, PROOFS_DDL)
