"""Merkle manifest of a table by nested-struct rollup.

Every document is a leaf; leaves of a language ascend by id, every ARITY consecutive nodes make a node, and the roots of
the languages make the root in the same way.  A leaf's rank is written in digits to the base ARITY.  Within a block of
ARITY ** DIGITS consecutive ranks the digit columns are grouped away one after the other, the last digit first: a group
becomes a struct of its digit, its digest and its children.  A block is one row of bounded size; block digests are
the nodes of the next tier, so no row grows with the table.  On the way back each level is transformed into children
with the siblings before and after them and exploded, which gives the proofs; within a block nothing is joined, between
two tiers the few block rows meet the proofs of their own nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwise.llm.common import stored

ARITY = 8
#: Levels that one tier groups away: blocks of 8 ** 4 = 4 096 nodes.
DIGITS = 4
#: One level of a proof: digests of the siblings before and after the node; on = false where the node was the only one.
STEP = "struct<on: boolean, pre: string, post: string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``nodes`` with ``rank`` (from 0) by ``order`` within ``group`` (not null) and ``n``, the size of the group.

    Rows are dealt by range over group and order, with their place in the scan as the last key, so that neither a large
    group nor many equal rows meet in one task.  A row's rank is its place in its partition plus the rows of the group
    in earlier partitions; only one row per group and partition is joined.
    """
    wide = nodes.withColumn("__scan", F.monotonically_increasing_id())
    keys = [F.col(group), *(F.col(c).asc_nulls_first() for c in order), F.col("__scan")]
    dealt = wide.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    dealt = stored(dealt.drop("__scan").withColumn("__part", F.shiftright("__at", 33)), "merkle-ranked")
    runs = dealt.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    whole = Window.partitionBy(group)
    offsets = runs.select(group, "__part", "__first", F.sum("__rows").over(whole).alias("n"), F.coalesce(
        F.sum("__rows").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    got = dealt.join(offsets, [group, "__part"])
    return got.withColumn("rank", F.col("__before") + F.col("__at") - F.col("__first")).drop("__at", "__part", "__first", "__before")


def _nodes_at(n: Column, level: int) -> Column:
    """Nodes of a group of n at a level above: ceil(n / ARITY ** level)."""
    return F.ceil(n / F.lit(ARITY**level).cast("double")) if level else n


def rolled(nodes: DataFrame, group: str) -> DataFrame:
    """One tier: ``(group, rank, n, h, kids)``, a row per block, from ``(group, rank, n, h, pay)``.

    ``kids`` nests DIGITS levels of structs down to ``(digit, h, pay)``; levels above a group's only node keep its digest.
    """
    digits = [f"__d{i}" for i in range(DIGITS)]
    now = nodes.withColumn("__block", F.floor(F.col("rank") / ARITY**DIGITS))
    for i, d in enumerate(digits):
        now = now.withColumn(d, F.floor(F.col("rank") / ARITY**i) % ARITY)
    now = now.withColumn("kids", F.col("pay")).repartition(group, "__block")
    for i, d in enumerate(digits):
        above = [group, "n", "__block", *digits[i + 1:]]
        now = now.groupBy(*above).agg(F.sort_array(F.collect_list(F.struct(F.col(d).alias("digit"), "h", "kids"))).alias("kids"))
        now = now.withColumn("h", F.when(_nodes_at(F.col("n"), i) > 1, F.sha2(F.array_join("kids.h", "").cast("binary"), 256)).otherwise(F.col("kids")[0]["h"]))
    return now.select(group, F.col("__block").alias("rank"), F.ceil(F.col("n") / ARITY**DIGITS).alias("n"), F.col("n").alias("below"), "h", "kids")


def _child(on: Column):
    """A child of ``kids`` at place k, with the step from it to its parent."""
    def child(kid, k):
        pre = F.array_join(F.transform(F.slice("kids", F.lit(1), k), lambda x: x["h"]), "")
        post = F.array_join(F.transform(F.slice("kids", k + 2, F.lit(ARITY)), lambda x: x["h"]), "")
        step = F.struct(on.alias("on"), pre.alias("pre"), post.alias("post"))
        return F.struct(kid["digit"].alias("digit"), kid["h"].alias("h"), kid["kids"].alias("kids"), step.alias("step"))

    return child


def unrolled(blocks: DataFrame, group: str) -> DataFrame:
    """Back to the nodes of a tier: ``(group, rank, h, pay, path, head)`` from blocks with ``path``, the steps above the
    block, and ``head``, which is handed on to every node."""
    now = blocks.withColumn("at", F.col("rank"))
    for i in range(DIGITS - 1, -1, -1):
        children = F.transform("kids", _child(_nodes_at(F.col("below"), i) > 1))
        now = now.select(group, "below", "at", "path", "head", F.explode(children).alias("kid"))
        now = now.select(group, "below", "head", (F.col("at") * ARITY + F.col("kid.digit")).alias("at"),
                         F.concat(F.array("kid.step"), F.col("path")).alias("path"), F.col("kid.h").alias("h"), F.col("kid.kids").alias("kids"))
    return now.select(group, F.col("at").alias("rank"), "h", F.col("kids").alias("pay"), "path", "head")


def tiers(nodes: DataFrame, group: str) -> list[DataFrame]:
    """Blocks tier by tier, until each group is one node; every tier has a 4 096th of the rows of the one below."""
    out = []
    while not out or not out[-1].filter("n > 1").isEmpty():
        below = nodes if not out else out[-1].select(group, "rank", "n", "h", F.lit(0).alias("pay"))
        out.append(stored(rolled(below, group), f"merkle-tier{len(out)}"))
    return out


def proofs(levels: list[DataFrame], group: str, top: DataFrame) -> DataFrame:
    """``(group, rank, h, pay, path, head)`` of all nodes below ``levels``; ``top`` has ``group, path, head`` of each root."""
    now = unrolled(levels[-1].join(top, group), group)
    for blocks in reversed(levels[:-1]):
        now = unrolled(blocks.join(now.select(group, "rank", "path", "head"), [group, "rank"]), group)
    return now


def folded(leaf: Column, path: Column) -> Column:
    """Root recomputed from a leaf and its siblings, level by level."""
    return F.aggregate(path, leaf, lambda h, s: F.when(s["on"], F.sha2(F.concat(s["pre"], h, s["post"]).cast("binary"), 256)).otherwise(h))


def siblings_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["pre"], s["post"])), "").cast("binary"), 256)


def manifest(leaves: DataFrame) -> DataFrame:
    """Manifest of ``(group, doc_id, leaf, checked)``: one row per leaf with subroot, root, proof digest and verdict.

    ``group`` null first, then by its bytes; leaves of a group ascend by ``doc_id`` (null first), ties by digest.
    ``checked`` is the digest to verify, null: the leaf itself.  Equal rows are leaves of their own.  An empty table
    gives an empty manifest.
    """
    keyed = leaves.select(F.coalesce(F.concat(F.lit("+"), F.col("group")), F.lit("")).alias("key"), "doc_id", F.col("leaf").alias("h"), F.coalesce("checked", "leaf").alias("checked"))
    nodes = ranked(keyed, "key", ["doc_id", "h", "checked"])
    low = tiers(nodes.select("key", "rank", "n", "h", F.struct("doc_id", "checked").alias("pay")), "key")
    roots = low[-1].select(F.lit(0).alias("all"), "key", "h")
    high = tiers(ranked(roots, "all", ["key"]).select("all", "rank", "n", "h", F.struct("key").alias("pay")), "all")
    no_steps = F.array().cast(f"array<{STEP}>")
    top = proofs(high, "all", high[-1].select("all", no_steps.alias("path"), F.struct(F.col("h").alias("root")).alias("head")))
    top = stored(top.select(F.col("pay.key").alias("key"), "path", F.struct(F.col("h").alias("subroot"), "head.root").alias("head")), "merkle-top")
    got = proofs(low, "key", top).select(
        "pay.doc_id", F.col("h").alias("leaf"), "head.subroot", "head.root", siblings_digest(F.col("path")).alias("proof_sha256"),
        folded(F.col("pay.checked"), F.col("path")).alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


def leaf_digest(columns: list[Column]) -> Column:
    return digest(*[field(c) for c in columns])


def document_manifest(docs: DataFrame) -> DataFrame:
    """Manifest of documents by language.  Of the third whose id has a CRC-32 divisible by 3, the text with A-Z lowered is verified.

    Null fields are ``-``; a null id comes first in its language and is verified as it is; columns beside
    doc_id, source, lang, n_chars and text are no part of a leaf.
    """
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    other = F.when(tampered, leaf_digest([*head, lower_ascii(F.col("text"))]))
    return manifest(docs.select(F.col("lang").alias("group"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest([*head, F.col("text")]).alias("leaf"), other.alias("checked")))
