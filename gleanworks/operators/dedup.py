"""Exact and near duplicates, their groups and reports.

Groups come as one row per member with the id of its group, never as a list in one row, so a content that a third of
all files share is spread like any other rows. Ids of groups are their first member in order of code points.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.session import cut_lineage, salted_join, written_table


def shared_size(files: DataFrame, size: str = "size") -> DataFrame:
    """Files whose size occurs more than once; only these need to be hashed. A null size is shared with nothing."""
    several = files.groupBy(size).count().filter(F.col("count") > 1).select(size)
    return files.join(several, size, "left_semi")


def exact_duplicates(files: DataFrame, path: str = "path", size: str = "size", content: str = "content") -> DataFrame:
    """``hash, size, path, group_id, members``: files that are equal byte by byte.

    Files of a size that no other has are never hashed. Null contents are equal to nothing; a path listed twice with
    one content counts once; an empty table gives no row.
    """
    hashed = shared_size(files.filter(F.col(content).isNotNull()), size)
    hashed = hashed.select(F.sha2(content, 256).alias("hash"), F.col(size).alias("size"), F.col(path).alias("path")).distinct()
    groups = hashed.groupBy("hash").agg(F.min("path").alias("group_id"), F.count("*").alias("members")).filter("members > 1")
    return salted_join(hashed, groups, ["hash"], "path")


def duplicate_report(members: DataFrame) -> DataFrame:
    """Groups, and files that are redundant (all but one of each group)."""
    return members.agg(F.count_distinct("group_id").alias("group_count"), (F.count("*") - F.count_distinct("group_id")).alias("redundant_files"))


def sign_bits(vector: str) -> F.Column:
    """The signs of up to 64 numbers as one integer, the first number in the highest bit."""
    return F.expr(f"aggregate(transform({vector}, (v, i) -> if(v > 0, shiftleft(1L, int(63 - i)), 0L)), 0L, (a, b) -> a | b)")


def block_bounds(bits: int, blocks: int) -> list[int]:
    """Where bits are cut into nearly equal blocks (halves to even)."""
    return [round(bits * i / blocks) for i in range(blocks + 1)]


def _bit_masks(groups: list[list[int]]) -> list[int]:
    """Signed 64-bit numbers that have the bits of each group (0 is the lowest)."""
    masks = [sum(1 << i for i in bits) for bits in groups]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_pairs(signatures: DataFrame, key: str, signature: str, threshold: int, exact_blocks: int = 2, bits: int = 64, crowd: int = 10_000) -> DataFrame:
    """Pairs ``a, b, distance`` (a < b) of keys whose signatures differ in at most ``threshold`` bits.

    The signature is cut into ``threshold + exact_blocks`` blocks. Two that differ in so few bits agree in at least
    ``exact_blocks`` of them, so an equi-join on every choice of that many blocks finds all pairs, each at the first
    choice in which it agrees. More exact blocks make longer keys and fewer candidates at the price of more keys per row.
    A value of a choice that more than ``crowd`` signatures share is split exactly: the bits outside of the choice are
    cut into ``threshold + 1`` groups, of which such a pair agrees in one, and that group becomes part of the key.
    Null signatures match nothing; a key that has several signatures is compared with each.
    """
    if threshold < 0 or exact_blocks < 1 or threshold + exact_blocks > bits:
        raise ValueError("the threshold leaves no block to agree in")
    bounds = block_bounds(bits, threshold + exact_blocks)
    blocks = [list(range(bits - hi, bits - lo)) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    picks = [sorted(i for block in pick for i in block) for pick in combinations(blocks, exact_blocks)]
    outside = [[i for i in range(bits) if i not in set(pick)] for pick in picks]
    cuts = [block_bounds(len(rest), threshold + 1) for rest in outside]
    finer = [_bit_masks([rest[lo:hi] for lo, hi in zip(cut, cut[1:], strict=False)]) for rest, cut in zip(outside, cuts, strict=True)]
    number = lambda m: f"{m}L" if m != -(1 << 63) else "shiftleft(1L, 63)"
    masks, finer = list(map(number, _bit_masks(picks))), [list(map(number, g)) for g in finer]
    masked = lambda ms: "array(" + ", ".join(f"s & {m}" for m in ms) + ")"
    # plain cases, no lambdas: the first choice, and the first group of a choice, in which two signatures agree
    first_of = lambda ms: "case " + " ".join(f"when (s ^ s2) & {m} = 0 then {i}" for i, m in enumerate(ms)) + " end"
    rows = signatures.filter(F.col(signature).isNotNull()).select(F.col(key).alias("id"), F.col(signature).cast("bigint").alias("s")).distinct()
    rows = written_table(rows)  # read by the count and by both sides of the joins
    keyed = rows.select("id", "s", F.expr(f"posexplode({masked(masks)}) as (n, v)"))
    crowded = cut_lineage(keyed.groupBy("n", "v").count().filter(F.col("count") > crowd).select("n", "v"))
    near = F.expr(f"id < id2 and bit_count(s ^ s2) <= {threshold} and {first_of(masks)} = n")

    def pairs(side: DataFrame, on: list[str]) -> DataFrame:
        return side.join(side.select(F.col("id").alias("id2"), F.col("s").alias("s2"), *on), on).filter(near)

    found = pairs(keyed.join(crowded, ["n", "v"], "left_anti"), ["n", "v"]).select("id", "id2", "s", "s2")
    if not crowded.isEmpty():
        groups = "case n " + " ".join(f"when {n} then {masked(g)}" for n, g in enumerate(finer)) + " end"
        first = "case n " + " ".join(f"when {n} then {first_of(g)}" for n, g in enumerate(finer)) + " end"
        split = keyed.join(crowded, ["n", "v"], "left_semi").select("id", "s", "n", "v", F.expr(f"posexplode({groups}) as (g, w)"))
        found = found.unionByName(pairs(split, ["n", "v", "g", "w"]).filter(F.expr(f"{first} = g")).select("id", "id2", "s", "s2"))
    return found.select(F.col("id").alias("a"), F.col("id2").alias("b"), F.expr("bit_count(s ^ s2)").alias("distance"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """``node, component``: the least node that each node is connected with.

    In every round all nodes of one label take over the least label that any of them has for a neighbour, and then the
    label of the node of that name, so the number of rounds grows with the logarithm of the longest path. Rounds are
    cut by written tables, whose sizes are known (estimates carried through checkpoints grow with each join). Self-links
    are components of one; null ends are passed over.
    """
    both = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y"))
    links = written_table(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = written_table(links.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")))
    for _ in range(max_rounds):
        own, other = labels.select(F.col("node").alias("x"), "component"), labels.select(F.col("node").alias("y"), F.col("component").alias("m"))
        # what each node's label sees at best; links within a label show it nothing new
        seen = links.join(own, "x").join(other, "y").filter("m < component").groupBy("component").agg(F.min("m").alias("m"))
        step = labels.join(seen, "component", "left").select("node", F.col("component").alias("old"), F.coalesce("m", "component").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("further"))
        new = written_table(step.join(jump, "c").select("node", F.least("c", "further").alias("component"), "old"))
        labels = new.select("node", "component")
        if new.filter("component != old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def near_duplicate_groups(items: DataFrame, key: str, signature: str, threshold: int, exact_blocks: int = 2) -> DataFrame:
    """``path, group_id, members``: items connected by links of at most ``threshold`` differing bits.

    Equal signatures are one node, so copies are never paired with each other. Grouping is transitive.
    """
    known = written_table(items.filter(F.col(signature).isNotNull()).select(F.col(key).alias("path"), F.col(signature).alias("s")))
    nodes = known.select("s").distinct()
    pairs = near_pairs(nodes, "s", "s", threshold, exact_blocks)
    loops = nodes.select(F.col("s").alias("a"), F.col("s").alias("b"))
    parts = connected_components(pairs.select("a", "b").unionByName(loops))
    members = known.join(parts, known["s"] == parts["node"]).select("path", "component")
    groups = members.groupBy("component").agg(F.min("path").alias("group_id"), F.count("*").alias("members")).filter("members > 1")
    return salted_join(members, groups, ["component"], "path").select("path", "group_id", "members")


def identical(left: str, right: str) -> F.Column:
    """Whether two file structs (path, size, content) are the same file or equal in bytes; unreadable ones are not."""
    return F.expr(f"coalesce({left}.size = {right}.size and ({left}.path = {right}.path or sha2({left}.content, 256) = sha2({right}.content, 256)), false)")
