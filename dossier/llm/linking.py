"""Connected groups of links, and finding them without writing out the pairs of a large group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """The smallest node each node can reach (``node``, ``group``), of links ``a``, ``b`` (longs).

    Alternates large and small stars: each node hands its larger neighbours, then its smaller ones,
    to the smallest. The number of links never grows, no node's neighbours are collected, and the
    rounds are logarithmic in the length of the longest path. Nodes without links are left out.
    """
    edges = stored(_ordered(links.select("a", "b")), "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a"))
        stars = _ordered(large.select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        least = stars.groupBy("b").agg(F.min("a").alias("m"))
        small = stars.join(least, "b")
        old, edges = edges, stored(
            _ordered(
                small.select(F.col("a"), F.col("m").alias("b")).unionByName(
                    least.select(F.col("b").alias("a"), F.col("m").alias("b"))
                )
            ),
            "links",
        )
        discard(old)
        before, state = state, _state(edges)
        if state == before:
            break
    ends = edges.select(F.col("b").alias("node"), F.col("a").alias("group"))
    heads = edges.select(F.col("a").alias("node"), F.col("a").alias("group"))
    groups = stored(ends.unionByName(heads).distinct(), "groups")
    discard(edges)
    return groups


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links with the smaller end first."""
    return (
        links.filter(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    mixed = F.pmod(F.xxhash64("a", "b"), F.lit(2**31))
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mixed), F.sum(F.pmod("a", F.lit(2**31)))).first())


def linked_pairs(
    pairs: DataFrame, verified: Callable[[DataFrame], DataFrame], first: int = 2
) -> tuple[DataFrame, DataFrame]:
    """A written table of links, and the groups, of a written table of pairs that may have one.

    Two nodes already in one group need no link of their own. So ``first`` times one pair of each node
    is tried, and of the others those whose ends then are in two groups; at last all that remain.
    """
    rest, links, groups = pairs, None, None
    for left in reversed(range(first + 1)):
        some = rest if left == 0 else stored(
            rest.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "some"
        )
        found = verified(some).select("a", "b")
        before, old, tried = links, groups, rest
        links = stored(found if links is None else links.unionByName(found), "links")
        groups = components(links)
        if left:
            others = rest.join(some, ["a", "b"], "left_anti")
            rest = stored(_between(others, groups), "rest")
            discard(some)
        discard(*[t for t in (before, old, None if tried is pairs else tried) if t is not None])
        if left and rest.isEmpty():
            discard(rest)
            break
    return links, groups


def _between(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose ends are in two groups."""
    x = groups.select(F.col("node").alias("a"), F.col("group").alias("_a"))
    y = groups.select(F.col("node").alias("b"), F.col("group").alias("_b"))
    return (
        pairs.join(x, "a", "left")
        .join(y, "b", "left")
        .filter(F.coalesce("_a", "a") != F.coalesce("_b", "b"))
        .select("a", "b")
    )


def linked_groups(
    members: DataFrame,
    rank: Column,
    fits: Callable[[str, str], Column],
    verified: Callable[[DataFrame], DataFrame],
    stars: int = 2,
    links: DataFrame | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Groups of nodes that are linked by way of others: ``node``, ``group``.

    ``members``: a row per node and bucket (``bucket``, ``node``, and what ``fits`` reads); any two
    nodes with a link share a bucket. ``fits`` tells of two members of a bucket, by the prefixes of
    their columns, whether they may have a link; ``verified`` keeps the true links of the pairs
    (``a``, ``b``) it is given. ``links``: a written table of links known before, ``groups`` their
    groups if these are known too.

    Two nodes already in one group need no link of their own. So each bucket first tries its first
    member by ``rank`` against the others, which costs a row per member; the members that then are
    in another group than the first do the same among themselves; and at last those meet every
    member in a group other than theirs. No link between different groups is missed.
    """
    columns = [c for c in members.columns if c != "bucket"]
    groups = components(links) if groups is None and links is not None else groups
    for _ in range(stars):
        open_members, grouped = (members, None) if groups is None else _outside(members, rank, groups)
        first = open_members.groupBy("bucket").agg(
            F.min(F.struct(rank.alias("rank"), *columns)).alias("x"), F.count(F.lit(1)).alias("n")
        )
        first = first.filter("n > 1").select(
            "bucket", *[F.col(f"x.{c}").alias(f"a_{c}") for c in columns]
        )
        met = first.join(_named(open_members, "b_", columns), "bucket")
        links, groups = _more(links, groups, met, fits, verified)
        if grouped is not None:
            discard(grouped)
    outside, grouped = _outside(members, rank, groups)
    outside = _named(outside, "a_", [*columns, "group"])
    everyone = _named(grouped, "b_", [*columns, "group"])
    met = outside.join(everyone, "bucket").filter("a_group <> b_group")
    groups = _more(links, groups, met, fits, verified)[1]
    discard(grouped)
    return groups


def _named(rows: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return rows.select("bucket", *[F.col(c).alias(f"{prefix}{c}") for c in columns])


def _grouped(members: DataFrame, groups: DataFrame) -> DataFrame:
    return members.join(groups, "node", "left").withColumn(
        "group", F.coalesce("group", "node")
    )


def _outside(members: DataFrame, rank: Column, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members in another group than their bucket's first member, and the table of all with groups."""
    grouped = stored(_grouped(members, groups), "members")
    first = (
        grouped.groupBy("bucket")
        .agg(
            F.min(F.struct(rank.alias("rank"), "node", "group")).alias("x"),
            F.min("group").alias("low"),
            F.max("group").alias("high"),
        )
        .filter("low <> high")
        .select("bucket", F.col("x.group").alias("first"))
    )
    return grouped.join(first, "bucket").filter("group <> first").select(*grouped.columns), grouped


def _more(
    links: DataFrame | None, groups: DataFrame | None, met: DataFrame, fits, verified
) -> tuple[DataFrame, DataFrame]:
    """All links with the true ones of the pairs that met, and their groups."""
    pairs = stored(_ordered(
        met.filter(fits("a_", "b_")).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    ), "pairs")
    if links is not None and pairs.isEmpty():
        discard(pairs)
        return links, groups
    found = verified(pairs).select("a", "b")
    both = stored(found if links is None else links.unionByName(found), "found")
    discard(pairs)
    return both, components(both)
