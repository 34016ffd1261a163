"""Entity resolution: files, their bytes and the names a catalog gives them, as connected components.

A catalog row may name several files, several rows may name one, and files may be equal byte by
byte.  Files, hashes and names are the nodes of a graph; what hangs together is one paper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators.catalog import match_artifacts
from lectern.session import settle


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of ``edges (a, b)``: the smallest node that hangs together with it.

    Every node points at a smaller one.  In a round a node, and the one it points at, take the
    smallest pointer among their neighbours, then pointers skip one step; all are minima that
    combine before the shuffle.  It ends when no pointer moves.
    """
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    held = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("to")))
    while True:
        near = both.join(held.select(F.col("node").alias("b"), "to"), "b").groupBy(F.col("a").alias("node")).agg(F.min("to").alias("near"))
        seen = held.join(near, "node")
        hooked = seen.groupBy(F.col("to").alias("node")).agg(F.min("near").alias("hook"))
        moved = settle(seen.join(hooked, "node", "left").select("node", F.col("to").alias("before"), F.least("to", "near", "hook").alias("to")))
        skipped = moved.select(F.col("node").alias("to"), F.col("to").alias("further"))
        held = settle(moved.join(skipped, "to").select("node", "before", F.col("further").alias("to")))
        if held.where("before <> to").isEmpty():
            return held.select("node", F.col("to").alias("component"))
        held = held.drop("before")


def resolve(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """``source_path, component, paper_id`` of the files that the catalog names.

    ``entries`` has ``(catalog_id, line_no, record_id, artifacts)`` and ``listing`` every
    ``(source_path, content_hash)``.  A component takes the record of the first row that names it
    and nothing else; files that only stand in rows together with others take the slug of their
    shallowest, first path.  Names that fit no file, or several, join nothing.
    """
    named = entries.select("catalog_id", "line_no", "record_id", F.explode("artifacts").alias("artifact"))
    matched = settle(match_artifacts(named.select("artifact"), listing.select("source_path")).where("artifact IS NOT NULL"))
    path, name = F.concat(F.lit("path:"), "source_path"), F.concat(F.lit("name:"), "artifact")
    edges = listing.select(path.alias("a"), F.concat(F.lit("hash:"), "content_hash").alias("b")).unionByName(matched.select(name.alias("a"), path.alias("b")))
    found = settle(components(edges).where(F.col("node").startswith("path:") | F.col("node").startswith("name:")))
    rows = named.join(found.select(F.expr("substring(node, 6)").alias("artifact"), "component", F.col("node").startswith("name:").alias("is_name")).where("is_name"), "artifact")
    single = rows.groupBy("catalog_id", "line_no", "record_id").agg(F.min("component").alias("component"), F.max("component").alias("last")).where("component = last AND record_id IS NOT NULL")
    records = single.groupBy("component").agg(F.min_by("record_id", F.struct("catalog_id", "line_no")).alias("record_id"))
    paths = found.where(F.col("node").startswith("path:")).select(F.expr("substring(node, 6)").alias("source_path"), "component")
    order = F.struct(tx.depth(F.col("source_path")).alias("depth"), tx.casefold(F.col("source_path")).alias("folded"), F.col("source_path").alias("path"))
    first = paths.groupBy("component").agg(F.min(order).getField("path").alias("first_path"))
    wanted = rows.select("component").distinct()
    return paths.join(wanted, "component", "left_semi").join(first, "component").join(records, "component", "left").select(
        "source_path", "component", F.coalesce("record_id", tx.record_slug(tx.stem(F.col("first_path")))).alias("paper_id")
    )
