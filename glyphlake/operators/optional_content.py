"""Optional content: whether nodes are hidden for a destination, and counters of references.

Unknown is strict: a node is unknown (null) if any operand is, unlike SQL's three-valued logic. Nodes on a cycle, or more than
DEPTH levels up, are unknown too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.operators.steps import settled

DEPTH = 64
DESTINATIONS = ["view", "print", "export"]


def group_hidden(state, enabled):
    """A group's state for a destination decides; without one, whether it is enabled."""
    return F.when(state == "OFF", True).when(state == "ON", False).otherwise(~enabled)


def combine(kind: str, members: DataFrame) -> DataFrame:
    """(file_id, node, destination, hidden) of nodes whose members are all known or known to be unknown.

    members: file_id, node, destination, op (policy or operator), hidden (of a member; null: unknown), with no row for a node
    without members. Policies: AnyOn (hidden if no member is visible), AllOn, AnyOff, AllOff. Operators: And, Or, Not.
    """
    by = members.groupBy("file_id", "node", "destination").agg(F.first("op").alias("op"), F.count("*").alias("n"), F.count_if(F.col("hidden").isNull()).alias("unknown"), F.count_if("hidden").alias("off"))
    on = F.col("n") - F.col("off")
    if kind == "membership":
        value = F.when(F.col("op") == "AllOn", F.col("off") > 0).when(F.col("op") == "AnyOff", F.col("off") == 0).when(F.col("op") == "AllOff", on > 0).otherwise(on == 0)
    else:
        value = F.when(F.col("op") == "And", F.col("off") > 0).when(F.col("op") == "Or", on == 0).when((F.col("op") == "Not") & (F.col("n") == 1), on == 1)
    return by.select("file_id", "node", "destination", F.when(F.col("unknown") == 0, value).alias("hidden"))


def evaluate(nodes: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(file_id, node, destination, hidden) for all nodes and destinations, from the groups upward.

    nodes: file_id, node, kind (group, membership, expr), policy, op, enabled, view_state, print_state, export_state; edges:
    file_id, parent, ordinal, child. Level by level, a node is evaluated when all its members are; what is never reached
    (cycles, missing children, beyond depth) stays unknown. A membership without members is visible; an expression without
    operands, or with another operator, is unknown.
    """
    each = nodes.select("file_id", "node", "kind", F.when(F.col("kind") == "membership", F.coalesce("policy", F.lit("AnyOn"))).otherwise(F.col("op")).alias("op"), "enabled", F.explode(F.array(*(F.struct(F.lit(d).alias("destination"), F.col(f"{d}_state").alias("state")) for d in DESTINATIONS))).alias("s")).select("file_id", "node", "kind", "op", "enabled", "s.*")
    links = edges.select("file_id", F.col("parent").alias("node"), F.col("child"), "ordinal")
    childless = each.join(links.select("file_id", "node").distinct(), ["file_id", "node"], "left_anti")
    known = each.filter("kind = 'group'").select("file_id", "node", "destination", group_hidden(F.col("state"), F.col("enabled")).alias("hidden"))
    known = known.unionByName(childless.filter("kind = 'membership'").select("file_id", "node", "destination", F.lit(False).alias("hidden")))
    known = settled(known)
    pending = settled(each.filter("kind != 'group'").join(known.select("file_id", "node").distinct(), ["file_id", "node"], "left_anti"))
    for _ in range(depth):
        child = known.select("file_id", F.col("node").alias("child"), "destination", "hidden", F.lit(1).alias("seen"))
        members = pending.join(links, ["file_id", "node"]).join(child, ["file_id", "child", "destination"], "left")
        ready = members.groupBy("file_id", "node", "destination").agg(F.count("*").alias("n"), F.count("seen").alias("m")).filter("n = m").select("file_id", "node", "destination")
        ready = members.join(ready, ["file_id", "node", "destination"], "left_semi")
        new = settled(combine("membership", ready.filter("kind = 'membership'")).unionByName(combine("expr", ready.filter("kind = 'expr'"))))
        if new.isEmpty():
            break
        known = known.unionByName(new)
        pending = settled(pending.join(new.select("file_id", "node").distinct(), ["file_id", "node"], "left_anti"))
    unknown = each.join(known.select("file_id", "node", "destination"), ["file_id", "node", "destination"], "left_anti")
    return known.unionByName(unknown.select("file_id", "node", "destination", F.lit(None).cast("boolean").alias("hidden")))


def reference_counters(refs: DataFrame, nodes: DataFrame, hidden: DataFrame) -> DataFrame:
    """Counters by page of references (file_id, page_number, ref_no, node). A null reference adds three failures and isn't counted as a reference; such are also counted apart."""
    wide = hidden.groupBy("file_id", "node").pivot("destination", DESTINATIONS).agg(F.first("hidden"))
    rows = refs.join(nodes.select("file_id", "node", "kind"), ["file_id", "node"], "left").join(wide, ["file_id", "node"], "left")
    real = F.col("node").isNotNull()
    failures = F.when(real, sum(F.col(d).isNull().cast("bigint") for d in DESTINATIONS)).otherwise(3)
    return rows.groupBy("file_id", "page_number").agg(
        F.count_if(real).alias("reference_count"), F.count_if(F.coalesce(F.col("kind") == "membership", F.lit(False))).alias("membership_reference_count"),
        *(F.count_if(real & F.coalesce(F.col(d), F.lit(False))).alias(f"hidden_in_{d}_count") for d in DESTINATIONS),
        F.sum(failures).cast("bigint").alias("evaluation_failure_count"), F.count_if(~real).alias("null_reference_count"),
    ).withColumn("complete", F.col("evaluation_failure_count") == 0)
