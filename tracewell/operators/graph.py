"""The evidence graph of every claim: nodes, edges, reachability, summary, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions.text import round3
from tracewell.operators.compare import valid_occurrence
from tracewell.operators.evidence import unique_evidence
from tracewell.operators.versions import best_versions
from tracewell.session import cut

CLAIM_NODE = "submitted-claim"


def source_nodes(versions: DataFrame, snaps: DataFrame) -> DataFrame:
    """One node per source whose best version is bound to one of its passages."""
    source = snaps.select(
        "claim_id", "source_id", "published_at", "date_confidence", "passages",
        F.coalesce("canonical_url", "final_url", "original_url").alias("url"),
    )
    bound = best_versions(versions).join(source, ["claim_id", "source_id"]).filter(
        F.exists("passages", lambda p: p["passage_id"] == F.col("evidence_passage_id")))
    return bound.select(
        "claim_id", F.concat(F.lit("node:"), "source_id").alias("node_id"), "source_id",
        F.lit("source").alias("kind"), "claim", "url", F.col("published_at").alias("date"), "date_confidence",
        F.array_distinct(F.concat(F.array("source_id"), "evidence_ids")).alias("evidence_ids"),
    )


def submitted_nodes(claims: DataFrame, occurrences: DataFrame) -> DataFrame:
    """One node per claim: its valid occurrence, else the bare claim.

    ``claims`` may name the claim's own ``evidence_id``.
    """
    valid = occurrences.filter(valid_occurrence()).select(
        "claim_id", F.col("occurrence_id").alias("_o"), F.col("exact_text").alias("_text"),
        F.col("source_url").alias("_url"), F.col("observed_at").alias("_date"),
        F.col("confidence").alias("_sure"), F.col("evidence_ids").alias("_ids"),
    )
    own = F.array_compact(F.array("evidence_id")) if "evidence_id" in claims.columns else F.array().cast("array<string>")
    has = F.col("_o").isNotNull()
    ident = F.coalesce("_o", F.lit(CLAIM_NODE))
    return claims.join(valid, "claim_id", "left").select(
        "claim_id", F.concat(F.lit("node:"), ident).alias("node_id"), ident.alias("source_id"),
        F.when(has, "submitted_occurrence").otherwise("submitted_claim").alias("kind"),
        F.when(has, F.col("_text")).otherwise(F.trim("claim")).alias("claim"),
        F.col("_url").alias("url"), F.col("_date").alias("date"),
        F.when(F.col("_date").isNotNull(), F.col("_sure")).otherwise(0.0).alias("date_confidence"),
        F.when(has, F.array_distinct("_ids")).otherwise(own).alias("evidence_ids"),
    )


def nodes(claims: DataFrame, versions: DataFrame, snaps: DataFrame, occurrences: DataFrame) -> DataFrame:
    return source_nodes(versions, snaps).unionByName(submitted_nodes(claims, occurrences))


def evidence_valid(items: Column, origin: Column, target: Column) -> Column:
    """Evidence shows the earlier text, the later text or occurrence, and the relationship."""
    filled = lambda e: (F.trim(e["passage_id"]) != "") & (F.trim(e["exact_text"]) != "")
    return F.coalesce(
        F.exists(items, lambda e: (e["source_id"] == origin) & (e["role"] == "before") & filled(e))
        & F.exists(items, lambda e: (e["source_id"] == target) & e["role"].isin("after", "occurrence") & filled(e))
        & F.exists(items, lambda e: e["role"].isin(*K.RELATION_ROLES) & filled(e)),
        F.lit(False),
    )


def derive_edges(comparisons: DataFrame, mutations: DataFrame) -> DataFrame:
    """Edges of comparisons that state a transmission: one per mutation, else one alone."""
    linked = comparisons.filter(
        F.col("relationship.type").isin(*K.TRANSMISSION_TYPES)
        & (F.col("relationship.status") != "insufficient_evidence"))
    changed = mutations.select(
        "claim_id", "from_source_id", "to_source_id", F.col("mutation_type"),
        F.col("confidence").alias("mutation_confidence"), F.col("status").alias("_mstatus"),
        F.col("evidence").alias("_mevidence"),
    )
    rows = linked.join(changed, ["claim_id", "from_source_id", "to_source_id"], "left").withColumn(
        "evidence", unique_evidence(F.concat(
            F.col("relationship.evidence"),
            F.coalesce("_mevidence", F.array().cast(comparisons.schema["relationship"].dataType["evidence"].dataType)))),
    ).filter(evidence_valid(F.col("evidence"), F.col("from_source_id"), F.col("to_source_id")))
    established = (
        (F.col("relationship.status") == "established") & (F.col("status") == "established")
        & F.coalesce(F.col("_mstatus") == "established", F.lit(True))
    )
    return rows.select(
        "claim_id",
        F.concat_ws(":", F.lit("edge"), "comparison_id", F.coalesce("mutation_type", "relationship.type")).alias("edge_id"),
        "from_source_id", "to_source_id", F.col("relationship.type").alias("relationship"),
        F.when(established, "established").otherwise("candidate").alias("status"),
        "mutation_type", "mutation_confidence",
        F.array_distinct(F.transform("evidence", lambda e: e["passage_id"])).alias("evidence_ids"), "evidence",
        round3(F.least(
            F.col("relationship.confidence"), F.col("confidence"), F.coalesce("mutation_confidence", F.lit(1.0))
        )).alias("confidence"),
    )


def edges(comparisons: DataFrame, mutations: DataFrame, node_table: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes; nothing may point at a bare claim."""
    known = node_table.select("claim_id", "source_id")
    ends = node_table.filter(F.col("kind") != "submitted_claim").select(
        "claim_id", F.col("source_id").alias("to_source_id"))
    return (
        derive_edges(comparisons, mutations)
        .join(known.withColumnRenamed("source_id", "from_source_id"), ["claim_id", "from_source_id"], "left_semi")
        .join(ends, ["claim_id", "to_source_id"], "left_semi")
    )


def reachable(edge_table: DataFrame, seeds: DataFrame, backward: bool = True) -> DataFrame:
    """All nodes connected to the seeds along directed edges, all graphs at once.

    ``edge_table(graph_id, source, target)``, ``seeds(graph_id, node)``; result adds ``hop``.
    Each round joins only the last frontier, drops nodes already seen, and is checkpointed,
    so neither the plan nor the recomputation after a lost executor grows with the depth.
    It ends when a round finds nothing new, at any depth.  Links lie in the partitioning of
    that join, so that a round moves only its frontier.
    """
    near, far = ("target", "source") if backward else ("source", "target")
    links = cut(
        edge_table.select("graph_id", F.col(near).alias("node"), F.col(far).alias("_next")).distinct()
        .repartition("graph_id", "node"))
    frontier = cut(seeds.select("graph_id", "node").distinct().withColumn("hop", F.lit(0)))
    seen = frontier
    hop = 0
    while not frontier.isEmpty():
        hop += 1
        step = (
            links.join(frontier.select("graph_id", "node"), ["graph_id", "node"])
            .select("graph_id", F.col("_next").alias("node")).distinct()
            .join(seen.select("graph_id", "node"), ["graph_id", "node"], "left_anti")
            .withColumn("hop", F.lit(hop))
        )
        frontier = cut(step)
        seen = seen.unionByName(frontier)
        if hop % 8 == 0:
            seen = cut(seen)
    return seen


def ancestors(edge_table: DataFrame, node_table: DataFrame) -> DataFrame:
    """Sources that reach a claim's valid occurrence over established edges."""
    links = edge_table.filter(
        (F.col("status") == "established")
        & evidence_valid(F.col("evidence"), F.col("from_source_id"), F.col("to_source_id"))
    ).select(F.col("claim_id").alias("graph_id"), F.col("from_source_id").alias("source"),
             F.col("to_source_id").alias("target"))
    seeds = node_table.filter(F.col("kind") == "submitted_occurrence").select(
        F.col("claim_id").alias("graph_id"), F.col("source_id").alias("node"))
    return reachable(links, seeds).select(
        F.col("graph_id").alias("claim_id"), F.col("node").alias("source_id"), "hop")


def summarize(node_table: DataFrame, edge_table: DataFrame, reached: DataFrame) -> DataFrame:
    """One row per claim: how much of the graph is established and reaches the occurrence."""
    marked = reached.select("claim_id", F.col("source_id"), F.lit(True).alias("_in"))
    per_node = node_table.join(marked, ["claim_id", "source_id"], "left").groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.bool_or(F.col("kind") == "submitted_occurrence").alias("_has_occurrence"),
        F.count_if(F.col("_in")).alias("_reached"),
    )
    end = lambda c: marked.withColumnsRenamed({"source_id": c, "_in": f"_{c}"})
    both = edge_table.join(end("from_source_id"), ["claim_id", "from_source_id"], "left").join(
        end("to_source_id"), ["claim_id", "to_source_id"], "left")
    from_in = F.coalesce("_from_source_id", F.lit(False))
    to_in = F.coalesce("_to_source_id", F.lit(False))
    established = F.col("status") == "established"
    micro = F.round(F.col("confidence") * F.lit(1e6)).cast("bigint")  # exact in any order
    per_pair = both.groupBy("claim_id", "from_source_id", "to_source_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(micro).alias("_sum"),
        F.count_if(from_in & to_in).alias("_n_in"),
        F.sum(F.when(from_in & to_in, micro)).alias("_sum_in"),
        F.bool_or(established & to_in).alias("_transition"),
        F.bool_or(from_in & ~established).alias("_provisional"),
    )
    per_edge = per_pair.groupBy("claim_id").agg(
        F.sum("_n").alias("edges"), F.sum("_sum").alias("_sum"), F.sum("_n_in").alias("_n_in"),
        F.sum("_sum_in").alias("_sum_in"), F.count_if("_transition").alias("_transitions"),
        F.bool_or("_provisional").alias("_provisional"),
    )
    rows = per_node.join(per_edge, "claim_id", "left").withColumns({
        "edges": F.coalesce("edges", F.lit(0)).cast("bigint"),
        "required_transitions": F.greatest(F.lit(1), F.col("nodes") - 1).cast("bigint"),
        "connected": F.col("_has_occurrence") & (F.col("_reached") > 1),
    })
    complete = (
        F.col("connected") & (F.col("_reached") == F.col("nodes"))
        & (F.coalesce("_transitions", F.lit(0)) >= F.col("required_transitions"))
        & ~F.coalesce("_provisional", F.lit(False))
    )
    relevant = F.when(F.col("_has_occurrence"), F.col("_sum_in") / (F.nullif(F.col("_n_in"), F.lit(0).cast("bigint")) * 1000)).otherwise(
        F.col("_sum") / (F.nullif(F.col("edges"), F.lit(0).cast("bigint")) * 1000))
    return rows.select(
        "claim_id", "nodes", "edges",
        F.when(complete, "established").when(F.col("edges") > 0, "candidate")
        .otherwise("insufficient_evidence").alias("status"),
        (F.floor(relevant + F.lit(0.5)) / F.lit(1000.0)).alias("confidence"), "connected",
        F.when(F.col("connected"), F.coalesce("_transitions", F.lit(0))).otherwise(0).cast("bigint").alias("established_transitions"),
        "required_transitions",
    )


def degrees(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """In- and out-degree of every node; a node without either is isolated."""
    out = edge_table.groupBy("claim_id", F.col("from_source_id").alias("source_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    in_ = edge_table.groupBy("claim_id", F.col("to_source_id").alias("source_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    keys = ["claim_id", "source_id"]
    return node_table.select(*keys).join(in_, keys, "left").join(out, keys, "left").select(
        *keys, F.coalesce("in_degree", F.lit(0)).cast("bigint").alias("in_degree"),
        F.coalesce("out_degree", F.lit(0)).cast("bigint").alias("out_degree"),
        (F.col("in_degree").isNull() & F.col("out_degree").isNull()).alias("isolated"),
    )


def levels(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Longest-path level of every node, all graphs at once.

    ``node_table(graph_id, node)``, ``edge_table(graph_id, source, target)``; links to or from other nodes play no part.
    Nodes are peeled: one whose last incoming link has been followed gets its level, and its own links are followed in the
    next round.  A round moves the links of the nodes that the one before has freed, and nodes that still wait for others;
    there are as many rounds as levels.  Graphs with a node that can not be peeled, behind a cycle, are done by
    ``levels_in_rounds``.
    """
    keys = ["graph_id", "node"]
    nodes = cut(node_table.select(*keys).distinct())
    end = lambda c: nodes.select("graph_id", F.col("node").alias(c))
    links = cut(edge_table.select("graph_id", "source", "target").distinct().join(end("target"), ["graph_id", "target"], "left_semi")
                .join(end("source"), ["graph_id", "source"], "left_semi").repartition("graph_id", "source"))
    need = cut(links.groupBy("graph_id", F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("_need")).repartition(*keys))
    frontier = cut(nodes.join(need, keys, "left_anti").withColumn("level", F.lit(0).cast("bigint")))
    done, waiting, number = frontier, None, 0
    while not frontier.isEmpty():
        number += 1
        met = links.join(frontier.select("graph_id", F.col("node").alias("source"), "level"), ["graph_id", "source"]).select(
            "graph_id", F.col("target").alias("node"), F.lit(1).cast("bigint").alias("_met"), (F.col("level") + 1).alias("level"))
        met = (met if waiting is None else met.unionByName(waiting)).groupBy(*keys).agg(
            F.sum("_met").alias("_met"), F.max("level").alias("level"))
        touched = cut(met.join(need, keys))
        frontier = touched.filter("_met = _need").select(*keys, "level")
        waiting = touched.filter("_met < _need").drop("_need")
        done = done.unionByName(frontier)
        if number % 8 == 0:
            done = cut(done)
    done = cut(done)
    tangled = cut(nodes.join(done, keys, "left_anti").select("graph_id").distinct())
    if tangled.isEmpty():
        return done
    return done.join(tangled, "graph_id", "left_anti").unionByName(levels_in_rounds(
        nodes.join(tangled, "graph_id", "left_semi"), links.join(tangled, "graph_id", "left_semi")))


def levels_in_rounds(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Levels of graphs that may have cycles.

    A node's level rises at most once per round; a graph stops rising after as many rounds as it has nodes, which also ends
    cycles.
    """
    links = cut(edge_table.select("graph_id", "source", "target").distinct())
    sizes = node_table.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_size"))
    state = cut(node_table.select("graph_id", "node").distinct().join(sizes, "graph_id").withColumn("level", F.lit(0)))
    active, number = state, 0
    while not active.isEmpty():
        number += 1
        raised = (
            links.join(active.select("graph_id", F.col("node").alias("source"), "level"), ["graph_id", "source"])
            .groupBy("graph_id", F.col("target").alias("node")).agg((F.max("level") + 1).alias("_new"))
        )
        higher = (F.col("_new") > F.col("level")) & (F.col("_size") >= number)
        state = cut(
            state.drop("_moved").join(raised, ["graph_id", "node"], "left")
            .withColumn("_moved", F.coalesce(higher, F.lit(False)))
            .withColumn("level", F.when(F.col("_moved"), F.col("_new")).otherwise(F.col("level")))
            .drop("_new")
        )
        active = state.filter("_moved")
    return state.select("graph_id", "node", F.col("level").cast("bigint").alias("level"))


