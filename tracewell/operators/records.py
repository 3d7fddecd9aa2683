"""The curated library: loading, checks, signals, curated paths and advice.

A record is one row with its authored lists nested inside (hops, relationships, sources):
these are short, hand-written lists, so path and level computations fold over them in the
row and never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions.dates import strict_date
from tracewell.functions.text import let
from tracewell.functions.urls import has_credentials, has_specific_target, is_bare_origin, is_web_url

SOURCE = (
    "struct<publisher: string, url: string, published_date: string, source_type: string, availability: string, "
    "is_primary: boolean, evidence_description: string>"
)
RECORD = (
    "record_id string, canonical_claim string, aliases array<string>, verdict string, topic string, region string, "
    "dataset_provenance string, "
    f"origin struct<source: string, date: string, what_actually_happened: string, sources: array<{SOURCE}>>, "
    f"hops array<struct<type: string, text: string, what_changed: string, why_it_matters: string, sources: array<{SOURCE}>>>, "
    "relationships array<struct<from_node_id: string, to_node_id: string, relationship: string, status: string, "
    "confidence: double, mutation_type: string, reason: string>>, "
    "scores map<string, int>, lesson string"
)


def read_records(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Authored records from JSON or Parquet files, with the expected schema."""
    return spark.read.schema(RECORD).format(fmt).load(path)


def availability(url: Column) -> Column:
    """Whether a source links to an item, only names a body, or links to nothing."""
    return F.when(url.isNull(), "unavailable").when(is_bare_origin(url), "organisation_only").otherwise("linked")


def _complete_source(s: Column) -> Column:
    return F.struct(
        s["publisher"].alias("publisher"), s["url"].alias("url"), s["published_date"].alias("published_date"),
        s["source_type"].alias("source_type"),
        F.coalesce(s["availability"], availability(s["url"])).alias("availability"),
        F.coalesce(s["is_primary"], F.lit(False)).alias("is_primary"),
        s["evidence_description"].alias("evidence_description"),
    )


def _sources(items: Column) -> Column:
    return F.transform(F.coalesce(items, F.array().cast(f"array<{SOURCE}>")), _complete_source)


def load_records(authored: DataFrame) -> DataFrame:
    """Complete authored records: hop numbers, predecessors, sources, relationship ids.

    A hop's predecessor is the one its last authored relationship names; the order of the
    hops never implies one.
    """
    def predecessor(number: Column) -> Column:
        target = F.concat(F.lit("hop-"), number.cast("string"))
        last = F.try_element_at(F.filter("relationships", lambda r: r["to_node_id"] == target), F.lit(-1))
        source = F.substring(last["from_node_id"], 5, 20).try_cast("int")
        return F.when(
            last["from_node_id"] == "origin", F.col("origin.what_actually_happened")
        ).otherwise(F.when(source >= 1, F.try_element_at("hops", source)["text"]))

    hops = F.transform("hops", lambda h, i: F.struct(
        (i + 1).alias("hop"), h["type"].alias("type"), h["text"].alias("text"), h["what_changed"].alias("what_changed"),
        predecessor(i + 1).alias("previously"), h["text"].alias("now"), h["why_it_matters"].alias("why_it_matters"),
        _sources(h["sources"]).alias("sources"),
    ))
    target_hop = lambda r: F.substring(r["to_node_id"], 5, 20).try_cast("int")
    relationships = F.transform("relationships", lambda r, i: F.struct(
        F.concat_ws(":", F.lit("curated"), "record_id", F.lit("relationship"), (i + 1).cast("string")).alias("id"),
        r["from_node_id"].alias("from_node_id"), r["to_node_id"].alias("to_node_id"),
        r["relationship"].alias("relationship"), r["status"].alias("status"), r["confidence"].alias("confidence"),
        r["mutation_type"].alias("mutation_type"), r["reason"].alias("reason"),
        _sources(F.when(target_hop(r) >= 1, F.try_element_at("hops", target_hop(r))["sources"])).alias("sources"),
    ))
    filled = authored.withColumns({
        "aliases": F.coalesce("aliases", F.array().cast("array<string>")),
        "hops": F.coalesce("hops", F.array().cast(authored.schema["hops"].dataType)),
        "relationships": F.coalesce("relationships", F.array().cast(authored.schema["relationships"].dataType)),
    })
    return filled.withColumns({
        "hops": hops, "relationships": relationships,
        "origin": F.struct(
            F.col("origin.source").alias("source"), F.col("origin.date").alias("date"),
            F.col("origin.what_actually_happened").alias("what_actually_happened"),
            _sources(F.col("origin.sources")).alias("sources")),
    })


def validate_records(authored: DataFrame) -> DataFrame:
    """Broken references: unknown ends, self-loops, duplicate record ids."""
    known = lambda node: (
        F.substring(node, 5, 20).try_cast("int").between(1, F.size("hops")) & node.startswith("hop-"))
    problem = lambda r: (
        F.when(~F.coalesce(known(r["to_node_id"]), F.lit(False)), "missing_target")
        .when((r["from_node_id"] != "origin") & ~F.coalesce(known(r["from_node_id"]), F.lit(False)), "missing_source")
        .when(r["from_node_id"] == r["to_node_id"], "self_loop"))
    broken = authored.select("record_id", F.posexplode("relationships").alias("position", "_r"), "hops").select(
        "record_id", (F.col("position") + 1).alias("position"), problem(F.col("_r")).alias("violation"))
    doubled = authored.groupBy("record_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        "record_id", F.lit(0).alias("position"), F.lit("duplicate_id").alias("violation"))
    return broken.filter(F.col("violation").isNotNull()).unionByName(doubled)


def list_records(records: DataFrame) -> DataFrame:
    """The library's summaries."""
    return records.select(
        "record_id", "canonical_claim", "verdict", "topic", "region", "dataset_provenance",
        F.col("origin.source").alias("origin_source"), F.col("origin.date").alias("origin_date"),
        F.size("hops").cast("bigint").alias("hop_count"), "lesson",
    )


def get_record(records: DataFrame, record_id) -> DataFrame:
    """One record; the filter reaches the scan."""
    return records.filter(F.col("record_id") == record_id)


def lookup_records(requests: DataFrame, records: DataFrame) -> DataFrame:
    """A record for every request; a null ``record_id`` where the library has none."""
    found = records.withColumn("_known", F.col("record_id"))
    return requests.join(found, "record_id", "left").withColumn("record_id", F.col("_known")).drop("_known")


def usable_citation(s: Column) -> Column:
    """A linked, described citation of a specific web page without credentials."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    target = is_web_url(s["url"]) & ~has_credentials(s["url"]) & has_specific_target(s["url"])
    return F.coalesce(
        (s["availability"] == "linked") & ~blank(s["publisher"]) & ~blank(s["evidence_description"]) & target,
        F.lit(False))


# ---------------------------------------------------------------- signals and advice

def signals(records: DataFrame) -> DataFrame:
    """Five signals per record, explained only by mutations that are in the record."""
    wide = records.select(
        "record_id", F.array_distinct(F.transform("hops", lambda h: h["type"])).alias("_types"), "scores",
        F.explode(F.array(*[F.lit(s) for s in K.SIGNAL_LABELS])).alias("signal_id"),
    )
    clauses = F.create_map(*[F.lit(v) for kind, signal, text in K.SIGNAL_CLAUSES for v in (f"{kind}/{signal}", text)])
    labels = F.create_map(*[F.lit(v) for pair in K.SIGNAL_LABELS.items() for v in pair])
    reasons = F.array_distinct(F.array_compact(F.transform(
        "_types", lambda t: F.try_element_at(clauses, F.concat_ws("/", t, F.col("signal_id"))))))
    level = lambda score: F.when(score >= 66, "high").when(score >= 33, "medium").otherwise("low")
    joined = F.when(F.size("_reasons") == 1, F.get("_reasons", F.lit(0))).otherwise(F.concat(
        F.array_join(F.slice("_reasons", 1, F.greatest(F.size("_reasons") - 1, F.lit(0))), ", "), F.lit(", and "),
        F.try_element_at("_reasons", F.lit(-1))))
    return wide.withColumns({
        "_reasons": reasons, "score": F.try_element_at("scores", F.col("signal_id")),
    }).select(
        "record_id", "signal_id", F.try_element_at(labels, F.col("signal_id")).alias("label"),
        F.when(F.col("signal_id") == "evidence_quality", level(100 - F.col("score"))).otherwise(level(F.col("score"))).alias("level"),
        "score",
        F.when(F.size("_reasons") > 0, F.concat(F.lit("In this lineage, "), joined, F.lit(".")))
        .otherwise("No mutation in the recorded chain bears directly on this signal.").alias("explanation"),
    )


def check_steps(records: DataFrame) -> DataFrame:
    """Self-check steps per record: latest hop first, distinct, one general habit if under four."""
    steps = F.create_map(*[F.lit(v) for pair in K.CHECK_STEPS for v in pair])
    general = F.array(*[F.lit(s) for s in K.GENERIC_STEPS])
    own = F.array_distinct(F.array_compact(F.transform(
        F.reverse("hops"), lambda h: F.try_element_at(steps, h["type"]))))
    return records.select("record_id", let(own, lambda s: F.when(F.size(s) == 0, general).when(
        F.size(s) < 4, F.concat(s, F.slice(general, 1, 1))).otherwise(s)).alias("_s")).select(
        "record_id", F.posexplode("_s").alias("_o", "step_id")).select(
        "record_id", (F.col("_o") + 1).cast("bigint").alias("step_no"), "step_id")


def messenger_explanations(traced: DataFrame, records: DataFrame) -> DataFrame:
    """Fixed wording by verdict for traced claims: ``traced(claim_id, record_id)``."""
    openers = F.create_map(*[F.lit(v) for pair in K.VERDICT_OPENERS for v in pair])
    text = F.concat(
        F.try_element_at(openers, F.col("verdict")), F.lit(K.MESSENGER_BRIDGE), F.col("origin.what_actually_happened"))
    return traced.join(records, "record_id").select("claim_id", "record_id", text.alias("explanation"))


# ---------------------------------------------------------------- curated paths

_PATH = "struct<reached: array<string>, credited: array<string>, evidence: array<string>, confidences: array<double>>"


def curated_path(record_id: Column, hops: Column, relationships: Column) -> Column:
    """Walk authored relationships forward from the origin, in list order, pass by pass.

    The first usable edge to reach a node counts: an identity edge extends the path without
    crediting the node, a transmission edge credits it.
    """
    kinds = list(K.TRANSMISSION_TYPES) + list(K.IDENTITY_TYPES)
    usable = F.filter(relationships, lambda r: (
        (r["status"] == "established") & r["relationship"].isin(*kinds) & F.exists(r["sources"], usable_citation)))
    strings, doubles = F.array().cast("array<string>"), F.array().cast("array<double>")
    start = F.struct(
        F.array(F.lit("origin")).alias("reached"), strings.alias("credited"), strings.alias("evidence"),
        doubles.alias("confidences"))

    def follow(s: Column, r: Column) -> Column:
        credit = r["relationship"].isin(*K.TRANSMISSION_TYPES)
        cited = F.transform(r["sources"], lambda _s, i: F.concat_ws(
            ":", F.lit("known"), record_id, F.lit("relationship"), r["id"], F.lit("source"), i.cast("string")))
        opens = F.array_contains(s["reached"], r["from_node_id"]) & ~F.array_contains(s["reached"], r["to_node_id"])
        return F.when(opens, F.struct(
            F.concat(s["reached"], F.array(r["to_node_id"])).alias("reached"),
            F.when(credit, F.concat(s["credited"], F.array(r["to_node_id"]))).otherwise(s["credited"]).alias("credited"),
            F.concat(s["evidence"], cited).alias("evidence"),
            F.when(credit, F.concat(s["confidences"], F.array(r["confidence"]))).otherwise(s["confidences"]).alias("confidences"),
        )).otherwise(s)

    passes = F.sequence(F.lit(1), F.size(hops) + 1)
    return let(usable, lambda edges: F.aggregate(
        passes, start.cast(_PATH), lambda state, _p: F.aggregate(edges, state, follow)))


def curated_completeness(records: DataFrame) -> DataFrame:
    """How much of a record's own path is established by cited transmissions."""
    required = F.array_distinct(F.transform(
        F.filter("hops", lambda h: h["type"] != "original_event"),
        lambda h: F.concat(F.lit("hop-"), h["hop"].cast("string"))))
    mutations = F.filter("relationships", lambda r: (
        (r["status"] == "established") & r["mutation_type"].isNotNull() & F.exists(r["sources"], usable_citation)))
    rows = records.select(
        "record_id", required.alias("_required"),
        curated_path(F.col("record_id"), F.col("hops"), F.col("relationships")).alias("_p"),
        F.array_max(F.transform(mutations, lambda r: r["confidence"])).alias("mutation_confidence"),
    )
    count = F.size("_required")
    done = F.size(F.array_intersect("_required", "_p.credited"))
    some = (count > 0) & (F.size("_p.confidences") > 0)
    total = F.aggregate("_p.confidences", F.lit(0.0), lambda a, c: a + c)
    return rows.select(
        "record_id", F.when(count > 0, done / count).otherwise(0.0).alias("completeness"),
        ((count > 0) & (done == count)).alias("complete"),
        F.when(count > 0, F.array_distinct("_p.evidence")).otherwise(F.array().cast("array<string>")).alias("evidence_ids"),
        F.when(some, total / F.size("_p.confidences")).alias("provenance_confidence"), "mutation_confidence",
    )


def curated_stages(records: DataFrame) -> DataFrame:
    """Five stages of externally verified records, from their cited evidence only."""
    cited = lambda items, prefix: F.transform(
        F.filter(F.transform(items, lambda s, i: F.struct(
            usable_citation(s).alias("ok"), s["is_primary"].alias("primary"),
            F.concat_ws(":", F.lit("known"), F.col("record_id"), prefix, F.lit("source"), i.cast("string")).alias("id"))),
            lambda c: c["ok"]),
        lambda c: F.struct(c["id"].alias("id"), c["primary"].alias("primary")))
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    hop_sources = F.transform("hops", lambda h: F.struct(
        h["type"].alias("type"),
        (filled(h["previously"]) & filled(h["now"]) & filled(h["what_changed"]) & (h["type"] != "original_event")).alias("ok"),
        cited(h["sources"], F.concat_ws(":", F.lit("hop"), h["hop"].cast("string"))).alias("sources")))
    rows = (
        records.filter(F.col("dataset_provenance") == "externally_verified")
        .join(curated_completeness(records), "record_id")
        .withColumns({
            "_origin": cited(F.col("origin.sources"), F.lit("origin")), "_hops": hop_sources,
            "_date": F.array(F.concat_ws(":", F.lit("known"), "record_id", F.lit("origin:date"))),
            "_dated": strict_date(F.col("origin.date")),
        })
        .withColumns({
            "_primary": F.filter("_origin", lambda s: s["primary"]),
            "_comparable": F.filter("_hops", lambda h: h["ok"] & (F.size(h["sources"]) > 0)),
        })
        .withColumn("_mutated", F.filter("_comparable", lambda h: h["type"].isin(*K.SUPPORTED_MUTATIONS)))
    )
    ids = lambda items: F.transform(items, lambda s: s["id"])
    of_hops = lambda hops: F.array_distinct(F.flatten(F.transform(hops, lambda h: ids(h["sources"]))))
    origin_known = (
        F.col("_dated") & filled(F.col("origin.source")) & filled(F.col("origin.what_actually_happened"))
        & (F.size("_primary") > 0))
    origin_ids = F.concat("_date", ids("_primary"))
    support = (
        ("earliest_source", F.col("_dated") & (F.size("_origin") > 0), F.concat("_date", ids("_origin"))),
        ("context_comparison", F.size("_comparable") > 0, of_hops("_comparable")),
        ("mutation_detection", F.size("_mutated") > 0, of_hops("_mutated")),
        ("origin_assessment", origin_known, origin_ids),
        ("lineage", origin_known & F.col("complete") & filled(F.col("canonical_claim")),
         F.array_distinct(F.concat(origin_ids, "evidence_ids"))),
    )
    stages = F.array(*[F.struct(
        F.lit(name).alias("stage_id"), F.when(ok, "established").otherwise("insufficient_evidence").alias("status"),
        F.when(ok, 1.0).alias("confidence"),
        F.when(ok, found_ids).otherwise(F.array().cast("array<string>")).alias("evidence_ids"),
    ) for name, ok, found_ids in support])
    return rows.select("record_id", F.posexplode(stages).alias("stage_ord", "_s")).select(
        "record_id", (F.col("stage_ord") + 1).alias("stage_ord"), "_s.*")


def known_scores(matches: DataFrame, records: DataFrame) -> DataFrame:
    """Curated scores of verified matches; all null (completeness 0) elsewhere."""
    origin = curated_stages(records).filter(F.col("stage_id") == "origin_assessment").select(
        "record_id", F.when(F.col("status") == "established", 1.0).alias("origin_confidence"))
    joined = (
        matches.filter("verified").select("claim_id", "record_id")
        .join(curated_completeness(records), "record_id").join(origin, "record_id", "left")
        .select("claim_id", "provenance_confidence", "mutation_confidence", "origin_confidence", "completeness"))
    return matches.select("claim_id").join(joined, "claim_id", "left").withColumn(
        "completeness", F.coalesce("completeness", F.lit(0.0)))


def record_levels(records: DataFrame) -> DataFrame:
    """Longest-path level of every node of a record's authored graph."""
    start = F.concat(
        F.array(F.struct(F.lit("origin").alias("id"), F.lit(0).alias("level"))),
        F.transform("hops", lambda h: F.struct(F.concat(F.lit("hop-"), h["hop"].cast("string")).alias("id"), F.lit(0).alias("level"))))

    def relax(levels: Column, r: Column) -> Column:
        base = F.coalesce(F.get(F.filter(levels, lambda n: n["id"] == r["from_node_id"]), F.lit(0))["level"], F.lit(0))
        return let(base + 1, lambda new: F.transform(levels, lambda n: F.struct(
            n["id"].alias("id"),
            F.when((n["id"] == r["to_node_id"]) & (new > n["level"]), new).otherwise(n["level"]).alias("level"))))

    levels = F.aggregate(
        F.sequence(F.lit(1), F.size("hops") + 1), start.cast("array<struct<id: string, level: int>>"),
        lambda state, _p: F.aggregate("relationships", state, relax))
    return records.select("record_id", F.explode(levels).alias("_n")).select(
        "record_id", F.col("_n.id").alias("node_id"), F.col("_n.level").cast("bigint").alias("level"))


def record_edges(records: DataFrame) -> DataFrame:
    """Authored relationships as a graph table."""
    return records.select("record_id", F.posexplode("relationships").alias("ord", "_r")).select(
        "record_id", "ord", "_r.*")


def hop_chain(hops: DataFrame, relationships: DataFrame, origins: DataFrame) -> DataFrame:
    """Predecessor text per hop when the library is kept as flat child tables.

    ``hops(record_id, hop, text)``, ``relationships(record_id, ord, from_node_id, to_node_id)``,
    ``origins(record_id, what_actually_happened)``.
    """
    last = relationships.groupBy("record_id", F.col("to_node_id").alias("node_id")).agg(
        F.max_by("from_node_id", "ord").alias("_from"))
    named = hops.withColumn("node_id", F.concat(F.lit("hop-"), F.col("hop").cast("string")))
    before = named.select("record_id", F.col("node_id").alias("_from"), F.col("text").alias("_text"))
    return (
        named.join(last, ["record_id", "node_id"], "left")
        .join(before, ["record_id", "_from"], "left").join(origins, "record_id", "left")
        .select("record_id", "hop", F.when(F.col("_from") == "origin", F.col("what_actually_happened"))
                .otherwise(F.col("_text")).alias("previously"), F.col("text").alias("now"))
    )


