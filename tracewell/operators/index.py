"""A library as an impact-ordered inverted index, and the best records of a claim without scoring all of them.

A term's records lie in the order of their best possible share in a score (the shortest norm of a wording with the
term, then the id), cut into blocks.  A claim reads a prefix of each list: the blocks whose first record could, with all
the claim's more frequent terms added, still reach the claim's k-th best score known so far.  A term in every record
so costs a claim a few rows, and a heavy list is spread over tasks block by block.

Where many wordings share most of their terms, hardly a pair can be ruled out that way, and pairs are many more than the
rows they come from.  So no table of pairs is made: records lie in the same order in pieces, each with the shortest norm
of every term in it; a claim is sent to the pieces that can still reach its k-th best score, and a task adds up the scores
of a piece's records list by list and hands on the best ``k`` of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import match_terms, negated_terms
from tracewell.operators.matching import library_texts, text_count, unseen_weight, weigh_terms
from tracewell.operators.ranking import range_ordinals, top_k
from tracewell.session import cut, new_folder, spread

#: Records of a posting list that are joined together.
BLOCK = 1024
#: Full scores that give a claim its first bound, as a multiple of ``k``: the most promising records of its lists' heads.
TRIED = 2
#: Bounds are sums of rounded quotients: a record this close below the bound is still scored.
SLACK = 1e-9
_TABLES = ("terms", "postings", "blocks", "texts", "wordings", "pieces", "heads")
#: Records of a piece, and claims that meet a piece in one task: claims are copied for every piece, a piece only for so many claims.
PIECE, PIECE_CLAIMS = 1 << 13, 1 << 15


@dataclass(frozen=True)
class Index:
    """``terms(term, df, w2, shortest)``, ``postings(term, block, position, record_id, norm)``,
    ``blocks(term, block, record_id, norm)`` with the first record of each, ``texts(record_id, denied, term, text_no,
    norm)`` with the terms of every wording and, as wording -1, those that a claim may deny, ``wordings``,
    ``pieces(piece, record_id, text_no, norm, terms)`` with the same whole, and ``heads(piece, term, norm)`` with the shortest
    norm of a wording with the term."""

    terms: DataFrame
    postings: DataFrame
    blocks: DataFrame
    texts: DataFrame
    wordings: DataFrame
    pieces: DataFrame
    heads: DataFrame


def write_index(records: DataFrame, folder: str) -> None:
    """Write the index of ``records(record_id, canonical_claim, aliases)`` as Parquet tables, once.

    A folder is one version of a library.  The table of terms is written last: where it stands, the others are whole.
    """
    spark = records.sparkSession
    text = F.col("text")
    asserted = F.when(F.col("text_no") == 0, F.array_except(match_terms(text), negated_terms(text)))
    library_texts(records).select("record_id", "text_no", match_terms(text).alias("terms"), asserted.alias("asserted")).write.mode(
        "overwrite").parquet(f"{folder}/wordings")  # the library's text is read once
    wordings = spark.read.parquet(f"{folder}/wordings")
    spread = wordings.select("record_id", "text_no", F.explode("terms").alias("term"))
    weigh_terms(spread.select("term"), text_count(wordings)).select("term", "df", "w2").write.mode("overwrite").parquet(f"{folder}/weights")
    weights = spark.read.parquet(f"{folder}/weights")
    norms = spread.join(weights, "term").groupBy("record_id", "text_no").agg(F.sum("w2").alias("norm"))
    denied = wordings.select("record_id", F.lit(True).alias("denied"), F.explode("asserted").alias("term"))
    (
        spread.join(norms, ["record_id", "text_no"]).withColumn("denied", F.lit(False)).unionByName(
            denied.withColumns({"text_no": F.lit(-1), "norm": F.lit(None).cast("bigint")}))
        .write.mode("overwrite").parquet(f"{folder}/texts")
    )
    listed = (
        spark.read.parquet(f"{folder}/texts").filter(~F.col("denied"))
        .groupBy("term", "record_id").agg(F.min("norm").alias("norm"))
    )
    placed = range_ordinals(listed, ["term"], [F.asc("norm"), F.asc("record_id")], "position")
    placed.withColumn("block", F.floor((F.col("position") - 1) / F.lit(BLOCK))).write.mode("overwrite").parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")
    heads = postings.filter((F.col("position") - 1) % BLOCK == 0).select("term", "block", "record_id", "norm")
    heads.write.mode("overwrite").parquet(f"{folder}/blocks")
    _write_pieces(spark.read.parquet(f"{folder}/texts"), folder)
    shortest = postings.filter(F.col("position") == 1).select("term", F.col("norm").alias("shortest"))
    weights.join(shortest, "term").write.mode("overwrite").parquet(f"{folder}/terms")


def _write_pieces(texts: DataFrame, folder: str) -> None:
    spark = texts.sparkSession
    least = texts.filter(~F.col("denied")).groupBy("record_id").agg(F.min("norm").alias("norm"))
    placed = range_ordinals(least, [], [F.asc("norm"), F.asc("record_id")], "_at").select(
        "record_id", F.floor((F.col("_at") - 1) / F.lit(PIECE)).alias("piece"))
    whole = texts.groupBy("record_id", "text_no").agg(  # one wording's terms
        F.max("norm").alias("norm"), F.collect_list("term").alias("terms"))
    whole.join(placed, "record_id").write.mode("overwrite").parquet(f"{folder}/pieces")
    pieces = spark.read.parquet(f"{folder}/pieces").filter("text_no >= 0")
    heads = pieces.select("piece", "norm", F.explode("terms").alias("term")).groupBy("piece", "term").agg(F.min("norm").alias("norm"))
    heads.write.mode("overwrite").parquet(f"{folder}/heads")


def read_index(spark: SparkSession, folder: str) -> Index:
    return Index(*[spark.read.parquet(f"{folder}/{name}") for name in _TABLES])


def kept_index(records: DataFrame, folder: str) -> Index:
    """The index in a folder, written first if no run before has finished it (its table of terms is the last one)."""
    spark = records.sparkSession
    try:
        return read_index(spark, folder)
    except AnalysisException:
        write_index(records, folder)
        return read_index(spark, folder)


def library_index(records: DataFrame) -> Index:
    """An index of its own for one run."""
    folder = new_folder(records.sparkSession, "index")
    write_index(records, folder)
    return read_index(records.sparkSession, folder)


def _sum(values: Column, each, zero: Column) -> Column:
    return F.aggregate(values, zero, lambda total, v: total + each(v))


def profiles(claims: DataFrame, index: Index, claim: str = "claim") -> DataFrame:
    """``claim_id, weights, denied, claim_norm``: the claim's terms that the library knows, rarest first."""
    spread = claims.select(
        "claim_id", match_terms(F.col(claim)).alias("_t"), negated_terms(F.col(claim)).alias("denied")
    ).select("claim_id", "denied", F.size("_t").alias("_n"), F.explode("_t").alias("term"))
    rows = spread.join(index.terms, "term").groupBy("claim_id").agg(
        F.array_sort(F.collect_list(F.struct("df", "term", "w2", "shortest"))).alias("weights"),  # one claim's terms
        F.max("denied").alias("denied"), F.max("_n").alias("_n"))
    unseen = unseen_weight(index.wordings)
    known = _sum(F.col("weights"), lambda w: w["w2"], F.lit(0).cast("bigint"))
    return rows.select(
        "claim_id", "weights", "denied", (known + (F.col("_n") - F.size("weights")) * unseen).alias("claim_norm"))


def _cosine(share: Column, norm: str = "norm") -> Column:
    return share / F.sqrt(F.col(norm).cast("double") * F.col("claim_norm").cast("double"))


def pair_scores(pairs: DataFrame, asked: DataFrame, index: Index) -> DataFrame:
    """``claim_id, record_id, score`` of given pairs, in full; without those whose claim denies what the record asserts."""
    tag = lambda denied, w2: lambda t: F.struct(F.lit(denied).alias("denied"), t.alias("term"), w2(t).alias("w2"))
    probes = asked.select("claim_id", "claim_norm", F.explode(F.concat(
        F.transform("weights", lambda w: F.struct(F.lit(False).alias("denied"), w["term"].alias("term"), w["w2"].alias("w2"))),
        F.transform("denied", tag(True, lambda t: F.lit(0).cast("bigint"))))).alias("_p")).select("claim_id", "claim_norm", "_p.*")
    sums = (
        pairs.join(probes, "claim_id").join(index.texts, ["record_id", "denied", "term"])
        .groupBy("claim_id", "record_id", "text_no")
        .agg(F.sum("w2").alias("share"), F.max("norm").alias("norm"), F.max("claim_norm").alias("claim_norm"), F.max("denied").alias("conflict"))
    )
    best = sums.groupBy("claim_id", "record_id").agg(
        F.max(F.when(~F.col("conflict"), _cosine(F.col("share")))).alias("score"), F.max("conflict").alias("conflict"))
    return best.filter(~F.col("conflict") & (F.col("score") > 0))


def promising(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """``claim_id, record_id``: all pairs that can be among the best ``k`` of a claim, and few others.

    Terms go from rare to frequent.  A wording is weighed at the first of them that it holds: its share there plus the
    greatest shares of all later terms bounds its score, and so does its share if it held all later terms too.  The bound to reach is the k-th best full score among the
    records at the heads of the claim's lists; at a claim's last term, where share and score are one, equal scores are
    told apart by id.  A claim with fewer than ``k`` such records reads its lists whole.
    """
    parts = _parts(asked)
    reaches = _reaches(F.col("record_id") <= F.col("last"))
    blocks = parts.join(_floors(asked, parts, index, k), "claim_id", "left").join(index.blocks, "term").filter(reaches).drop("record_id", "norm")
    return blocks.join(index.postings, ["term", "block"]).filter(reaches).select("claim_id", "record_id").distinct()


def _parts(asked: DataFrame) -> DataFrame:
    """The terms of each claim with the greatest shares of the terms after them."""
    return asked.select("claim_id", "weights", "claim_norm", F.posexplode("weights").alias("_i", "_w")).select(
        "claim_id", "claim_norm", F.col("_w.term").alias("term"), F.col("_w.w2").alias("w2"),
        _sum(F.slice("weights", F.col("_i") + 2, F.size("weights")), lambda w: w["w2"] / F.sqrt(w["shortest"].cast("double")), F.lit(0.0)).alias("rest"),
        _sum(F.slice("weights", F.col("_i") + 1, F.size("weights")), lambda w: w["w2"], F.lit(0).cast("bigint")).alias("tail"))


def _floors(asked: DataFrame, parts: DataFrame, index: Index, k: int) -> DataFrame:
    """``claim_id, floor, last``: the ``k``-th best score among the records at the heads of a claim's lists, and its record."""
    order = [F.desc("score"), F.asc("record_id")]
    heads = parts.join(index.postings.filter(F.col("position") <= TRIED * k), "term").groupBy("claim_id", "record_id").agg(
        F.sum(F.floor(F.col("w2") / F.sqrt(F.col("norm").cast("double")))).alias("score"))
    tried = top_k(heads, ["claim_id"], order, TRIED * k).select("claim_id", "record_id")
    return top_k(pair_scores(tried, asked, index), ["claim_id"], order, k).filter(F.col("rank") == k).select(
        "claim_id", F.col("score").alias("floor"), F.col("record_id").alias("last"))


def _reaches(first: Column) -> Column:
    """A wording of this ``norm`` may reach the claim's floor; ``first`` tells equal scores apart."""
    alone = _cosine(F.col("w2"))
    bound = F.least(
        (F.col("w2") / F.sqrt(F.col("norm").cast("double")) + F.col("rest")) / F.sqrt(F.col("claim_norm").cast("double")),
        _cosine(F.col("tail")))
    return F.col("floor").isNull() | F.when(F.col("rest") > 0, bound >= F.col("floor") * F.lit(1 - SLACK)).otherwise(
        (alone > F.col("floor")) | ((alone == F.col("floor")) & first))


def _lists(owner: np.ndarray, lists: pa.ListArray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the list of each of ``terms`` begins, the owners in it, and how often each has the term."""
    sizes = np.diff(lists.offsets.to_numpy())
    ids = pc.index_in(lists.flatten(), terms).to_numpy(zero_copy_only=False).astype(np.int64)
    places = max(int(owner.max(initial=-1)) + 1, 1)
    keys, times = np.unique(ids * places + np.repeat(owner, sizes), return_counts=True)
    return np.searchsorted(keys, np.arange(len(terms) + 1) * places), keys % places, times


def _score(k: int):
    """The best ``k`` records of one piece for each of the claims that meet it; sums are whole, so their order is free."""
    def score(asked: pa.Table, known: pa.Table) -> pa.Table:
        asked, known = asked.combine_chunks(), known.combine_chunks().sort_by([("record_id", "ascending"), ("text_no", "ascending")]).combine_chunks()
        types = {"claim_id": asked.schema.field("claim_id").type, "record_id": known.schema.field("record_id").type}
        found_claims, found_records, found_scores = [], [], []
        if len(asked) and len(known):
            names = known["record_id"].combine_chunks()
            numbers = names.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)  # sorted: in order
            lists, text = known["terms"].combine_chunks(), known["text_no"].to_numpy() >= 0
            terms = lists.flatten().unique()
            said = lists.filter(pa.array(text))
            starts, rows, times = _lists(np.arange(len(said)), said, terms)
            once = bool((times == 1).all())
            owner = numbers[text]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            denials = _lists(numbers[~text], lists.filter(pa.array(~text)), terms)
            norms = known["norm"].filter(pa.array(text)).to_numpy().astype(np.float64)
            place = names.dictionary_encode().dictionary
            own = {n: asked[n].combine_chunks() for n in ("term", "w2", "denied")}
            ids = {n: pc.fill_null(pc.index_in(own[n].flatten(), terms), -1).to_numpy(zero_copy_only=False) for n in ("term", "denied")}
            ends = {n: np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(own[n]), 0).to_numpy())] for n in ("term", "denied")}
            weights, sums = own["w2"].flatten().to_numpy(), asked["claim_norm"].to_numpy().astype(np.float64)
            for c in range(len(asked)):
                share, refused = np.zeros(len(said), np.int64), np.zeros(len(place), bool)
                for at in range(ends["term"][c], ends["term"][c + 1]):
                    if (t := ids["term"][at]) >= 0:
                        share[rows[starts[t]:starts[t + 1]]] += weights[at] if once else weights[at] * times[starts[t]:starts[t + 1]]
                for t in ids["denied"][ends["denied"][c]:ends["denied"][c + 1]]:
                    if t >= 0:
                        refused[denials[1][denials[0][t]:denials[0][t + 1]]] = True
                value = np.zeros(len(said))
                with np.errstate(invalid="ignore"):  # a norm below zero, of a claim in several rows, gives NaN as in SQL
                    np.divide(share, np.sqrt(norms * sums[c]), out=value, where=share > 0)
                best = np.zeros(len(place))
                best[owner[first]] = np.maximum.reduceat(value, first) if len(first) else 0
                best[refused] = 0
                order = np.nan_to_num(best, nan=np.inf)  # NaN is the greatest
                kept = np.flatnonzero(order > 0)
                if len(kept) > k:
                    kept = kept[order[kept] >= np.partition(order[kept], len(kept) - k)[len(kept) - k]]
                    kept = kept[np.argsort(-order[kept], kind="stable")[:k]]
                found_claims.append(np.full(len(kept), c))
                found_records.append(kept)
                found_scores.append(best[kept])
        if not found_claims:
            return pa.table({"claim_id": pa.array([], types["claim_id"]), "record_id": pa.array([], types["record_id"]), "score": pa.array([], pa.float64())})
        return pa.table({
            "claim_id": asked["claim_id"].take(pa.array(np.concatenate(found_claims))),
            "record_id": place.take(pa.array(np.concatenate(found_records))).cast(types["record_id"]), "score": np.concatenate(found_scores)})

    return score


def best_records(claims: DataFrame, index: Index, k: int, claim: str = "claim") -> DataFrame:
    """``claim_id, record_id, score, conflict``: the best ``k`` records of each claim, as scoring all would find them.

    Ties go to the earlier record id; records that the claim denies are not among them, so ``conflict`` is false.
    """
    asked = cut(profiles(claims, index, claim))
    parts = _parts(asked)
    met = parts.join(_floors(asked, parts, index, k), "claim_id", "left").join(index.heads, "term").filter(
        _reaches(F.lit(True))).select("claim_id", "piece").distinct()
    met = cut(met)
    shares = met.groupBy("piece").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(PIECE_CLAIMS))).cast("int").alias("_parts"))
    columns = ["claim_id", "claim_norm", "denied", F.transform("weights", lambda w: w["term"]).alias("term"),
               F.transform("weights", lambda w: w["w2"]).alias("w2")]
    left = met.join(shares, "piece").join(asked.select(*columns), "claim_id").select(
        F.struct("piece", F.pmod(F.xxhash64("claim_id"), F.col("_parts")).cast("int").alias("part")).alias("_key"),
        "claim_id", "claim_norm", "denied", "term", "w2")
    right = index.pieces.join(shares, "piece").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(
        F.struct("piece", "part").alias("_key"), "record_id", "text_no", "norm", "terms")
    types = {c: f.schema[c].dataType.simpleString() for c, f in (("claim_id", asked), ("record_id", index.pieces))}
    # AQE goes by bytes and would leave all pieces to one task
    scored = spread(left, "_key").groupBy("_key").cogroup(spread(right, "_key").groupBy("_key")).applyInArrow(
        _score(k), f"claim_id {types['claim_id']}, record_id {types['record_id']}, score double")
    kept = top_k(scored, ["claim_id"], [F.desc("score"), F.asc("record_id")], k)
    return kept.select("claim_id", "record_id", "score", F.lit(False).alias("conflict"))
