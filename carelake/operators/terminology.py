"""Terminologies: loads, crosswalks, panels, mapping lookups, fuzzy and vector search, suggestions, decisions and their review."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity


#: Concepts of a code up to which its rows carry the list of them; pairs of which both codes have several and one has more are made distinct by a shuffle.
LISTED = 64
#: Codes of a concept on one side up to which they meet the other side's in one group of the join; more are dealt into pieces of about so many.
WIDE = 8192


def _concepts_of(rows: DataFrame, code: str, entry: Column, side: str) -> DataFrame:
    """rows (one for each code and concept) with the number of the code's concepts, and with its entries in order if there are 2 to LISTED."""
    own = Window.partitionBy(code)
    counted = rows.withColumn(f"{side}_n", F.count("*").over(own))
    several = F.collect_list(F.when(F.col(f"{side}_n").between(2, LISTED), entry)).over(own)
    return counted.withColumn(f"{side}_list", F.when(F.col(f"{side}_n").between(2, LISTED), F.sort_array(several)))


def _dealt(start: DataFrame, ends: DataFrame, keyed: list[DataFrame]) -> list[DataFrame]:
    """keyed (starts and ends with more columns) with the pieces in which they meet, dealt over the session's number of shuffle partitions.

    A code of a wide concept is in one piece of its side's, once for each of the other's. The number is given, as adaptive execution would put rows
    into few tasks by their size, which doesn't tell how many pairs they make.
    """
    wide = [x.groupBy("cui").agg(F.ceil(F.count("*") / WIDE).alias(name)).where(F.col(name) > 1) for x, name in ((start, "start_pieces"), (ends, "end_pieces"))]
    tasks, out = int(start.sparkSession.conf.get("spark.sql.shuffle.partitions")), []
    for rows, code, own, other in zip(keyed, ("code", "target_code"), ("start", "end"), ("end", "start"), strict=True):
        for w in wide:
            rows = rows.join(F.broadcast(w), "cui", "left")
        piece = F.pmod(F.xxhash64(code), F.coalesce(f"{own}_pieces", F.lit(1))).alias(f"{own}_piece")
        met = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(f"{other}_pieces", F.lit(1)) - 1)).alias(f"{other}_piece")
        out.append(rows.select("*", piece, met).drop("start_pieces", "end_pieces").repartition(tasks, "cui", "start_piece", "end_piece"))
    return out


def crosswalk(concepts: DataFrame, code: DataFrame, from_source: str, to_source: str) -> DataFrame:
    """(code, target_code, target_name) for each asked code: same concept, preferred names, each target code once, best name first.

    The pairs grow with the square of a concept's codes, so they are neither shuffled nor sorted: a pair that shares several concepts is made under
    the one with the best name only, and a code of one concept makes each of its pairs once. A concept of many codes is dealt into pieces, whose pairs are
    made by different tasks. A name comes before none, then the least rank, a missing one last.
    """
    known = concepts.where(F.col("cui").isNotNull())
    start = known.where(F.col("source") == from_source).select("code", "cui").distinct().join(code.select("code").distinct(), "code")
    best = F.min(F.struct(F.col("name").isNull(), F.col("rank").isNull(), "rank", F.col("name").alias("target_name"))).alias("best")
    ends = known.where((F.col("source") == to_source) & (F.col("is_preferred") == "Y")).groupBy("cui", F.col("code").alias("target_code")).agg(best)
    keyed_start = _concepts_of(start, "code", F.struct("cui"), "start").withColumn("start_list", F.col("start_list.cui"))
    keyed_ends = _concepts_of(ends, "target_code", F.struct("best", "cui"), "end").withColumn("end_list", F.col("end_list.cui"))
    start, ends = _dealt(start, ends, [keyed_start, keyed_ends])
    met = ["cui", "start_piece", "end_piece"]
    several, wide = (F.col("start_n") > 1) & (F.col("end_n") > 1), (F.col("start_n") > LISTED) | (F.col("end_n") > LISTED)
    first = F.get(F.array_intersect("end_list", "start_list"), F.lit(0)) == F.col("cui")  # in the order of end_list: best name first
    once = start.hint("merge").join(ends.withColumn("target_name", F.col("best.target_name")), met).where(~several | (~wide & first)).select("code", "target_code", "target_name")
    rest = start.where("start_n > 1").hint("merge").join(ends.where("end_n > 1"), met).where(wide).groupBy("code", "target_code").agg(F.min("best").alias("best"))
    return once.unionByName(rest.select("code", "target_code", "best.target_name"))


def relations(rel: DataFrame, concepts: DataFrame, limit: int = 100) -> DataFrame:
    """Relations with the preferred name of their target where it has one."""
    names = concepts.where("is_preferred = 'Y'").groupBy(F.col("cui").alias("cui2")).agg(F.min("name").alias("name"))
    return rel.join(names, "cui2", "left").orderBy("cui1", "relation", "cui2").limit(limit)


def closure(edges: DataFrame, child: str, parent: str, spark) -> DataFrame:
    """(descendant, ancestor, depth) of an acyclic hierarchy, by the engine's recursive query."""
    name = f"edges_of_closure_{abs(hash((child, parent))) % 10**8}"
    edges.select(F.col(child).alias("descendant"), F.col(parent).alias("ancestor")).distinct().createOrReplaceTempView(name)
    return spark.sql(f"""WITH RECURSIVE up(descendant, ancestor, depth) AS (
      SELECT descendant, ancestor, 1 FROM {name} UNION ALL SELECT u.descendant, e.ancestor, u.depth + 1 FROM up u JOIN {name} e ON e.descendant = u.ancestor)
    SELECT descendant, ancestor, CAST(min(depth) AS BIGINT) AS depth FROM up GROUP BY descendant, ancestor""")


def panel_members(panels: DataFrame, codes: DataFrame) -> DataFrame:
    """Members of each panel with their names, in sequence, those without one last."""
    return panels.join(codes, panels["member"] == codes["code"]).select("panel", "member", "name", "sequence").orderBy("panel", F.asc_nulls_last("sequence"), "member")


def lookup(asked: DataFrame, mappings: DataFrame, profile: str) -> DataFrame:
    """asked (system, code) with the profile's mapping, else the global one (null profile); codes and systems in any case, first target by code."""
    key = [F.upper("system").alias("key_system"), F.upper("code").alias("key_code")]
    own = F.when(F.col("profile") == profile, 1).otherwise(0)
    best = mappings.where((F.col("profile") == profile) | F.col("profile").isNull()).groupBy(*key).agg(F.max_by(F.struct("target_system", "target_code", "profile"), F.struct(own, F.lit(0))).alias("best"))
    found = asked.join(best, (F.upper(asked["system"]) == F.col("key_system")) & (F.upper(asked["code"]) == F.col("key_code")), "left")
    return found.select(asked["system"], asked["code"], "best.target_system", "best.target_code", F.col("best.profile").isNotNull().alias("from_profile"))


def insert_mappings(mappings: DataFrame, batch: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to add, counts of created and duplicate): a row whose key is there already, or came earlier in the batch, is a duplicate."""
    once = batch.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).where("n = 1").drop("n")
    new = once.join(mappings.select(*keys).distinct(), keys, "left_anti")
    counts = batch.agg(F.count("*").alias("total")).crossJoin(F.broadcast(new.agg(F.count("*").alias("created"))))
    return new, counts.select("created", (F.col("total") - F.col("created")).alias("duplicate"))


def text_search(concepts: DataFrame, term: str, limit: int) -> DataFrame:
    """Names that contain the term: preferred ones first, then the shortest."""
    hit = concepts.where(F.contains(F.lower("name"), F.lit(term.lower())))
    return hit.orderBy(F.when(F.col("is_preferred") == "Y", 0).otherwise(1), F.length("name"), "name", "code").limit(limit)


def fuzzy(concepts: DataFrame, query: str, limit: int, least: float = 0.5) -> DataFrame:
    """Codes by confidence: exact code, exact name, name that begins with or contains the query, else edit similarity or shared words."""
    q, name = F.lit(query.lower()), F.lower("name")
    overlap, near = similarity.token_overlap(F.lit(query), F.col("name")), similarity.edit_similarity(name, q)
    # fixed values: confidences of the tiers
    tier = F.when(F.upper("code") == query.upper(), 1.0).when(name == q, 0.98).when(F.startswith(name, q), 0.96).when(F.contains(name, q), 0.7 + 0.2 * F.length(q) / F.length(name)).otherwise(F.greatest(0.9 * overlap, 0.85 * near))
    return concepts.withColumn("confidence", tier).where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "code").limit(limit)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, least: float = -1.0, block: int = 8192, asked_block: int = 1024) -> DataFrame:
    """(query_id, vec_id, score) of the k nearest by cosine for each query (query_id, asked), exactly, over all vectors but the query's own.

    The queries are a stated set: each block of vectors meets each block of queries in a matrix product, and keeps its own k best of each query
    before the results are put together. Scores have five decimals; equal ones go by vec_id. Vectors of other lengths, and nulls, score 0.
    """
    context = queries.sparkSession.sparkContext
    shards, parts = max(context.defaultParallelism, -(-vectors.count() // block)), max(1, -(-queries.count() // asked_block))
    spread = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    asked = queries.select("query_id", "asked", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"))

    def unit(rows: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length: places and unit vectors."""
        sizes = np.array([-1 if x is None else len(x) for x in rows])
        out = {}
        for d in set(sizes.tolist()) - {-1, 0}:
            at = np.nonzero(sizes == d)[0]
            m = np.stack([np.asarray(rows.iloc[i], float) for i in at])
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            out[d] = at, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        return out

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros((len(q), len(v)))
        a, b = unit(q["asked"]), unit(v["embedding"])
        for d in a.keys() & b.keys():
            found[np.ix_(a[d][0], b[d][0])] = a[d][1] @ b[d][1].T
        found = np.sign(found) * np.floor(np.abs(found) * 1e5 + 0.5) / 1e5
        ids, out = v["vec_id"].to_numpy(), []
        for query, row in zip(q["query_id"].tolist(), found, strict=True):
            at = np.nonzero((row >= least) & (ids != query))[0]
            if len(at) > k:
                at = at[row[at] >= np.partition(row[at], len(at) - k)[len(at) - k]]
            best = at[np.lexsort((ids[at], -row[at]))[:k]]
            out += [(query, ids[i], row[i]) for i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, score double"
    local = asked.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInPandas(meet, kinds)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("place", place).where(F.col("place") <= k).select("query_id", "vec_id", "score")


def hybrid(exact: DataFrame, semantic: DataFrame, weight: float) -> DataFrame:
    """(code, score) of both result lists: a code of both gets the better of its confidence and the weighted mean, others what they have."""
    both = exact.select("code", "confidence").join(semantic.select("code", "score"), "code", "full_outer")
    mean = (1 - weight) * F.col("confidence") + weight * F.col("score")
    return both.select("code", F.coalesce(F.greatest("confidence", mean), "confidence", weight * F.col("score")).alias("score"))


# Scores from which a suggestion is accepted or reviewed.
HIGH, MEDIUM = 0.90, 0.70


def decision(score: Column) -> Column:
    return F.when(score >= HIGH, "auto").when(score >= MEDIUM, "review").otherwise("none")


def suggestions(feedback: DataFrame, semantic: DataFrame, per_code: int, least: float) -> DataFrame:
    """Best targets for each code: accepted feedback at 0.95 and a hundredth for each acceptance, semantic hits at their score; each target once."""
    taught = feedback.groupBy("code", "target").agg(F.count_if("accepted").alias("n")).where("n > 0").select("code", "target", (0.95 + 0.01 * F.col("n")).alias("score"), F.lit("feedback").alias("strategy"))
    both = taught.unionByName(semantic.select("code", "target", "score", F.lit("semantic").alias("strategy")))
    best = both.groupBy("code", "target").agg(F.max("score").alias("score"), F.max_by("strategy", "score").alias("strategy")).where(F.col("score") >= least)
    return best.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("score"), "target")).cast("long")).where(F.col("place") <= per_code)


def decision_stats(decisions: DataFrame) -> DataFrame:
    """Totals and means over decision types: each type's mean of known values, weighted by all of the type's rows."""
    each = decisions.groupBy("type").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg("millis").alias("m"))
    weighted = [F.sum(F.col("n") * F.coalesce(k, F.lit(0.0))) / F.sum("n") for k in ("c", "m")]
    return each.agg(F.sum("n").alias("decisions"), F.round(weighted[0], 6).alias("confidence"), F.round(weighted[1], 6).alias("millis"))


def effective_status(status: Column, expires: Column, now: Column) -> Column:
    return F.when((status == "pending") & (expires < now), "expired").otherwise(status)


def resolve(asked: DataFrame, mappings: DataFrame, semantic: DataFrame) -> DataFrame:
    """asked (code) resolved by a stored mapping, else by the best semantic hit that is certain enough, else not at all."""
    stored = mappings.groupBy("code").agg(F.min("target").alias("mapped"))
    hit = semantic.groupBy("code").agg(F.max(F.struct("score", "target")).alias("hit"))
    out = asked.join(stored, "code", "left").join(hit, "code", "left")
    sure = F.col("hit.score") >= HIGH
    return out.select("code", F.coalesce("mapped", F.when(sure, F.col("hit.target"))).alias("target"), F.when(F.col("mapped").isNotNull(), "mapping").when(sure, "autoroute").otherwise("none").alias("via"))


# Shapes of codes and the systems that they tell.
SHAPES = [("LOINC", r"^[0-9]{1,5}-[0-9]$"), ("ICD-10-CM", r"^[A-TV-Z][0-9][0-9AB](\.[0-9A-Z]{1,4})?$"), ("NDC", r"^[0-9]{5}-[0-9]{4}-[0-9]{2}$"), ("HCPCS", r"^[A-V][0-9]{4}$"), ("CPT", r"^[0-9]{4}[0-9FT]$"), ("SNOMED", r"^[0-9]{6,18}$")]


def code_system(code: Column) -> Column:
    return reduce(lambda out, x: out.when(code.rlike(x[1]), x[0]), SHAPES, F).otherwise("unknown")


def ndc(eleven: Column) -> Column:
    """Eleven digits as 5-4-2; other texts stay."""
    return F.when(eleven.rlike("^[0-9]{11}$"), F.concat_ws("-", F.substring(eleven, 1, 5), F.substring(eleven, 6, 4), F.substring(eleven, 10, 2))).otherwise(eleven)


def upload_errors(rows: DataFrame) -> DataFrame:
    """rows (row, source_system, source_code, target_system, target_code, confidence) with errors: an array of codes, empty for rows to take."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    value = F.col("confidence").try_cast("double")
    tests = [F.when(blank(c), F.lit(f"MISSING_{c.upper()}")) for c in ("source_system", "source_code", "target_system", "target_code")]
    tests.append(F.when(~blank("confidence") & value.isNull(), "INVALID_CONFIDENCE").when((value < 0) | (value > 1), "CONFIDENCE_RANGE"))
    return rows.withColumn("errors", F.array_compact(F.array(*tests)))
