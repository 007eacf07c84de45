"""Patient record linkage: blocking, deterministic rules, a weighted score, classification, and a master index of links and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identifiers, similarity

# Weights of the fields of a score, and the scores from which a pair is confirmed, reviewed or possible.
WEIGHTS = {"ssn": 0.25, "mbi": 0.20, "family": 0.15, "given": 0.10, "birth_date": 0.15, "phone": 0.08, "zip": 0.04, "gender": 0.03}
CONFIRMED, REVIEW, POSSIBLE = 0.95, 0.70, 0.50


def blocking_keys(family: Column, birth_date: Column, phone: Column) -> Column:
    """Keys under which records meet: sound of the family name with the birth year, and the phone number; empty parts make no key."""
    name, number = similarity.soundex(family), identifiers.phone(F.coalesce(phone, F.lit("")))
    first = F.when((name != "") & birth_date.isNotNull(), F.concat_ws(":", F.lit("n"), name, F.year(birth_date)))
    return F.array_distinct(F.array_compact(F.array(first, F.when(number != "", F.concat_ws(":", F.lit("p"), number)))))


def _keyed(records: DataFrame, record_id: str, keys: Column, kept: list[Column]) -> DataFrame:
    """A row for each record and key, with all of the record's keys."""
    return records.select(F.col(record_id).alias("id"), F.array_distinct(keys).alias("all"), *kept).withColumn("key", F.explode("all"))


def sided_pairs(records: DataFrame, record_id: str, keys: Column, columns: list[str] | None = None) -> DataFrame:
    """(a, b, l, r) with a < b of records that share a key, each pair once, with the named columns of both (all if none are named).

    One join on the keys: a pair that shares several keys is made under the least of them only, so nothing has to be made distinct. A key with n
    records makes n * (n - 1) / 2 pairs by nature; both sides are shuffled directly, so that adaptive execution can split a wide key. Records of one
    key carry no list of keys, and their pairs compare none.
    """
    own, more = F.struct(*(columns or records.columns)), F.when(F.size("all") > 1, F.col("all"))
    a = _keyed(records, record_id, keys, [own.alias("l")]).select(F.col("id").alias("a"), more.alias("left_keys"), "key", "l")
    b = _keyed(records, record_id, keys, [own.alias("r")]).select(F.col("id").alias("b"), more.alias("right_keys"), "key", "r")
    least = F.col("left_keys").isNull() | F.col("right_keys").isNull() | (F.col("key") == F.array_min(F.array_intersect("left_keys", "right_keys")))
    return a.join(b, "key").where((F.col("a") < F.col("b")) & least).select("a", "b", "l", "r")


def pairs(records: DataFrame, record_id: str, keys: Column) -> DataFrame:
    """(a, b) with a < b of records that share a key, each pair once; see sided_pairs."""
    return sided_pairs(records, record_id, keys, [record_id]).select("a", "b")


def _present(name: str) -> Column:
    return F.col(f"l.{name}").isNotNull() & (F.col(f"l.{name}").cast("string") != "") & F.col(f"r.{name}").isNotNull() & (F.col(f"r.{name}").cast("string") != "")


def _same(name: str) -> Column:
    return _present(name) & (F.col(f"l.{name}") == F.col(f"r.{name}"))


RULES = [("SSN_EXACT", ["ssn"]), ("MBI_EXACT", ["mbi"]), ("MRN_SYSTEM", ["mrn", "system"]), ("NAME_DOB_GENDER", ["family", "given", "birth_date", "gender"]), ("NAME_DOB_ZIP", ["family", "given", "birth_date", "zip"])]


def rule_keys(columns: list[str], within: str) -> dict[str, Column]:
    """For each rule whose fields are among the columns its key: the texts of its fields and of the column within which records meet; null where one is missing."""
    keys = {}
    for name, fields in RULES:
        if set(fields) <= set(columns):
            given = F.col(within).isNotNull()
            for f in fields:
                given = given & F.col(f).isNotNull() & (F.col(f).cast("string") != "")
            keys[name] = F.when(given, F.to_json(F.array(*[F.col(f).cast("string") for f in (within, *fields)])))
    return keys


def ruled_pairs(records: DataFrame, record_id: str, within: str) -> DataFrame:
    """(a, b, rule) of all pairs with one value of the column within for which a deterministic rule holds, each under the first one.

    Records meet by a join for each rule on its own fields, not by the column alone, which would compare all of its records with each other.
    """
    keys = rule_keys(records.columns, within)
    keyed = records.select(F.col(record_id).alias("id"), *[v.alias(k) for k, v in keys.items()])
    out = keyed.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit("").alias("rule")).where("false")
    for n, name in enumerate(keys):
        own = list(keys)[: n + 1]
        l, r = (keyed.where(F.col(name).isNotNull()).select(F.col("id").alias(end), *[F.col(k).alias(f"{end}_{k}") for k in own]) for end in "ab")
        met = l.join(r, F.col(f"a_{name}") == F.col(f"b_{name}")).where("a < b")
        for k in own[:-1]:  # what an earlier rule links is that rule's
            met = met.where(F.coalesce(F.col(f"a_{k}") != F.col(f"b_{k}"), F.lit(True)))
        out = out.unionByName(met.select("a", "b", F.lit(name).alias("rule")))
    return out


def rule(columns: list[str]) -> Column:
    """Name of the first deterministic rule that holds, by priority: national number, beneficiary number, record number of one system, then demographics."""
    out = F
    for name, fields in RULES:
        if set(fields) <= set(columns):
            held = F.lit(True)
            for f in fields:
                held = held & _same(f)
            out = out.when(held, name)
    return out.otherwise(F.lit(None).cast("string")) if out is not F else F.lit(None).cast("string")


#: Different names of a field up to which all pairs of them are compared beforehand; with more, names are compared pair by pair of records.
FEW_NAMES = 512
NAMES = ("family", "given")


def _name_similarity(a: Column, b: Column) -> Column:
    return similarity.jaro_winkler(identifiers.person_name(a), identifiers.person_name(b))


def _listed(spark: SparkSession, texts: list[str], name: str, tasks: int = 1) -> DataFrame:
    """A row for each text, made without Python workers."""
    return spark.range(0, len(texts), 1, tasks).select(F.get(F.array(*[F.lit(x) for x in texts]).cast("array<string>"), F.col("id").cast("int")).alias(name))


def name_similarities(met: DataFrame, records: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """met (l, r) with the similarity of each name field of which records have few different values, for score; others are left to score itself."""
    for name in NAMES:
        if name not in records.columns or name not in (weights or WEIGHTS):
            continue
        own = records.select(F.col(name).cast("string").alias("x")).where("x <> ''").distinct()
        few = [x.x for x in own.limit(FEW_NAMES + 1).collect()]
        if len(few) > FEW_NAMES:
            continue
        l, r = _listed(met.sparkSession, few, f"{name}_l", 1 + len(few) // 64), _listed(met.sparkSession, few, f"{name}_r")
        table = l.crossJoin(r).withColumn(f"{name}_similarity", _name_similarity(F.col(f"{name}_l"), F.col(f"{name}_r")))
        same = (F.col(f"l.{name}").cast("string") == F.col(f"{name}_l")) & (F.col(f"r.{name}").cast("string") == F.col(f"{name}_r"))
        met = met.join(F.broadcast(table), same, "left").drop(f"{name}_l", f"{name}_r")
    return met


def score(columns: list[str], weights: dict[str, float] | None = None, known: list[str] | None = None) -> Column:
    """Weighted mean of the fields' similarities over the fields that both records have; 0 where they share none. known: columns of the pairs; names whose similarity is among them aren't compared again."""
    weights, total, weight = weights or WEIGHTS, F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        if name not in columns:
            continue
        a, b = F.col(f"l.{name}").cast("string"), F.col(f"r.{name}").cast("string")
        if name in NAMES:
            value = F.col(f"{name}_similarity") if f"{name}_similarity" in (known or []) else _name_similarity(a, b)
        elif name == "phone":
            value = identifiers.phone_score(a, b)
        elif name == "ssn":
            x, y = identifiers.ssn(a), identifiers.ssn(b)
            value = F.when((x != "") & (x == y), 1.0).otherwise(0.0)
        else:
            value = F.when(a == b, 1.0).otherwise(0.0)
        total = total + F.when(_present(name), F.coalesce(value, F.lit(0.0)) * w).otherwise(0.0)
        weight = weight + F.when(_present(name), F.lit(w)).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(0.0)


def confirmed(rule_name: Column, value: Column) -> Column:
    """Whether classify says confirmed; as a filter it has the score once and not for each class."""
    return rule_name.isNotNull() | (value >= CONFIRMED)


def classify(rule_name: Column, value: Column) -> Column:
    return F.when(confirmed(rule_name, value), "confirmed").when(value >= REVIEW, "review").when(value >= POSSIBLE, "possible").otherwise("none")


def duplicates(records: DataFrame, record_id: str, keys: Column, weights: dict[str, float] | None = None) -> DataFrame:
    """(a, b, rule, score, class) of all pairs that share a key and are at least possible."""
    columns = records.columns
    met = name_similarities(sided_pairs(records, record_id, keys), records, weights)
    scored = met.select("a", "b", rule(columns).alias("rule"), score(columns, weights, met.columns).alias("score"))
    return scored.withColumn("class", classify(F.col("rule"), F.col("score"))).where("class <> 'none'")


#: Fields of which a rule or score may ask more than whether both records have the same.
VALUED = (*NAMES, "phone", "ssn")


def alike_pairs(records: DataFrame, record_id: str, within: list[str], fields: list[str]) -> DataFrame:
    """(l, r, pairs): of the pairs of records with the same values of the columns within, how many have such fields, for rule and score.

    The sides have the values of VALUED fields; of others only whether they are given and the same. Pairs are counted and not made: for each set of
    fields, those that agree in these, in others or not, are sums of products of how many records are alike. Sums of alternating sign then give those
    that agree in just these; pairs of one id are taken off. That needs a row for each kind of record and set (2 ** n for n fields that aren't VALUED
    or within), and one for each two kinds of sides that agree in a set and its values, which are fewer than pairs of records and don't grow with copies.
    Which record comes first is lost. No rule or score depends on it: Jaro too passes over the same characters from either side.
    """
    free = [f for f in fields if f not in (*VALUED, *within)]
    bits = {f: 1 << k for k, f in enumerate([*free, *[f for f in fields if f in within and f not in VALUED]])}
    shared, sets = sum(b for f, b in bits.items() if f in within), F.array(*[F.lit(k) for k in range(1 << len(free))])
    texts = {f: F.when(F.col(f).cast("string") != "", F.col(f).cast("string")) for f in fields}
    mask = sum((F.when(texts[f].isNotNull(), b).otherwise(0) for f, b in bits.items()), F.lit(0))

    def subsets(of: str) -> Column:
        return F.explode(F.filter(sets, lambda s: s.bitwiseAND(F.col(of)) == s))

    places, values = [f"within{k}" for k in range(len(within))], [f"free{k}" for k in range(len(free))]
    own = records.select(
        F.col(record_id).alias("id"), F.lit("").alias("copy"), *[F.col(w).cast("string").alias(p) for w, p in zip(within, places, strict=True)],
        F.struct(*[texts[f].alias(f) for f in fields if f in VALUED], mask.alias("mask")).alias("side"), *[texts[f].alias(v) for f, v in zip(free, values, strict=True)],
    ).dropna(subset=["id", *places])
    twice = own.groupBy("id").count().where("count > 1").select("id")
    if not twice.isEmpty():  # their pairs are counted once more, to be taken off
        own = own.unionByName(own.join(twice, "id").withColumn("copy", F.concat(F.lit("of "), F.col("id").cast("string"))))
    # alike records are one row, dealt over all tasks, before there is one for each set
    kinds = own.groupBy("copy", *places, "side", *values).agg(F.count("*").alias("n")).withColumn("agreed", subsets("side.mask"))
    keys = ["copy", *places, "agreed", *values]
    kinds = kinds.withColumns({v: F.when(F.col("agreed").bitwiseAND(bits[f]) != 0, F.col(v)).otherwise("") for f, v in zip(free, values, strict=True)}).groupBy(*keys, "side").agg(F.sum("n").alias("n"))
    l, r = (kinds.select(*keys, F.col("side").alias(end), F.col("n").alias(f"{end}_n")) for end in "lr")
    agreed = l.join(r, keys).where("l <= r").groupBy("agreed", "l", "r").agg(F.sum(F.expr("if(copy = '', 1, -1) * if(l = r, l_n * (l_n - 1) div 2, l_n * r_n)")).alias("pairs"))
    just = agreed.withColumn("same", subsets("agreed")).groupBy("same", "l", "r").agg(F.sum(F.expr("if(bit_count(agreed ^ same) % 2 = 0, pairs, -pairs)")).alias("pairs")).where("pairs > 0")

    def side(end: str, same: Column) -> Column:
        text = {f: F.when(F.col(f"{end}.mask").bitwiseAND(b) != 0, F.when(same.bitwiseAND(b) != 0, "same").otherwise("other")) for f, b in bits.items()}
        return F.struct(*[text.get(f, F.col(f"{end}.{f}")).alias(f) for f in fields]).alias(end)

    return just.select(side("l", F.lit(-1)), side("r", F.col("same").bitwiseOR(F.lit(shared))), "pairs")


def candidates(records: DataFrame, targets: DataFrame, record_id: str, keys: Column, least: float, n: int) -> DataFrame:
    """The n best records for each target by score, from those that share a key; targets have the records' columns."""
    t = targets.select(F.col(record_id).alias("a"), F.struct(*records.columns).alias("l"), F.explode(keys).alias("key"))
    c = records.select(F.col(record_id).alias("b"), F.struct(*records.columns).alias("r"), F.explode(keys).alias("key"))
    met = t.join(c, "key").where("a <> b").dropDuplicates(["a", "b"])
    scored = met.select("a", "b", score(records.columns).alias("score")).where(F.col("score") >= least)
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b")))
    return ranked.where(F.col("place") <= n)


def index_add(index: DataFrame, batch: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(matched: record_id, existing_id; new records): a record is known by the first key column whose value the index has."""
    out = batch
    for k, name in enumerate(keys):
        known = index.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(name).agg(F.min("record_id").alias(f"known{k}"))
        out = out.join(known, name, "left")
    found = F.coalesce(*[F.col(f"known{k}") for k in range(len(keys))])
    out = out.withColumn("existing_id", found).drop(*[f"known{k}" for k in range(len(keys))])
    return out.where("existing_id IS NOT NULL").select("record_id", "existing_id"), out.where("existing_id IS NULL").select(*batch.columns)


def merged(links: DataFrame, merges: DataFrame) -> DataFrame:
    """links (a, b, status) with each end replaced by the record that it was merged into (from_id, to_id)."""
    for end in ("a", "b"):
        links = links.join(merges.select(F.col("from_id").alias(end), "to_id"), end, "left").withColumn(end, F.coalesce("to_id", end)).drop("to_id")
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "status").distinct()


def index_metrics(records: DataFrame, links: DataFrame) -> DataFrame:
    r = records.agg(F.count("*").alias("records"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "merged").alias("merged"))
    link = links.agg(F.count("*").alias("links"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(F.col("status") == "review").alias("in_review"))
    return r.crossJoin(F.broadcast(link))  # a row each
