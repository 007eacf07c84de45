"""Look-ups in terminology releases: drugs, national drug codes, laboratory codes, diagnoses, concepts, their counts, releases and pins.

Asked codes are DataFrames, so that a look-up is one equi-join for any number of them; searches by text are one scan with a bounded top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Term types that a national drug code stands for, and the order of term types in a search by name.
NDC_TYPES = ["SCD", "SBD", "GPCK", "BPCK"]
DRUG_ORDER = ["IN", "BN", "SCD", "SBD"]


def in_release(rows: DataFrame, releases: DataFrame, vocabulary: str, pins: DataFrame | None = None) -> DataFrame:
    """rows (with release_id) of the vocabulary's pinned release, else of its active one. pins has vocabulary and release_id."""
    own = releases.where(F.col("vocabulary") == vocabulary)
    chosen = own.where("is_active").select("release_id")
    if pins is not None:
        pinned = pins.where(F.col("vocabulary") == vocabulary).select("release_id")
        state = chosen.withColumn("rank", F.lit(1)).unionByName(pinned.withColumn("rank", F.lit(0)))
        chosen = state.withColumn("best", F.min("rank").over(Window.partitionBy(F.lit(vocabulary)))).where("rank = best").select("release_id")
    return rows.join(chosen.distinct(), "release_id", "left_semi")


def activated(releases: DataFrame, vocabulary: str, release_id: int) -> DataFrame:
    """releases after one of them is made its vocabulary's active one."""
    own = F.col("vocabulary") == vocabulary
    return releases.withColumn("is_active", F.when(own, F.col("release_id") == release_id).otherwise(F.col("is_active")))


def _bare(code: Column) -> Column:
    return F.regexp_replace(code, "[- ]", "")


def drugs_of_ndc(asked: DataFrame, xref: DataFrame, concepts: DataFrame) -> DataFrame:
    """(ndc, rxcui, tty, name) for each asked ndc, in any form: clinical and branded drugs and packs of the same release, not suppressed ones."""
    known = xref.select(_bare(F.col("ndc")).alias("bare"), "rxcui", "release_id")
    own = concepts.where((F.col("suppress") == "N") & F.col("tty").isin(NDC_TYPES)).select("rxcui", "release_id", "tty", "name")
    return asked.select("ndc", _bare(F.col("ndc")).alias("bare")).join(known, "bare").join(own, ["rxcui", "release_id"]).select("ndc", "rxcui", "tty", "name")


def ingredients(asked: DataFrame, relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """(rxcui, ingredient, name) of asked drugs."""
    to = relations.where("rela = 'has_ingredient'").select(F.col("rxcui1").alias("rxcui"), F.col("rxcui2").alias("ingredient"), "release_id")
    own = concepts.where("suppress = 'N' AND tty = 'IN'").select(F.col("rxcui").alias("ingredient"), "release_id", "name")
    return asked.select("rxcui").join(to, "rxcui").join(own, ["ingredient", "release_id"]).select("rxcui", "ingredient", "name")


def brand_names(asked: DataFrame, relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """(rxcui, brand, name) of asked ingredients, each once."""
    to = relations.where("rela = 'tradename_of'").select(F.col("rxcui2").alias("rxcui"), F.col("rxcui1").alias("brand"), "release_id")
    own = concepts.where("suppress = 'N' AND tty = 'BN'").select(F.col("rxcui").alias("brand"), "release_id", "name")
    return asked.select("rxcui").join(to, "rxcui").join(own, ["brand", "release_id"]).select("rxcui", "brand", "name").distinct()


def ndcs_of(asked: DataFrame, xref: DataFrame) -> DataFrame:
    """(rxcui, ndc) of asked drugs, with the codes as 5-4-2."""
    from .terminology import ndc

    return asked.select("rxcui").join(xref.select("rxcui", ndc(_bare(F.col("ndc"))).alias("ndc")), "rxcui")


def drug_search(concepts: DataFrame, term: str, limit: int) -> DataFrame:
    """Drugs whose name holds the term: ingredients first, then brands, clinical and branded drugs, others; shorter names first."""
    rank = F
    for k, tty in enumerate(DRUG_ORDER):
        rank = rank.when(F.col("tty") == tty, k)
    hit = concepts.where(F.contains(F.lower("name"), F.lit(term.lower())) & (F.col("suppress") == "N"))
    return hit.withColumn("rank", rank.otherwise(len(DRUG_ORDER))).orderBy("rank", F.length("name"), "name", "rxcui").limit(limit).drop("rank")


def by_code(concepts: DataFrame, asked: DataFrame) -> DataFrame:
    """Concepts of asked (source, code)."""
    return concepts.join(asked.select("source", "code").distinct(), ["source", "code"])


def semantic_types(types: DataFrame, asked: DataFrame) -> DataFrame:
    """(cui, sty) of asked concepts, each type once."""
    return types.select("cui", "sty").join(asked.select("cui").distinct(), "cui").distinct()


def counts_by_source(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy("source").agg(F.count("*").alias("concepts"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of several tables, from one query."""
    parts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def icd_search(codes: DataFrame, term: str, limit: int) -> DataFrame:
    """Diagnoses whose text holds the term, codes that can be billed first."""
    return codes.where(F.contains(F.lower("description"), F.lit(term.lower()))).orderBy(F.col("is_billable").desc(), "code").limit(limit)


def icd_children(codes: DataFrame, asked: DataFrame) -> DataFrame:
    """(parent, code) of asked parents."""
    return codes.join(asked.select("parent").distinct(), "parent").select("parent", "code")


def icd_billable(codes: DataFrame, prefix: str = "", limit: int | None = None) -> DataFrame:
    out = codes.where(F.col("is_billable") & F.col("code").startswith(prefix.replace(".", "").upper())).orderBy("code")
    return out.limit(limit) if limit else out


def icd_categories(codes: DataFrame, chapter: str | None = None) -> DataFrame:
    """Headers, of a chapter if one is given."""
    out = codes.where(~F.col("is_billable"))
    return (out.where(F.col("chapter") == chapter) if chapter else out).orderBy("code")


def lab_index(codes: DataFrame) -> DataFrame:
    """(word, code): each word of the names and components of laboratory codes, for look-ups by words."""
    from ..functions.similarity import words

    return codes.select("code", F.explode(F.array_distinct(F.flatten(F.array(words(F.col("name")), words(F.col("component")))))).alias("word")).select("word", "code")


def lab_by_words(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, code, hits): codes that have all words of a query (query, text)."""
    from ..functions.similarity import words

    w = asked.select("query", F.explode(F.array_distinct(words(F.col("text")))).alias("word"), F.size(F.array_distinct(words(F.col("text")))).alias("wanted"))
    return w.join(index, "word").groupBy("query", "code").agg(F.count("*").alias("hits"), F.max("wanted").alias("wanted")).where("hits = wanted").select("query", "code", "hits")


def lab_class(codes: DataFrame, name: str, limit: int) -> DataFrame:
    return codes.where(F.col("class") == name).orderBy("code").limit(limit)


def with_panels(codes: DataFrame, panels: DataFrame) -> DataFrame:
    """codes with is_panel: whether the hierarchy (panel, member) has members for it."""
    return codes.join(panels.select(F.col("panel").alias("code"), F.lit(True).alias("has_members")).distinct(), "code", "left").withColumn("is_panel", F.coalesce("has_members", F.lit(False))).drop("has_members")


# Abbreviations of laboratory terms and what they stand for.
ABBREVIATIONS = {
    "WBC": "WHITE BLOOD CELLS", "RBC": "RED BLOOD CELLS", "HGB": "HEMOGLOBIN", "HCT": "HEMATOCRIT", "PLT": "PLATELETS", "MCV": "MEAN CORPUSCULAR VOLUME", "MCH": "MEAN CORPUSCULAR HEMOGLOBIN",
    "MCHC": "MEAN CORPUSCULAR HEMOGLOBIN CONCENTRATION", "GLU": "GLUCOSE", "BUN": "BLOOD UREA NITROGEN", "CREAT": "CREATININE", "NA": "SODIUM", "K": "POTASSIUM", "CL": "CHLORIDE", "CO2": "CARBON DIOXIDE",
    "CA": "CALCIUM", "MG": "MAGNESIUM", "PHOS": "PHOSPHORUS", "ALT": "ALANINE AMINOTRANSFERASE", "AST": "ASPARTATE AMINOTRANSFERASE", "ALP": "ALKALINE PHOSPHATASE", "TBIL": "TOTAL BILIRUBIN", "ALB": "ALBUMIN",
    "TP": "TOTAL PROTEIN", "CHOL": "CHOLESTEROL", "TRIG": "TRIGLYCERIDES", "HDL": "HIGH DENSITY LIPOPROTEIN", "LDL": "LOW DENSITY LIPOPROTEIN", "TSH": "THYROID STIMULATING HORMONE", "T3": "TRIIODOTHYRONINE",
    "T4": "THYROXINE", "HBA1C": "HEMOGLOBIN A1C", "A1C": "HEMOGLOBIN A1C", "PT": "PROTHROMBIN TIME", "INR": "INTERNATIONAL NORMALIZED RATIO", "PTT": "PARTIAL THROMBOPLASTIN TIME",
    "APTT": "ACTIVATED PARTIAL THROMBOPLASTIN TIME", "CBC": "COMPLETE BLOOD COUNT", "BMP": "BASIC METABOLIC PANEL", "CMP": "COMPREHENSIVE METABOLIC PANEL", "LFT": "LIVER FUNCTION TESTS", "UA": "URINALYSIS",
    "ABG": "ARTERIAL BLOOD GAS", "ESR": "ERYTHROCYTE SEDIMENTATION RATE", "CRP": "C-REACTIVE PROTEIN", "PSA": "PROSTATE SPECIFIC ANTIGEN", "BNP": "BRAIN NATRIURETIC PEPTIDE", "TROP": "TROPONIN",
}
# Laboratory terms that mean the same.
SYNONYMS = [
    ["GLUCOSE", "BLOOD SUGAR", "BS", "FBS", "FASTING GLUCOSE"],
    ["WHITE BLOOD CELLS", "LEUKOCYTES", "WBC", "WHITE COUNT"],
    ["RED BLOOD CELLS", "ERYTHROCYTES", "RBC", "RED COUNT"],
    ["HEMOGLOBIN", "HGB", "HB"],
    ["PLATELETS", "PLT", "THROMBOCYTES"],
    ["CREATININE", "CREAT", "CR"],
    ["BLOOD UREA NITROGEN", "BUN", "UREA"],
    ["POTASSIUM", "K+", "K"],
    ["SODIUM", "NA+", "NA"],
    ["CHOLESTEROL", "TOTAL CHOLESTEROL", "TC", "CHOL"],
    ["TRIGLYCERIDES", "TG", "TRIG"],
    ["HEMOGLOBIN A1C", "HBA1C", "A1C", "GLYCATED HEMOGLOBIN"],
    ["THYROID STIMULATING HORMONE", "TSH", "THYROTROPIN"],
    ["ALANINE AMINOTRANSFERASE", "ALT", "SGPT"],
    ["ASPARTATE AMINOTRANSFERASE", "AST", "SGOT"],
]

# Laboratory tests and panels by the names that orders use.
LAB_CODES = {
    "WBC": "6690-2", "RBC": "789-8", "HGB": "718-7", "HCT": "4544-3", "PLT": "777-3", "MCV": "787-2", "MCH": "785-6", "MCHC": "786-4", "GLUCOSE": "2345-7", "BUN": "3094-0", "CREATININE": "2160-0", "SODIUM": "2951-2",
    "POTASSIUM": "2823-3", "CHLORIDE": "2075-0", "CO2": "2028-9", "CALCIUM": "17861-6", "MAGNESIUM": "19123-9", "ALT": "1742-6", "AST": "1920-8", "ALP": "6768-6", "BILIRUBIN": "1975-2", "ALBUMIN": "1751-7", "PROTEIN": "2885-2",
    "CHOLESTEROL": "2093-3", "HDL": "2085-9", "LDL": "2089-1", "TRIGLYCERIDE": "2571-8", "TSH": "3016-3", "T3": "3053-6", "T4": "3026-2", "FREE_T4": "3024-7", "TROPONIN_I": "10839-9", "TROPONIN_T": "6598-7", "BNP": "30934-4",
    "PRBNP": "33762-6", "PT": "5902-2", "INR": "6301-6", "PTT": "3173-2", "HBA1C": "4548-4", "UA_GLUCOSE": "2350-7", "UA_PROTEIN": "2888-6", "UA_BLOOD": "5794-3", "UA_PH": "2756-5", "UA_SPECIFIC_GRAVITY": "2965-2",
}
PANEL_CODES = {
    "CBC": "58410-2", "BMP": "51990-0", "CMP": "24323-8", "LIPID": "57698-3", "LIPID_PANEL": "57698-3", "LFT": "24325-3", "HEPATIC": "24325-3", "URINALYSIS": "24356-8", "UA": "24356-8", "TSH": "3016-3", "HBA1C": "4548-4",
    "A1C": "4548-4", "PT_INR": "34714-6", "COAG": "34714-6",
}


def _constant_map(entries: dict[str, object]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in entries]), F.array(*[F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]) for v in entries.values()]))


def folded(text: Column) -> Column:
    """Upper case with single spaces."""
    return F.upper(F.regexp_replace(F.trim(text), "\\s+", " "))


def expanded(text: Column, abbreviations: dict[str, str] | None = None) -> Column:
    """The folded text with its abbreviated words written out."""
    known = _constant_map(abbreviations or ABBREVIATIONS)
    return F.array_join(F.transform(F.split(folded(text), " "), lambda w: F.coalesce(F.element_at(known, w), w)), " ")


def synonyms_of(text: Column) -> Column:
    """Array of the other terms of the folded text's groups; empty for terms without a group."""
    own: dict[str, list[str]] = {}
    for group in SYNONYMS:
        for term in group:
            own.setdefault(term, []).extend(x for x in group if x != term)
    return F.coalesce(F.element_at(_constant_map(own), folded(text)), F.array().cast("array<string>"))


# Spellings of a mapping's equivalence.
EQUIVALENCES = {
    "equivalent": ["equivalent", "equal", "exact"],
    "wider": ["wider", "broader"],
    "narrower": ["narrower", "more specific"],
    "inexact": ["inexact", "approximate"],
}


def equivalence(text: Column, default: str = "equivalent") -> Column:
    """Equivalence of a mapping by its spelling, in any case; the default for empty and unknown ones."""
    v, out = F.lower(F.trim(text)), F
    for name, spellings in EQUIVALENCES.items():
        out = out.when(v.isin(spellings), name)
    return out.otherwise(default)


def lab_code(name: Column) -> Column:
    """Code of a common test by its usual name in any case."""
    return F.element_at(_constant_map(LAB_CODES), F.upper(name))


def panel_code(name: Column) -> Column:
    return F.element_at(_constant_map(PANEL_CODES), F.upper(name))


def _display_score(query: Column, name: Column, component: Column) -> Column:
    """0.98 for the component, 0.97 for the name, 0.7 to 0.9 where the name holds the query, else shared words at 0.9."""
    from ..functions.similarity import token_overlap

    q, n, c = F.upper(query), F.upper(name), F.upper(component)
    return F.when(c == q, 0.98).when(n == q, 0.97).when(F.contains(n, q), 0.7 + 0.2 * F.length(q) / F.length(n)).otherwise(0.9 * token_overlap(query, F.concat_ws(" ", name, component)))


def matched(codes: DataFrame, query: str, limit: int, least: float = 0.5) -> DataFrame:
    """(code, name, confidence, via): the best tier of each laboratory code (code, name, component) for a query, best first.

    Tiers: the code itself (1), the code of a common test or panel name (1), names by the query with its abbreviations written out, by its
    synonyms (at 0.95), by the query as it is, and by edit similarity. One scan scores all of them.
    """
    from ..functions.similarity import edit_similarity

    text = " ".join(query.split()).upper()
    long = " ".join(ABBREVIATIONS.get(w, w) for w in text.split())
    alike = list(dict.fromkeys(x for group in SYNONYMS if text in group for x in group if x != text))
    alias = [c for c in (LAB_CODES.get(text), PANEL_CODES.get(text)) if c]
    tiers = [("code", F.when(F.upper("code") == text, 1.0)), ("alias", F.when(F.col("code").isin(alias), 1.0) if alias else None)]
    score = lambda q: _display_score(F.lit(q), F.col("name"), F.col("component"))
    tiers.append(("abbreviation", score(long) if long != text else None))
    tiers.append(("synonym", 0.95 * F.greatest(*[score(x) for x in alike], F.lit(0.0)) if alike else None))
    tiers += [("display", score(text)), ("fuzzy", F.greatest(edit_similarity(F.upper("component"), F.lit(text)), edit_similarity(F.upper("name"), F.lit(text))))]
    found = F.array(*[F.struct(F.coalesce(c, F.lit(0.0)).alias("score"), F.lit(-k).alias("rank"), F.lit(name).alias("via")) for k, (name, c) in enumerate(tiers) if c is not None])
    best = codes.withColumn("best", F.array_max(found)).where(F.col("best.score") >= least)
    return best.select("code", "name", F.round("best.score", 9).alias("confidence"), F.col("best.via").alias("via")).orderBy(F.desc("confidence"), "code").limit(limit)
