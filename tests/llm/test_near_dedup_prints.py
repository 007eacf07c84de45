"""The near-duplicate stage's fingerprints: their links are candidates beside the sketches', and exact sets decide."""

from pyspark.sql import functions as F

from carelake.llm import shingle_sets, simhash


def test_fingerprints_propose_and_sets_decide(spark, monkeypatch):
    base = " ".join(f"word{k}" for k in range(300))
    texts = [base, base + " tail", "one two three four five six", " ".join(f"other{k}" for k in range(300)), base.replace("word150", "x")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = [r.doc_id for r in shingle_sets.keep_one(docs).orderBy("doc_id").collect()]
    assert kept == [0, 2, 3]
    # without buckets of minima the fingerprints alone bring the close pair together
    monkeypatch.setattr(shingle_sets, "sketch", lambda text, words=5, own=shingle_sets.sketch: (*own(text, words)[:3], []))
    prints = [simhash.fingerprint(x, 5) for x in texts]
    near = [k for k in range(1, 5) if (prints[0] ^ prints[k]).bit_count() <= 2]
    assert near and [r.doc_id for r in shingle_sets.keep_one(docs).orderBy("doc_id").collect()] == [k for k in range(5) if k not in near]


def test_far_texts_with_close_fingerprints_stay(spark):
    rows = [(k, 7, b"", []) for k in range(3)] + [(3, 7 ^ 3, b"", []), (4, ~7, b"", [])]
    v = spark.createDataFrame(rows, "fp long, print long, signature binary, bands array<long>")
    assert sorted(map(tuple, shingle_sets.fingerprint_links(v).collect())) == [(1, 0), (2, 0), (3, 0)]
    assert sorted(map(tuple, shingle_sets.candidate_blocks(v).where(F.col("vertex") != F.col("root")).collect())) == [(1, 0), (2, 0), (3, 0)]
