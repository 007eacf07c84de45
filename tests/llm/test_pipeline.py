"""The pipeline's stages against the operators and brute force."""

import os
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from carelake.llm import pii, quality_model, shingle_sets, textstats, toxicity

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, n = {r.doc_id: r.text for r in docs.collect()}, docs.count()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.staged(stage(spark, kept, DATA), name)
        assert kept.columns == docs.columns
        assert kept.count() <= n
        n = kept.count()
    gone = set(before) - {r.doc_id for r in kept.collect()}
    assert all(i in before for i in gone)
    assert sum(labels[i].quality == 0 for i in gone if i in labels) >= 0.8 * sum(x.quality == 0 for x in labels.values())
    name, last = corpus_pipeline.STAGES[-1]
    rows = last(spark, kept, DATA).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept.collect()}


def test_odd_rows(spark):
    rows = [(None, None, "en", "s", None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "Good words " * 30, None, None, 330)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
    assert docs.count() <= 4


def plain_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar_or_equal(a, b):
    return a == b or len(a & b) * 5 >= len(a | b) * 4


@pytest.mark.parametrize("limits", [{}, {"block_hashes": 100}])
def test_near_dedup_brute_force(spark, limits):
    """Blocks in one task, and blocks that stay dealt over all tasks."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    long = [r for r in rows if len((r[1] or "").split()) > 120][:10]
    for n, r in enumerate(long):
        words = r[1].split()
        for k in range(2):  # each changed word takes five shingles
            words[10 + 40 * k] = f"changed{n}x{k}"
            rows.append((900_000 + 10 * n + k, " ".join(words), *r[2:]))
        half = words[: len(words) // 2]
        rows.append((900_000 + 10 * n + 9, " ".join(half + [f"other{n}x{i}" for i in range(len(half))]), *r[2:]))
    frame = spark.createDataFrame(rows, docs.schema)
    sets = [plain_shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and similar_or_equal(sets[i], sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for r, x in zip(rows, label, strict=True):
        least[x] = min(r[0], least.get(x, r[0]))
    want = sorted(least.values())
    assert not {900_000 + 10 * n for n in range(len(long))} & set(want)  # the planted near copies are found by brute force
    got = shingle_sets.keep_one(frame, **limits)
    assert sorted(r.doc_id for r in got.collect()) == want


def chain(n):
    """Sets of which each is similar to its neighbours alone."""
    return [np.arange(k * 10, k * 10 + 100, dtype=np.uint64) for k in range(n)]


@pytest.mark.parametrize("queries", [4096, 3])
def test_large_blocks_by_rounds(spark, queries):
    """Chains, a dense group and sets that are alone, in two blocks; few queries a round."""
    draw = np.random.default_rng(5)
    dense = [np.unique(np.concatenate([np.arange(5000, 5100), draw.integers(6000, 7000, 8)])).astype(np.uint64) for _ in range(40)]
    alone = [draw.integers(1 << 40, 1 << 50, 50).astype(np.uint64) for _ in range(6)]
    sets = [np.unique(x) for x in chain(12) + dense + alone]
    rows = [(k % 2, k, x.tobytes()) for k, x in enumerate(sets)]
    got = {r.fp: r.head for r in shingle_sets.large_heads(spark.createDataFrame(rows, "root long, fp long, hashes binary"), queries).collect()}
    for root in range(2):
        own = [k for r, k, _ in rows if r == root]
        label = {k: k for k in own}
        for a in own:
            for b in own:
                shared = len(np.intersect1d(sets[a], sets[b]))
                if shared * 5 >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                    old, new = label[a], label[b]
                    label = {k: new if v == old else v for k, v in label.items()}
        assert {(a, b) for a in own for b in own if got[a] == got[b]} == {(a, b) for a in own for b in own if label[a] == label[b]}
    assert len(shingle_sets.similar([sets[k] for k in range(12)])) == 12 and set(shingle_sets.similar(chain(3))) == {0}


def test_near_dedup_odd_rows(spark):
    rows = [(None, "a b c", 1), (7, "A  b\nc", 2), (7, "a b c", 3), (None, None, 4), (None, "", 5), (9, "x " * 60000, 6), (8, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row_of_keep_one long")
    kept = shingle_sets.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(r[2] for r in kept.collect())
    assert len(got) == 4 and set(got) & {2, 3} and set(got) & {4, 5} and {6, 7} <= set(got)
    assert shingle_sets.keep_one(docs.limit(0)).count() == 0


def plain_redaction(text):
    """The four patterns one by one, without the network."""
    digits = lambda x: re.sub("[^0-9]", "", x)
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    out, at = "", 0
    for a, kind, b in sorted(spans):
        if a >= at:
            out += text[at:a] + f"[{pii.KINDS[kind].upper()}]"
        at = max(at, b)
    return out + text[at:]


def test_each_stage_by_plain_computation(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda frame: {r.doc_id for r in frame.select("doc_id").collect()}
    model = quality_model.fit(docs, labels)
    assert ids(stages["quality_classifier"](spark, docs, data)) == {i for i, t in text.items() if model.score(np.array([textstats.features(t)], float))[0] >= 0.3}
    lexicon = toxicity.fit(docs, labels)
    assert ids(stages["toxicity"](spark, docs, data)) == {i for i, t in text.items() if lexicon.score(t) < 0.5}
    tagger = pii.fit(docs)
    redacted = {r.doc_id: r for r in stages["pii"](spark, docs, data).collect()}
    assert redacted.keys() == text.keys()
    touched = 0
    for i, t in text.items():
        if not pii.all_spans(tagger, [t])[0][1]:  # the network adds nothing
            assert (redacted[i].text or "") == plain_redaction(t)
            touched += redacted[i].text != t
        assert redacted[i].text is None or redacted[i].n_chars == len(redacted[i].text)
    assert touched > 10
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    some = docs.where("doc_id % 7 = 0")
    want = sorted((i, k // 2048, k, min(2048, n - k)) for i, t in text.items() if i % 7 == 0 for n in [len(library.encode(t, add_special_tokens=False).ids) + 1] for k in range(0, n, 2048))
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in stages["best_fit_packing"](spark, some, data).collect()) == want


def test_empty_long_and_clashing(spark):
    clash = ["row_of_classifier", "text_of_row", "id", "fp", "head", "score", "predicted", "redacted", "row_of_redact", "_row_of_keep_one", "label", "hash"]
    rows = [(1, "Good words of some length here. " * 20_000, *[f"c{k}" for k in range(len(clash))]), (2, None, *[None] * len(clash)), (None, "mail a.b@c.org now", *["x"] * len(clash))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert stage(spark, docs.limit(0), DATA).count() == 0
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            assert all(tuple(r[c] for c in clash) in {x[2:] for x in rows} for r in out.collect())


def test_run_leaves_only_its_last_tables(spark, tmp_path):
    from carelake.llm import common

    before = len(common.MADE)
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and [r.length for r in rows]
    made = [p.removeprefix("file://") for p in common.MADE[before:]]
    assert len(made) > 10 and sum(os.path.exists(p) for p in made) <= 4


def test_large_block_takes_few_rounds(spark, monkeypatch):
    """A block that many sets keep open: rounds double their queries, so that the driver runs few queries; 64 a round would take ten rounds."""
    draw = np.random.default_rng(7)
    sets = [np.unique(draw.integers(1 << 40, 1 << 50, 20)).astype(np.uint64) for _ in range(560)] + [np.arange(k // 2, 100 + k // 2, dtype=np.uint64) for k in range(60)]
    rows = [(0, k, x.tobytes()) for k, x in enumerate(sets)]
    asked, own = [], shingle_sets.query_links
    monkeypatch.setattr(shingle_sets, "query_links", lambda members, queries: asked.append(len(queries)) or own(members, queries))
    got = {r.fp: r.head for r in shingle_sets.large_heads(spark.createDataFrame(rows, "root long, fp long, hashes binary")).collect()}
    assert len(asked) <= 4 and asked[0] == shingle_sets.EACH and max(asked) <= shingle_sets.QUERIES
    assert [got[k] for k in range(560)] == list(range(560)) and len({got[k] for k in range(560, 620)}) == 1
    joined = [tuple(r) for r in own(spark.createDataFrame(rows, "root long, fp long, hashes binary").coalesce(1), rows[560:]).collect()]
    assert len(joined) <= 60 + 59 and set(shingle_sets.reach(lambda x, left: np.array([(x + 560, k + 560) in joined or (k + 560, x + 560) in joined for k in left], bool), 60)) == {0}
