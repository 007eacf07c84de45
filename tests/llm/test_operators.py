"""The training-data operators against brute force, on odd rows and on the smallest tables."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from html import unescape

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carelake.llm import bpe, license_scan, media, packing, pii, quality_model, quality_rules, registry, simhash, textstats, toxicity, warc
from carelake.llm.common import shared_folder

DATA = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 9000
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id here, only text"), (7, LONG), (8, "x" * 30000), (9, "Ünïcode ÉTÉ ñandú ß İstanbul ΣΑΣ 𝔘 日本語"),
    (10, "mail a.b@c.example.com or 10.20.30.40 card 4111 1111 1111 1111 call +1 (541) 555-3219"), (11, "a <|endoftext|> b<|startoftext|>c"), (12, "\x1c\x1d|*** $$$ %%%\nline\nline\n"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated rows, with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", 1, "x", 0.5, 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, label int, words string, score double, predicted int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(None, 1, 0), (1, None, None), (4, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_bpe_equals_library(library, texts):
    vocab, draw = bpe.vocabulary(VOCABULARY), random.Random(1)
    made = ["".join(draw.choice("abceinorstthe 'st\n1<|éñÉ.,") for _ in range(draw.randint(0, 60))) for _ in range(800)]
    encoder = bpe.Encoder(vocab, bpe.LISTS, 50)  # so small that the tables turn over all the time
    for text in [t for _, t in ODD if t] + made + [t for _, t in texts] + ["a" * 3000]:
        got = [t for _, part in encoder.values([text]) for x in part for t in x]
        assert got == ids_of(library, text)
        assert bpe.decode(vocab, got) == library.decode(got, skip_special_tokens=False)


@pytest.mark.parametrize("size", [20_000, 4 << 20])
def test_bpe_columns_of_slices(library, texts, size, monkeypatch):
    """Many texts at a time, and texts in several slices, in both renderings."""
    monkeypatch.setattr(bpe, "SLICE", size)
    monkeypatch.setattr(bpe.slices, "__defaults__", (size,))
    vocab, draw = bpe.vocabulary(VOCABULARY), random.Random(2)
    made = ["".join(draw.choice("abceinorstthe 'st\n1<|éñÉ.,") for _ in range(draw.randint(0, 60))) for _ in range(300)]
    every = [t or "" for _, t in ODD] + made + [t for _, t in texts[:60]]
    for rendering in (bpe.LISTS, bpe.texts_of(vocab)):
        got = [[b"", b""] for _ in every]
        for k, part in bpe.Encoder(vocab, rendering, 200).joined(every):
            got[k] = [a + b for a, b in zip(got[k], part, strict=False)]
        for text, own in zip(every, got, strict=True):
            ids = ids_of(library, text)
            if rendering is bpe.LISTS:
                assert own[0] == np.array(ids, "<u4").tobytes()
            else:
                assert own == ["".join(f" {x}" for x in ids).encode(), "".join(f" {vocab.tokens[x]}" for x in ids).encode()]


def test_bpe_every_character(library):
    vocab = bpe.vocabulary(VOCABULARY)
    text = " ".join(f"a{chr(c)}b {chr(c)}A" for c in itertools.chain(range(1, 0xD800), range(0xE000, 0x20000), range(0x20000, 0x110000, 97)))
    assert bpe.encode(vocab, text) == ids_of(library, text)


def test_bpe_strings_of():
    """As one by one, from slices of a column too."""
    import pyarrow as pa

    column = pa.array(["x", "", "é\n", "\x1f", "\u3042\U0001f600", "", "y"], pa.large_string())
    for part in (column, column[1:6], column[5:6], column[:0], column.dictionary_encode().dictionary):
        assert bpe.strings_of(part) == part.to_pylist()


def test_bpe_encode_words(library):
    """Words as they are in the text, of which the bytes become letters all at once; long ones that fail are told apart."""
    words = ["the", "é", "ß\x7f", "naïveté", "ü" * 90, "日本", "x" * 200, "ciónosñco"]
    flat, bounds, long = bpe.vocabulary(VOCABULARY).encode_words(words)
    letters = bpe.byte_letters()
    for k, w in enumerate(words):
        got = long.get(k, flat[bounds[k] : bounds[k + 1]].tolist())
        tokens = [library.id_to_token(t) for t in got]
        assert "".join(tokens).removesuffix("</w>") == "".join(letters[b] for b in w.encode())
        if w != "ß\x7f":  # two words to the library
            assert got == ids_of(library, w)


def test_bpe_query(odd, library):
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(odd, VOCABULARY).collect())
    want = []
    for i, t in ODD:
        ids = ids_of(library, t or "")
        want.append((i or -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)


def test_packing(odd, library):
    rows = packing.pack(odd, VOCABULARY).collect()
    want = []
    for i, t in ODD:
        ids = [*ids_of(library, t or ""), 0]
        want += [(i or -1, k // 2048, k, len(p := ids[k : k + 2048]), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for k in range(0, len(ids), 2048)]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        end = 0
        for r in own:
            assert r.offset == end
            end += r.length
        assert end <= 2048


@pytest.mark.parametrize("seed", range(6))
def test_rounds_are_best_fit_decreasing(seed):
    draw, capacity = np.random.default_rng(seed), 50
    counts = np.zeros(capacity + 1, np.int64)
    for n in draw.integers(1, capacity + 1, 400) if seed % 2 else draw.integers(1, 9, 700):
        counts[n] += 1
    gaps = []  # one piece at a time
    for n in range(capacity, 0, -1):
        for _ in range(counts[n]):
            fit = min((k for k in range(len(gaps)) if gaps[k] >= n), key=lambda k: gaps[k], default=None)
            if fit is None:
                gaps.append(capacity - n)
            else:
                gaps[fit] -= n
    runs = packing.rounds(counts, capacity)
    starts = [*runs[:, 0].tolist(), int(counts.sum())]
    used = {}
    for (at, n, first, each, offset), end in zip(runs.tolist(), starts[1:], strict=True):
        for j in range(end - at):
            used.setdefault(first + j // each, []).append((offset + j % each * n, n))
    assert len(used) == len(gaps)
    assert sum(len(x) for x in used.values()) == counts.sum()
    for own in used.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)]).tolist()][:-1]
        assert sum(n for _, n in own) <= capacity


def simple_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_simhash(docs, texts, odd):
    for frame, rows in ((docs, texts), (odd, [(i, (t or "")[:400000]) for i, t in ODD])):
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
        prints = [simple_fingerprint(t) for _, t in rows]
        root = components(prints)
        want = sorted((i or -1, f"{p:016x}", rows[k][0]) for (i, _), p, k in zip(rows, prints, root, strict=True))
        got = simhash.near_duplicates(frame, members=16).collect()
        assert sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in got) == [(a, b, c if c is not None else None) for a, b, c in want]


def test_simhash_keeps_one(docs, texts, odd):
    rows = sorted(texts)
    root = components([simple_fingerprint(t) for _, t in rows])
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(rows[k][0] for k in set(root))
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert [r.doc_id for r in kept.collect()].count(5) + [r.doc_id for r in kept.collect()].count(4) == 1


def test_tree_loses_no_pair():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 63, 1500, dtype=np.uint64)
    near = np.concatenate([base, *[base[:400] ^ (np.uint64(1) << draw.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 400, dtype=np.uint64)) for _ in range(4)]])
    prints = np.unique(near)
    tree = simhash.Tree(prints[::5], len(prints), 2, 64)
    shards = [set(part.tolist()) for _, part in tree.route(prints)]
    assert len(shards) > 8
    i, j = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None]) <= 2)
    for a, b in zip(prints[i[i < j]].tolist(), prints[j[i < j]].tolist(), strict=True):
        assert any(a in s and b in s for s in shards)


@pytest.mark.parametrize("small", [0, 15, 1000])
def test_components_of_chains(spark, small):
    links = [(k, k + 1) for k in range(60)] + [(200 + 2 * k, 198 + 2 * k) for k in range(20)] + [(500, 500)]
    got = {r.vertex: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long"), small).collect()}
    assert all(got[k] == 0 for k in range(61))
    assert all(got[198 + 2 * k] == 198 for k in range(21)) and len(got) == 82
    assert simhash.components(spark.createDataFrame([], "a long, b long"), small).count() == 0


def simple_stats(text):
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_rules(texts, odd, labels):
    draw = random.Random(4)
    made = [" ".join(draw.choice("a b c".split()) for _ in range(draw.randint(0, 40))) for _ in range(300)]
    for text in [t for _, t in texts] + made + [t[:20000] for _, t in ODD if t]:
        assert textstats.base_stats(text) == simple_stats(text)
    got = quality_rules.judge(odd, labels).collect()
    assert sorted(((r.doc_id or -1), r.n_words, r.base_failed, r.kept) for r in got) == sorted(
        ((i or -1), (s := simple_stats(t or ""))[0], s[0] < 20 or 100 * s[4] > 30 * s[0], not (s[0] < 20 or 100 * s[4] > 30 * s[0])) for i, t in ODD
    )


def test_rules_are_learned():
    draw = np.random.default_rng(1)
    x = {"a": draw.random(600), "b": draw.random(600)}
    bad = (x["a"] > 0.7) & (x["b"] < 0.5)
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(600, bool)
    for r in rules:
        hit |= quality_rules._covers(r, x, 600)
    assert (hit == bad).mean() > 0.95
    assert quality_rules.learn(x, np.zeros(600, bool)) == []


@pytest.mark.parametrize(("name", "label", "least"), [("op7_quality_classifier", "quality", 0.97), ("op9_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    data = "/root/testdata/sf0.01"
    found = registry.queries()[name](spark, data)
    known = spark.read.parquet(f"{data}/labels.parquet")
    row = found.where("held_out").join(known, "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("right"), F.min("score"), F.max("score")).first()
    assert row.right >= least
    assert 0 <= row[1] <= row[2] <= 1


def test_classifiers_on_odd_rows(odd, labels):
    for classify in (quality_model.classify, toxicity.classify):
        rows = classify(odd, labels).collect()
        assert len(rows) == len(ODD)
        assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0) for r in rows)
        assert classify(odd.limit(0), labels.limit(0)).count() == 0
    assert quality_model.keep_good(odd, labels).columns == odd.columns == toxicity.keep_clean(odd, labels).columns


def test_segments_are_maximal():
    """Each found segment sums up as said, all others are worth no more than the best, and none touches zero from its left."""
    draw = random.Random(3)
    for _ in range(300):
        s = np.array([draw.choice([-2.0, -1.0, -0.5, 1.0, 2.0]) for _ in range(draw.randint(0, 25))])
        found = toxicity.segments(s)
        best = max((s[a:b].sum() for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=0)
        assert max([x[2] for x in found], default=0) == pytest.approx(max(best, 0))
        for a, b, value in found:
            assert value == pytest.approx(s[a:b].sum())
            assert all(s[a:k].sum() > 0 for k in range(a + 1, b + 1)) and all(s[k:b].sum() > 0 for k in range(a, b))
        assert all(x[1] <= y[0] for x, y in itertools.pairwise(found))
        covered = {k for a, b, _ in found for k in range(a, b)}
        assert set(np.nonzero(s > 0)[0].tolist()) <= covered


def simple_spans(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15])


def test_base_spans():
    draw = random.Random(3)
    parts = ["1", "2", "9", "0", ".", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "255", "4242", "example.com", "x@y.z", "4111111111111111"]
    for _ in range(8000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))
        assert pii.base_spans(text) == simple_spans(text), text


def test_pii_query(spark, odd):
    tagger = pii.fit(odd)
    rows = pii.find(odd, tagger).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = next(t or "" for i, t in ODD if i == r.doc_id)
        if len(text) < 1000:
            want = simple_spans(text)
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in want) for k in range(4))
            assert r.base_sha256 == hashlib.sha256(pii.written(want).encode()).hexdigest()
            assert set(filter(None, pii.written(want).split(","))) <= set(r.spans.split(","))
    clean = pii.redact(odd, tagger)
    assert clean.columns == odd.columns
    assert "[EMAIL]" in clean.where("doc_id = 10").first().text and clean.where("doc_id = 1").first().text is None
    side = "Pay +1 (826) 555-4081 190.137.223.204 now"
    own, added = pii.all_spans(tagger, [side])[0]
    assert all(s in own + added for s in simple_spans(side))


def test_warc(spark):
    rows = [(3, "http://a", "same"), (1, "http://b", "same"), (2, None, "same"), (1, "http://b", "same"), (None, "http://c", "same"), (5, "u", None), (6, "u", ""), (7, "é\n", "x" * 3_000_000), (None, "n", "only null")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    folder = f"{shared_folder(spark)}/archives/test"
    index = warc.write(pages, folder)
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(index).collect())
    least = {"same": 1, "": 5, "x" * 3_000_000: 7}
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        first = least.get(html or "")
        seen = first is not None and i != first
        want.append((i or -1, len(body), warc.digest(body), "revisit" if seen else "response", first if seen else None))
    assert got == sorted(want, key=repr) or sorted(got, key=repr) == sorted(want, key=repr)
    one = index.where("page_id = 7").first()
    headers, block = warc.fetch(one.bundle, one.frame_at, one.frame_size, one.at, one.size)
    assert headers["X-Record-Key"] == "7" and block.endswith(b"x" * 1000)
    with open(one.bundle.removeprefix("file://"), "rb") as f:
        data = f.read()
    table = warc.seek_table(data)
    assert sum(c for c, _ in table) + 8 + 8 * len(table) + 9 == len(data)
    assert len(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()) == sum(p for _, p in table)
    assert warc.archive(pages, 5).where("record_type = 'revisit'").count() == 0
    assert warc.archive(pages.limit(0)).count() == 0


def test_media(odd):
    for _, t in ODD:
        data = (t or "").encode()
        n, payload = media.from_media(media.to_media(data))
        assert n == len(data) and payload == data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
    got = sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature, r.n_items, r.position, r.caption) for r in media.store_and_read(odd).collect())
    want = []
    for i, t in ODD:
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        stored = media.to_media(data)
        lines = [x for x in (t or "").split("\n") if x]
        shown = [bool(x.split()) for x in lines]  # a line of white space is no item
        want.append((i or -1, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), plain_feature(payload), 1 + sum(shown), sum(shown[: len(lines) // 2]), f"{len(data)} bytes"))
    assert got == sorted(want)


def plain_feature(payload):
    """Sample by sample."""
    n = len(payload) // 64
    share = [payload.count(v) / len(payload) for v in range(256)]
    entropy = -sum(p * math.log2(p) for p in share if p)
    edges = [int(n * k / 8) for k in range(9)]
    grid = []
    for a, b in itertools.pairwise(edges):
        rows = range(a, max(b, a + 1)) if a < n else []
        grid += [sum(payload[64 * r + 8 * c + k] for r in rows for k in range(8)) / len(rows) if rows else 0.0 for c in range(8)]
    mean = sum(grid) / 64
    bits = "".join("1" if g > mean else "0" for g in grid)
    return f"64x{n};mean={sum(payload) / len(payload):.4f};entropy={entropy:.4f};hash={int(bits, 2):016x}"


def plain_items(html):
    """Tags and texts one after another, by a plain cut at angle brackets."""
    html = re.sub(r"<!--.*?-->|<(script|style|head)\b.*?</\1>", "", html, flags=re.S)
    out, words = [], ""
    for x in [*re.split(r"(<[^>]*>)", html), "<p>"]:
        tag = re.match(r"</?([a-zA-Z0-9]+)", x)
        if not tag:
            words += unescape(x) if not x.startswith("<") else ""
        elif tag[1] in media.BLOCKS or tag[1] in media.MEDIA_TAGS:
            if words.split():
                out.append(("text", " ".join(words.split())))
            words = ""
            if tag[1] == "img":
                out.append(("image", re.search('src="([^"]*)"', x)[1], re.search('alt="([^"]*)"', x)[1]))
    return out


def test_real_pages_are_interleaved(spark):
    """Real pages with images put between their paragraphs; one digest is stored, one isn't, one source has none."""
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").orderBy("page_id").limit(40).collect() if r.html]
    known, other = hashlib.sha256(b"k").hexdigest(), hashlib.sha256(b"o").hexdigest()
    sources = [f"sha256:{known}", f"sha256:{other}", "https://x/y.png"]
    made = []
    for i, html in rows:
        parts = html.split("<p>")
        made.append((i, "<p>".join(x + (f'<img src="{sources[k % 3]}" alt="caption {k} of {i}">' if 0 < k < len(parts) - 1 else "") for k, x in enumerate(parts))))
    found = media.sequences(spark.createDataFrame(made, "page_id long, html string").withColumn("items", F.lit("clash")))
    got = {r.page_id: r["items"] for r in found.collect()}
    for i, html in made:
        want = plain_items(html)
        assert [(x.kind, x.text or x.src) for x in got[i]] == [w[:2] for w in want]
        assert [x.position for x in got[i]] == list(range(len(want)))
        assert [x.caption for x in got[i] if x.kind != "text"] == [w[2] for w in want if w[0] != "text"]
    store = spark.createDataFrame([(known, 7)], "digest string, n_bytes long")
    refs = media.resolve(found, store).collect()
    assert len(refs) == sum(w[0] == "image" for _, html in made for w in plain_items(html)) > 40
    assert all(r.n_bytes == (7 if r.src == sources[0] else None) and r.digest == (r.src[7:] if r.src != sources[2] else None) and got[r.page_id][r.position].caption == r.caption for r in refs)


def test_interleaving():
    html = "<body><p>One &amp; two</p><figure><img src='a.png' alt='x'><figcaption>The <b>cat</b></figcaption></figure>tail<script>no</script><img src='b.png' alt='dog'><figure><img src='c.png'>"
    assert [(k, kind, text or src, caption) for k, kind, text, src, _, caption in media.items(html)] == [
        (0, "text", "One & two", None), (1, "image", "a.png", "The cat"), (2, "text", "tail", None), (3, "image", "b.png", "dog"), (4, "image", "c.png", None)
    ]
    assert media.items("") == [] and media.items("<p>") == []


def test_license_scan(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."
    rows = [(1, mit, "MIT"), (2, None, ""), (3, "", ""), (4, "text.\nReleased under the MIT License.\nmore", "MIT"), (5, "Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), (6, "SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), (7, "a licence? no", ""), (7, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.", "Apache-2.0")]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("sentences", F.lit(0))
    got = sorted((r.doc_id, r.licenses, r.n_licenses) for r in license_scan.scan(frame).collect())
    assert got == sorted((i, x, int(bool(x))) for i, _, x in rows)
    assert all(any(a in s for a in license_scan.ANCHORS) for s in license_scan.catalogue())
    assert len(license_scan.NAMES) < 200 and all(license_scan.normal(n) == n for n in license_scan.names())
    assert license_scan.scan(frame.limit(0)).count() == 0


BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAME = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED.
"""
APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
LGPL = """Foo is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software.
"""
LICENSE_TEXTS = [
    (BSD + NAME + BSD_END, "BSD-3-Clause", "rights,bsd-grant,bsd-source,bsd-binary,bsd-name,bsd-as-is"), (BSD + BSD_END, "BSD-2-Clause", "rights,bsd-grant,bsd-source,bsd-binary,bsd-as-is"),
    (BSD.replace("1.", "*").replace("2.", "*"), "BSD-2-Clause", "rights,bsd-grant,bsd-source,bsd-binary"), (BSD + NAME.replace("the copyright holder", "Google LLC"), "BSD-3-Clause", "rights,bsd-grant,bsd-source,bsd-binary,bsd-name"),
    (APACHE, "Apache-2.0", "grant Apache-2.0,apache-use,apache-copy,apache-law,apache-see"), (GPL, "GPL-3.0-or-later", "notice GPL-3.0-or-later,gnu-hope"), (LGPL, "LGPL-2.1-or-later", "notice LGPL-2.1-or-later"),
    (MPL, "MPL-2.0", "mpl-form,mpl-copy"), (MIT, "MIT", "mit-grant,mit-notice,as-is"), (ISC, "ISC", "isc-grant,isc-as-is"), (UNLICENSE, "Unlicense", "public-domain"),
    ("Released under the MIT License\nCopyright 2020 X", "MIT", "grant MIT"), ("licensed under the terms of the MIT License", "MIT", "grant MIT"), ("License: MIT", "MIT", "grant MIT"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT,Apache-2.0", "grant MIT,grant Apache-2.0"), ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later", "grant GPL-2.0-or-later"),
    ("SPDX-License-Identifier: (LGPL-2.1-only AND BSD-3-Clause)", "BSD-3-Clause,LGPL-2.1-only", "grant LGPL-2.1-only,grant BSD-3-Clause"), ("All rights reserved.", "Proprietary", "rights"),
    ("Copyright X. All rights reserved.\nReleased under the MIT License.", "MIT", "rights,grant MIT"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", "grant GPL-3.0"),
    ("https://creativecommons.org/licenses/by-sa/4.0/", "CC-BY-SA-4.0", "grant CC-BY-SA-4.0"), ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "grant CC-BY-NC-4.0"),
    ("He took his license and permission as is.", "", ""),
]


def test_license_canonical_texts(spark):
    """As they are, as comments of two kinds, in one line, and in capitals; the SQL gives the same rows."""
    import duckdb

    forms = [lambda t: t, lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */\n", lambda t: "".join(f"# {x}\r\n" for x in t.splitlines()), lambda t: " ".join(t.split()), str.upper]
    rows = [(10 * i + k, form(t), licence, ids) for i, (t, licence, ids) in enumerate(LICENSE_TEXTS) for k, form in enumerate(forms)]
    got = {r.doc_id: (r.licenses, r.sentences) for r in license_scan.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == {i: (licence, ids) for i, _, licence, ids in rows}
    documents = pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"])  # noqa: F841
    assert {i: (licence, ids) for i, ids, licence, _ in duckdb.sql(license_scan.oracle()).fetchall()} == got


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_on_empty_tables(spark, name, tmp_path):
    for t in ("documents", "labels", "pages"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = registry.queries()[name](spark, DATA).toPandas()
    want = db.sql(registry.oracle_sql()[name]).df()[got.columns.tolist()]
    plain = lambda f: sorted(repr(tuple(None if pd.isna(x) else int(x) if isinstance(x, float) else x for x in r)) for r in f.astype(object).itertuples(index=False, name=None))
    assert plain(got) == plain(want)


def test_additive_scores_by_plain_loops(texts):
    """One table entry for each feature and pair, looked up and added one by one."""
    x = np.array([textstats.features(t) for _, t in texts], float)
    model = quality_model.AdditiveModel(x, (x[:, 0] > np.median(x[:, 0])).astype(float))
    assert model.pairs and any(t.any() for t in model.tables)
    for row, got in zip(x[:60], model.score(x[:60]), strict=True):
        places = [sum(v >= c for c in cuts) for v, cuts in zip(row, model.cuts, strict=True)]
        z = model.intercept + sum(t[p] for t, p in zip(model.tables, places, strict=True)) + sum(t[places[i], places[j]] for t, (i, j) in zip(model.pair_tables, model.pairs, strict=True))
        assert got == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))


def test_rules_as_expressions(spark):
    """The learned list as a conditional expression says what plain conjunctions say, row by row."""
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(docs, known)
    assert rules
    found = quality_rules.described(docs)
    for r in found.select(quality_rules.verdict(rules).alias("rule"), *[c.alias(n) for n, c in quality_rules.statistics().items()]).collect():
        want = next((k for k, rule in enumerate(rules, 1) if all((r[n] >= t if sign == ">=" else r[n] <= t) for n, sign, t in rule)), 0)
        assert r.rule == want
    judged = {r.doc_id: r.kept for r in quality_rules.judge(docs, known).collect()}
    truth = {r.doc_id: r.quality for r in known.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in judged}
    assert np.mean([judged[i] == bool(q) for i, q in truth.items()]) > 0.9


def plain_segments(s):
    """By the definition: repeatedly the best remaining segment (the shortest, then leftmost), and then what lies on its sides."""
    if not len(s):
        return []
    best = max(((s[a:b].sum(), -(b - a), -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)))
    if best[0] <= 0:
        return []
    a, b = -best[2], -best[2] - best[1]
    return plain_segments(s[:a]) + [(a, b, best[0])] + [(b + x, b + y, v) for x, y, v in plain_segments(s[b:])]


def test_toxicity_scores_by_definition(spark):
    """Token scores by the forms' table, all maximal segments by their definition, excesses over the Gumbel level, and the logistic."""
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, known)
    assert model.scores
    toxic = known.where("toxic = 1").select("doc_id")
    short = docs.where("length(text) < 700").select("doc_id", "text")
    chosen = [r.text for part in (short.join(toxic, "doc_id"), short.join(toxic, "doc_id", "left_anti")) for r in part.orderBy("doc_id").limit(20).collect()]
    assert len(chosen) > 20 and len({round(model.score(t), 6) for t in chosen}) > 2
    for text in chosen:
        words = toxicity.tokens(text)
        scores = []
        for k, w in enumerate(words):
            held = [model.scores[f] for f in toxicity.forms(w) if f in model.scores]
            scores.append((max(held)[1] if held and words[k - 1 : k] != [w] else 0.0) - toxicity.DRIFT)
        scores = np.array(scores)
        level = math.log(model.k * len(scores) + 1e-12) - math.log(-math.log(1 - toxicity.ALPHA)) if len(scores) else 0.0
        total = sum(max(0.0, model.lam * v - level) for _, _, v in plain_segments(scores))
        z = model.slope * math.log1p(total) + model.offset
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


def test_best_tags_by_enumeration():
    """The decoder's path is the best of all paths."""
    draw = np.random.default_rng(9)
    tagger = pii.Tagger(seed=3, hidden=4)
    tagger.p["t"], tagger.p["s"] = (draw.normal(0, 1, x.shape).astype(np.float32) for x in (tagger.p["t"], tagger.p["s"]))
    x = draw.integers(1, 20, (6, 4))
    em = tagger.emissions(x)[0]
    for n, got in enumerate(tagger.decode(x)):
        value = lambda path: tagger.p["s"][path[0]] + sum(em[k, n, t] for k, t in enumerate(path)) + sum(tagger.p["t"][a, b] for a, b in itertools.pairwise(path))  # noqa: B023, E731
        assert value(got.tolist()) == pytest.approx(max(map(value, itertools.product(range(len(pii.TAGS)), repeat=4))), abs=1e-4)


def test_tagger_gradient():
    """The likelihood's gradient against differences of the likelihood, by enumeration of all paths."""
    draw = np.random.default_rng(4)
    tagger = pii.Tagger(seed=5, hidden=3)
    x, y = draw.integers(1, 20, (1, 3)), draw.integers(0, len(pii.TAGS), (1, 3))

    def loss(em, trans):
        value = lambda path: sum(em[k, 0, t] for k, t in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))
        every = np.array([value(p) for p in itertools.product(range(len(pii.TAGS)), repeat=3)])
        return every.max() + math.log(np.exp(every - every.max()).sum()) - value(y[0].tolist())

    em = tagger.emissions(x)[0].astype(float)
    trans = tagger.p["t"].astype(float)
    grad, dt, _ = tagger._crf(em, y)
    for at in [(0, 0, int(y[0, 0])), (1, 0, 2), (2, 0, int(y[0, 2]))]:
        step = np.zeros_like(em)
        step[at] = 1e-4
        assert grad[at] == pytest.approx((loss(em + step, trans) - loss(em - step, trans)) / 2e-4, abs=1e-4)
    step = np.zeros_like(trans)
    step[1, 2] = 1e-4
    assert dt[1, 2] == pytest.approx((loss(em, trans + step) - loss(em, trans - step)) / 2e-4, abs=1e-4)
