"""Toxicity by maximum-scoring segments over token log-odds.

A token is a word in lower case; its forms are the word and its prefixes, so that inflected forms share evidence. The log-odds of a form
between toxic and other labelled texts are smoothed by a Dirichlet prior in proportion to the form's share of both. A token scores what its
most significant form says, if that is significant at all, less a drift, so that ordinary text loses score. A linear-time scan then finds all
maximal-scoring segments of a text; each is a candidate passage. Extreme-value theory (scores of the best segment in n random tokens follow a
Gumbel law with parameters lambda and K) turns segment scores into comparable excesses over what a text of that length gives by chance;
the excesses of a text's significant segments are added, and a logistic fitted to labels maps the sum to 0..1.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_ended, held_out, map_texts

PRIOR, FLOOR, SIGNIFICANT, DRIFT, CLIP = 4.0, 0.3, 3.5, 0.4, 6.0
#: Labelled rows that a lexicon is learned from, at most (those with the least hashes of their ids), and characters of such a row.
FIT_ROWS, FIT_CHARS = 8_000, 50_000
PREFIXES = (4, 5, 6, 7, 8)
STRIP = ".,;:!?*#$%&|<>()[]{}\"'`"
THRESHOLD, ALPHA = 0.5, 0.05
#: Forms that a lexicon keeps at most, the most significant ones; forms seen in fewer texts than that are left out.
LEXICON, LEAST_TEXTS = 50_000, 3


def tokens(text: str) -> list[str]:
    return [w for x in text.lower().split() if (w := x.strip(STRIP))]


def forms(token: str) -> list[str]:
    """The token, marked as a whole, and its proper prefixes."""
    return [f"{token}$"] + [token[:n] for n in PREFIXES if n <= len(token)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end exclusive, score) in order, by the linear scan over cumulative sums.

    Each open candidate has the sums before and after it. A new one joins the nearest candidate to the left whose left sum is lower, unless
    that one's right sum is at least its own; otherwise it stands alone. Runs without a positive score are passed over at once.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    out: list[tuple[int, int, float, float]] = []  # start, end, left sum, right sum
    below: list[int] = []  # of each candidate: the nearest to the left with a lower left sum
    for k in np.nonzero(scores > 0)[0].tolist():
        start, end, left, right = k, k + 1, float(total[k]), float(total[k + 1])
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = below[j]
            if j < 0 or out[j][3] >= right:
                break
            start, left = out[j][0], out[j][2]
            del out[j:], below[j:]
        out.append((start, end, left, right))
        below.append(j)
    return [(a, b, r - x) for a, b, x, r in out]


class Lexicon:
    """Token scores, Gumbel parameters and the final logistic, learned from labelled texts."""

    def __init__(self, texts: Iterable[str], labels: Iterable[float]):
        pool: dict[str, str] = {}  # equal tokens are one string
        docs, y = [[pool.setdefault(w, w) for w in tokens(x)] for x in texts], np.array(list(labels), float)
        self.scores, self.lam, self.k, self.slope, self.offset = {}, 1.0, 0.1, 0.0, 0.0
        self.seen: dict[str, float] = {}
        if len(y) and 0 < y.sum() < len(y):
            self._learn(docs, y)
        else:
            share = (y.sum() + 0.5) / (len(y) + 1) * 0.9
            self.offset = math.log(share / (1 - share))

    def _learn(self, docs: list[list[str]], y: np.ndarray) -> None:
        """Texts count a form once. Copies, exact or near, share the weight of one text: they mostly have the same least hash of three words."""
        key = [min((zlib.crc32(" ".join(t).encode()) for t in zip(w, w[1:], w[2:], strict=False)), default=-k) for k, w in enumerate(docs)]
        copies = Counter(key)
        index: dict[str, int] = {}
        own = [np.unique(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))) for words in docs]
        weights, sides = [1 / copies[k] for k in key], [int(label) for label in y]
        n = [sum(w for w, side in zip(weights, sides, strict=True) if side == k) for k in range(2)]
        found = []
        whole = None
        for size in (None, *PREFIXES):  # whole words first, then the prefixes of each length, as numbers
            names: dict[str, int] = {}
            form = np.array([k if size is None else names.setdefault(w[:size], len(names)) if size <= len(w) else -1 for k, w in enumerate(index)], np.int64)
            seen = np.zeros((2, len(index) if size is None else len(names)))
            for ids, weight, side in zip(own, weights, sides, strict=True):
                held = ids if size is None else np.unique(form[ids])
                seen[side, held[held >= 0]] += weight
            if size is None:
                whole, telling = seen[1], np.ones(seen.shape[1], bool)
            else:  # one word alone says nothing of other words with its prefix
                widest, has = np.zeros(seen.shape[1]), form >= 0
                np.maximum.at(widest, form[has], whole[has])
                telling = widest <= 0.5 * seen[1]
            total = seen.sum(axis=0)
            at = np.nonzero(telling & (total >= LEAST_TEXTS))[0]
            prior = FLOOR + PRIOR * total[at] / (n[0] + n[1])
            toxic, other = seen[1, at] + prior, seen[0, at] + prior
            delta = np.log(toxic / (n[1] + PRIOR + 1)) - np.log(other / (n[0] + PRIOR + 1))
            z = delta / np.sqrt(1 / toxic + 1 / other)
            texts = list(index if size is None else names)
            found += [(abs(v), f"{texts[i]}$" if size is None else texts[i], d) for i, v, d in zip(at.tolist(), z.tolist(), delta.tolist(), strict=True) if abs(v) >= SIGNIFICANT]
        del index, own
        self.scores = {f: (z, max(-CLIP, min(CLIP, d))) for z, f, d in sorted(found, reverse=True)[:LEXICON]}
        plain = [self.token_scores(w) for w, label in zip(docs, y, strict=True) if not label]
        self._gumbel(plain)
        x = np.array([self.excess(self.token_scores(w)) for w in docs])
        self._logistic(x, y)
        self.seen.clear()  # tasks begin with none

    def token_score(self, token: str) -> float:
        best = max((self.scores[f] for f in forms(token) if f in self.scores), default=None)
        return (best[1] if best else 0.0) - DRIFT

    def token_scores(self, words: list[str]) -> np.ndarray:
        """Scores in order; a word that stands right after itself adds no evidence."""
        seen = self.seen
        if new := set(words).difference(seen):
            if len(seen) > 4 * LEXICON:
                seen.clear()
                new = set(words)
            seen.update((w, self.token_score(w)) for w in new)
        out = np.array([seen[w] for w in words])
        if len(out) > 1:
            out[1:][np.fromiter(map(eq, words, words[1:]), bool, len(words) - 1)] = -DRIFT
        for w in new:
            if len(w) > 64:
                del seen[w]
        return out

    def _gumbel(self, plain: list[np.ndarray]) -> None:
        """lambda solves E exp(lambda s) = 1 over tokens of texts that aren't toxic; K follows from their best segments' mean."""
        s = np.concatenate([*plain, [-DRIFT]])
        values, count = np.unique(np.round(s, 3), return_counts=True)
        share = count / count.sum()
        if values.max() > 0 and (values * share).sum() < 0:
            low, high = 1e-6, 1.0
            while (share * np.exp(high * values)).sum() < 1 and high < 64:
                high *= 2
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if (share * np.exp(mid * values)).sum() < 1 else (low, mid)
            self.lam = low
        best = [(max((x[2] for x in segments(w)), default=0.0), len(w)) for w in plain if len(w)]
        if best:
            self.k = math.exp(np.mean([self.lam * m - math.log(n) for m, n in best]) - np.euler_gamma)

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """The significant segments: start and end token, score, and excess of lambda * score over the level that chance exceeds in ALPHA of texts."""
        if not len(scores):
            return []
        level = math.log(self.k * len(scores) + 1e-12) - math.log(-math.log(1 - ALPHA))
        return [(a, b, s, self.lam * s - level) for a, b, s in segments(scores) if self.lam * s > level]

    def excess(self, scores: np.ndarray) -> float:
        return math.log1p(sum(x[3] for x in self.passages(scores)))

    def _logistic(self, x: np.ndarray, y: np.ndarray) -> None:
        """Newton steps with a small ridge; then as many toxic as other labels weigh, as the label counts do."""
        w, b = 0.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(w * x + b, -30, 30)))
            g = np.array([((p - y) * x).sum() + 1e-2 * w, (p - y).sum()])
            q = p * (1 - p) + 1e-6
            h = np.array([[(q * x * x).sum() + 1e-2, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-3]])
            step = np.clip(np.linalg.solve(h, g), -2, 2)
            w, b = w - step[0], b - step[1]
        self.slope, self.offset = max(0.0, float(w)), float(b)

    def score(self, text: str) -> float:
        x = self.excess(self.token_scores(tokens(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * x + self.offset))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon from at most ``rows`` labelled documents of at most FIT_CHARS characters that aren't held out, with the least hashes of their ids.

    Only this bounded sample comes to the driver. Ids with several labels count once; null ids and labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= FIT_CHARS).join(F.broadcast(chosen), "doc_id")
    sample = texts.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).select("label", F.coalesce("text", F.lit("")).alias("text")).limit(rows).toPandas()
    lexicon = Lexicon(sample["text"], sample["label"])
    del sample
    forget_ended(docs.sparkSession)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The columns keep of docs with score and predicted; null and empty texts have no passages and get the lowest score."""
    return map_texts(docs, keep, "text", lambda: lambda texts: [(s := lexicon.score(x), int(s >= threshold)) for x in texts], "score double, predicted int")


def passages(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, start, end, score, excess, words): every significant passage of each text, in token numbers."""

    def find(texts: list[str]) -> list[tuple[list]]:
        out = []
        for x in texts:
            words = tokens(x)
            out.append(([(a, b, float(s), float(e), " ".join(words[a:b])) for a, b, s, e in lexicon.passages(lexicon.token_scores(words))],))
        return out

    found = map_texts(docs, ["doc_id"], "text", lambda: find, "passages array<struct<start:int,end:int,score:double,excess:double,words:string>>")
    return found.select("doc_id", F.explode("passages").alias("p")).select("doc_id", "p.*")


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs. Without labels of both kinds all scores are one prior share below the threshold."""
    return score(docs, fit(docs, labels, rows=rows), ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """docs without the rows that score as toxic; all columns stay."""
    lexicon, names = fit(docs, labels, rows=rows), docs.columns
    aside = docs.select(F.struct(*names).alias("row_of_classifier"), F.col("text").alias("text"))
    return score(aside, lexicon, ["row_of_classifier"]).where("predicted = 0").select("row_of_classifier.*")
