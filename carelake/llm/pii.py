"""Personal data: patterns as the base, and a character-level bidirectional LSTM with CRF transitions that adds what they miss.

The network is trained in numpy from labelled spans: the base spans of a bounded sample of documents, and the same kinds of values written
in ways that the patterns pass over (numbers side by side, phones without their plus). It reads zones: every stretch of text with a digit or
an @ and what stands around it. No value of any kind is without one of these, so nothing is left out. Zones are cut into overlapping
windows of fixed length, decoded in batches. Each character takes its tag from the window in which it lies most central, and the tags of a
zone then give its spans, so a value that several windows cut comes out whole. A span of the network counts if it has the form of its kind,
stands free of letters and digits, and meets no base span.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

KINDS = ["email", "ip", "card", "phone"]
TAGS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
WINDOW, STRIDE, MARGIN = 64, 32, 16
HIDDEN, STEPS, BATCH, LEARNING = 12, 260, 96, 0.02
#: Documents whose base spans train the network, at most: those with the least hashes of their ids. Windows of them and made ones.
FIT_ROWS, FIT_WINDOWS, MADE = 6_000, 4_000, 1_500

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that fails from the start of a run of digits fails from its other digits too, so runs are taken whole and times stay linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_ZONE = re.compile(r"[0-9@](?:[^0-9@]{0,%d}[0-9@])*+" % MARGIN)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain: the local part is all that stands before an @ since the last match; one @ has one chance."""
    since, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > since and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            since = found.end()
        at = text.find("@", max(at + 1, since))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all base spans in order of start, then kind."""
    if not _TRIGGER.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def formed(kind: int, text: str) -> bool:
    """Whether a span found by the network has the form of its kind."""
    digits = _digits(text)
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text))
    if kind == 1:
        return bool(_IP.fullmatch(text)) and all(len(x) <= 3 and int(x) <= 255 for x in text.split("."))
    if kind == 2:
        return bool(_CARD.fullmatch(text)) and 12 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9])+", text)) and 9 <= len(digits) <= 15 and len(re.findall(r"[0-9][^0-9]+(?=[0-9])", text)) >= 2


_MARKS = {c: 14 + k for k, c in enumerate("@.-+()_% \n:,/\"=")}
_SYMBOLS = 14 + len(_MARKS)


def symbols(text: str) -> list[int]:
    """Small alphabet: padding 0, other 1, letters 2 and 3 by case, digits 4 to 13, each mark its own."""
    out = []
    for c in text:
        if "0" <= c <= "9":
            out.append(ord(c) - 44)
        elif (k := _MARKS.get(c)) is not None:
            out.append(k)
        else:
            out.append((3 if c.isupper() else 2) if c.isalpha() else 1)
    return out


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and @, far enough apart that no value spans two of them."""
    for m in _ZONE.finditer(text):
        yield max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)


def windows(start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(window start, end, first and last character that takes its tag there) of the overlapping windows of a zone."""
    at, edge = start, (WINDOW - STRIDE) // 2
    while True:
        last = at + WINDOW >= end
        yield at, min(end, at + WINDOW), at if at == start else at + edge, end if last else at + WINDOW - edge
        if last:
            return
        at += STRIDE


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """BiLSTM emissions, CRF transitions; everything in float32 numpy, seeded."""

    def __init__(self, seed: int = 7, hidden: int = HIDDEN):
        draw, k = np.random.default_rng(seed), len(TAGS)
        self.h = hidden
        scale = 0.3
        self.p = {
            **{f"x{d}": draw.normal(0, scale, (_SYMBOLS, 4 * hidden)) for d in "fb"},
            **{f"h{d}": draw.normal(0, scale, (hidden, 4 * hidden)) for d in "fb"},
            **{f"c{d}": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]) for d in "fb"},
            "o": draw.normal(0, scale, (2 * hidden, k)),
            "e": np.zeros(k),
            "t": np.zeros((k, k)),
            "s": np.zeros(k),
        }
        self.p = {n: v.astype(np.float32) for n, v in self.p.items()}

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """States of one direction, (T, N, h), and what the gradient needs."""
        n, t = x.shape
        wx, wh, bias, h = self.p[f"x{d}"], self.p[f"h{d}"], self.p[f"c{d}"], self.h
        out, cell, state, tape = np.zeros((t, n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = wx[x[:, k]] + state @ wh + bias
            i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            before, prior = cell, state
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            state = o * squashed
            out[k] = state
            if keep:
                tape.append((k, i, f, o, g, before, prior, squashed))
        return out, tape

    def emissions(self, x: np.ndarray, keep: bool = False):
        f, tf = self._lstm(x, "f", keep)
        b, tb = self._lstm(x, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["o"] + self.p["e"], both, tf, tb

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tag sequences (N, T) by Viterbi."""
        em, trans = self.emissions(x)[0], self.p["t"]
        best, back = em[0] + self.p["s"], []
        for k in range(1, len(em)):
            paths = best[:, :, None] + trans
            back.append(paths.argmax(1))
            best = paths.max(1) + em[k]
        tags = np.empty(x.shape, np.int8)
        at = best.argmax(1)
        tags[:, -1] = at
        for k in range(len(em) - 2, -1, -1):
            at = back[k][np.arange(len(at)), at]
            tags[:, k] = at
        return tags

    def _crf(self, em: np.ndarray, y: np.ndarray):
        """Gradient of the negative log-likelihood by emissions, transitions and start, from forward and backward sums."""
        t, n, k = em.shape
        trans, rows = self.p["t"], np.arange(n)

        def lse(a: np.ndarray, axis: int) -> np.ndarray:
            m = a.max(axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis))

        fwd, bwd = np.empty_like(em), np.zeros_like(em)
        fwd[0] = em[0] + self.p["s"]
        for i in range(1, t):
            fwd[i] = lse(fwd[i - 1][:, :, None] + trans, 1) + em[i]
        for i in range(t - 2, -1, -1):
            bwd[i] = lse(trans + (em[i + 1] + bwd[i + 1])[:, None, :], 2)
        total = lse(fwd[-1], 1)
        marginal = np.exp(fwd + bwd - total[None, :, None])
        dt = np.zeros_like(trans)
        for i in range(1, t):
            joint = fwd[i - 1][:, :, None] + trans + (em[i] + bwd[i])[:, None, :] - total[:, None, None]
            dt += np.exp(joint).sum(0)
            np.add.at(dt, (y[:, i - 1], y[:, i]), -1)
        for i in range(t):
            marginal[i, rows, y[:, i]] -= 1
        return marginal, dt, marginal[0].sum(0)

    def _back(self, x: np.ndarray, d: str, grad: np.ndarray, tape: list, out: dict) -> None:
        h, wh = self.h, self.p[f"h{d}"]
        dx, dh = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(wh)
        ds = np.zeros(grad.shape[1:], np.float32)
        dc = np.zeros_like(ds)
        bias = np.zeros(4 * h, np.float32)
        for k, i, f, o, g, before, prior, squashed in reversed(tape):
            ds = ds + grad[k]
            dc = dc + ds * o * (1 - squashed**2)
            z = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            np.add.at(dx, x[:, k], z)
            dh += prior.T @ z
            bias += z.sum(0)
            ds, dc = z @ wh.T, dc * f
        out |= {f"x{d}": dx, f"h{d}": dh, f"c{d}": bias}

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam over random batches of windows."""
        draw = np.random.default_rng(seed)
        m, v = ({n: np.zeros_like(p) for n, p in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = draw.integers(0, len(x), BATCH)
            bx, by = x[pick], y[pick]
            em, both, tf, tb = self.emissions(bx, True)
            de, dt, ds = self._crf(em, by)
            de = (de / BATCH).astype(np.float32)
            g = {"t": dt / BATCH, "s": ds / BATCH, "e": de.sum((0, 1)), "o": np.einsum("tnh,tnk->hk", both, de)}
            dboth = de @ self.p["o"].T
            self._back(bx, "f", dboth[:, :, : self.h], tf, g)
            self._back(bx, "b", dboth[:, :, self.h :], tb, g)
            rate = LEARNING * min(1.0, 2 * (1 - step / (steps + 1)))
            for n, p in self.p.items():
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v[n] = 0.99 * v[n] + 0.01 * g[n] ** 2
                p -= (rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def tag_row(length: int, spans: Iterable[tuple[int, int, int]], start: int = 0) -> list[int]:
    """Tags of a window from spans (start, kind, end) in text positions."""
    out = [0] * length
    for a, kind, b in spans:
        for k in range(max(a, start), min(b, start + length)):
            out[k - start] = 2 + 2 * kind if k > a else 1 + 2 * kind
    return out


def labelled_windows(text: str) -> list[tuple[str, list[int]]]:
    """Windows of a text's zones with the tags of its base spans; zones with numbers that might be values but match nothing are left out."""
    spans = base_spans(text)
    out = []
    for a, b in zones(text):
        own = [s for s in spans if s[0] < b and s[2] > a]
        loose = [m for m in re.finditer(r"[0-9][0-9 ().-]{10,}", text[a:b]) if not any(s[0] < a + m.end() and s[2] > a + m.start() for s in own)]
        if not loose:
            out += [(text[x:y], tag_row(y - x, own, x)) for x, y, _, _ in windows(a, b)]
    return out


def made_windows(carriers: list[str], count: int, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Windows with values that the patterns miss or take, side by side, in letters of the sample's texts."""
    draw = np.random.default_rng(seed)
    digit = lambda n: "".join(map(str, draw.integers(0, 10, n)))

    def card() -> str:
        body = digit(15)
        last = next(c for c in "0123456789" if luhn(body + c))
        whole = body + last
        return whole if draw.random() < 0.6 else draw.choice([" ", "-"]).join(whole[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        lead = draw.choice(["+1 ", "+44 ", "", "", "1-"])
        return lead + (f"({digit(3)}) {digit(3)}-{digit(4)}" if draw.random() < 0.6 else f"{digit(3)}{(s := draw.choice(['-', '.', ' ']))}{digit(3)}{s}{digit(4)}")

    word = lambda n: "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    make = [lambda: f"{word(4)}{draw.choice(['.', '_', ''])}{digit(2)}@{word(6)}.{draw.choice(['com', 'org', 'example.com'])}", lambda: ".".join(str(x) for x in draw.integers(0, 256, 4)), card, phone]
    decoys = [lambda: digit(int(draw.integers(1, 9))), lambda: f"{digit(1)}.{digit(1)}", lambda: f'token = "{"".join(draw.choice(list("0123456789abcdef"), 24))}"', lambda: f"{word(3)}{digit(12)}{word(2)}"]
    out = []
    for _ in range(count):
        left = str(draw.choice(carriers))[: int(draw.integers(0, 24))] if carriers else word(8)
        text, spans = left + " ", []
        for _ in range(int(draw.integers(1, 4))):
            kind = int(draw.integers(0, 6))
            value = make[kind]() if kind < 4 else decoys[int(draw.integers(0, 4))]()
            if kind < 4:
                spans.append((len(text), kind, len(text) + len(value)))
            text += value + str(draw.choice([" ", " ", ", ", ". ", "\n", "### ", f" {word(5)} "]))
        text += str(draw.choice(carriers))[:20] if carriers else word(8)
        out += [(text[x:y], tag_row(y - x, spans, x)) for x, y, _, _ in windows(0, len(text))]
    return out


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Tagger:
    """A tagger from the base spans of at most ``rows`` documents. Only their ids, and then at most FIT_WINDOWS windows, come to the driver."""
    chosen = docs.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = map_texts(texts, ["doc_id"], "text", lambda: lambda batch: [([(w, bytes(t)) for w, t in labelled_windows(x)],) for x in batch], "windows array<struct<text:string,tags:binary>>")
    sample = [(r[0], list(r[1])) for r in found.select(F.explode("windows").alias("w")).select("w.*").orderBy(F.xxhash64("text"), "text").limit(FIT_WINDOWS).collect()]
    carriers = [re.sub(r"[0-9@+]", "", w) for w, _ in sample[:200]]
    data = sample + made_windows(carriers, MADE)
    x, y = np.zeros((len(data), WINDOW), np.int64), np.zeros((len(data), WINDOW), np.int64)
    for k, (text, tags) in enumerate(data):
        x[k, : len(text)], y[k, : len(text)] = symbols(text), tags
    tagger = Tagger()
    tagger.train(x, y)
    return tagger


def found_spans(tagger: Tagger, texts: list[str], batch: int = 2048) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) by the network alone, for each text; windows of all texts are decoded together."""
    tags: list[dict[int, int]] = [{} for _ in texts]
    rows, places = [], []

    def flush() -> None:
        if rows:
            x = np.zeros((len(rows), WINDOW), np.int64)
            for k, r in enumerate(rows):
                x[k, : len(r)] = r
            for got, (k, at, first, last) in zip(tagger.decode(x).tolist(), places, strict=True):
                own = tags[k]
                for i in range(first, last):
                    if got[i - at]:
                        own[i] = got[i - at]
            rows.clear()
            places.clear()

    for k, text in enumerate(texts):
        for a, b in zones(text):
            for at, end, first, last in windows(a, b):
                rows.append(symbols(text[at:end]))
                places.append((k, at, first, min(last, end)))
                if len(rows) >= batch:
                    flush()
    flush()
    out = []
    for own in tags:
        spans: list[tuple[int, int, int]] = []
        for i in sorted(own):
            kind, begins = (own[i] - 1) // 2, own[i] % 2 == 1
            if not begins and spans and spans[-1][2] == i and spans[-1][1] == kind:
                spans[-1] = (spans[-1][0], kind, i + 1)
            else:
                spans.append((i, kind, i + 1))
        out.append(spans)
    return out


def all_spans(tagger: Tagger, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, spans that the network adds) of each text."""
    base = [base_spans(x) for x in texts]
    out = []
    for text, own, found in zip(texts, base, found_spans(tagger, texts), strict=True):
        added, k, ends = [], 0, 0
        ordered = sorted(own)
        for a, kind, b in found:
            while k < len(ordered) and ordered[k][0] < b:
                ends = max(ends, ordered[k][2])
                k += 1
            free = not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())
            if ends <= a and free and formed(kind, text[a:b]):
                added.append((a, kind, b))
        out.append((own, added))
    return out


def written(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame, tagger: Tagger | None = None, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of docs; the counts are those of the base spans.

    Null and empty texts have no spans: counts 0, the digest and list of nothing. Repeated rows and null ids are kept. Times are linear in the
    length of a text. Without a tagger one is fitted on docs; an empty table fits it on made windows alone.
    """
    import hashlib

    tagger = tagger or fit(docs, rows)

    def run(texts: list[str]) -> list[tuple]:
        out = []
        for own, added in all_spans(tagger, texts):
            count = [sum(1 for s in own if s[1] == k) for k in range(4)]
            out.append((*count, hashlib.sha256(written(own).encode()).hexdigest(), written(own + added)))
        return out

    return map_texts(docs.select("doc_id", "text"), ["doc_id"], "text", lambda: run, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, tagger: Tagger | None = None, rows: int = FIT_ROWS) -> DataFrame:
    """docs with each span replaced by its kind in brackets; overlapping spans go as one, by the first. Null texts stay null; n_chars follows."""
    tagger, names = tagger or fit(docs, rows), docs.columns

    def run(texts: list[str]) -> list[tuple[str]]:
        out = []
        for text, (own, added) in zip(texts, all_spans(tagger, texts), strict=True):
            parts, at = [], 0
            for a, kind, b in sorted(own + added):
                if a >= at:
                    parts += [text[at:a], f"[{KINDS[kind].upper()}]"]
                at = max(at, b)
            out.append(("".join(parts) + text[at:],))
        return out

    aside = docs.select(F.struct(*names).alias("row_of_redact"), F.col("text").alias("text"))
    done = map_texts(aside, ["row_of_redact"], "text", lambda: run, "redacted string")
    new = {"text": F.when(F.col("row_of_redact.text").isNotNull(), F.col("redacted"))}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("row_of_redact.text").isNull(), F.col("row_of_redact.n_chars")).otherwise(F.length("redacted").cast(docs.schema["n_chars"].dataType))
    return done.select(*[new[c].alias(c) if c in new else F.col(f"row_of_redact.{c}") for c in names])
