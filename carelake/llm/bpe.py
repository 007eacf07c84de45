"""BPE encoding and decoding by proposal and proof, for word-end vocabularies in the tokenizers library's file format.

Texts are cut at white space and their chunks numbered, some megabytes at a time; each different chunk is normalised and split into words once. For a new word, greedy longest match proposes
tokens. A sequence of tokens is what the merges would give exactly if each adjacent pair of it is, so one vectorised test undoes the merges
at the edges of all proposed pairs of a batch, latest first, and looks for a merge across the edge that would have come earlier. Only words
with a failing pair go through the merges themselves. Chunk and word results are kept in tables of bounded size.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import HELD, map_texts

NONE = np.iinfo(np.int32).max - 1
#: Entries of each table, characters of a text handled at once, characters up to which words and chunks are kept.
TABLE, SLICE, KEPT = 400_000, 2 << 20, 64
#: More than the highest letter that stands for a byte.
LETTERS = 512
#: Characters up to here have the same properties in all Unicode versions and no compositions; the library itself normalises others.
BEYOND = re.compile("[^\x00-\u024f]")
#: Python counts these as white space, the vocabulary's normaliser doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Fixed value: how the vocabulary cuts words.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _plain_words() -> re.Pattern:
    """The same cut for characters that aren't beyond, in lower case, as explicit classes; line ends stand between chunks."""
    low = sorted({c for k in range(0x250) for c in chr(k).lower()})
    letters, numbers = ("".join(c for c in low if unicodedata.category(c)[0] == kind) for kind in "LN")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\n{letters}{numbers}]+|\n")


PLAIN_WORDS = _plain_words()


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + other.index(b)) for b in range(256)]


def strings_of(column: pa.Array) -> list[str]:
    """The strings of a column in which none has a space: joined and split, which makes them far faster than one by one."""
    if not len(column):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), pa.scalar(" ", column.type))[0].as_py().split(" ")


class PairTable:
    """Values of pairs of small numbers, for arrays: two hash tables, of which the second holds what clashes in the first."""

    BITS = 17

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        draw = np.random.default_rng(1)
        self.tables = []
        while len(keys):
            best = None
            for factor in draw.integers(1 << 40, 1 << 62, 8, dtype=np.uint64) | np.uint64(1):
                place = self.place(keys, factor)
                first = np.unique(place, return_index=True)[1]
                if best is None or len(first) > len(best[1]):
                    best = factor, first, place
            factor, first, place = best
            own, held = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, NONE, np.int32)
            own[place[first]], held[place[first]] = keys[first], values[first]
            self.tables.append((factor, own, held))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]

    def place(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return (keys.astype(np.uint64) * factor) >> np.uint64(64 - self.BITS)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, NONE where there is none."""
        out = np.full(len(keys), NONE, np.int64)
        for factor, own, held in self.tables:
            at = self.place(keys, factor)
            np.copyto(out, held[at], where=own[at] == keys)
        return out


class Vocabulary:
    """Tokens, merges and special strings of a vocabulary file, with the merges as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.path, self.ids, self.end = path, model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.tokens = dict((i, t) for t, i in [*self.ids.items(), *self.special.items()])
        self.size = max(self.tokens) + 1
        if data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN:
            raise ValueError(f"{path}: words are cut by another pattern than {PATTERN}")
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        self.byte_codes = np.array([*map(ord, self.letters)])
        self.letter_bytes = {x: b for b, x in enumerate(self.letters)}
        self.left, self.right, self.rank = (np.full(self.size, -1, np.int64) for _ in range(3))
        self.merges: dict[int, int] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges[x * self.size + y] = k << 32 | z
            self.left[z], self.right[z], self.rank[z] = x, y, k
        self.ranks = PairTable(np.array([*self.merges], np.int64), np.arange(len(self.merges)))
        self.made = np.array([m & 0xFFFFFFFF for m in self.merges.values()], np.int64)
        made = np.nonzero(self.rank >= 0)[0]
        lost = set(made[~self.compatible(self.left[made], self.right[made], self.rank[made])].tolist())
        self.tree: dict = {}
        for token, i in self.ids.items():
            if i not in lost:  # a token that its own text doesn't give is never proposed
                last = self.end and token.endswith(self.end)
                node = self.tree
                for c in token.removesuffix(self.end) if last else token:
                    node = node.setdefault(c, {})
                node[self.end if last else ""] = i
        self._number_tree()

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.ranks(a * self.size + b)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether the merges of a's text followed by b's text leave exactly a and b until the merge of rank limit.

        Of the two last merges at the edge, the later is undone; ties are equal tokens, of which the left is made first. What is undone
        bounds the time at which the pair met; a merge across the edge before that would have come first.
        """
        a, b, good = a.copy(), b.copy(), np.ones(len(a), bool)
        limit = np.full(len(a), NONE, np.int64) if limit is None else limit.copy()
        at = np.arange(len(a))
        while len(at):
            crossed = self.pair_ranks(a, b) < limit
            good[at[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~crossed & ((ra >= 0) | (rb >= 0))
            a, b, ra, rb, at = a[on], b[on], ra[on], rb[on], at[on]
            right = rb >= ra
            limit = np.where(right, rb + 1, ra)
            a, b = np.where(right, a, self.right[a]), np.where(right, self.left[b], b)
        return good

    def _number_tree(self) -> None:
        """The tree as arrays: edges by node and letter, and each node's token inside a word and at its end."""
        nodes, edges, inside, last = [self.tree], [], [], []
        for k, node in enumerate(nodes):
            inside.append(node.get("", -1))
            last.append(node.get(self.end, -1) if self.end else -1)
            for c, child in node.items():
                if isinstance(child, dict):
                    edges.append((k * LETTERS + ord(c), len(nodes)))
                    nodes.append(child)
        self.inside, self.last = np.array(inside), np.array(last if self.end else inside)
        self.edges = PairTable(np.array([e for e, _ in edges], np.int64), np.array([n for _, n in edges]))
        own, end = np.zeros(LETTERS, np.int64), np.zeros(LETTERS, np.int64)
        for c in self.letters:
            own[ord(c)], end[ord(c)] = self.ids[c], self.ids[c + self.end]
        self.letter_ids, self.end_ids = own, end
        del self.tree

    def propose(self, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match in all words at once: (word, token) in order. The last token alone carries the word's end."""
        word, at, end = np.arange(len(starts)), starts.copy(), ends
        node, cursor = np.zeros(len(word), np.int64), at.copy()
        best, to = np.full(len(word), -1), at.copy()
        words, tokens = [], []
        while len(word):
            child = np.full(len(word), NONE, np.int64)
            on = cursor < end
            child[on] = self.edges(node[on] * LETTERS + letters[cursor[on]])
            alive = child < NONE
            node = np.where(alive, child, 0)
            cursor = cursor + alive
            token = np.where(alive, np.where(cursor == end, self.last[node], self.inside[node]), -1)
            better = token >= 0
            best, to = np.where(better, token, best), np.where(better, cursor, to)
            stop = np.nonzero(~alive)[0]
            if len(stop):
                words.append(word[stop])
                tokens.append(best[stop])
                at[stop] = cursor[stop] = to[stop]
                best[stop] = -1
                go = at < end
                if not go.all():
                    word, at, end, node, cursor, best, to = (x[go] for x in (word, at, end, node, cursor, best, to))
        words, tokens = np.concatenate(words), np.concatenate(tokens)
        order = words.argsort(kind="stable")
        return words[order], tokens[order]

    def merge_all(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merges themselves, in all words at once: each round makes every word's merge of lowest rank, leftmost first."""
        rank = np.full(len(ids), NONE, np.int64)
        inner = np.nonzero(owner[1:] == owner[:-1])[0]
        rank[inner] = self.pair_ranks(ids[inner], ids[inner + 1])
        done = []
        while len(ids):
            begins = np.concatenate([[True], owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(rank, np.nonzero(begins)[0])[begins.cumsum() - 1]
            on = low < NONE
            if not on.all():
                done.append((owner[~on], ids[~on]))
                ids, owner, rank, low = ids[on], owner[on], rank[on], low[on]
                if not len(ids):
                    break
            hit = np.nonzero(rank == low)[0]
            hit = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])]
            ids[hit] = self.made[rank[hit]]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            hit = hit - np.arange(len(hit))
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            changed = np.concatenate([hit, hit[hit > 0] - 1])
            rank[changed] = NONE
            changed = changed[changed + 1 < len(ids)]
            changed = changed[owner[changed] == owner[changed + 1]]
            rank[changed] = self.pair_ranks(ids[changed], ids[changed + 1])
        owner, ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (owner, ids)
        order = owner.argsort(kind="stable")
        return owner[order], ids[order]

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a queue over a linked list, for words of any length."""
        n, size, get = len(ids), self.size, self.merges.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            m, i, x, y = heapq.heappop(queue)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = m & 0xFFFFFFFF, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (m := get(ids[k] * size + ids[after[k]])) is not None:
                    heapq.heappush(queue, (m, k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, list[int], dict[int, list[int]]]:
        """Token ids of words, one after another, and their bounds; very long words that fail are told apart.

        The bytes of all words become letters in one go. Proposals, one test of all their pairs, merges for those that fail.
        """
        _, ends, data = pa.array(words, pa.large_string()).buffers()
        ends = np.frombuffer(ends, np.int64)[: len(words) + 1]
        letters, sizes, ends = self.byte_codes[np.frombuffer(data, np.uint8)[: ends[-1]]], np.diff(ends), ends[1:]
        owner, tokens = self.propose(letters, ends - sizes, ends)
        inner = np.nonzero(owner[1:] == owner[:-1])[0]
        failed = np.zeros(len(words), bool)
        failed[owner[inner[~self.compatible(tokens[inner], tokens[inner + 1])]]] = True
        base = self.letter_ids[letters]
        base[ends - 1] = self.end_ids[letters[ends - 1]]
        long = np.nonzero(failed & (sizes > KEPT))[0]
        failed[long] = False
        again = np.repeat(failed, sizes)
        new_owner, new = self.merge_all(base[again], np.repeat(np.arange(len(words)), sizes)[again])
        keep = ~failed[owner]
        owner, tokens = np.concatenate([owner[keep], new_owner]), np.concatenate([tokens[keep], new])
        flat = tokens[owner.argsort(kind="stable")]
        bounds = [0, *np.bincount(owner, minlength=len(words)).cumsum().tolist()]
        return flat, bounds, {k: self.merge_long(base[ends[k] - sizes[k] : ends[k]].tolist()) for k in long.tolist()}

    @property
    @lru_cache  # noqa: B019
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def split_odd(self, chunk: str) -> list[str | int]:
        """Words, and ids of special strings, of a chunk that has a special string or characters that the library itself normalises."""
        if self.special_pattern and self.special_pattern.search(chunk):
            parts = [x for x in self.special_pattern.split(chunk) if x]
            return [y for x in parts for y in ([self.special[x]] if x in self.special else self.split_odd(x))]
        if not BEYOND.search(chunk):
            return PLAIN_WORDS.findall(chunk.lower())
        own = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes(map(self.letter_bytes.__getitem__, w)).decode() for w, _ in own]

    def split_chunks(self, chunks: list[str]) -> tuple[list[str | int], np.ndarray]:
        """The different words, and ids of special strings, of chunks without white space, and the places among them of all in order; a line end stands after each chunk.

        The plain chunks are cut in one go.
        """
        text = "\n".join(chunks)
        if not BEYOND.search(text) and "<|" not in text:
            coded = pa.array(PLAIN_WORDS.findall(text.lower() + "\n"), pa.large_string()).dictionary_encode()
            return strings_of(coded.dictionary), coded.indices.to_numpy()
        numbers: dict[str | int, int] = {}
        return numbers, np.array([numbers.setdefault(w, len(numbers)) for c in chunks for w in (*self.split_odd(c), "\n")])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in each process."""
    return Vocabulary(path)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in parts of about size characters that end before white space."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + size) if at + size < len(text) else None
        to = cut.start() if cut else len(text)
        yield text[at:to]
        at = to


class Table(dict):
    """A dict of bounded size: when it is full it becomes the older half, from which what is used again is taken over."""

    def __init__(self, size: int = TABLE):
        super().__init__()
        self.size, self.older = size, {}

    def known(self, keys: list[str]) -> tuple[list, list[int]]:
        """The values of the keys that either half has, None for the others, and the places of those."""
        values = list(map(self.get, keys))
        absent = [i for i, v in enumerate(values) if v is None]
        if self.older and absent:
            rest = []
            for i, v in zip(absent, list(map(self.older.get, [keys[i] for i in absent])), strict=True):
                if v is None:
                    rest.append(i)
                else:
                    self[keys[i]] = values[i] = v
            absent = rest
        return values, absent

    def trim(self) -> None:
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()


class Rendering:
    """What is kept of words and chunks: values gives those of words from their tokens and bounds, split the columns of many values, unite the reverse.

    A column holds byte strings; what a chunk gives in it is what its words give, one after another.
    """

    def __init__(self, values: Callable[[np.ndarray, list[int]], list], split: Callable[[list], list] = lambda x: [x], unite: Callable[[list], list] = lambda x: x[0]):
        self.values, self.split, self.unite = values, split, unite

    def gather(self, values: list, place: np.ndarray | pa.Array, bounds: np.ndarray) -> list[list[bytes]]:
        """In each column, what the values at the places from one bound to the next give, one after another."""
        columns, place = [], place if isinstance(place, pa.Array) else pa.array(place)
        for column in self.split(values):
            row = pa.array(column, pa.large_binary()).take(place)
            _, ends, data = row.buffers()
            columns.append(_between(data.to_pybytes() if data else b"", np.frombuffer(ends, np.int64)[row.offset :][bounds].tolist()))
        return columns


def _between(flat, bounds: list[int]) -> list:
    return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


#: The ids as 32-bit numbers.
LISTS = Rendering(lambda flat, bounds: _between(flat.astype("<u4").tobytes(), [4 * b for b in bounds]))


def texts_of(vocab: Vocabulary) -> Rendering:
    """Two columns: the ids, and the tokens, in text with a space before each."""
    numbers, names = {t: b" %d" % t for t in vocab.tokens}, {t: b" " + x.encode() for t, x in vocab.tokens.items()}

    def values(flat: np.ndarray, bounds: list[int]) -> list[tuple[bytes, bytes]]:
        own, join = flat.tolist(), b"".join
        return [(join(x), join(y)) for x, y in zip(_between([numbers[t] for t in own], bounds), _between([names[t] for t in own], bounds), strict=True)]

    return Rendering(values, lambda x: list(zip(*x, strict=True)), lambda x: list(zip(*x, strict=True)))


class Encoder:
    """Values of texts' chunks in order, as a rendering makes them."""

    def __init__(self, vocab: Vocabulary, rendering: Rendering = LISTS, size: int = TABLE):
        # nothing here makes cycles, and the collector would go through the tables again and again
        gc.set_threshold(500_000, 20, 100)
        self.vocab, self.rendering, self.chunks, self.words = vocab, rendering, Table(size), Table(size // 4)

    def learn(self, chunks: list[str]) -> list:
        """Values of chunks; their short words are kept."""
        if not chunks:
            return []
        different, place = self.vocab.split_chunks(chunks)
        words, rendering = list(different), self.rendering
        mark = words.index("\n")
        values, absent = self.words.known(words)
        own = [i for i in absent if words[i].__class__ is str and i != mark]
        if own:
            made = self._encoded([words[i] for i in own])
            for i, v in zip(own, made, strict=True):
                values[i] = v
            self.words.update((words[i], v) for i, v in zip(own, made, strict=True) if len(words[i]) <= KEPT)
        for i in absent:
            if words[i].__class__ is int:
                values[i] = rendering.values(np.array([words[i]]), [0, 1])[0]
        values[mark] = rendering.values(np.array([], np.int64), [0, 0])[0]
        self.words.trim()
        return rendering.unite(rendering.gather(values, place, np.concatenate([[0], np.nonzero(place == mark)[0] + 1])))

    def _encoded(self, words: list[str]) -> list:
        """Values of words that no table has."""
        flat, bounds, long = self.vocab.encode_words(words)
        values = self.rendering.values(flat, bounds)
        for k, ids in long.items():
            values[k] = self.rendering.values(np.array(ids), [0, len(ids)])[0]
        return values

    def values(self, texts: Iterable[str]) -> Iterator[tuple[int, list[list[int]]]]:
        """(number of the text, lists of the ids of a slice of it) in order, for LISTS; empty texts don't appear."""
        for k, (ids,) in self.joined(texts):
            yield k, [np.frombuffer(ids, "<u4").tolist()]

    def joined(self, texts: Iterable[str]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(number of the text, what the chunks of a slice of it give in each column) in order; empty texts don't appear."""
        for own, bounds, place, values in self._slices(texts):
            yield from zip(own, zip(*self.rendering.gather(values, place, bounds), strict=True), strict=True)

    def _slices(self, texts: Iterable[str]) -> Iterator[tuple[list[int], np.ndarray, pa.Array, list]]:
        """For some slices at a time: the numbers of their texts, bounds of their chunks, for each chunk its place among the values, the values."""
        own, parts, size = [], [], 0
        for k, text in enumerate(texts):
            for part in slices(text):
                own.append(k)
                parts.append(part)
                size += len(part)
                if size >= SLICE:
                    yield own, *self._number(parts)
                    own, parts, size = [], [], 0
        if own:
            yield own, *self._number(parts)

    def _number(self, parts: list[str]) -> tuple[np.ndarray, pa.Array, list]:
        """Each different chunk is looked up once; the empty ones that stand at white space at an end are worth nothing."""
        texts = pa.array(parts, pa.large_string())
        if pc.any(pc.match_substring_regex(texts, SEPARATORS.pattern)).as_py():
            chunks = pa.array([SPACE.split(x) for x in parts], pa.list_(pa.large_string()))
        else:
            chunks = pc.utf8_split_whitespace(texts)
        coded = chunks.values.dictionary_encode()
        different = strings_of(coded.dictionary)
        values, absent = self.chunks.known(different)
        new = [different[i] for i in absent]
        made = self.learn(new)
        for i, v in zip(absent, made, strict=True):
            values[i] = v
        self.chunks.update(zip(new, made, strict=True) if not new or max(map(len, new)) <= KEPT else [(c, v) for c, v in zip(new, made, strict=True) if len(c) <= KEPT])
        self.chunks.trim()
        return chunks.offsets.to_numpy(), coded.indices, values


@lru_cache(maxsize=4)
def kept_encoder(path: str, kind: str) -> Encoder:
    """An encoder that a worker process keeps from task to task, with its tables: chunks as bytes of 32-bit ids, or as ids and tokens in text."""
    vocab = vocabulary(path)
    HELD["bpe"] = forget_encoders
    return Encoder(vocab, LISTS if kind == "bytes" else texts_of(vocab))


def forget_encoders() -> None:
    HELD.pop("bpe", None)
    kept_encoder.cache_clear()
    vocabulary.cache_clear()


def decode(vocab: Vocabulary, ids: Iterable[int]) -> str:
    """As the library does for a file without a decoder: the tokens with a space between; ids that aren't in the vocabulary are passed over."""
    return " ".join([vocab.tokens[i] for i in ids if i in vocab.tokens])


def encode(vocab: Vocabulary, text: str) -> list[int]:
    return [t for _, part in Encoder(vocab).values([text]) for ids in part for t in ids]


def encode_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of docs; other columns are ignored.

    Null texts are empty: no tokens, digests of the empty string. Repeated rows and null ids are kept. Long texts are handled slice by slice.
    """

    def make():
        encoder = kept_encoder(path, "texts")

        def digests(texts: list[str]) -> list[tuple[int, str, str]]:
            n, ids, decoded = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
            for k, part in encoder.joined(texts):
                for total, x in zip((ids[k], decoded[k]), part, strict=True):
                    total.update(x if n[k] else x[1:])
                n[k] += part[0].count(b" ")
            return [(i, x.hexdigest(), y.hexdigest()) for i, x, y in zip(n, ids, decoded, strict=True)]

        return digests

    plain = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return map_texts(plain, ["doc_id"], "text", make, "n_tokens long, ids_sha256 string, decoded_sha256 string", "bpe", SLICE)

