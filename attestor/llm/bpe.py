"""Operator 2, BPE encoding and decoding through a minimal acyclic transducer lexicon.

The corpus' most frequent words, each encoded once by exact merging, are compiled into an acyclic automaton whose
equal suffixes are shared (built from the sorted words, so that it is minimal as it grows). Its arcs carry
numbers that add up, along a word, to the word's row in a table of id lists. The automaton is one flat file in the shared
folder that Spark copies to every executor and that Python workers map into memory, so all workers of a machine share its pages. A batch's
distinct words walk it side by side, one character for all at a time; words it lacks are merged exactly.

The lexicon only saves time: results are those of exact merging, whichever words it holds.

Defined cases: null and empty texts have no ids and decode to the empty text; a row of any id (null, repeated) is
encoded by itself; texts are never cut; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import fresh_path, store, table, tuned

#: Words that the lexicon holds, and bytes of the longest.
LEXICON_WORDS, LEXICON_BYTES = 400_000, 40
#: Words whose results a worker keeps at once, about 300 bytes each; a caller short of memory names fewer. It changes no result.
CACHE_WORDS = 500_000
#: Words that a worker counts at once before it sends them on.
COUNT_WORDS = 400_000


# ---- text to words ----------------------------------------------------------------------------------------------

@lru_cache(1)
def _classes() -> tuple[str, str, str]:
    """Regular-expression classes, from the Unicode tables: letters, numbers, white space."""
    def spans(test) -> str:
        out, start = [], None
        for c in range(0x110001):
            if c < 0x110000 and test(chr(c)):
                start = c if start is None else start
            elif start is not None:
                out.append(f"\\U{start:08x}" + (f"-\\U{c - 1:08x}" if c - 1 > start else ""))
                start = None
        return "".join(out)

    white = spans(lambda c: (c.isspace() and not "\x1c" <= c <= "\x1f"))
    return spans(lambda c: unicodedata.category(c)[0] == "L"), spans(lambda c: unicodedata.category(c)[0] == "N"), white


@lru_cache(1)
def _word_pattern() -> re.Pattern:
    letter, number, white = _classes()
    # ASCII letters first: the long class is only searched for other letters
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{letter}]+|[0-9{number}]|[^{white}{letter}{number}]+")


def normalized(text: str) -> str:
    """NFC, then lower case character by character (a final capital sigma is no exception)."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


# ---- exact merging ----------------------------------------------------------------------------------------------

@lru_cache(1)
def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [chr(b) if b in plain else chr(256 + sum(x not in plain for x in range(b))) for b in range(256)]


#: More than any merge's number (its rank and the new id in one integer, so that the least is the first to apply).
_NONE = 1 << 62


class Merger:
    """Byte-pair merging by a tokenizer file: lowest rank first, leftmost first."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self.decimal = list(map(str, range(self.size)))
        chars = _byte_chars()
        self.inner, self.final = [vocab[c] for c in chars], [vocab[c + end] for c in chars]
        self.pairs = {vocab[a] * self.size + vocab[b]: rank * self.size + vocab[a + b] for rank, (a, b) in enumerate(map(tuple, spec["model"]["merges"]))}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        """The text's words in order; a special token is a word by itself."""
        if not text:
            return []
        if text.isalpha() and (low := normalized(text)).isalpha():  # letters only, which are one word
            return [low]
        find = _word_pattern().findall
        if self.split is None or "<|" not in text:
            return find(normalized(text))
        out = []
        for part in self.split.split(text):
            out += [part] if part in self.special else find(normalized(part))
        return out

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        raw = word.encode()
        ids = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        return self._long(ids) if len(ids) > 64 else self._short(ids)

    def _short(self, ids: list[int]) -> list[int]:
        get, n = self.pairs.get, self.size
        found = [get(a * n + b, _NONE) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != _NONE:
            at = found.index(best)
            ids[at : at + 2] = [best % n]
            del found[at]
            if at:
                found[at - 1] = get(ids[at - 1] * n + ids[at], _NONE)
            if at < len(found):
                found[at] = get(ids[at] * n + ids[at + 1], _NONE)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, for runs of thousands of characters."""
        n, after, before = len(ids), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        alive, heap = [True] * n, []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (x := self.pairs.get(ids[i] * self.size + ids[j])) is not None:
                heapq.heappush(heap, (x, i, ids[i], ids[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            x, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = x % self.size, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i)
            if before[i] >= 0:
                push(before[i])
        return [x for x, ok in zip(ids, alive) if ok]


# ---- the transducer ---------------------------------------------------------------------------------------------

class Transducer:
    """A minimal acyclic automaton over UTF-8 words, in flat arrays. `rows` finds the row of each word, or -1."""

    PARTS = (("keys", np.int64), ("target", np.int32), ("skip", np.int32), ("final", np.uint8), ("begin", np.int32), ("ids", np.int32))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @staticmethod
    def build(words: list[bytes], ids: list[list[int]]) -> "Transducer":
        """words: sorted, distinct, not empty. A state is registered by its finality and arcs once no later
        word can change it; an equal registered state takes its place."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((byte, target), ...)) of registered states, targets first

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if (k := register.get(key)) is None:
                k = register[key] = len(states)
                states.append(key)
            return k

        path, last = [[False, []]], b""  # an open node: [final, [(byte, settled target)]]
        for w in [*words, None]:
            same = 0 if w is None else len(os.path.commonprefix([w, last]))
            while len(path) > same + 1:
                child = settle(path.pop())
                path[-1][1].append((last[len(path) - 1], child))
            if w is None:
                break
            path += [[False, []] for _ in range(len(w) - same)]
            path[-1][0] = True
            last = w
        root = settle(path[0])
        below = [0] * len(states)  # words that end at or below a state
        keys, target, skip = [], [], []
        for s, (final, arcs) in enumerate(states):
            n = int(final)
            for b, t in arcs:
                keys.append(s << 8 | b)
                target.append(t)
                skip.append(n)
                n += below[t]
            below[s] = n
        sizes = np.cumsum([0, *map(len, ids)])
        final = [int(f) for f, _ in states] + [root]  # the root's number comes last, as a byte cannot hold it below
        a = {"keys": keys, "target": target, "skip": skip, "final": final[:-1], "begin": sizes, "ids": [i for x in ids for i in x]}
        out = Transducer({k: np.asarray(a[k], t) for k, t in Transducer.PARTS})
        out.root = root
        return out

    def dump(self) -> bytes:
        out = [np.asarray([self.root, *(len(getattr(self, k)) for k, _ in self.PARTS)], np.int64).tobytes()]
        for k, t in self.PARTS:
            out.append(b"\0" * (-sum(map(len, out)) % 8))
            out.append(getattr(self, k).astype(t).tobytes())
        return b"".join(out)

    @staticmethod
    def load(path: str) -> "Transducer":
        flat = np.memmap(path, np.uint8, "r")
        head = flat[: 8 * (1 + len(Transducer.PARTS))].view(np.int64)
        at, arrays = 8 * len(head), {}
        for (k, t), n in zip(Transducer.PARTS, head[1:]):
            at += -at % 8
            size = int(n) * np.dtype(t).itemsize
            arrays[k] = flat[at : at + size].view(t)
            at += size
        out = Transducer(arrays)
        out.root = int(head[0])
        return out

    def rows(self, words: list[bytes]) -> np.ndarray:
        if not words or not len(self.keys):
            return np.full(len(words), -1)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(words), np.uint8)
        state, row = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero((sizes > 0) & (sizes <= LEXICON_BYTES))
        done = np.full(len(words), -1)
        for depth in range(LEXICON_BYTES):
            if not len(live):
                break
            key = state[live] << 8 | flat[begin[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            live, at = live[found], at[found]
            state[live] = self.target[at]
            row[live] += self.skip[at]
            ended = sizes[live] == depth + 1
            w = live[ended]
            done[w] = np.where(self.final[state[w]] == 1, row[w], -1)
            live = live[~ended]
        return done


# ---- over a DataFrame -------------------------------------------------------------------------------------------

_SEPARATORS = re.compile("[\x1c-\x1f]")


def pieces(text: str | None) -> list[str]:
    """What white space separates. No word and no composition crosses it, so each piece is encoded by itself.
    (str.split would also cut at four control characters that are not white space here.)"""
    if not text:
        return []
    return re.split(f"[{_classes()[2]}]+", text) if not text.isprintable() and _SEPARATORS.search(text) else text.split()


_mergers: dict[bytes, Merger] = {}


def merger_of(source: bytes) -> Merger:
    """One merger a worker and vocabulary, which counting and encoding share."""
    key = hashlib.sha256(source).digest()
    if key not in _mergers:
        _mergers.clear()
        _mergers[key] = Merger(source)
    return _mergers[key]


class Encoder:
    """A worker's encoder: transducer first, exact merging for the rest; results are kept by piece, up to a bound."""

    def __init__(self, source: bytes, lexicon: Transducer | None):
        self.merger, self.lexicon, self.room = merger_of(source), lexicon, CACHE_WORDS
        self.forget()

    def forget(self) -> None:
        """Lets go of all results; the vocabulary stays."""
        self.known: dict[str, str] = {}  # a piece's ids in decimal, joined by spaces
        self.decoded: dict[str, str] = {}  # its tokens, joined by spaces

    def learn(self, new: list[str]) -> None:
        """Words first, which pieces then share: a word is a piece itself."""
        known, decoded, split = self.known, self.decoded, {}
        for p in new:
            words = self.merger.words(p)
            if len(words) != 1 or words[0] != p:
                split[p] = words
        words = list({w for ws in split.values() for w in ws if w not in known}.union(p for p in new if p not in split))
        special, tokens, decimal = self.merger.special, self.merger.tokens, self.merger.decimal
        if self.lexicon:
            rows = self.lexicon.rows([b"" if w in special else w.encode() for w in words])
            at = np.where(rows < 0, 0, rows)
            begin, end = self.lexicon.begin[at].tolist(), self.lexicon.begin[at + 1].tolist()
            ids, first, rows = self.lexicon.ids, self.lexicon.ids[self.lexicon.begin[at]].tolist(), rows.tolist()
        else:
            rows = [-1] * len(words)
        for i, w in enumerate(words):
            if rows[i] < 0:
                told = self.merger.ids(w)
            else:
                told = [first[i]] if end[i] - begin[i] == 1 else ids[begin[i] : end[i]].tolist()
            if len(told) == 1:
                known[w], decoded[w] = decimal[told[0]], tokens[told[0]]
            else:
                known[w], decoded[w] = " ".join([decimal[t] for t in told]), " ".join([tokens[t] for t in told])
        for p, ws in split.items():
            known[p] = " ".join([known[w] for w in ws])
            decoded[p] = " ".join([decoded[w] for w in ws])

    def batch(self, texts: list[str | None]) -> list[list[str]]:
        if len(self.known) > self.room:
            self.forget()
        out = [[p for p in pieces(t) if p] for t in texts]
        self.learn([p for p in set().union(*out) if p not in self.known])
        return out


_encoders: dict[tuple, Encoder] = {}


def _encoder(source, lexicon: str | None, room: int | None = None) -> Encoder:
    """One encoder a worker, vocabulary and lexicon."""
    key = (hashlib.sha256(source.value).digest(), lexicon)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(source.value, Transducer.load(SparkFiles.get(lexicon)) if lexicon else None)
    if room is not None:
        _encoders[key].room = room
    return _encoders[key]


def word_counts(docs: DataFrame, source) -> DataFrame:
    """word, n over the whole corpus; a task sends each of its words once for each so many rows."""
    def count(batches):
        merger, seen = merger_of(source.value), Counter()

        def out():
            words = Counter()
            for piece, n in seen.items():
                for w in merger.words(piece):
                    words[w] += n
            seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(pieces(text))
            if len(seen) > COUNT_WORDS:
                yield from out()
        yield from out()

    rows = docs.select("text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(spark: SparkSession, counts: DataFrame, source: bytes, size: int = LEXICON_WORDS) -> str | None:
    """Builds the transducer of the most frequent words and hands its file to the executors; returns the file's name."""
    merger = Merger(source)
    top = counts.where((F.octet_length("word") <= LEXICON_BYTES) & (F.col("n") > 1)).orderBy(F.desc("n"), "word").limit(size)
    words = sorted(r.word.encode() for r in top.select("word").toLocalIterator() if r.word not in merger.special)
    if not words:
        return None
    raw = Transducer.build(words, [merger.ids(w.decode()) for w in words]).dump()
    name = f"lexicon-{hashlib.sha256(raw + source).hexdigest()[:24]}"
    if (spark.sparkContext.applicationId, name) not in _sent:
        path = fresh_path(spark, name)
        fs, at = store(path)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(at) as f:
            f.write(raw)
        spark.sparkContext.addFile(path)  # executors copy it from there, now or when one is added
        _sent.add((spark.sparkContext.applicationId, name))
    return name


_sent: set[tuple[str, str]] = set()


def encode(docs: DataFrame, vocabulary: str, lexicon_words: int = LEXICON_WORDS, digests: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """docs (doc_id, text) to doc_id, ids array<int>; with digests, to the contract's columns instead."""
    spark = tuned(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        raw = f.read()
    source = spark.sparkContext.broadcast(raw)
    docs = docs.select("doc_id", "text")
    lexicon = compile_lexicon(spark, word_counts(docs, source), raw, lexicon_words)

    def ids(batches):
        enc = _encoder(source, lexicon, cache_words)
        for b in batches:
            rows = enc.batch(b.column("text").to_pylist())
            known = enc.known
            lists = [[int(i) for i in " ".join([known[w] for w in ws]).split()] for ws in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

    def hashed(batches):
        enc = _encoder(source, lexicon, cache_words)
        for b in batches:
            rows = enc.batch(b.column("text").to_pylist())
            known, decoded = enc.known.__getitem__, enc.decoded.__getitem__
            n, a, d = [], [], []
            for ws in rows:
                joined = " ".join(map(known, ws))
                n.append(joined.count(" ") + 1 if joined else 0)
                a.append(hashlib.sha256(joined.encode()).hexdigest())
                d.append(hashlib.sha256(" ".join(map(decoded, ws)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    if digests:
        return docs.mapInArrow(hashed, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.mapInArrow(ids, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids to doc_id, text: the tokens joined by spaces, as the file names no decoder."""
    spark = tuned(rows.sparkSession)
    with open(vocabulary, "rb") as f:
        source = spark.sparkContext.broadcast(f.read())

    def run(batches):
        tokens = Merger(source.value).tokens
        for b in batches:
            texts = [" ".join([tokens[i] for i in x or ()]) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), vocabulary_path(), digests=True)
