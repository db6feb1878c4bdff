"""Operator 6, license scans by ordered signature rules.

One pass of a keyword automaton over a text tells which rules can match at all; only their patterns run. Detections are
then taken by rank (group, length, place, rule): one that lies inside or overlaps a detection already taken is
suppressed, so the rest are disjoint and each place has its strongest rule. Four base phrases are counted word by word
beside the rules and always keep their labels.

score: 1 - product over the labels found of (1 - weight of the label's strongest rule), 0 without a label.

Defined cases: null and empty texts have no words and no labels; texts are scanned whole; repeated rows and null ids are
rows of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from attestor.llm.common import table, tuned
from attestor.llm.license_rules import GROUPS

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BASE_WEIGHT = 0.6
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def written_out(pattern: str) -> str:
    """A signature as a regular expression. Separators are runs of any length, gaps are counted in words, so how a text
    is indented, boxed or broken does not matter."""
    gap = r"(?:[^a-z0-9]++[a-z0-9]++){0,\1}? "
    return re.sub(r" <(\d+)> ", gap, pattern).replace(" ", "(?:[^a-z0-9]++)")


class Rules:
    """The compiled rules: keyword automaton, rules by keyword, patterns."""

    def __init__(self, groups=GROUPS):
        self.rules, by_word = [], {}
        for rank, (_, weight, lines) in enumerate(groups):
            for line in lines.strip().splitlines():
                label, keyword, pattern = (x.strip() for x in line.split(" | "))
                compiled = re.compile(r"(?<![a-z0-9])" + written_out(pattern), re.S)
                by_word.setdefault(keyword, []).append(len(self.rules))
                self.rules.append((rank, weight, label, compiled))
        self.words = ahocorasick.Automaton()
        for word, rules in by_word.items():
            # blanks of a pattern match any separators: the gate asks for the longest piece of the keyword only
            piece = max(re.split(r"[^a-z0-9]+", word), key=len)
            known = self.words.get(piece, ())
            self.words.add_word(piece, (*known, *rules))
        self.words.make_automaton()
        self.base = [(label, re.compile(f"(?<!{_WORD})" + f"{_SEPARATOR}+".join(p.split()) + f"(?!{_WORD})")) for p, label in BASE.items()]
        self.base_gate = [max(p.split(), key=len) for p in BASE]

    def candidates(self, low: str) -> list[int]:
        return sorted({r for rules in {v for _, v in self.words.iter(low)} for r in rules})

    def detections(self, low: str) -> list[tuple[int, int, str, float]]:
        """start, end, label, weight, disjoint and by place."""
        found = []
        for r in self.candidates(low):
            rank, weight, label, pattern = self.rules[r]
            found += [(rank, m.start() - m.end(), m.start(), r, m.end(), label, weight) for m in pattern.finditer(low)]
        found.sort()
        starts, ends, kept = [], [], []
        for _, _, start, _, end, label, weight in found:
            i = bisect_left(starts, end)  # those before i begin before this one ends
            if i and ends[i - 1] > start:
                continue
            starts.insert(i, start)
            ends.insert(i, end)
            kept.append((start, end, label, weight))
        return sorted(kept)

    def base_places(self, low: str) -> list[tuple[int, str]]:
        return [(m.start(), label) for gate, (label, p) in zip(self.base_gate, self.base) if gate in low for m in p.finditer(low)]


@lru_cache(1)
def rules() -> Rules:
    return Rules()


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER)
    inside = _IS_WORD[np.frombuffer(raw, np.uint8)]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    n_words = int(np.count_nonzero(begin))
    low, r = raw.decode("utf-8", "surrogatepass"), rules()
    spans = r.detections(low)
    places = r.base_places(low)
    weights = {}
    for label, weight in [*((s[2], s[3]) for s in spans), *((label, BASE_WEIGHT) for _, label in places)]:
        weights[label] = max(weights.get(label, 0.0), weight)
    first = last = None
    if places:
        at = [len(low[:p].encode("utf-8", "surrogatepass")) if not low.isascii() else p for p in (min(places)[0], max(places)[0])]
        first, last = (int(np.count_nonzero(begin[:a])) for a in at)
    labels = sorted(weights)
    score = 1.0 - float(np.prod([1.0 - weights[x] for x in labels])) if labels else 0.0
    return n_words, len(places), first, last, ",".join(sorted({x for _, x in places})), ",".join(labels), score, spans


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("weight", pa.float64())]))
_OUT = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", _SPAN)]


def license_scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, the columns above and the detections as spans of code points."""
    tuned(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = [scan(t) for t in b.column("text").to_pylist()]
            cols = [[*c] for c in zip(*rows)] or [[] for _ in _OUT]
            cols[-1] = [[dict(zip(("start", "end", "label", "weight"), s)) for s in spans] for spans in cols[-1]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, (_, k) in zip(cols, _OUT))], ["doc_id", *(n for n, _ in _OUT)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: long, end: long, label: string, weight: double>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")
