"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton in folded text.

Folding maps look-alike letters of other scripts and full-width forms to Latin letters, digits and signs
that stand for letters to those letters (only in words that hold a letter), letters that look alike to
one of them (l, i, 1), and everything that is not a letter or mark to a space. An entry is a whole word
(" word ") or a word's beginning (" wor"), with a weight. An exception phrase (two words in a row) cancels
the entries it covers. The weights found are added up and normalised by length; a logistic curve of the
sum and of the normalised sum is the score.

The lexicon, the exceptions and the curve are learned from labelled rows: at most `per_class` of each
class, taken by a hash of the identifier, with texts up to `max_chars` (a bounded sample for fitting
only; scoring reads whole texts). One half gives entries, the other half the curve.

Defined results: null text counts as empty and has the score of a text without any match; without both
classes among the labelled rows the lexicon is empty and every score is 0. Repeated rows stay repeated.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letters that they look like.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ϲ": "c", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "ѡ": "w",
}
# Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
SHORTEST_STEM = 4


class Folding(dict):
    """A translation table that works out a character when it is first met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        plain = unicodedata.normalize("NFKC", char).lower()
        out = "".join(self._one(c) for c in plain) if plain else " "
        self[code] = out
        return out

    @staticmethod
    def _one(c: str) -> str:
        c = HOMOGLYPHS.get(c, c)
        c = SUBSTITUTES.get(c, c)
        if c == "l":
            return "i"
        return c if unicodedata.category(c)[0] in "LM" else " "


FOLD = Folding()
#: Signs at a word's end are punctuation; inside a word they may stand for a letter.
ENDING = re.compile(r"[!|$@]+(?=\s|$)")


def fold(text: str) -> str:
    """Folded text with one space before and after."""
    if "!" in text or "|" in text or "$" in text or "@" in text:
        text = ENDING.sub(" ", text)
    return " " + text.translate(FOLD) + " "


@dataclass
class Lexicon:
    """Weighted entries, exception phrases and the curve; small, its size is bounded by `max_entries`."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] | None = None

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for e, w in self.entries.items():
            a.add_word(e, (len(e), w))
        for e in self.exceptions:
            a.add_word(e, (len(e), None))
        if len(a):
            a.make_automaton()
        return a


def weighed(folded: str, automaton) -> tuple[float, int]:
    """Sum of the weights of matched words (the heaviest entry of each word) and the number of words."""
    found: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for end, (size, weight) in automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
    for a, b in spared:
        for s in range(a, b):  # a phrase is short, so this is linear in the text
            found.pop(s, None)
    return sum(found.values()), folded.count(" ")


def features(total: float, n_words: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(100 * total / (n_words + 20))


def score_of(total: float, n_words: int, curve: tuple[float, float, float] | None) -> float:
    if curve is None:
        return 0.0
    a, b = features(total, n_words)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, curve[0] + curve[1] * a + curve[2] * b))))


def _candidates(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        for k in range(SHORTEST_STEM, min(len(w), 8)):
            out.add(" " + w[:k])
    return out


def _word_starts(text: str) -> list[int]:
    return [m.start() for m in re.finditer(r"\S+", text)]


def fit(rows: list[tuple[str, int]], max_entries: int = 2000, least_gain: float = 12.0) -> Lexicon:
    """Learn from (text, label) rows. An entry must be tied to label 1 by a log-likelihood ratio of `least_gain`."""
    folded = [(fold(t or ""), y, zlib.crc32((t or "").encode()) % 2) for t, y in rows]
    counts = [Counter(), Counter()]
    sizes = [0, 0]
    half = [x for x in folded if not x[2]]
    for text, y, _ in half:
        counts[y].update(_candidates(text))
        sizes[y] += 1
    if not all(sizes):
        return Lexicon()
    share, gains = sizes[1] / sum(sizes), {}
    for e, n1 in counts[1].items():
        n0 = counts[0][e]
        p = n1 / (n1 + n0)
        if n1 < 3 or p <= share:
            continue
        gain = 2 * (n1 * math.log(p / share) + (n0 * math.log((1 - p) / (1 - share)) if n0 else 0))
        if gain >= least_gain and p > 0.5 + share / 2:
            gains[e] = (gain, math.log((n1 + 0.5) / (sizes[1] + 1)) - math.log((n0 + 0.5) / (sizes[0] + 1)))
    best = sorted(gains, key=lambda e: (-gains[e][0], e))[:max_entries]
    entries = {e: gains[e][1] for e in best}
    # phrases around an entry that clean rows hold and others do not
    lexicon = Lexicon(entries)
    pairs = [Counter(), Counter()]
    automaton = lexicon.automaton()
    for text, y, _ in half:
        if len(automaton):
            starts = {end - size + 1 for end, (size, _) in automaton.iter(text)}
            if starts:
                words, at = text.split(), set(np.searchsorted(_word_starts(text), [s + 1 for s in starts]).tolist())
                near = {j for i in at for j in (i - 1, i) if 0 <= j < len(words) - 1}
                pairs[y].update({f" {words[j]} {words[j + 1]} " for j in near})
    lexicon.exceptions = sorted(p for p, n in pairs[0].items() if n >= 3 and n > 4 * pairs[1][p])[:max_entries]
    automaton = lexicon.automaton()
    x, y = [], []
    for text, label, part in folded:
        if part:
            x.append((1.0, *features(*weighed(text, automaton))))
            y.append(float(label))
    lexicon.curve = _curve(np.array(x), np.array(y)) if x and 0 < sum(y) < len(y) else (-4.0, 4.0, 0.0)
    return lexicon


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w * [0, 1, 1]
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, ridge, ridge])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def sample(docs: DataFrame, labelled: DataFrame, label: str, per_class: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """At most `per_class` labelled texts of each class, by a hash of the identifier; bounded by its parameters."""
    taken = None
    for y in (0, 1):
        part = labelled.filter(F.col(label) == y).select(F.col(id_col).alias("k"), F.lit(y).alias("y")).orderBy(F.xxhash64("k"), "k").limit(per_class)
        taken = part if taken is None else taken.unionByName(part)
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).filter(F.length("t") <= max_chars)
    rows = texts.join(F.broadcast(taken), "k").select("k", "t", "y").collect()  # at most 2 * per_class texts
    return [(r["t"], r["y"]) for r in sorted(rows, key=lambda r: (r["k"], r["t"]))]


@lru_cache(maxsize=2)
def _ready(key: tuple):
    entries, exceptions = key
    return Lexicon(dict(entries), list(exceptions)).automaton()


def score(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per input row: id, score, predicted, weight (the sum of matched weights). No shuffle."""
    kind = df.schema[id_col].dataType.simpleString()
    key, curve = (tuple(lexicon.entries.items()), tuple(lexicon.exceptions)), lexicon.curve

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _ready(key)
        for batch in batches:
            totals = [weighed(fold(t or ""), automaton) for t in batch.column(1).to_pylist()]
            scores = np.array([score_of(*t, curve) for t in totals])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32)), pa.array([t[0] for t in totals], pa.float64())], ["id", "score", "predicted", "weight"])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(work, f"id {kind}, score double, predicted int, weight double").withColumnRenamed("id", id_col)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the held-out third are not read."""
    from .common import documents, held_out, labels

    docs = documents(spark, sf_dir)
    known = labels(spark, sf_dir).filter(~held_out(F.col("doc_id"), 3, 1) & F.col("toxic").isin(0, 1))
    lexicon = fit(sample(docs, known, "toxic", per_class=2000, max_chars=50_000))
    scored = score(docs, lexicon, threshold=0.7)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted", "weight")
