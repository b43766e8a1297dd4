"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Text is lower-cased and folded first: homoglyph letters become their Latin look-alikes, and
digits or signs written in place of letters inside a word become letters. The automaton then
finds every lexicon entry (a whole word, or a stem at the start of a word) in one pass over
the whole text. Matches inside an exception phrase do not count. The weights of the matches
are summed, divided by the logarithm of the document's length, and calibrated to 0..1.

Learning: log-odds weights of words and word stems come from at most ``max_train`` labelled
documents (those with the smallest hash of doc_id), counted by Spark; an entry must be
significant after correction for the number of candidates. The lexicon has at most
``lexicon_size`` entries, so it travels to the tasks with the function. Scoring is a map over
the documents without a shuffle; only the text is an input of a score.

Null text counts as empty and scores the calibrated value of "no match". Rows whose doc_id is
null are scored like any other and are not held out. Without usable labels every score is 0.
Repeated labels of a document count once (toxic if any says so).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

MAX_TRAIN = 8000
LEXICON_SIZE = 512
STEM_LENGTHS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "sore loser")

# Look-alike letters of other scripts and the Latin letter each stands for.
_LOOKALIKES = "аеорсухіѕјкмтвнοαεικνρτυχ"
_LETTERS = "aeopcyxisjkmtbhoaeikvptux"
# Digits and signs written for letters.
_DIGITS = "0134578@$"
_AS_LETTERS = "oieastbas"

_GLYPHS = str.maketrans(_LOOKALIKES, _LETTERS)
_GLYPHS |= {0xFF41 + i: chr(97 + i) for i in range(26)}  # full-width letters
_HAS_GLYPH = re.compile("[" + _LOOKALIKES + "ａ-ｚ]")
_LEET = str.maketrans(_DIGITS, _AS_LETTERS)
_IN_WORD = re.compile(r"[0134578@$]+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    """Lower-case and undo homoglyphs and digit substitutions."""
    text = (text or "").lower()
    if not text.isascii() and _HAS_GLYPH.search(text):
        text = text.translate(_GLYPHS)
    return _IN_WORD.sub(lambda m: m[0].translate(_LEET), text)


@dataclass
class Lexicon:
    """Entries are (text, whole word?) -> weight; slope and bias calibrate the score."""

    entries: dict[tuple[str, bool], float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 0.0
    bias: float = -math.inf

    def automaton(self) -> ahocorasick.Automaton | None:
        found: dict[str, list[tuple[float, bool | None]]] = {}
        for (text, whole), weight in self.entries.items():
            found.setdefault(text, []).append((weight, whole))
        if not found:
            return None
        for phrase in self.exceptions:
            found.setdefault(fold(phrase), []).append((0.0, None))
        machine = ahocorasick.Automaton()
        for text, senses in found.items():
            machine.add_word(text, (len(text), senses))
        machine.make_automaton()
        return machine


def strength(text: str | None, machine) -> float:
    """Summed weights of the matches, normalised by the text's length; 0 without a match."""
    if machine is None or not text:
        return 0.0
    folded = fold(text)
    hits, spared, size = [], [], len(folded)
    for end, (n, senses) in machine.iter(folded):
        start = end - n + 1
        if start and folded[start - 1].isalpha():
            continue
        closed = end + 1 == size or not folded[end + 1].isalpha()
        for weight, whole in senses:
            if whole is None:
                if closed:
                    spared.append((start, end))
            elif closed or not whole:
                hits.append((start, end, weight))
    if not hits:
        return 0.0
    best: dict[int, float] = {}  # of nested entries that match one word, the strongest counts
    for s, e, w in hits:
        if not any(a <= s and e <= b for a, b in spared):
            best[s] = max(w, best.get(s, w))
    return sum(best.values()) / math.log2(2 + len(folded.split()))


def probability(x: float, lexicon: Lexicon) -> float:
    z = lexicon.slope * x + lexicon.bias
    return 1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0


def _features(text: str | None) -> set[str]:
    """Whole words as "word$", stems as plain text."""
    out = set()
    for word in set(_WORD.findall(fold(text))):
        out.add(word + "$")
        out.update(word[:n] for n in STEM_LENGTHS if len(word) >= n)
    return out


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document counts of features by label, flushed before they grow large."""
    def flush(toxic: Counter, clean: Counter) -> pa.RecordBatch:
        keys = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()),
             pa.array([clean[k] for k in keys], pa.int64())], names=["feature", "a", "b"])

    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            (toxic if label else clean).update(_features(text.as_py()))
            if len(toxic) + len(clean) > 200_000:
                yield flush(toxic, clean)
                toxic, clean = Counter(), Counter()
    if toxic or clean:
        yield flush(toxic, clean)


def held_out(doc_id):
    """Column: the fold that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """text, toxic of the bounded training sample; its ids (at most max_train) are broadcast."""
    sample = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
              .where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # Copies of one text would pass for independent evidence.
    return rows.dropDuplicates(["text"]).select("text", "toxic")


def _choose(counted: list, pos: int, neg: int, lexicon_size: int) -> dict[tuple[str, bool], float]:
    """Of stems and words that say the same keep the most specific, of nested ones the widest."""
    table = {r["feature"]: (r["a"], r["b"]) for r in counted}
    kept = {}
    for name, (a, b) in table.items():
        word = name.rstrip("$")
        stems = [word[:n] for n in STEM_LENGTHS if n < len(word) or (n == len(word) and name.endswith("$"))]
        if any(s in table and table[s][0] > a and table[s][1] * a <= b * table[s][0] for s in stems):
            continue
        kept[name] = (a, b)
    same = {name for name, ab in kept.items() for other, ab2 in kept.items()
            if other != name and ab2 == ab and not name.endswith("$")
            and (other.startswith(name) and len(other) > len(name))}
    weighed = {(name.rstrip("$"), name.endswith("$")): math.log((a + 0.5) / (pos + 1)) - math.log((b + 0.5) / (neg + 1))
               for name, (a, b) in kept.items() if name not in same}
    return dict(sorted(weighed.items(), key=lambda x: (-x[1], x[0]))[:lexicon_size])


def _calibrate(points: list[tuple[float, int]]) -> tuple[float, float]:
    """Logistic regression of the label on the strength, lightly regularised (Newton steps)."""
    slope, bias = 0.0, 0.0
    ridge = 0.01
    for _ in range(50):
        g0 = g1 = 0.0
        h00, h01, h11 = 1e-9, 0.0, ridge
        for x, y in points:
            p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, slope * x + bias))))
            w = p * (1 - p)
            g0 += p - y
            g1 += (p - y) * x
            h00 += w
            h01 += w * x
            h11 += w * x * x
        g1 += ridge * slope
        det = h00 * h11 - h01 * h01
        if det <= 1e-12:
            break
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 4.0 / (abs(d0) + abs(d1) + 1e-12))
        bias, slope = bias - step * d0, slope - step * d1
        if abs(d0) + abs(d1) < 1e-6:
            break
    return slope, bias


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, lexicon_size: int = LEXICON_SIZE,
          exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn entries, weights and calibration from the bounded training sample."""
    rows = _training_rows(docs, labels, max_train)
    sums = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    pos, total = sums[0] or 0, sums[1]
    neg = total - pos
    if not pos or not neg:
        return Lexicon(exceptions=exceptions)
    counts = (rows.mapInArrow(_count_features, "feature string, a long, b long")
              .groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a + b >= 3"))
    a, b, n = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    xlogx = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    g2 = 2 * (xlogx(a, F.lit(pos / total)) + xlogx(b, F.lit(neg / total)))
    counts = counts.withColumn("g2", g2).persist()
    try:
        candidates = counts.count()
        # Bonferroni-like: about one candidate would pass by chance.
        strong = (counts.where((F.col("g2") >= 2 * math.log(max(candidates, 2))) & (a * neg > 3 * b * pos))
                  .orderBy(F.desc("g2"), "feature").limit(8 * lexicon_size).collect())
    finally:
        counts.unpersist()
    lexicon = Lexicon(_choose(strong, pos, neg, lexicon_size), exceptions)

    def strengths(batches):
        machine = lexicon.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([strength(t.as_py(), machine) for t in batch.column("text")], pa.float64()),
                 batch.column("toxic")], names=["x", "y"])

    points = [(r.x, r.y) for r in rows.mapInArrow(strengths, "x double, y int").collect()]  # max_train rows
    lexicon.slope, lexicon.bias = _calibrate(points)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""

    def run(batches):
        machine = lexicon.automaton()
        for batch in batches:
            scores = [probability(strength(t.as_py(), machine), lexicon) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                 pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    cols = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return cols.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""

    def run(batches):
        machine = lexicon.automaton()
        for batch in batches:
            keep = [probability(strength(t.as_py(), machine), lexicon) < threshold for t in batch.column("text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
