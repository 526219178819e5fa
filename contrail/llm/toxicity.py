"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding lower-cases, maps homoglyphs and accented letters to plain Latin ones, digits and signs that stand for
letters to those letters, and all else to one space. Lexicon entries are word beginnings (or whole short words)
that labelled toxic documents hold far more often than clean ones, with their log-odds as weight. Exception
phrases are words or word pairs around a match that only clean labelled documents hold; they cancel the matches
inside them. A document's weights are summed, normalised by its words, and calibrated by a logistic curve.

The classifier is learned from a bounded sample of labelled rows (``max_toxic``, ``max_clean``); every document
is then scored over its whole text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import crc_fold, id_text
from contrail.sources.sinks import materialize

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнαοερτυνικ", "aeopcyxijsdhkmtbnaoeptuvik", strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

#: Lengths of word beginnings that can become entries; shorter words count whole.
SHORTEST, LONGEST = 4, 8


class Folding(dict):
    """Translation table that learns each character when it is first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = HOMOGLYPHS.get(c) or SIGNS.get(c)
        if plain is None:
            base = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
            base = "".join(HOMOGLYPHS.get(x, x) for x in base)
            plain = base if base.isalpha() else " "
        self[code] = plain
        return plain


FOLDING = Folding()
#: Signs that end a word.
ORNAMENT = re.compile(r"[$@!]+(?![^\s.,;:?#*%&|<>])")
#: The table for ASCII text, by bytes.
ASCII = bytes(ord(FOLDING[b].ljust(1)[0]) for b in range(128)) + bytes(128)


def folded(text: str | None) -> str:
    """Folded words, one space before, between and after them; no words make one space.

    Signs at a word's end are ornament and stand for no letter.
    """
    if not text:
        return " "
    plain = ORNAMENT.sub(" ", text.lower())
    plain = plain.encode().translate(ASCII).decode() if plain.isascii() else plain.translate(FOLDING)
    out = plain.split()
    return f" {' '.join(out)} " if out else " "


def entries_of(text: str) -> set[str]:
    """Possible lexicon entries of a folded text."""
    found = set()
    for w in set(text.split()):
        if len(w) < SHORTEST:
            if len(w) > 1:
                found.add(f" {w} ")
        else:
            found.update(f" {w[:k]}" for k in range(SHORTEST, min(len(w), LONGEST) + 1))
    return found


@dataclass
class ToxicityModel:
    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    #: intercept, weight of the log sum, weight of the log sum per 100 words; None without labelled rows
    curve: tuple[float, float, float] | None = None

    def automaton(self):
        a = ahocorasick.Automaton()
        for e, w in self.entries.items():
            a.add_word(e, (len(e), w, False))
        for e in self.exceptions:
            a.add_word(e, (len(e), 0.0, True))
        if len(a):
            a.make_automaton()
        return a

    def probability(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(total))
        z = np.array(self.curve) @ features(total, words)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / np.maximum(words, 1))])


def matches(a, text: str) -> dict[int, float]:
    """Place of each matched word and its largest entry's weight, without those inside exception phrases."""
    hits: dict[int, float] = {}
    free: list[tuple[int, int]] = []
    if len(a):
        for end, (size, weight, exception) in a.iter(text):
            start = end - size + 1
            if exception:
                free.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
    if free and hits:
        hits = {s: w for s, w in hits.items() if not any(x <= s < y for x, y in free)}
    return hits


def _strings(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    for value in batch.column(name):
        yield folded(value.as_py())


def _counted(sample: DataFrame, make, most: int = 200_000) -> DataFrame:
    """``(entry, toxic, clean)``: in how many toxic and clean documents each entry stands; ``make()`` gives the
    function from a folded text to its entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            names = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64())
                                                                              for c in (seen[1], seen[0]))],
                                             names=["entry", "toxic", "clean"])
            for c in seen:
                c.clear()
            return out
        for batch in batches:
            for text, toxic in zip(_strings(batch), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic].update(of(text))
                if len(seen[0]) + len(seen[1]) > most:
                    yield flush()
        yield flush()
    return sample.mapInArrow(run, "entry string, toxic bigint, clean bigint").groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _around(model: ToxicityModel):
    """From a folded text to its matched words and the pairs they make with their neighbours."""
    a = model.automaton()

    def of(text: str) -> set[str]:
        out = set()
        for s in matches(a, text):
            e = text.index(" ", s + 1)
            before, after = text.rfind(" ", 0, s), text.find(" ", e + 1)
            out.add(text[s:e + 1])
            if before >= 0:
                out.add(text[before:e + 1])
            if after > 0:
                out.add(text[s:after + 1])
        return out
    return of


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(len(x))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -40, 40)))
        grad = x @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + ridge * np.eye(len(x)), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_toxic: int = 3000, max_clean: int = 6000, max_entries: int = 4000, min_evidence: float = 18.0,
          min_ratio: float = 8.0, exceptions: tuple[str, ...] = ()) -> ToxicityModel:
    """Learn from documents whose label is 0 or 1, at most ``max_toxic`` and ``max_clean`` of them, drawn by id hash.

    An entry needs a log-likelihood ratio of ``min_evidence`` and ``min_ratio`` times the clean rate. Several labels
    of one document count as toxic if one is. Null labels or ids are left out. Without a toxic and a clean row
    the model has no curve and scores 0.
    """
    y = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(
        "toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = materialize(y.join(docs.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id", "left_semi"), "toxic-labels")
    share = dict(y.groupBy("toxic").count().collect())
    if len(share) < 2:
        return ToxicityModel()
    drawn = [y.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, max_toxic), (0, max_clean))]
    sample = materialize(id_text(docs, id_col, text_col).join(F.broadcast(drawn[0].union(drawn[1])), "doc_id").repartition("doc_id"),
                         "toxic-sample")
    sizes = dict(sample.groupBy("toxic").count().collect())
    t, c = sizes[1], sizes[0]

    rows = _counted(sample, lambda: entries_of)
    pt, pc, both = F.col("toxic") / t, F.col("clean") / c, (F.col("toxic") + F.col("clean")) / (t + c)
    evidence = 2 * (F.col("toxic") * F.log(F.greatest(pt, F.lit(1e-12)) / both)
                    + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.greatest(pc, F.lit(1e-12)) / both)).otherwise(0.0))
    strong = rows.where("toxic > 2").where(pt >= min_ratio * pc).withColumn("evidence", evidence).where(F.col("evidence") >= min_evidence)
    found = {r.entry: (r.toxic, r.clean) for r in strong.orderBy(F.desc("evidence"), "entry").limit(max_entries).collect()}
    # a beginning that a longer one replaces without loss goes: the longer one says the same more narrowly
    kept = {e: x for e, x in found.items()
            if not any(n[0] >= 0.95 * x[0] and n[1] <= x[1] for n in (found[f] for f in found if len(f) == len(e) + 1 and f.startswith(e)))}
    weight = {e: math.log((n1 + .5) / (t + 1)) - math.log((n0 + .5) / (c + 1)) for e, (n1, n0) in kept.items()}
    model = ToxicityModel(weight, [folded(e) for e in exceptions if folded(e) != " "])

    free = _counted(sample, lambda: _around(model)).where("toxic = 0 and clean >= 3").orderBy(F.desc("clean"), "entry").limit(max_entries)
    model.exceptions += [r.entry for r in free.collect()]

    got = _totals(sample, model, "toxic").select("toxic", "total", "words").toPandas()
    w = _fit_curve(features(got.total.to_numpy(), got.words.to_numpy()), got.toxic.to_numpy().astype(float))
    w[0] += math.log(share[1] / share[0]) - math.log(t / c)  # the sample's share of toxic rows is not the table's
    model.curve = tuple(float(v) for v in w)
    return model


def _totals(docs: DataFrame, model: ToxicityModel, *keep: str) -> DataFrame:
    """``(doc_id, keep..., hits, total, words, score)`` for each row."""
    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in ("doc_id", *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton()
        for batch in batches:
            hits, total, words = [], [], []
            for text in _strings(batch):
                m = matches(a, text)
                hits.append(len(m))
                total.append(math.fsum(m.values()))
                words.append(text.count(" ") - 1 if len(text) > 1 else 0)
            p = model.probability(np.array(total), np.array(words))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("doc_id", *keep)), pa.array(hits, pa.int64()), pa.array(total, pa.float64()),
                 pa.array(words, pa.int64()), pa.array(p, pa.float64())],
                names=["doc_id", *keep, "hits", "total", "words", "score"])
    return docs.select("doc_id", "text", *keep).mapInArrow(run, f"{kinds}, hits bigint, total double, words bigint, score double")


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted, hits, words)`` for each row of ``docs``; predicted is 1 from 0.5 up.

    Null, empty and word-less texts score as a text without matches. Null ids and repeated rows are scored like
    any row. Other columns are not read. An empty table gives an empty table.
    """
    out = _totals(id_text(docs, id_col, text_col), model)
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits", "words")


def learn_by_fold(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, **options) -> ToxicityModel:
    """Learn from the labelled documents outside the held-out fold."""
    return learn(docs, labels.where(crc_fold(F.col("doc_id"), folds) != held), **options)
