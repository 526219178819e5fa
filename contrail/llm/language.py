"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is built for each language. A text is parsed by it into phrases, each the longest
match from where the last one ended; a character that the language's text does not hold is a phrase alone. The
language that needs the fewest phrases for the same letters wins: they are normalised by the letters parsed.

Text is lower-cased, runs of other than letters become one space, and the automata work on UTF-8 bytes, of which
any script has 256 at most. Phrases also end every ``BLOCK`` bytes, so that a batch of texts, long ones as well,
is parsed by all languages in step: one table lookup for each byte of all blocks at once.

The classifier is learned from a bounded sample: in each of ``passages`` hash buckets of a language one passage of
``passage`` characters, drawn at a hashed place of one labelled document. All documents are scored over their whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import crc_fold, id_text

BLOCK = 256
OTHER = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> bytes:
    """Lower-cased words of letters, a space before, between and after them; empty without a letter."""
    words = OTHER.sub(" ", (text or "").lower()).strip()
    return f" {words} ".encode("utf-8", "replace") if words else b""


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``data``, whose state 0 reads every substring."""
    after: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in data:
        new = len(after)
        after.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(after)
                after.append(dict(after[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return after


@dataclass
class LanguageModel:
    languages: list[str]
    classes: np.ndarray  # class of each byte; 0 for bytes that no language's text holds
    table: np.ndarray  # next state by state and class, all languages below each other; 0 for none
    roots: np.ndarray  # first state of each language

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases that each text needs by each language."""
        k, n = len(self.languages), len(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        data = self.classes[np.frombuffer(b"".join(texts), np.uint8)]
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(n), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
        length = np.minimum(sizes[owner] - nth * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        width = self.table.shape[1]
        flat = self.table.ravel()
        open_ = np.searchsorted(-length, -np.arange(BLOCK), side="left")  # blocks longer than each offset
        roots = self.roots[:, None] * width
        state = np.repeat(self.roots[:, None], len(owner), 1)
        count = np.ones((k, len(owner)), np.int64)
        for at in range(int(length.max()) if len(length) else 0):
            m = open_[at]
            c = data[start[:m] + at]
            step = flat[state[:, :m] * width + c]
            end = step == 0
            if at:
                count[:, :m] += end
            # a byte unknown to the language leads to state 0, which goes nowhere: the next byte begins a phrase
            state[:, :m] = np.where(end, flat[roots + c], step)
        out = np.zeros((n, k), np.int64)
        np.add.at(out, owner, count.T)
        return out


def build(samples: dict[str, bytes]) -> LanguageModel:
    languages = sorted(samples)
    seen = sorted({b for t in samples.values() for b in t})
    classes = np.zeros(256, np.int64)
    classes[seen] = np.arange(1, len(seen) + 1)
    tables, roots, base = [np.zeros((1, len(seen) + 1), np.int32)], [], 1
    for name in languages:
        after = suffix_automaton(samples[name])
        table = np.zeros((len(after), len(seen) + 1), np.int32)
        for s, nexts in enumerate(after):
            for c, t in nexts.items():
                table[s, classes[c]] = base + t
        roots.append(base)
        base += len(after)
        tables.append(table)
    return LanguageModel(languages, classes, np.concatenate(tables), np.array(roots, np.int64))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", passages: int = 48, passage: int = 500) -> LanguageModel:
    """Learn from rows whose language is not null. A language has at most ``passages`` x ``passage`` characters.

    Each row offers one passage at a place that its text's hash chooses; in each hash bucket of a language the one of
    the smallest hash is taken, so languages of any share are summed before they are shuffled.
    """
    h = F.xxhash64("text")
    pieces = F.greatest(F.ceil(F.length("text") / passage), F.lit(1))
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(
        "lang is not null and text is not null").select(
        "lang", F.pmod(h, F.lit(passages)).alias("bucket"), h.alias("h"),
        F.substring("text", (F.pmod(F.xxhash64(h), pieces) * passage + 1).cast("int"), F.lit(passage)).alias("piece"))
    drawn = rows.groupBy("lang", "bucket").agg(F.min(F.struct("h", "piece")).alias("x")).select("lang", "bucket", "x.piece").collect()
    samples: dict[str, bytes] = {}
    for r in sorted(drawn, key=lambda r: (r.lang, r.bucket)):
        samples[r.lang] = samples.get(r.lang, b"") + normal(r.piece)
    return build({k: v for k, v in samples.items() if v})


def languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` for each row of ``docs``.

    The score is the share by which the winner needs fewer phrases than the runner-up, 1 for a model of one language.
    ``und`` with score 0 if the text is null or has no letter, or if the model knows no language. Of equal languages the
    first by name wins. Null ids and repeated rows are predicted like any row. Other columns are not read.
    """
    docs = id_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.classes, model.table, model.roots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(*shared.value)
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            pred, score = [], []
            texts, size = [], 0

            def flush():
                letters = np.array([len(t) > 0 for t in texts]) & bool(model.languages)
                best = np.full(len(texts), len(model.languages))
                share = np.zeros(len(texts))
                if letters.any():
                    n = model.phrases([t for t, ok in zip(texts, letters, strict=True) if ok])
                    best[letters] = n.argmin(1)
                    low = np.sort(n, 1)
                    share[letters] = 1 - low[:, 0] / low[:, 1] if n.shape[1] > 1 else 1.0
                pred.extend(names[best])
                score.extend(share.tolist())
                texts.clear()
            for value in batch.column("text"):
                texts.append(normal(value.as_py()))
                size += len(texts[-1])
                if size > 2_000_000:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def learn_by_fold(docs: DataFrame, folds: int = 4, held: int = 2, **options) -> LanguageModel:
    """Learn from the documents outside the held-out fold."""
    return learn(docs.where(crc_fold(F.col("doc_id"), folds) != held), **options)
