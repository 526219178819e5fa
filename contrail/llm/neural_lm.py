"""Language-model scores by a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

The model predicts the class of a token from the class of the one before, then the token inside its class by its share of the
class's smoothed counts. Every word has a class, however many words there are: the ``classes`` most frequent ones (and the end
mark) one of their own, other frequent words that of the group of words they stand next to, all others, unknown ones too, that
of their spelling, learned from the frequent words. A context vector, multiplied by a matrix, meets the target vectors, and a
bias is added. The probabilities of all known words and one unknown event in each class of spelling add up to 1.

Training sees every training token: Spark sums the pairs of neighbouring classes over the corpus, a table of bounded
size. The noise-contrastive objective depends on the corpus by these counts alone, so its gradient is taken over all of them
at once, with the noise in expectation. Batched matrix products then give the normalised log-probabilities of all targets in
all contexts.

Counts of words are exact and open: frequent words, ``head`` at most, travel to the tasks, all others meet
their counts in a join by word, summed per document and word before.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import crc_fold, id_text
from contrail.sources.sinks import discard, materialize

#: Words hold no line end, so this key cannot be a word.
END = "\n"
#: Longest word, in bytes, that travels to the tasks.
LONGEST = 64
SMOOTH = 0.1
#: Hashes of three-byte strings; a power of two.
GRAMS = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_counts(train: DataFrame) -> DataFrame:
    """``(word, c)``: how often each word, and the end mark, stands in the texts of ``train(text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())],
                                             names=["word", "c"])
            seen.clear()
            return out
        for batch in batches:
            for value in batch.column("text"):
                seen.update(words_of(value.as_py()))
                seen[END.encode()] += 1
                if len(seen) > 300_000:
                    yield flush()
        if seen:
            yield flush()
    return train.select("text").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Numbers(dict):
    """Number of a word in the head, -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


def text_blocks(batch: pa.RecordBatch, size: int = 4_000_000) -> Iterator[tuple[int, list[list[bytes]]]]:
    """First row and words of the texts of consecutive rows, some ``size`` bytes of text (at least one row) at a time."""
    first, block, held = 0, [], 0
    for k, value in enumerate(batch.column("text")):
        text = value.as_py()
        block.append(words_of(text))
        held += len(text or "") + 100
        if held >= size:
            yield first, block
            first, block, held = k + 1, [], 0
    if block:
        yield first, block


def gram_numbers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all three-byte strings of the words between two marks, word after word, and where each word's begin."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), np.uint8).astype(np.uint32)
    hashed = ((text[:-2] * 40503 + text[1:-1]) * 40503 + text[2:]) * 40503 >> 8 & (GRAMS - 1)
    inside = np.ones(len(text), bool)
    ends = np.cumsum(sizes)
    inside[ends - 1] = inside[ends - 2] = False
    return hashed[inside[:-2]], ends - sizes - 2 * np.arange(len(words))


def spelled(words: list[bytes], weights: np.ndarray, size: int = 100_000) -> np.ndarray:
    """The group of each word that its three-byte strings speak for most."""
    out = np.zeros(len(words), np.int64)
    lo = 0
    while lo < len(words):
        hi, held = lo, 0
        while hi < len(words) and held < size:
            held += len(words[hi])
            hi += 1
        grams, starts = gram_numbers(words[lo:hi])
        if held > 10 * size:  # a very long word: its strings are counted first
            stops = np.r_[starts[1:], len(grams)]
            sums = np.array([np.bincount(grams[x:y], minlength=GRAMS) @ weights for x, y in zip(starts, stops, strict=True)])
        else:
            sums = np.add.reduceat(weights[grams], starts, 0)
        out[lo:hi] = sums.argmax(1)
        lo = hi
    return out


@dataclass
class Classes:
    """Classes of all words: plain data, so that it travels to workers as a tuple."""

    head: dict[bytes, int]  # number of each frequent word, by falling frequency, from 1; 0 is the end mark
    own: np.ndarray  # class of each number; -1: by spelling
    weights: np.ndarray  # group weights of hashed three-byte strings
    first: int  # classes from here on are those of spelling

    @property
    def total(self) -> int:
        return self.first + self.weights.shape[1]

    def plain(self) -> tuple:
        return self.head, self.own, self.weights, self.first


def class_sequence(block: list[list[bytes]], number: Numbers, own: np.ndarray, weights: np.ndarray, first: int) -> tuple[np.ndarray, ...]:
    """Numbers (-1: not in the head) and classes of the tokens of all texts of a block, end marks included, and where the texts begin."""
    starts = np.cumsum([0] + [len(w) + 1 for w in block])
    ids = np.zeros(starts[-1], np.int64)
    for at, w in zip(starts, block, strict=False):
        ids[at:at + len(w)] = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
    classes = np.where(ids >= 0, own[ids], -1)
    open_ = np.flatnonzero(classes < 0)
    if weights.shape[1] == 1:
        classes[open_] = first
    elif len(open_):
        text = np.searchsorted(starts, open_, "right") - 1
        words = [block[t][k] for t, k in zip(text.tolist(), (open_ - starts[text]).tolist(), strict=True)]
        place = {w: i for i, w in enumerate(dict.fromkeys(words))}
        classes[open_] = first + spelled(list(place), weights)[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]
    return ids, classes, starts[:-1]


def _cell_sums(train: DataFrame, count, cells: int) -> DataFrame:
    """``(cell, n)``: sums over all texts of the table of ``cells`` numbers to which ``count(block, table)`` adds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, np.int64)
        for batch in batches:
            for _, block in text_blocks(batch):
                count(block, table)
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table[some])], names=["cell", "n"])
    return train.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def pair_counts(train: DataFrame, classes: Classes) -> np.ndarray:
    """Matrix of how often class j follows class i; the last row is the start of a text."""
    shared = train.sparkSession.sparkContext.broadcast(classes.plain())
    total = classes.total

    def count(block: list[list[bytes]], table: np.ndarray) -> None:
        head, own, weights, first = shared.value
        _, seq, starts = class_sequence(block, Numbers(head), own, weights, first)
        before = np.r_[total, seq[:-1]]
        before[starts] = total
        np.add.at(table, before * total + seq, 1)
    rows = _cell_sums(train, count, (total + 1) * total).toPandas()
    out = np.zeros((total + 1) * total)
    out[rows.cell.to_numpy(np.int64)] = rows.n.to_numpy()
    return out.reshape(total + 1, total)


def group_words(pairs: np.ndarray, groups: int, rounds: int = 30) -> np.ndarray:
    """Group of each class of ``pairs`` (square) by what stands before and after it: k-means on the sphere, started far apart."""
    beside = np.c_[pairs, pairs.T]
    often = beside.sum(1)
    usual = beside.sum(0) / max(beside.sum(), 1)
    x = np.sqrt(beside / np.maximum(often, 1)[:, None]) - np.sqrt(usual)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    weight = np.sqrt(often)
    centres = [x[weight.argmax()]]
    while len(centres) < groups:
        centres.append(x[(weight * np.min([((x - c)**2).sum(1) for c in centres], 0)).argmax()])
    centres = np.array(centres)
    for _ in range(rounds):
        mine = (x @ centres.T).argmax(1)
        for k in range(groups):
            if (mine == k).any():
                centres[k] = weight[mine == k] @ x[mine == k]
                centres[k] /= np.linalg.norm(centres[k]) + 1e-9
    return (x @ centres.T).argmax(1)


def neighbour_groups(train: DataFrame, head: dict[bytes, int], group: np.ndarray, groups: int, near: int = 3) -> np.ndarray:
    """Group of each word of the head by the grouped words at most ``near`` places away; -1 for words that never stand near one."""
    size = len(head) + 1
    shared = train.sparkSession.sparkContext.broadcast((head, group))

    def count(block: list[list[bytes]], table: np.ndarray) -> None:
        head, group = shared.value
        number, known = Numbers(head), len(group)
        starts = np.cumsum([0] + [len(w) + 1 + near for w in block])  # texts stand further apart than words are near
        ids = np.full(starts[-1], -1)
        for at, w in zip(starts, block, strict=False):
            ids[at:at + len(w)] = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
            ids[at + len(w)] = 0
        voice = np.where((ids >= 0) & (ids < known), group[np.clip(ids, 0, known - 1)], -1)
        for k in range(1, near + 1):
            for word, by in ((ids[:-k], voice[k:]), (ids[k:], voice[:-k])):
                some = (word >= 0) & (by >= 0)
                np.add.at(table, word[some] * groups + by[some], 1)
    votes = _cell_sums(train, count, size * groups).select(F.floor(F.col("cell") / groups).alias("word"), (F.col("cell") % groups).cast("int").alias("g"), "n")
    votes = materialize(votes, "lm-votes")
    sums = np.full(groups, 1e-9)
    for g, n in votes.groupBy("g").agg(F.sum("n")).collect():
        sums[g] += n
    share = F.element_at(F.array(*(F.lit(float(x)) for x in sums / sums.sum())), F.col("g") + 1)
    best = votes.groupBy("word").agg(F.max_by("g", F.struct((F.col("n") + 2 * share) / F.sqrt(share), -F.col("g"))).alias("g")).toPandas()
    discard(votes)
    out = np.full(size, -1)
    out[best.word.to_numpy(np.int64)] = best.g.to_numpy()
    return out


def spelling_weights(words: list[bytes], group: np.ndarray, groups: int) -> np.ndarray:
    """How much more often than elsewhere each hashed three-byte string stands in words of each group, as a logarithm."""
    seen = np.zeros((GRAMS, groups))
    usual = (np.bincount(group, minlength=groups) + 1) / (len(group) + groups)
    for lo in range(0, len(words), 10_000):
        grams, starts = gram_numbers(words[lo:lo + 10_000])
        np.add.at(seen, (grams, np.repeat(group[lo:lo + 10_000], np.diff(np.r_[starts, len(grams)]))), 1)
    return np.log((seen + usual) / (seen.sum(1, keepdims=True) + 1) / usual).astype(np.float32)


def word_classes(train: DataFrame, words: list[bytes], classes: int, groups: int, often: int = 20_000) -> Classes:
    """Classes of all words from the head, ``words`` by falling frequency: the first ``classes`` numbers (the end mark is number 0)
    have their own, the next up to ``often`` and the others of the head those of two bands of groups, open words those of spelling."""
    head = {w: i + 1 for i, w in enumerate(words)}
    alone = np.full(len(words) + 1, -1)
    classes = min(classes, len(alone))
    alone[:classes] = np.arange(classes)
    groups = min(groups, classes)
    pairs = pair_counts(train, Classes(head, alone, np.zeros((GRAMS, 1), np.float32), classes))[:classes, :classes]
    near = neighbour_groups(train, head, group_words(pairs, groups), groups)
    band = (np.arange(len(alone)) >= often).astype(np.int64)
    own = np.where(alone >= 0, alone, np.where(near >= 0, classes + band * groups + near, -1))
    known = np.flatnonzero(near[1:] >= 0)
    weights = spelling_weights([words[i] for i in known], near[known + 1], groups)
    return Classes(head, own, weights, classes + 2 * groups)


def class_masses(table: DataFrame, classes: Classes) -> np.ndarray:
    """Smoothed count of the known words of each class, and of one unknown event in each class of spelling."""
    shared = table.sparkSession.sparkContext.broadcast(classes.plain())
    total = classes.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own, weights, first = shared.value
        number = Numbers(head)
        n, kinds = np.zeros(total, np.int64), np.zeros(total, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 10_000):
                part = batch.slice(lo, 10_000)
                words = [w.encode() for w in part.column("word").to_pylist()]
                ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                mine = np.where(ids >= 0, own[ids], -1)
                open_ = np.flatnonzero(mine < 0)
                mine[open_] = first + spelled([words[i] for i in open_], weights)
                np.add.at(n, mine, np.asarray(part.column("c")))
                kinds += np.bincount(mine, minlength=total)
        some = np.flatnonzero(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(kinds[some])], names=["class", "n", "kinds"])
    sums = table.where(F.col("word") != END).mapInArrow(run, "class bigint, n bigint, kinds bigint").groupBy("class").agg(
        F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).toPandas()
    out = np.zeros(total)
    out[classes.first:] = SMOOTH
    np.add.at(out, sums["class"].to_numpy(np.int64), sums.n.to_numpy() + SMOOTH * sums.kinds.to_numpy())
    return out


def train_log_bilinear(pairs: np.ndarray, size: int = 24, noise: int = 8, steps: int = 250, rate: float = 0.05, seed: int = 5) -> np.ndarray:
    """Log-bilinear model of ``pairs`` (contexts x targets) by noise-contrastive estimation: natural log-probabilities of
    all targets in all contexts.

    A pair's score is (context vector x matrix) . target vector + bias. The noise distribution is that of the targets,
    ``noise`` draws for each pair, in expectation. Adam steps over all pairs at once.
    """
    contexts, targets = pairs.shape
    r = np.random.default_rng(seed)
    often = pairs.sum(0) + SMOOTH
    p = often / often.sum()
    log_noise = np.log(noise * p)
    weight = pairs / max(pairs.sum(), 1)
    against = weight.sum(1, keepdims=True) * (noise * p)
    params = [r.normal(0, 0.1, (contexts, size)), np.eye(size) + r.normal(0, 0.01, (size, size)), r.normal(0, 0.1, (targets, size)), np.log(p)]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for step in range(1, steps + 1):
        ctx, mat, tgt, bias = params
        hidden = ctx @ mat
        data = 1 / (1 + np.exp(-np.clip(hidden @ tgt.T + bias - log_noise, -30, 30)))  # chance that a pair is data
        g = weight * (1 - data) - against * data  # gradient by the score
        back = g @ tgt
        grads = [back @ mat.T, ctx.T @ back, g.T @ hidden, g.sum(0)]
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, grad in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad * grad
            params[k] = params[k] + now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    ctx, mat, tgt, bias = params
    scores = ctx @ mat @ tgt.T + bias
    scores -= scores.max(1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(1, keepdims=True))


@dataclass
class LanguageModel:
    classes: Classes
    counts: np.ndarray  # training count of the end mark and of each word of the head
    masses: np.ndarray  # smoothed count of each class
    log_probs: np.ndarray  # log10 probability of each class after each context
    tokens: int  # N
    kinds: int  # V
    table: DataFrame  # (word, c) of all training words


def learn(docs: DataFrame, text_col: str = "text", classes: int = 768, head: int = 200_000, groups: int = 16, **options) -> LanguageModel:
    """Learn from all texts of ``docs``; a null text counts as an empty one, which is one end mark."""
    train = docs.select(F.col(text_col).cast("string").alias("text"))
    table = materialize(word_counts(train), "word-counts")
    n, v = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # words seen once tell how words never seen behave: both go by spelling
    top = table.where((F.col("c") > 1) & (F.octet_length("word") <= LONGEST) & (F.col("word") != END)).orderBy(F.desc("c"), "word").limit(head).toPandas()
    ends = table.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    counts = np.r_[ends, top.c.to_numpy(np.float64)]
    found = word_classes(train, [w.encode() for w in top.word], classes, groups)
    masses = class_masses(table, found)
    masses[0] += ends + SMOOTH
    return LanguageModel(found, counts, masses, train_log_bilinear(pair_counts(train, found), **options) / np.log(10), n, v, table)


def scores(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)``: one row for each row of ``docs``.

    ``base_score`` is the smoothed unigram log10 probability of the text, ``score`` that of the log-bilinear model. A null or
    empty text is the end mark alone. Without training tokens every probability is that of the one unknown event, 1.
    Null ids and repeated rows are scored like any row. Other columns are not read.
    """
    docs = id_text(docs, id_col, text_col)
    log_count = np.log10(np.r_[model.counts, 1 - SMOOTH] + SMOOTH)  # words outside the head are added after the join
    # a class in which no word was seen and none can be met has no mass
    inside = np.log10(np.where(model.masses > 0, model.masses, 1.0))
    shared = docs.sparkSession.sparkContext.broadcast((*model.classes.plain(), log_count, model.counts > 0, inside, model.log_probs))
    trained = model.tokens > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own, weights, first, log_count, known, inside, log_probs = shared.value
        number = Numbers(head)
        for batch in batches:
            for row, block in text_blocks(batch):
                ids, seq, starts = class_sequence(block, number, own, weights, first)
                before = np.r_[len(inside), seq[:-1]]
                before[starts] = len(inside)
                logs = log_count[ids]
                full = log_probs[before, seq] + logs - inside[seq]
                seen = np.where(ids >= 0, known[ids], False).astype(np.int64)
                rare = []
                for w, part in zip(block, np.split(ids, starts[1:]), strict=True):
                    often = Counter(w[i].decode("utf-8", "replace") for i in np.flatnonzero(part < 0))
                    rare.append([{"word": a, "n": b} for a, b in often.items()])
                kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, len(block)), pa.array(np.diff(np.r_[starts, len(ids)])), pa.array(np.add.reduceat(seen, starts)),
                     pa.array(np.add.reduceat(logs, starts)), pa.array(np.add.reduceat(full, starts)), pa.array(rare, kind)],
                    names=["doc_id", "n_tokens", "n_head", "logs", "model", "rare"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = docs.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_head bigint, logs double, model double, "
                                   "rare array<struct<word: string, n: bigint>>")
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "lm-scan")
    rare = scanned.select("row", F.inline("rare")).join(model.table, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + SMOOTH)).alias("rare_logs"),
                                   F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    out = scanned.drop("rare").join(rare, "row", "left")
    more = F.coalesce("rare_logs", F.lit(0.0))
    base_total = float(np.log10(model.tokens + SMOOTH * (model.kinds + 1)))
    return out.select("doc_id", "n_tokens", (F.col("n_head") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
                      F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
                      (F.col("logs") + more - F.col("n_tokens") * base_total).alias("base_score"),
                      (F.col("model") + more if trained else F.lit(0.0)).alias("score"))


def learn_by_fold(docs: DataFrame, folds: int = 10, held: int = 0, **options) -> LanguageModel:
    """Learn from the documents outside the held-out fold."""
    return learn(docs.where(crc_fold(F.col("doc_id"), folds) != held), **options)
