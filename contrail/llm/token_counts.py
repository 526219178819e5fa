"""Token counts by heap-and-linked-list byte-pair merging.

The count of a chunk is its initial symbols less its merges, so no token is ever looked up. A character outside
the vocabulary starts as one symbol for each of its bytes, which never merge. Merges do not run over the start of
a run of spaces, so a text is the sum of its chunks, and each task remembers the counts of the chunks it has met.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import id_text
from contrail.llm.pieces import SPACE, Vocabulary, line_chunks, load, merge


class Counts(dict):
    """Tokens of a chunk, which is ``lead`` and the key; remembers keys up to ``longest`` characters, and forgets all
    when it holds ``most``."""

    def __init__(self, vocabulary: Vocabulary, lead: str = "", most: int = 500_000, longest: int = 64):
        super().__init__()
        self.ranks, self.lead, self.most, self.longest = vocabulary.ranks, lead, most, longest

    def __missing__(self, key: str) -> int:
        chunk, ranks = self.lead + key, self.ranks
        n = len(chunk) - merge(chunk, ranks)[1]
        if not ranks.keys() >= set(chunk):
            n += sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in chunk if c not in ranks)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = n
        return n


def count(text: str | None, counts: Counts, words: Counts, splits: bool) -> int:
    """Tokens of a text; ``words`` holds those of words that follow one space, by the word alone."""
    if not text:
        return 0
    total = 0
    for n, line in enumerate(text.split("\n") if splits else [text]):
        parts = line.split(" ")
        if "" in parts or SPACE in line:  # runs of spaces, or a space at either end
            total += (n > 0) + sum(counts[c] for c in line_chunks(line, not n))
            continue
        if n:
            total += 1 + counts[parts[0]]
            del parts[0]
        total += sum(map(words.__getitem__, parts))
    return total


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``: one row for each row of ``docs``.

    ``model`` is the path of a SentencePiece BPE model (the public one by default); the counts are those of its library,
    without begin or end marks. A null or empty text has no bytes and no tokens. Null ids and repeated rows are
    counted like any row. Other columns are not read.
    """
    docs = id_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(load(model).plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(*shared.value)
        counts = Counts(vocabulary)
        words = Counts(vocabulary, SPACE)
        splits = vocabulary.line_end_splits
        for batch in batches:
            n = [count(t.as_py(), counts, words, splits) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = read.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
