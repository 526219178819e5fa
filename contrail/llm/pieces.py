"""The vocabulary of a SentencePiece BPE model, and its merging of one chunk with a heap and a linked list.

The model file is read once on the driver; tasks get the pieces and scores, whose number the model fixes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import public_tokenizers
import sentencepiece

#: SentencePiece writes a space as this character and puts one before every text that is not empty.
SPACE = "▁"
MODEL = "piece_bpe_32k.model"


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]  # id of each byte's piece
    ids: dict[str, int] = field(init=False)
    #: rank of each normal piece by its text: the smaller, the earlier it is merged; equal scores share a rank
    ranks: dict[str, int] = field(init=False)

    def __post_init__(self):
        special = set(self.byte_ids)
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special and p is not None}
        order = {s: r for r, s in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.ranks = {p: order[self.scores[i]] for p, i in self.ids.items()}

        if max(map(len, self.ranks)) > 255:
            raise ValueError("the model has pieces of over 255 characters")

    def plain(self) -> tuple[list[str], list[float], list[int]]:
        """What makes the vocabulary, as plain data: a broadcast of it can be read where this package is not installed."""
        return self.pieces, self.scores, self.byte_ids

    @property
    def line_end_splits(self) -> bool:
        """Whether a line end is a token of its own wherever it stands."""
        return not any("\n" in p for p in self.ids)


def load(path: str | None = None) -> Vocabulary:
    """Read a BPE model with byte fallback whose pieces hold spaces at their start alone; others are refused.

    Control and unknown pieces take no part in merges and have no text here.
    """
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path or public_tokenizers.path(MODEL)))
    n = sp.get_piece_size()
    bytes_ = [i for i in range(n) if sp.is_byte(i)]
    pieces = [None if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else sp.id_to_piece(i) for i in range(n)]
    if len(bytes_) != 256:
        raise ValueError("the model has no byte fallback")
    if any(p and SPACE in p.lstrip(SPACE) for i, p in enumerate(pieces) if i not in set(bytes_)):
        raise ValueError("the model has pieces that run over a space")
    return Vocabulary(pieces, [sp.get_score(i) for i in range(n)], bytes_)


def merge(chunk: str, ranks: dict[str, int]) -> tuple[list[int], int, int]:
    """Merge the characters of ``chunk``: where the symbol that starts at each place ends (0 inside symbols), the number
    of merges, and the place of the last one's seam.

    A heap gives the adjacent pair of the lowest rank, the leftmost of equals; a linked list of ends and
    predecessors joins its symbols. An entry whose symbols have changed since is recognised by its size and dropped.
    """
    n = len(chunk)
    ends = list(range(1, n + 1))
    before = list(range(-1, n))
    get = ranks.get
    heap = [r << 40 | i << 8 | 2 for i in range(n - 1) if (r := get(chunk[i:i + 2])) is not None]
    heapq.heapify(heap)
    merges = seam = 0
    while heap:
        entry = heapq.heappop(heap)
        i = entry >> 8 & 0xFFFFFFFF
        j = ends[i]
        stop = i + (entry & 255)
        if not 0 < j < n or ends[j] != stop:
            continue
        merges += 1
        seam = j
        ends[i] = stop
        ends[j] = 0
        before[stop] = i
        if stop < n and (r := get(chunk[i:ends[stop]])) is not None:
            heapq.heappush(heap, r << 40 | i << 8 | ends[stop] - i)
        h = before[i]
        if h >= 0 and (r := get(chunk[h:stop])) is not None:
            heapq.heappush(heap, r << 40 | h << 8 | stop - h)
    return ends, merges, seam


def line_chunks(line: str, first: bool) -> Iterator[str]:
    """Chunks of one line; the first line of a text gets the leading space."""
    words = line.split(" ")
    if "" in words or SPACE in line:
        line = (SPACE if first else "") + line.replace(" ", SPACE)
        start = 0
        for i in range(1, len(line)):
            if line[i] == SPACE and line[i - 1] != SPACE:
                yield line[start:i]
                start = i
        if line:
            yield line[start:]
        return
    yield SPACE + words[0] if first else words[0]
    for w in words[1:]:
        yield SPACE + w


def chunks(text: str, splits: bool) -> Iterator[str]:
    """Chunks of a text, spaces written as SPACE, that no merge runs over: before each run of spaces, and around
    line ends where the vocabulary allows it (``splits``). Joined, they are the text with its leading space."""
    for n, line in enumerate(text.split("\n") if splits else [text]):
        if n:
            yield "\n"
        yield from line_chunks(line, not n)
