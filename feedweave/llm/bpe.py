"""Byte-level BPE as a tree of a monoid.

The element of a text is its tokens, cut at the matches of the splitting pattern; joining the elements of
two neighbours gives the element of both texts together. A text is halved down to leaves, each leaf is
encoded by the tokenizer, and neighbours are joined up the tree.

A join re-encodes a window around the border. A sure border is a blank that follows a character which is no
white space: no match of the pattern holds both, and none looks past one, so every reading of the text has a
match that starts there. The window grows to the left until it starts at a sure border of the left part, and
to the right until it ends at one of the right part. Tokens outside the window are then the same in the
joint text as in the parts. If there is no such border the window is the whole part, and the join still right.

Elements keep their tokens as a list of slices, so a join copies the border and nothing else, and the parts
of very long texts can be encoded apart.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from feedweave.llm.words import SLICE_BYTES, text_slices

SURE_BORDER = re.compile(r"(?<!\s)[ \n\t]")
LEAF_CHARS = 8192
WINDOW_CHARS = 64  # first window of a join; doubled until the tokens stabilise


@dataclass(frozen=True)
class Vocabulary:
    """Ranks and splitting pattern. `path` is a rank file on every machine, or one added by SparkContext.addFile."""

    path: str
    pattern: str

    def encoder(self) -> tiktoken.Encoding:
        return _encoder(self.path, self.pattern)[0]

    def pieces(self) -> list[bytes]:
        return _encoder(self.path, self.pattern)[1]


@functools.lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    with open(path if "/" in path else SparkFiles.get(path), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), pieces


@dataclass
class Element:
    """The tokens of text[start:end], in runs that follow each other."""

    start: int
    end: int
    runs: list[list[int]] = field(default_factory=list)


class TreeEncoder:
    """Encodes one text after another; not shared between threads."""

    def __init__(self, vocabulary: Vocabulary, leaf_chars: int = LEAF_CHARS, window_chars: int = WINDOW_CHARS):
        self.encoder = vocabulary.encoder()
        self.pieces = vocabulary.pieces()
        self.leaf_chars, self.window_chars = max(1, leaf_chars), max(1, window_chars)

    def encode(self, text: str) -> list[int]:
        """Token ids of the whole text, those of one encode_ordinary call."""
        return [i for run in self._element(text, 0, len(text)).runs for i in run]

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree; decoding is a homomorphism, so no border needs care."""
        if len(ids) <= self.leaf_chars:
            pieces = self.pieces
            return b"".join([pieces[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def _element(self, text: str, start: int, end: int) -> Element:
        if end - start <= self.leaf_chars:
            return Element(start, end, [self.encoder.encode_ordinary(text[start:end])] if end > start else [])
        half = (start + end) // 2
        return self.join(text, self._element(text, start, half), self._element(text, half, end))

    def join(self, text: str, left: Element, right: Element) -> Element:
        """The element of both parts of `text`."""
        cut, meet = self._border_before(text, left), self._border_after(text, right)
        if meet == right.start:  # the parts meet at a sure border
            return Element(left.start, right.end, left.runs + right.runs)
        encode = self.encoder.encode_ordinary
        kept = _without_last(left.runs, len(encode(text[cut : left.end])))
        rest = _without_first(right.runs, len(encode(text[right.start : meet])))
        return Element(left.start, right.end, [*kept, encode(text[cut:meet]), *rest])

    def _border_before(self, text: str, part: Element) -> int:
        """The last sure border in a part, or its start."""
        window = self.window_chars
        while True:
            start = max(part.start, part.end - window)
            found = [m.start() for m in SURE_BORDER.finditer(text, start, part.end)]
            if found or start == part.start:
                return found[-1] if found else part.start
            window *= 2

    def _border_after(self, text: str, part: Element) -> int:
        """The first sure border in a part, or its end."""
        window = self.window_chars
        while True:
            stop = min(part.end, part.start + window)
            found = SURE_BORDER.search(text, part.start, stop)
            if found or stop == part.end:
                return found.start() if found else part.end
            window *= 2


def _without_last(runs: list[list[int]], n: int) -> list[list[int]]:
    out = list(runs)
    while n:
        last = out.pop()
        if len(last) > n:
            out.append(last[: len(last) - n])
            break
        n -= len(last)
    return out


def _without_first(runs: list[list[int]], n: int) -> list[list[int]]:
    for i, run in enumerate(runs):
        if len(run) > n:
            return [run[n:], *runs[i + 1 :]]
        n -= len(run)
    return []


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, ids (array of int) of the whole text and `decoded`, the bytes that decoding gives back.

    A null text is empty and has no ids. Repeated rows and empty tables need no care; columns not in `keep`
    are dropped, so that none can clash with the results.
    """
    kept = docs.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "ids array<int>", "decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TreeEncoder(vocabulary)
        for batch in batches:
            for a, b in text_slices(batch.column(len(keep)), SLICE_BYTES):
                part = batch.slice(a, b - a)
                ids = [tree.encode(t or "") for t in part.column(len(keep)).to_pylist()]
                columns = [*part.columns[: len(keep)], pa.array(ids, pa.list_(pa.int32())), pa.array([tree.decode(i) for i in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids", "decoded"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of encode_documents, without moving the ids out of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TreeEncoder(vocabulary)
        names = [str(i) for i in range(len(tree.pieces))]
        for batch in batches:
            counts, idsums, textsums = [], [], []
            for t in batch.column(1):
                ids = tree.encode(t.as_py() or "")
                counts.append(len(ids))
                idsums.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                textsums.append(hashlib.sha256(tree.decode(ids)).hexdigest())
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": idsums, "decoded_sha256": textsums})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
