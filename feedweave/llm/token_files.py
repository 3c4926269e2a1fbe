"""Token ids as flat binary files.

A data set of token files is a folder in shared storage. Part p, of the documents between two doc_ids, has
  p.ids   the ids of all its documents, one after another, little-endian unsigned 16 or 32 bits by vocabulary size
  p.off   int64, one more than documents: where each document's ids start in p.ids, in ids
  p.doc   int64, the doc_ids (NULL_DOC for a missing one)
Parts follow each other in ascending doc_id order, so a prefix sum over the parts' id counts gives each part
its base: the position of a document in the whole stream is base + offset. Readers map the files into memory.

A part is written under a name of its attempt and renamed when whole, so a task that is run again after a
lost executor, or twice at once, leaves the same file.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedweave.llm.common import run_folder, stored
from feedweave.llm.words import text_slices

NULL_DOC = -(2**63)
CACHE_WORDS = 1_200_000  # words a worker remembers, about 240 MB
SLICE_BYTES = 1 << 23


@dataclass(frozen=True)
class WordTokenizer:
    """A tokenizers file that lower-cases and never splits across ASCII white space, so words can be encoded apart.

    A word of letters is one piece to its merges, and the last token of a piece ends with `word_end`; so new
    words of letters are encoded together, and those of lower-case ASCII letters by the merges alone.
    """

    path: str
    word_end: str = "</w>"

    def load(self) -> tuple[object, np.ndarray, list[bytes]]:
        return _tokenizer(self.path, self.word_end)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str, word_end: str) -> tuple[object, np.ndarray, list[bytes]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        ends[i] = token.endswith(word_end)
    # As the library does by itself, the strings of special tokens are those tokens in a text too.
    special = [t.content.lower().encode() for t in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, ends, special


_caches: dict[tuple[str, str], dict[bytes, bytes]] = {}


class WordEncoder:
    """The ids of whole texts as `dtype`; each new word goes through the tokenizer once."""

    def __init__(self, spec: WordTokenizer, dtype: str):
        self.tokenizer, self.ends, self.special = spec.load()
        self.dtype, self.code = np.dtype(dtype), {"<u2": "H", "<u4": "I"}[dtype]
        self.known = _caches.setdefault((spec.path, dtype), {})

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and len + 1 offsets into them. Words are told apart, and ids put
        together, for the whole array at once."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = words.flatten().dictionary_encode()
        ids = self._ids_of(coded.dictionary.cast(pa.large_binary()).to_pylist())
        size = np.array([len(i) for i in ids], np.int64) // self.dtype.itemsize
        which = coded.indices.to_numpy(zero_copy_only=False)
        n = size[which]
        ends = np.concatenate(([0], np.cumsum(n)))
        shift = np.repeat((np.cumsum(size) - size)[which] - ends[:-1], n)
        shift += np.arange(len(shift))
        at = words.offsets.to_numpy() - words.offsets[0].as_py()
        return np.frombuffer(b"".join(ids), self.dtype)[shift], ends[at]

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        known = self.known
        found = list(map(known.get, words))
        new = {w for w, ids in zip(words, found, strict=True) if ids is None}
        if not new:
            return found
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
        self._learn(new)
        return [known[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]

    def _learn(self, new: set[bytes]) -> None:
        """Stops and commas after an ASCII letter, and the case of ASCII letters, change nothing in the rest of a word."""
        whole, parts = set(), {}
        for w in new:
            if any(token in w.lower() for token in self.special):
                whole.add(w)  # the case of a special token's string matters
                continue
            core = w.rstrip(b".,") if w.isascii() else w
            if core and core != w and chr(core[-1]).isalpha():
                parts[w] = (core.lower(), w[len(core) :])
                whole.update(parts[w])
            elif core == w and w.isascii():
                parts[w] = (w.lower(), b"")
                whole.add(w.lower())
            else:
                whole.add(w)
        known, done = self.known, {}
        fresh = [w for w in whole if w not in known]
        for w in fresh:
            if w.isalpha() and w.islower():  # lower-case ASCII letters: one piece that no normaliser changes
                done[w] = array(self.code, [t.id for t in self.tokenizer.model.tokenize(w.decode())]).tobytes()
        letters = [w for w in fresh if w not in done and w.decode().isalpha()]
        done |= self._together(letters) if letters else {}
        rest = [w for w in fresh if w not in done]
        if rest:
            for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
                done[w] = array(self.code, e.ids).tobytes()
        known.update(done)
        for w, (core, tail) in parts.items():
            if w not in done:
                known[w] = known[core] + (known[tail] if tail else b"")

    def _together(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words of letters as one text, cut after each token that ends a word; {} if the number of ends is another."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return {}
        data, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        bounds = [0, *(cuts * size).tolist()]
        return {w: data[a:b] for w, a, b in zip(words, bounds, bounds[1:], strict=False)}


def write_token_files(docs: DataFrame, spec: WordTokenizer, end_id: int | None) -> tuple[str, DataFrame]:
    """Writes all documents in ascending doc_id order (missing ones first) and returns (folder, parts).

    parts has a row for each part: part, dtype, n_docs, n_ids, base. A null text is empty; `end_id` is added to each
    document if given. Rows that repeat a doc_id are documents of their own, next to each other. An empty
    table gives no parts. Other columns are not looked at.
    """
    vocabulary = spec.load()[0].get_vocab_size()
    dtype = "<u2" if max(vocabulary, end_id or 0) < 1 << 16 else "<u4"
    folder = run_folder(docs.sparkSession, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordEncoder(spec, dtype), TaskContext.get().partitionId()
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt = f"{root}/{part:06d}.{uuid.uuid4().hex}"
        n_ids, n_docs = 0, 0
        with store.open_output_stream(f"{attempt}.ids") as ids, store.open_output_stream(f"{attempt}.off") as off, store.open_output_stream(f"{attempt}.doc") as doc:
            for batch in batches:
                for a, b in text_slices(batch.column(1), SLICE_BYTES):
                    coded, at = encoder.encode(batch.column(1).slice(a, b - a))
                    if end_id is not None:
                        coded, at = np.insert(coded, at[1:], end_id), at + np.arange(len(at))
                    off.write((n_ids + at[:-1]).astype("<i8").tobytes())
                    doc.write(batch.column(0).slice(a, b - a).fill_null(NULL_DOC).to_numpy().astype("<i8").tobytes())
                    ids.write(coded.tobytes())
                    n_ids, n_docs = n_ids + int(at[-1]), n_docs + b - a
            off.write(np.array([n_ids], "<i8").tobytes())
        for kind in ("ids", "off", "doc"):
            if n_docs:
                store.move(f"{attempt}.{kind}", f"{root}/{part:06d}.{kind}")
            else:
                store.delete_file(f"{attempt}.{kind}")
        if n_docs:
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    parts = stored(ordered.mapInArrow(write, "part int, n_docs long, n_ids long"), "token-parts")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a part file
    return folder, parts.select("part", F.lit(dtype).alias("dtype"), "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))


def read_token_files(folder: str, parts: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian uint32)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, dtype in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, off, doc = (_mapped(f"{folder}/{part:06d}.{kind}", t) for kind, t in (("ids", dtype), ("off", "<i8"), ("doc", "<i8")))
                for a in range(0, len(doc), 10_000):
                    cut = off[a : a + 10_001].tolist()
                    sums = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(cut, cut[1:], strict=False)]
                    names = doc[a : a + 10_000]
                    yield pa.record_batch(
                        {
                            "doc_id": pa.array(names, pa.int64(), mask=names == NULL_DOC),
                            "start": pa.array(np.array(cut[:-1]) + base, pa.int64()),
                            "n_tokens": pa.array(np.diff(cut), pa.int64()),
                            "ids_crc32": pa.array(sums, pa.int64()),
                        }
                    )

    tasks = max(1, min(parts.count(), 10_000))
    return parts.select("part", "base", "dtype").repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _mapped(uri: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped into memory where the store is a file system of the machine, else read."""
    store, path = pafs.FileSystem.from_uri(uri)
    if store.get_file_info(path).size == 0:
        return np.empty(0, dtype)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)
