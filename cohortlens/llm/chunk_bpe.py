"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last ``WINDOW`` bytes cuts every text into chunks whose borders depend
on content only, so passages that documents share fall into the same chunks. Each task keeps a
memo of chunk encodings (bounded in bytes): while it is held, a chunk that documents share is
encoded once per Python worker.

Chunks encoded on their own disagree with the whole text's encoding around their joins only.
A position is *settled* when a non-space character stands before it, a space at it and a
non-space character after it: the byte-level pre-tokenizer always starts a new word there,
whatever surrounds it, so the text may be encoded separately on both sides. Between two neighbouring settled
positions lies one unit, in prose a space and a word; a second bounded memo holds their ids, so
a new chunk only has its unseen units encoded. Per chunk the memo keeps the ids between its
first and last settled position. At a join, the window from the
left chunk's last to the right chunk's first settled position is encoded again; where a chunk
has none, the window grows over further chunks until both ends are settled (or the text ends),
and the window's ids then agree exactly with those of the whole text.

Decoding maps ids back to bytes and replaces invalid UTF-8, as the library does; it works per
document on the ids alone.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cohortlens.llm.common import Memo, columns

WINDOW = 16
MEAN_CHUNK = 512  # bytes between cuts on average (a power of two)
CHUNK_MEMO = 24 << 20  # bounds of the memos per Python worker, in bytes
UNIT_MEMO = 96 << 20
RUN_BYTES = 1 << 19  # bytes of the texts that are encoded together
SETTLED = re.compile(r" (?=\S)(?<=\S )")
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: bytes) -> list[int]:
    """Positions where the window's hash has its low bits zero, moved to a character border."""
    if len(data) <= WINDOW:
        return []
    raw = np.frombuffer(data, np.uint8)
    g = GEAR[raw]
    h = np.zeros(len(g), np.uint32)
    for back in range(WINDOW):  # gear hash: each step back weighs one more bit
        h[back:] += g[:len(g) - back] << np.uint32(back)
    cuts = np.flatnonzero((h >> np.uint32(7)) & np.uint32(MEAN_CHUNK - 1) == 0) + 1
    out = []
    for c in cuts.tolist():
        while c < len(data) and data[c] & 0xC0 == 0x80:
            c += 1
        if c < len(data) and (not out or c > out[-1]):
            out.append(c)
    return out


class ChunkCoder:
    """Encodes whole texts by chunks; ``tokenizer_file`` is a byte-level BPE of the tokenizers
    library without normalizer, prefix space or post-processor."""

    def __init__(self, tokenizer_file: str, chunk_memo: int = CHUNK_MEMO, unit_memo: int = UNIT_MEMO):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_file)
        self.chunks, self.units = Memo(chunk_memo), Memo(unit_memo)
        self.bytes_of = _id_bytes(tokenizer_file)

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Ids as unsigned 32-bit integers, one bytes object a text."""
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_units(self, units: list[list[str]]) -> list[bytes]:
        """Ids of runs of units, each unit standing for a space and its text."""
        known = {u: self.units.get(u) for u in set().union(*units)}
        new = [u for u, ids in known.items() if ids is None]
        for u, ids in zip(new, self._ids([" " + u for u in new])):
            known[u] = ids
            self.units.put(u, ids, len(ids))
        return [b"".join(map(known.__getitem__, run)) for run in units]

    def _learn(self, chunks: list[str]) -> dict[str, tuple | None]:
        """Of each distinct chunk: head text, settled ids, tail text (no settled position: None)."""
        got = {c: self.chunks.get(c, False) for c in chunks}
        new = [c for c, held in got.items() if held is False]
        heads, middles, tails = [], [], []
        for c in new:
            first, *units = SETTLED.split(c)
            heads.append(first if units else None)
            tails.append(" " + units.pop() if units else None)
            middles.append(units)
        for c, head, ids, tail in zip(new, heads, self._encode_units(middles), tails):
            got[c] = None if head is None else (head, ids, tail)
            self.chunks.put(c, got[c], len(ids))
        return got

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text, exactly as encoding it whole gives them."""
        cut = []
        for t in texts:
            data = t.encode("utf-8", "surrogatepass")
            edges = [0, *cut_points(data), len(data)]
            cut.append([data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(edges, edges[1:])] if data else [])
        known = self._learn([c for parts in cut for c in parts])
        plans: list[list] = []
        for parts in cut:
            plan: list = []
            window = ""
            for c in parts:
                if known[c] is None:  # no settled position: the window goes on
                    window += c
                    continue
                head, ids, tail = known[c]
                plan += [window + head, ids]
                window = tail
            plans.append([*plan, window])
        # Windows at joins, encoded again; a window after a text's start begins with a space.
        windows = list({w for plan in plans for w in plan[::2]})
        fresh = dict(zip(windows, self._ids(windows)))
        return [np.frombuffer(b"".join([fresh[p] if isinstance(p, str) else p for p in plan]), np.uint32)
                for plan in plans]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.bytes_of[i] for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _id_bytes(tokenizer_file: str) -> dict[int, bytes]:
    """Id to bytes: vocabulary entries spell bytes in the byte-level alphabet, added tokens
    are plain text."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in plain}
    alphabet |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    table = {i: bytes(alphabet[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    return table | {a["id"]: a["content"].encode() for a in spec["added_tokens"]}


@lru_cache(maxsize=1)
def _coder(tokenizer_file: str) -> ChunkCoder:
    """One coder per Python worker, so that its memo lasts over the worker's tasks; one thread,
    as the cluster gives a task one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkCoder(tokenizer_file)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """``doc_id`` and texts of slices of a batch, ``RUN_BYTES`` of text each at most (a longer text is alone): only one
    slice's texts are Python objects at a time."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    first = 0
    while first < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(size[first:], dtype=np.int64), RUN_BYTES, "right")))
        run = batch.slice(first, n)
        yield run.column("doc_id"), [t or "" for t in run.column("text").to_pylist()]
        first += n


def encode(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """One row per input row: ``doc_id, ids array<int>, decoded string``.

    Null and empty texts have no ids and decode to the empty string; repeated rows are encoded
    alike; an empty table gives an empty result; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer_file)
        for b in batches:
            for doc_id, texts in _runs(b):
                ids = coder.encode(texts)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [doc_id, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).view(np.int32))),
                     pa.array([coder.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """``encode`` reduced in the task to ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer_file)
        for b in batches:
            for doc_id, texts in _runs(b):
                ids = coder.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [doc_id, pa.array([len(i) for i in ids], pa.int64()),
                     pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]),
                     pa.array([hashlib.sha256(coder.decode(i).encode("utf-8")).hexdigest() for i in ids])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return columns(docs, doc_id="long", text="string").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
