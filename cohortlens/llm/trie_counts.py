"""Token counts by a unigram model: a trie of distinct pre-tokens with shared forward scores.

A pre-token is a maximal run of non-space characters with the word mark before it, as the
vocabulary's pieces have it. Its best segmentation into pieces maximises the sum of the pieces'
scores (forward dynamic programming over its prefixes). Distinct pre-tokens are inserted in a
trie; a node is a prefix and carries its best score and number of pieces, computed once from
the nodes above it however many pre-tokens share the prefix. A pre-token's terminal node stores
its count, and a document's count is the sum over its pre-tokens.

The trie is visited in sorted order, so only the path to the current node is held (the nodes of
finished branches are never asked again); terminal counts are kept in a memo bounded in bytes
that lasts over a Python worker's tasks. Documents need no shuffle: each task inserts the
distinct pre-tokens of its batches.

Scores: the vocabulary file is public and fixed; its pieces are ordered by rank, and a piece's
score is -ln(rank + 1), the log-probability of a Zipf unigram up to a constant. A character that no
piece covers costs ``BYTE_SCORE`` and one token for each of its UTF-8 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from cohortlens.llm.common import Memo, columns, text_batches

MARK = "▁"
BYTE_SCORE = -20.0
MEMO_BYTES = 96 << 20


def piece_scores(model_file: str) -> dict[str, float]:
    """Piece to score from a sentencepiece model; control, unknown and byte pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {p: -math.log(r + 1) for r, p in enumerate(pieces, 1)}


def trie_counts(words: Iterable[str], scores: dict[str, float]) -> Iterator[tuple[str, int]]:
    """``(word, pieces of its best segmentation)`` for distinct words, in sorted order.

    Equal sums: the segmentation with fewer pieces counts."""
    longest = max(map(len, scores), default=0)
    path = ""  # the marked word whose nodes are held
    best, pieces = [0.0], [0]  # of its prefixes, by length
    for word in sorted(words):
        marked = MARK + word
        shared, most = 0, min(len(path), len(marked))
        while shared < most and path[shared] == marked[shared]:
            shared += 1
        del best[shared + 1:], pieces[shared + 1:]
        for end in range(shared + 1, len(marked) + 1):
            n_bytes = len(marked[end - 1].encode("utf-8", "surrogatepass"))
            top = (best[end - 1] + BYTE_SCORE * n_bytes, -(pieces[end - 1] + n_bytes))
            for start in range(max(0, end - longest), end):
                score = scores.get(marked[start:end])
                if score is not None:
                    top = max(top, (best[start] + score, -(pieces[start] + 1)))
            best.append(top[0])
            pieces.append(-top[1])
        path = marked
        yield word, pieces[-1]


@lru_cache(maxsize=1)
def _model(model_file: str) -> tuple[dict[str, float], Memo]:
    return piece_scores(model_file), Memo(MEMO_BYTES)


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """One row per input row: ``doc_id, n_pretokens, n_tokens``.

    Pre-tokens lie between Unicode white space. Null, empty and blank texts count zero; repeated
    rows count alike; an empty table gives an empty result; extra columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores, memo = _model(model_file)
        for f in frames:
            n_words, n_tokens = [], []
            for texts in text_batches([t or "" for t in f["text"]]):
                split = [t.split() for t in texts]
                terminal = {w: memo.get(w) for w in set().union(*split)}
                for word, n in trie_counts([w for w, n in terminal.items() if n is None], scores):
                    terminal[word] = n
                    memo.put(word, n, 0)
                n_words += map(len, split)
                n_tokens += [sum(map(terminal.__getitem__, words)) for words in split]
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_pretokens": n_words, "n_tokens": n_tokens})

    return columns(docs, doc_id="long", text="string").mapInPandas(run, "doc_id long, n_pretokens long, n_tokens long")
