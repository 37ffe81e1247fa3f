"""Token counts under a unigram model, by dynamic programming over a trie.

The most likely segmentation of a prefix depends on its own prefixes only. So the
distinct pre-tokens of a chunk are put into a trie, the best score and its number of
tokens are computed once per node for all words that share the prefix, and the count
at each terminal node is kept as that of the word. Visiting the words in order is the
depth-first traversal of that trie; only the current path is held.

Map only: no shuffle, and each task holds one chunk of documents and a bounded cache.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .batches import chunks, id_series, map_documents, shared_prefix
from .common import documents, query

MARK = "▁"  # stands before every word in the vocabulary
CACHED_WORDS = 400_000
#: A byte of a character outside the vocabulary is that much less likely than the last piece.
UNKNOWN_PENALTY = 10.0


def zipf_scores(vocabulary: str) -> dict[str, float]:
    """Log-probabilities of the pieces of a vocabulary file by their rank.

    The file orders its pieces by frequency without giving probabilities. They are
    taken as proportional to 1 / (rank + 1); nothing is trained.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    plain = [
        i
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    plain.sort(key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1 / (r + 1) for r in range(len(plain))))
    return {model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(plain)}


class TrieCounter:
    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores))
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.counts: dict[str, int] = {}

    def extend(self, word: str, k: int, path: list[tuple[float, int]]) -> tuple[float, int]:
        """Best score of the first k characters and minus its tokens; ties: fewer tokens."""
        scores = self.scores
        best = None
        for start in range(max(0, k - self.longest), k):
            score = scores.get(word[start:k])
            if score is not None:
                before = path[start]
                found = (before[0] + score, before[1] - 1)
                if best is None or found > best:
                    best = found
        if word[k - 1] not in scores:
            n = len(word[k - 1].encode())
            found = (path[k - 1][0] + n * self.unknown, path[k - 1][1] - n)
            if best is None or found > best:
                best = found
        return best

    def learn(self, words: set[str]) -> None:
        before, path = "", [(0.0, 0)]
        for word in sorted(words):
            marked = MARK + word
            del path[min(shared_prefix(before, marked), len(path) - 1) + 1 :]
            for k in range(len(path), len(marked) + 1):
                path.append(self.extend(marked, k, path))
            self.counts[word] = -path[-1][1]
            before = marked

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """Words and tokens of each text."""
        if len(self.counts) > CACHED_WORDS:
            self.counts.clear()
        counts = self.counts
        split = [t.split() for t in texts]
        self.learn({w for words in split for w in words if w not in counts})
        return [(len(words), sum(map(counts.__getitem__, words))) for words in split]


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens.

    Pre-tokens are the runs without white space, each with the mark of a word start.
    A character outside the vocabulary counts as its UTF-8 bytes. A null or empty text
    has zero of both. Repeated rows stay repeated; an empty table gives an empty
    result. The vocabulary file must be readable on every executor.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TrieCounter(zipf_scores(vocabulary))
        for doc_ids, texts in chunks(frames):
            found = counter.count(texts)
            yield pd.DataFrame(
                {
                    "doc_id": id_series(doc_ids),
                    "n_words": [f[0] for f in found],
                    "n_tokens": [f[1] for f in found],
                }
            )

    return map_documents(docs, work, "doc_id long, n_words long, n_tokens long", id_col, text_col)


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op10_token_counts")
def op10(spark, sf_dir):
    return count_tokens(documents(spark, sf_dir), piece_vocabulary())
