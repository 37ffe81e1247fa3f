"""BPE encoding and decoding of words by a traversal of their prefix trie.

The encoding of a prefix is known by its last token alone: the rest is the encoding
of the shorter prefix before that token. A token may follow a prefix if the last
token of the prefix and the token itself stay apart when the two are merged alone.
So the distinct words of a chunk are put into a trie and each node gets its last
token from its ancestors' states, once for all words that share the prefix. Visiting
the words in order is the depth-first traversal of that trie; only the states on the
path to the current node are held. What distinguishes the end of a word (its last
symbol carries the end mark) is a leaf of its own under the node of the prefix.

This needs merges that make each token in one way and in an order in which no merge
precedes those of its parts; the constructor checks both.

Map only: no shuffle, and each task holds one chunk of documents and bounded caches.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import chunks, id_series, map_documents, shared_prefix
from .common import documents, query

END = "</w>"
# White space and the splitting pattern of the vocabulary's tokenizer.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
NOT_SPACE = re.compile(rf"[^{SPACE}]+")
#: These split in Python, but are no white space to the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")

CACHED_PAIRS = 2_000_000
CACHED_WORDS = 500_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class TrieEncoder:
    """Encodes sets of words; ``vocabulary`` is the path of a tokenizer file with word ends."""

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.halves = pairs
        self.ranks = {pair: k for k, pair in enumerate(pairs)}
        self.made = made = {a + b: k for k, (a, b) in enumerate(pairs)}
        if len(made) != len(pairs) or any(max(made.get(a, -1), made.get(b, -1)) > k for k, (a, b) in enumerate(pairs)):
            raise ValueError("the merges make a token in two ways or before its parts")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.plain = {t: i for t, i in self.ids.items() if not t.endswith(END)}
        self.final = {t.removesuffix(END): i for t, i in self.ids.items() if t.endswith(END)}
        self.longest = max(map(len, [*self.plain, *self.final]))
        self.token = dict(zip(self.ids.values(), self.ids))
        self.number = {i: str(i) for i in self.token}
        self.size = {i: len(t.removesuffix(END)) for i, t in self.token.items()}
        self.bytes = byte_symbols()
        self.apart: dict[int, bool] = {}  # by left * 2^32 + right
        self.words: dict[str, tuple[int, str, str]] = {}
        self.pieces: dict[str, tuple[int, str, str]] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether both tokens stay whole when they stand side by side.

        Their merges are undone from the last to the first. If at some point the two
        symbols at the border have a merge that comes before the one just undone, that
        merge would have joined them. Among equal merges the leftmost comes first.
        """
        x, y, before = self.token[left], self.token[right], len(self.ranks)
        while self.ranks.get((x, y), before) >= before:
            a, b = self.made.get(x, -1), self.made.get(y, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                before, x = a, self.halves[a][1]
            else:
                before, y = b + 1, self.halves[b][0]
        return False

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Tokens of each word (in byte symbols), by depth-first traversal of their trie."""
        plain, size, apart, longest = self.plain.get, self.size, self.apart, self.longest
        if len(apart) > CACHED_PAIRS:
            apart.clear()

        def last_token(word: str, k: int, known) -> int:
            """The last token of the first k symbols; last[j] is that of the first j."""
            for start in range(max(0, k - longest), k):
                right = known(word[start:k])
                if right is not None:
                    if not start:
                        return right
                    pair = last[start] << 32 | right
                    fits = apart.get(pair)
                    if fits is None:
                        fits = apart[pair] = self.may_follow(last[start], right)
                    if fits:
                        return right
            raise ValueError(f"no token for {word!r}")

        out, before, last = {}, "", [-1]
        for word in sorted(words):
            n = len(word)
            del last[min(shared_prefix(before, word), len(last) - 1) + 1 :]
            for k in range(len(last), n):
                last.append(last_token(word, k, plain))
            tokens = [last_token(word, n, self.final.get)]
            k = n - size[tokens[0]]
            while k:
                tokens.append(last[k])
                k -= size[last[k]]
            tokens.reverse()
            out[word] = tokens
            before = word
        return out

    def learn(self, wanted: set[str]) -> None:
        """Adds (number of tokens, ids, tokens) of white-space separated words."""
        pieces = {}
        for word in wanted:
            low = word.replace("Σ", "σ").lower()  # no final sigma: each character alone
            pieces[word] = [low] if low.isalpha() else PIECES.findall(low)
        known = self.pieces
        symbols = {p: self.as_symbols(p) for found in pieces.values() for p in found if p not in known}
        encoded = self.encode_words(set(symbols.values()))
        number, token = self.number.__getitem__, self.token.__getitem__
        for piece, word in symbols.items():
            tokens = encoded[word]
            known[piece] = (len(tokens), " ".join(map(number, tokens)), " ".join(map(token, tokens)))
        for word, found in pieces.items():
            if len(found) == 1:
                self.words[word] = known[found[0]]
            else:
                counts, ids, tokens = zip(*map(known.__getitem__, found))
                self.words[word] = (sum(counts), " ".join(ids), " ".join(tokens))

    def as_symbols(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece
        return piece.encode().decode("latin-1").translate(self.bytes)

    def split(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        out = []
        parts = self.split_special.split(text) if "<|" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(part)
                continue
            part = unicodedata.normalize("NFC", part)
            out += NOT_SPACE.findall(part) if SEPARATORS.search(part) else part.split()
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of tokens, ids and decoded text of each text."""
        split = [self.split(t) for t in texts]
        if len(self.words) > CACHED_WORDS:  # this chunk's words stay
            self.words = {w: self.words[w] for words in split for w in words if w in self.words}
            self.pieces = {}
        known = self.words
        self.learn({w for words in split for w in words if w not in known and w not in self.special})
        for word, number in self.special.items():
            known[word] = (1, str(number), word)
        for words in split:
            counts, ids, tokens = zip(*map(known.__getitem__, words)) if words else ((), (), ())
            yield sum(counts), " ".join(ids), " ".join(tokens)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (decimal, one space between), decoded.

    Equals the tokenizer of the file without added special tokens, truncation and
    padding; strings of special tokens in a text are those tokens, as there. A null
    or empty text has no tokens and empty strings. Repeated rows stay repeated; an
    empty table gives an empty result. The file must be readable on every executor.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = TrieEncoder(vocabulary)
        for doc_ids, texts in chunks(frames):
            found = list(encoder.encode(texts))
            yield pd.DataFrame(
                {
                    "doc_id": id_series(doc_ids),
                    "n_tokens": [f[0] for f in found],
                    "ids": [f[1] for f in found],
                    "decoded": [f[2] for f in found],
                }
            )

    return map_documents(docs, work, "doc_id long, n_tokens long, ids string, decoded string", id_col, text_col)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op7_bpe_encode_decode")
def op7(spark, sf_dir):
    return encode(documents(spark, sf_dir), word_vocabulary()).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
