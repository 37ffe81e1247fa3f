"""Spelling variants: words one edit apart, found with k-d trees over letter counts.

One inserted, deleted or replaced letter moves the vector of a word's letter counts by an
L1 distance of at most two: up by one in a letter, down by one in another, or one of both.
So a word looks for its neighbours among the words of its own length and of one letter
less or more, each pair of lengths a range search in a k-d tree that prunes boxes further
away. What the counts let through is verified letter by letter.

The words of a length are cut into cells by the upper levels of its tree, whose split
planes come from a bounded sample of words. A word goes as data to its one cell and as a
query to all cells that its range touches; inside a cell a tree over all its words takes
the search on. Cells hold a bounded number of words and meet the queries as a stream, and
each query brings back one row per cell: how many near words, and the one of largest count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persist_to_shared
from .batches import map_frames
from .common import documents, query, text_of

# The letters of a word; its shortest length and fewest occurrences; one run in so many
# loses a letter; a form occurs so many times as often as its variant.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, FEWEST, DROP_ONE_IN, TIMES = 6, 5, 199, 5

#: Words of a cell, and letters of a cell of very long words.
CELL_WORDS, CELL_LETTERS = 8_000, 4_000_000
#: Words that the split planes of the upper levels are taken from.
SAMPLE_WORDS = 100_000
#: Words of a leaf inside a cell, and numbers compared at once.
LEAF_WORDS, NUMBERS_AT_ONCE = 24, 4_000_000
#: Words that go to Python at once.
WORDS_AT_ONCE = 5_000


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of all whole texts; see ``spelling_forms``."""
    lower = F.translate(text_of(text_col), UPPER, LOWER)
    # A run too short for a word never gives one, so only longer ones are taken out of the text.
    runs = F.regexp_extract_all(lower, F.lit(f"[{LETTERS}]{{{SHORTEST},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    at = (h % F.length("run")).cast("int")
    without = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    word = F.when(F.col("h") % DROP_ONE_IN == 0, without).otherwise(F.col("run"))
    words = found.select("run", h.alias("h"), at.alias("at")).select(word.alias("word"))
    counted = words.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= FEWEST)


# --- words as arrays -------------------------------------------------------------------


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of their letters."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """How often each of the 256 letters stands in each word."""
    rows = np.repeat(np.arange(len(letters)) << 8, letters.shape[1])
    counts = np.bincount(rows + letters.ravel(), minlength=len(letters) << 8)
    return counts.reshape(len(letters), 256).astype(np.int8 if letters.shape[1] < 64 else np.int32)


def best_plane(counts: np.ndarray) -> tuple[int, int] | None:
    """(letter, t) such that as near to half of the words as possible have more than t of it."""
    middle = np.median(counts, axis=0).astype(np.int64)
    best = (0.0, None)
    for t in (middle, middle - 1):
        share = (counts > t).mean(axis=0)
        balance = np.minimum(share, 1 - share)
        j = int(balance.argmax())
        if balance[j] > best[0]:
            best = (float(balance[j]), (j, int(t[j])))
    return best[1]


class Node:
    """A node of a k-d tree; ``leaf`` is what a leaf holds, None elsewhere.

    ``low`` and ``high`` bound the node's box in the letter that divides it.
    """

    __slots__ = ("letter", "t", "low", "high", "left", "right", "leaf")

    def __init__(self, leaf=None) -> None:
        self.leaf = leaf


#: The box of a whole tree, per letter: no bounds.
LOW, HIGH = -(1 << 30), 1 << 30


def build(counts: np.ndarray, rows: np.ndarray, divide, box: dict | None = None) -> Node:
    """``divide(rows)`` gives a leaf's content, or None where the rows are to be divided."""
    box = box or {}
    content = divide(rows)
    plane = best_plane(counts[rows]) if content is None else None
    if plane is None:
        return Node(rows if content is None else content)
    node = Node()
    node.letter, node.t = j, t = plane
    node.low, node.high = box.get(j, (LOW, HIGH))
    more = counts[rows, j] > t
    node.left = build(counts, rows[~more], divide, box | {j: (node.low, t)})
    node.right = build(counts, rows[more], divide, box | {j: (t + 1, node.high)})
    return node


def reach(root: Node, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, object]]:
    """(queries, leaf) for each leaf whose box some queries can reach by at most ``up`` letters
    more and ``down`` letters less. All queries go down the tree together."""
    none = np.zeros(len(counts), np.int8)
    stack = [(root, np.arange(len(counts)), none, none)]
    while stack:
        node, idx, ups, downs = stack.pop()
        if not len(idx):
            continue
        if node.leaf is not None:
            yield idx, node.leaf
            continue
        q = counts[idx, node.letter].astype(np.int64)
        ups_right = ups + np.maximum(0, node.t + 1 - q) - np.maximum(0, node.low - q)
        downs_left = downs + np.maximum(0, q - node.t) - np.maximum(0, q - node.high)
        right, left = ups_right <= up, downs_left <= down
        stack.append((node.right, idx[right], ups_right[right], downs[right]))
        stack.append((node.left, idx[left], ups[left], downs_left[left]))


def one_edit(long: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Which rows differ by exactly one replaced letter, or by one that only ``long`` has."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (long != short).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(long[:, :n] == short, axis=1)
    behind = np.logical_and.accumulate((long[:, 1:] == short)[:, ::-1], axis=1)
    return ahead.sum(axis=1) + behind.sum(axis=1) >= n


def near_pairs(tree: Node, data, data_counts, queries, query_counts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, word of the data) that are one edit apart."""
    longer = data.shape[1] - queries.shape[1]
    up, down = int(longer >= 0), int(longer <= 0)
    for idx, leaf in reach(tree, query_counts, up, down):
        step = max(1, NUMBERS_AT_ONCE // max(1, len(leaf) * query_counts.shape[1]))
        for k in range(0, len(idx), step):
            some = idx[k : k + step]
            apart = np.abs(query_counts[some][:, None, :] - data_counts[leaf][None, :, :]).sum(axis=2, dtype=np.int64)
            i, j = np.nonzero(apart == up + down)
            i, j = some[i], leaf[j]
            at_once = max(1, NUMBERS_AT_ONCE // data.shape[1])
            for m in range(0, len(i), at_once):
                a, b = i[m : m + at_once], j[m : m + at_once]
                x, y = queries[a], data[b]
                good = one_edit(y, x) if longer >= 0 else one_edit(x, y)
                yield a[good], b[good]


# --- cells -----------------------------------------------------------------------------


def cell_limit(length: int) -> int:
    return max(1, min(CELL_WORDS, CELL_LETTERS // length))


def plan_cells(words: DataFrame) -> dict[int, Node]:
    """Upper levels of the trees of those lengths that need more than one cell.

    A leaf holds (first cell, number of cells): words whose letter counts no plane divides
    share several cells by a hash, and queries go to all of them. There is one entry for
    ``CELL_WORDS`` words and at most SAMPLE_WORDS words come to the driver.
    """
    length = F.length("word")
    sizes = words.groupBy(length.alias("length")).agg(F.count("*").alias("n"))
    limit = F.greatest(F.lit(1), F.least(F.lit(CELL_WORDS), F.floor(CELL_LETTERS / F.col("length"))))
    sizes = sizes.where(F.col("n") > limit)
    sizes = {r["length"]: r["n"] for r in sizes.collect()}
    if not sizes:
        return {}
    one_in = max(1, sum(sizes.values()) // SAMPLE_WORDS)
    chosen = words.where(length.isin(list(sizes)) & (F.pmod(F.xxhash64("word"), F.lit(one_in)) == 0))
    sample: dict[int, list[str]] = {}
    for r in chosen.select("word").limit(2 * SAMPLE_WORDS).collect():
        sample.setdefault(len(r["word"]), []).append(r["word"])
    return {n: _upper_levels(sample.get(n, []), n, size) for n, size in sizes.items()}


def _upper_levels(sample: list[str], length: int, size: int) -> Node:
    each = size / max(1, len(sample))
    used = 0

    def divide(rows: np.ndarray):
        nonlocal used
        wanted = len(rows) * each
        small = wanted <= cell_limit(length)
        if not small and len(rows) > 1 and best_plane(counts[rows]) is not None:
            return None
        cells = max(1, int(np.ceil(wanted / cell_limit(length))))
        used += cells
        return used - cells, cells

    if not sample:
        return Node((0, int(np.ceil(size / cell_limit(length)))))
    counts = letter_counts(letters_of(sample))
    return build(counts, np.arange(len(sample)), divide)


def _route(frames: Iterator[pd.DataFrame], trees: dict[int, Node]) -> Iterator[pd.DataFrame]:
    """Each word as data to its cell and as a query to the cells it can reach."""
    whole = Node((0, 1))
    for frame in frames:
        for length, rows in frame.groupby(frame["word"].str.len()):
            words, n = rows["word"].tolist(), rows["n"].to_numpy()
            counts = letter_counts(letters_of(words))
            salt = np.array([hash_of(w) for w in words])
            for is_query, target, up, down in (
                (False, length, 0, 0),
                (True, length - 1, 0, 1),
                (True, length, 1, 1),
                (True, length + 1, 1, 0),
            ):
                for idx, (first, cells) in reach(trees.get(target, whole), counts, up, down):
                    for k in range(cells):
                        some = idx if is_query else idx[salt[idx] % cells == k]
                        if len(some):
                            yield pd.DataFrame(
                                {
                                    "length": np.full(len(some), target, np.int32),
                                    "cell": np.full(len(some), first + k, np.int32),
                                    "is_query": is_query,
                                    "word": [words[i] for i in some],
                                    "n": n[some],
                                }
                            )


def hash_of(word: str) -> int:
    """The same in all processes, unlike Python's own."""
    return reduce(lambda h, c: (h * 31 + c) & 0xFFFFFFFF, word.encode("latin-1"), 7)


class Cell:
    """The words of a cell, which queries of three lengths meet."""

    def __init__(self, words: list[str], n: list[int]) -> None:
        order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
        self.words = [words[k] for k in order]  # the form of a query comes first among its near words
        self.n = np.array([n[k] for k in order])
        self.letters = letters_of(self.words)
        counts = letter_counts(self.letters)
        self.columns = np.flatnonzero(counts.any(axis=0))
        self.counts = counts[:, self.columns]
        leaf = lambda rows: rows if len(rows) <= LEAF_WORDS else None
        self.tree = build(self.counts, np.arange(len(words)), leaf)

    def search(self, words: list[str]) -> pd.DataFrame:
        """Queries of one length: (word, n_near, form, form_n) of those with near words here."""
        letters = letters_of(words)
        all_counts = letter_counts(letters)
        counts = all_counts[:, self.columns]
        # Letters that no word of the cell has count together, in a column of their own.
        other = all_counts.sum(axis=1, dtype=np.int64) - counts.sum(axis=1, dtype=np.int64)
        few = np.flatnonzero(other <= 1)
        counts = np.column_stack([counts[few], other[few]]).astype(counts.dtype)
        data_counts = np.column_stack([self.counts, np.zeros(len(self.words), self.counts.dtype)])
        near = np.zeros(len(few), np.int64)
        first = np.full(len(few), len(self.words))
        for i, j in near_pairs(self.tree, self.letters, data_counts, letters[few], counts):
            np.add.at(near, i, 1)
            np.minimum.at(first, i, j)
        found = np.flatnonzero(near)
        return pd.DataFrame(
            {
                "word": [words[k] for k in few[found]],
                "n_near": near[found],
                "form": [self.words[k] for k in first[found]],
                "form_n": self.n[first[found]],
            }
        )


def _search_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of (length, cell, is_query): a cell's words, then its queries."""
    at, words, n, cell = None, [], [], None
    for frame in frames:
        for key, rows in frame.groupby(["length", "cell"], sort=True):
            if key != at:
                at, words, n, cell = key, [], [], None
            data = rows[~rows["is_query"]]
            words += data["word"].tolist()
            n += data["n"].tolist()
            asking = rows.loc[rows["is_query"], "word"]
            if not len(asking) or not words:
                continue
            cell = cell or Cell(words, n)
            for _, some in asking.groupby(asking.str.len()):
                if len(found := cell.search(some.tolist())):
                    yield found


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near words; ``form`` is the near
    word of largest n, of equal ones the smallest in code-point order."""
    trees = plan_cells(words)
    schema = "length int, cell int, is_query boolean, word string, n long"
    routed = map_frames(words, lambda frames: _route(frames, trees), schema, WORDS_AT_ONCE)
    # A fixed number of partitions: the rows are few bytes and much work.
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.count() // CELL_WORDS)
    cells = routed.repartition(tasks, "length", "cell").sortWithinPartitions("length", "cell", "is_query")
    found = map_frames(cells, _search_cells, "word string, n_near long, form string, form_n long", WORDS_AT_ONCE)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    whole = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return whole.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Runs of letters are taken from whole texts and lower-cased from A to Z; one run in
    DROP_ONE_IN, by a hash of doc_id and run, loses a letter. Words are what has SHORTEST
    letters and FEWEST occurrences. Near words differ by one edit; the form of a word is its
    near word of largest n (ties: the smallest) if that is TIMES its own n, else null.
    ``root`` is where the forms end; ``n_near`` is 0 and ``form_n`` null where there is none.

    A null text has no words, a null doc_id hashes as an empty one, repeated rows count
    again. Further columns are ignored, an empty table gives an empty result.
    """
    words = persist_to_shared(count_words(docs, id_col, text_col), "words")
    near = words.join(near_words(words), "word", "left")
    is_form = F.col("form_n") >= TIMES * F.col("n")
    forms = persist_to_shared(
        near.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("form")).alias("form"),
            F.when(is_form, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return forms.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) by doubling: n grows along the forms, so there are no cycles and few steps.

    A word is the form of a bounded number of words, so no join key is hot."""
    links = persist_to_shared(links, "roots")
    while True:
        next_ones = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = persist_to_shared(
            links.join(next_ones, "root", "left").select(
                "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")
            ),
            "roots",
        )
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


@query("op13_spelling_variants")
def op13(spark, sf_dir):
    return spelling_forms(documents(spark, sf_dir))
