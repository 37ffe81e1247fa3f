"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shiftcast.llm import spelling

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def expected_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def expected_forms(n):
    """Words that share a pattern with one letter open, or one the other without a letter."""
    patterns = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            patterns[k, w[:k], w[k + 1 :]].add(w)
    near = defaultdict(set)
    for met in patterns.values():
        for w in met:
            near[w] |= met - {w}
    for w in n:
        for k in range(len(w)):
            if (shorter := w[:k] + w[k + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found_rows(df):
    rows = df.collect()
    found = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_equals_brute_force(spark):
    from shiftcast.llm.registry import llm_queries

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    expected = expected_forms(expected_words([(d[0], d[1]) for d in docs]))
    assert found_rows(llm_queries()["op13_spelling_variants"](spark, SF_DIR)) == expected and len(expected) > 100


def invented():
    rng = random.Random(3)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 7))) for _ in range(250)]
    stems += ["Banana", "banana", "bananas", "ananas", "a" * 300, "a" * 299, "ÀÉÎõü×÷", "àÉÎõü×÷"]
    rows = []
    for k, stem in enumerate(stems):
        rows += [(k % 40, f"{stem},{stem} 1{stem}_{stem}ß! {stem}")] * rng.choice([1, 1, 2, 9])
    return rows + [(None, None), (1, ""), (None, "nobody nobody nobody nobody nobody"), (2, "x" * 20_000 + " " + "short " * 9)]


@pytest.mark.parametrize("cell_words, leaf_words", [(8_000, 24), (20, 2), (1, 1)])
def test_edges_equal_brute_force(spark, monkeypatch, cell_words, leaf_words):
    """Many words of few letters, so that ranges cross cells, and letter counts repeat."""
    monkeypatch.setattr(spelling, "CELL_WORDS", cell_words)
    monkeypatch.setattr(spelling, "LEAF_WORDS", leaf_words)
    rows = invented()
    docs = spark.createDataFrame([(*r, "?", 0, "?") for r in rows], "doc_id long, text string, word string, n long, form string")
    expected = expected_forms(expected_words(rows))
    assert found_rows(spelling.spelling_forms(docs)) == expected
    assert any(e[1] for e in expected) and max(e[4] for e in expected) > 3
    if cell_words == 20:
        assert found_rows(spelling.spelling_forms(docs.where("false"))) == set()


def test_chain_of_forms_ends_at_its_root(spark):
    words = ["abcdef", "abcdeg", "abcdhg", "abckhg", "ablkhg", "amlkhg"]
    text = " ".join(w for k, w in enumerate(words) for _ in range(5 ** (k + 1)))
    found = {r["word"]: r["root"] for r in spelling.spelling_forms(spark.createDataFrame([(7, text)], "doc_id long, text string")).collect()}
    assert found["abcdef"] == found["ablkhg"] == "amlkhg"


def test_tree_reaches_all_within_range():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcd"), 7)) for _ in range(400)]
    cell = spelling.Cell(words := sorted(set(words)), [1] * len(set(words)))
    found = dict(zip(*cell.search(words)[["word", "n_near"]].to_numpy().T))
    for w in words:
        assert found.get(w, 0) == sum(sum(a != b for a, b in zip(w, v)) == 1 for v in words)
