"""Tokenizer alignment against brute force, with the libraries' own encoders."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shiftcast.llm import alignment
from shiftcast.llm.bpe import byte_symbols

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, spill long, number long, counts string, radix int"


def brute_force(texts):
    """Rows of (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), by position."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    value = {c: k for k, c in byte_symbols().items()}
    links, shown = [], []
    for text in texts:
        tokens_a, tokens_b = [], []
        if text:
            for k in a.encode(" " + text, add_special_tokens=False).ids:
                tokens_a.append((k, bytes(value[c] for c in a.id_to_token(k))))
            for k in b.encode(text):
                piece = b.id_to_piece(k)
                tokens_b.append((k, bytes([int(piece[3:5], 16)]) if b.is_byte(k) else piece.replace("▁", " ").encode()))
            raw = (" " + text).encode()
            if b"".join(t for _, t in tokens_a) != raw or b"".join(t for _, t in tokens_b) != raw:
                tokens_a, tokens_b = [], []
        ends = [list(np.cumsum([len(t) for _, t in side], dtype=int)) for side in (tokens_a, tokens_b)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in both]
        for s, side in enumerate((tokens_a, tokens_b)):
            for (k, _), end in zip(side, ends[s]):
                groups[int(np.searchsorted(both, end))][s].append(k)
        links.append(Counter((x, y) for p, q in groups for x in p for y in q))
        line = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        digest = hashlib.sha256(line.encode()).hexdigest() if groups else ""
        shown.append((len(tokens_a), len(tokens_b), len(groups), sum(links[-1].values()), digest))
    count = Counter(pair for found in links for pair in found)
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    return [
        (*s[:4], sum(n for p, n in f.items() if count[p] == highest[p[0]]), sum(n * count[p] for p, n in f.items()), s[4])
        for s, f in zip(shown, links)
    ]


def found_rows(df):
    return [
        (r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
        for r in df.collect()
    ]


def expected_rows(ids, texts):
    return sorted(((i, *row) for i, row in zip(ids, brute_force(texts))), key=repr)


def test_query_equals_brute_force(spark):
    from shiftcast.llm.registry import llm_queries

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    found = found_rows(llm_queries()["op12_tokenizer_alignment"](spark, SF_DIR))
    assert sorted(found, key=repr) == expected_rows([d[0] for d in docs], [d[1] for d in docs])


ROWS = [
    (1, "the cat sat on the mat"),
    (2, "the cat sat on the mat"),
    (2, "the cat sat on the mat"),  # the row again
    (None, "the dog"),
    (3, None),
    (4, ""),
    (5, " "),
    (6, "two  spaces\tand a tab\n\nand lines "),
    (7, "ﬁne ligature and <|endoftext|> </s> <s> <unk> <0x41>"),
    (8, "日本語 text 🙂🙂 Ωmega naïve"),
    (9, "x" * 30_000),
    (10, "1234567890" * 50 + "🙂" * 400),
    (11, "\u0000 nul"),
]


@pytest.mark.parametrize("spill_records, radixes", [(10, 3), (10_000_000, 64)])
def test_edges_equal_brute_force(spark, spill_records, radixes):
    docs = spark.createDataFrame([(*r, 0, 0, "?", 0) for r in ROWS], SCHEMA).repartition(3)
    found = alignment.align_documents(
        docs, *alignment.production_tokenizers(), radixes=radixes, spill_records=spill_records
    )
    assert sorted(found_rows(found), key=repr) == expected_rows([r[0] for r in ROWS], [r[1] for r in ROWS])
    nothing = alignment.align_documents(docs.where("false"), *alignment.production_tokenizers())
    assert nothing.collect() == []


def test_large_groups_multiply_distinct_ids(monkeypatch):
    """Groups beyond the slice, and many slices, give the same records."""
    t = alignment.tables(*alignment.production_tokenizers())
    texts = [r[1] for r in ROWS if r[1]]
    whole = alignment.align(t, texts, 5)
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", 3)
    cut = alignment.align(t, texts, 5)
    assert (whole.keys == cut.keys).all() and (whole.links == cut.links).all()
    assert (np.diff(whole.keys) > 0).all() and whole.links.sum() == whole.frame["n_links"].sum()


def test_merge_counts_across_runs():
    """Each run gets the totals of its own pairs; the highest count of a side is marked, ties too."""
    bits = 4
    runs = [{(1, 2): 3, (1, 3): 1, (7, 0): 2}, {(1, 3): 2, (2, 2): 5}, {(1, 2): 1, (1, 4): 4}]
    packed = []
    for run in runs:
        keys = np.array([a << bits | b for a, b in run])
        packed.append(alignment.pack(np.diff(keys, prepend=0), np.array(list(run.values()))))
    back = [[x.tolist() for x in alignment.unpack(f)] for f in alignment.merge_runs(packed, bits)]
    assert back == [[[4, 3, 2], [1, 0, 1]], [[3, 5], [0, 1]], [[4, 4], [1, 1]]]
