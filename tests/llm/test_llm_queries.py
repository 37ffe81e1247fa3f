"""Every training-data query on the small tables: against its SQL, or against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from oracle import compare, connect
from shiftcast.llm import bpe, packing, token_counts
from shiftcast.llm.registry import llm_queries, llm_sql

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def rows(spark, name, sf_dir=SF_DIR):
    return llm_queries()[name](spark, sf_dir).collect()


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_equals_sql(spark, con, name):
    assert compare(llm_queries()[name](spark, SF_DIR), con, llm_sql()[name]) == ""


def test_entry_names_all_queries():
    import __spark_entry__ as contract

    numbers = {int(n[2:].split("_")[0]) for n in contract.queries() if re.match(r"op\d", n)}
    assert numbers == set(range(1, 14)) and "pipeline" in contract.queries()


def test_packing_is_a_round_trip(spark, texts):
    """Segments, put together by document and offset, are the tokenizer's ids."""
    found = packing.pack(spark.read.parquet(f"{SF_DIR}/documents.parquet"), *packing.byte_vocabulary(), width=256).collect()
    parts = defaultdict(dict)
    for r in found:
        line = np.frombuffer(r["ids"], "<u2")
        assert len(line) == 256 and r["cu_seqlens"][-1] == r["n_tokens"] and (line[r["n_tokens"] :] == 50256).all()
        assert r["position_resets"] == r["cu_seqlens"][:-1]
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            parts[doc][start] = line[a:b]
    encoder = packing.tokenizer(*packing.byte_vocabulary())
    assert parts.keys() == texts.keys()
    for doc, text in texts.items():
        ids = np.concatenate([parts[doc][s] for s in sorted(parts[doc])])
        assert ids[-1] == 50256 and encoder.decode(ids[:-1].tolist()) == text
        assert ids[:-1].tolist() == encoder.encode_ordinary(text)


def test_packing_query_names_every_document(spark, texts):
    assert {d for r in rows(spark, "op3_packed_token_ids") for d in r["doc_ids"]} == texts.keys()


def test_shards_are_near_equal_and_numbered_without_gaps(spark, texts):
    found = rows(spark, "op4_kd_tree_shards")
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    held, slots = Counter(), defaultdict(list)
    for r in found:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "bytes")
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(held) <= set(range(40))
    largest = max(r["size"] for r in found)
    assert max(held.values()) - sum(held.values()) / 40 <= largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_bpe_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.word_vocabulary())
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in rows(spark, "op7_bpe_encode_decode"):
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == digest(" ".join(map(str, ids)))
        assert r["decoded_sha256"] == digest(library.decode(ids, skip_special_tokens=False))


def shingle_sets(texts, size):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for doc, text in texts.items():
        words = WORD.findall(text.translate(lower))
        n = max(1, len(words) - size + 1)
        out[doc] = frozenset(tuple(words[k : k + size]) for k in range(n)) if words else frozenset()
    return out


def test_near_duplicates_equal_brute_force(spark, texts):
    sets = shingle_sets(texts, 2)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows(spark, "op9_minhash_near_dedup")}
    assert found == {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def test_token_counts_equal_brute_force(spark, texts):
    scores = token_counts.zipf_scores(token_counts.piece_vocabulary())
    floor = min(scores.values()) - token_counts.UNKNOWN_PENALTY
    known = {}

    def count(word):
        if word not in known:
            word_ = "▁" + word
            best = [(0.0, 0)]
            for k in range(1, len(word_) + 1):
                ways = [(best[j][0] + scores[word_[j:k]], best[j][1] - 1) for j in range(k) if word_[j:k] in scores]
                if word_[k - 1] not in scores:
                    n = len(word_[k - 1].encode())
                    ways.append((best[k - 1][0] + n * floor, best[k - 1][1] - n))
                best.append(max(ways))
            known[word] = -best[-1][1]
        return known[word]

    found = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in rows(spark, "op10_token_counts")}
    assert found == {d: (len(t.split()), sum(count(w) for w in t.split())) for d, t in texts.items()}


def test_passages_cover_every_repeated_run(spark, texts):
    """Each run of 50 words that two different texts share lies in a reported passage."""
    words = {d: t.encode().lower().split() for d, t in texts.items()}
    places = defaultdict(list)
    for d, w in words.items():
        for k in range(len(w) - 49):
            places[tuple(w[k : k + 50])].append((d, k))
    needed = {p for found in places.values() if len({d for d, _ in found}) > 1 for p in found}
    covered = defaultdict(list)
    for r in rows(spark, "op5_repeated_passages"):
        covered[r["doc_id"]].append((r["start_word"], r["end_word"]))
        covered[r["other_id"]].append((r["other_start"], r["other_end"]))
        a = words[r["doc_id"]][r["start_word"] : r["end_word"]]
        b = words[r["other_id"]][r["other_start"] : r["other_end"]]
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        assert len(a) >= 50 and len(x & y) / len(x | y) == pytest.approx(r["similarity"]) and r["similarity"] >= 0.8
    assert needed and all(any(a <= k and k + 50 <= b for a, b in covered[d]) for d, k in needed)


def test_toxicity_separates_held_out_documents(spark):
    """On unseen documents toxic ones rank higher, and few are on the wrong side."""
    sf_dir = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = rows(spark, "op2_toxicity", sf_dir)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] in toxic]
    high = [r["score"] for r in held if toxic[r["doc_id"]]]
    low = [r["score"] for r in held if not toxic[r["doc_id"]]]
    assert np.mean([a > b for a in high for b in low]) > 0.9
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held]) > 0.9
