"""Nulls, empty and very long texts, ties, repeated rows, clashing columns, empty tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shiftcast.llm import (
    bpe,
    components,
    exact_dedup,
    minhash,
    mixing,
    packing,
    passages,
    quality,
    sharding,
    token_counts,
    toxicity,
)

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "kept boolean, keep_id long, size long, bucket string, node string, tokens string, score string, group_size string"
)
RNG = random.Random(5)
PROSE = " ".join(RNG.choice("alder birch cedar elm fir hazel larch maple oak pine rowan willow".split()) + str(RNG.randint(0, 99)) for _ in range(80))
LONG = " ".join(f"w{RNG.randint(0, 5000)}" for _ in range(60_000))
ROWS = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "b"),
    (2, PROSE, "en", "b"),  # the row again
    (3, PROSE + " extra", "en", "a"),
    (4, None, None, None),
    (5, "", "en", None),
    (6, " \t\n ", "de", "a"),
    (None, "no id here", "de", "a"),
    (None, PROSE, "de", "a"),
    (7, LONG, "en", "a"),
    (8, "x" * 50_000, "en", "a"),
    (9, "one", "en", "a"),
    (9, "two words", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    full = [(*r, None, False, -1, -1, "?", "?", "?", "?", "?") for r in ROWS]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def labels(spark):
    return spark.createDataFrame([(1, 1), (3, None), (None, 1), (8, 0), (77, 1)], "doc_id long, toxic int")


WHOLE = {
    "exact": lambda d: exact_dedup.mark_copies(d),
    "exact, all digests": lambda d: exact_dedup.mark_copies(d, digest_all=True),
    "toxic": lambda d: toxicity.score(d, toxicity.fit([], [])),
    "shards": lambda d: sharding.assign(d, shards=4),
    "quality": lambda d: quality.judge(d),
    "bpe": lambda d: bpe.encode(d, bpe.word_vocabulary()),
    "near": lambda d: minhash.near_duplicates(d),
    "counts": lambda d: token_counts.count_tokens(d, token_counts.piece_vocabulary()),
}


@pytest.mark.parametrize("name", WHOLE)
def test_one_row_per_input_row(docs, none, name):
    found = WHOLE[name](docs).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in ROWS)
    assert WHOLE[name](none).collect() == []


def test_exact_copies_and_ties(docs):
    found = exact_dedup.mark_copies(docs).collect()
    prose = [r for r in found if r["group_size"] == 4]
    assert sorted((str(r["doc_id"]), r["keep_id"], r["kept"]) for r in prose) == [
        ("1", 2, False), ("2", 2, True), ("2", 2, True), ("None", 2, False)]
    assert {r["doc_id"]: r["keep_id"] for r in found if r["doc_id"] in (4, 5)} == {4: 5, 5: 5}  # null is empty
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([2, 3, 5, 6, None, 7, 8, 9, 9])


def test_near_copies(docs):
    found = minhash.near_duplicates(docs).collect()
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 2, 3)} == {1}
    assert all(r["component_id"] == r["doc_id"] and r["n_shingles"] == 0 for r in found if r["doc_id"] in (4, 5, 6))
    by_text = [(r["component_id"], r["kept"]) for r in found if r["doc_id"] is None]
    assert sorted(by_text, key=str) == [(1, False), (None, True)]


def test_leaders_and_blocks_find_what_all_pairs_find(spark):
    """A hot group in which many pairs are just below the threshold."""
    rng = random.Random(3)
    base = [f"v{k}" for k in range(60)]
    texts = []
    for _ in range(120):
        words = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3, 4, 6])):
            words[at] = f"n{rng.randint(0, 10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 2]) for k in range(59)} for t in texts]
    root = list(range(len(texts)))

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, words=2).collect()}
    assert found == {d: find(d) for d in range(len(texts))}
    assert len(set(found.values())) > 1


def test_components_of_long_chains_and_stars(spark):
    links = [(f"c{k:03}", f"c{k + 1:03}") for k in range(40)] + [("hub", f"s{k}") for k in range(30)] + [("x", "x")]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert set(found.values()) == {"c000", "hub"} and len(found) == 72


def test_bpe_long_and_special_texts():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.word_vocabulary())
    texts = ["", "  ", "I'll DON'T 123", "a<|endoftext|> b <|startoftext|", "ΟΔΟΣ Σ İ ß", "é ́x", "日本 🎉🎉!!", "a\x1cb\x85c", "ab" * 5000]
    for text, (n, ids, decoded) in zip(texts, bpe.TrieEncoder(bpe.word_vocabulary()).encode(texts)):
        right = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, right)) and n == len(right)
        assert decoded == library.decode(right, skip_special_tokens=False)


def test_packing_edges(docs, none, tmp_path):
    packed = packing.pack(docs, *packing.byte_vocabulary(), width=64)
    found = packed.collect()
    assert Counter(d for r in found for d, s in zip(r["doc_ids"], r["starts"]) if s == 0) == Counter(r[0] for r in ROWS)
    assert packing.pack(none, *packing.byte_vocabulary()).collect() == []
    packing.write_matrices(packed, str(tmp_path / "m"), rows=16, width=64)
    matrices = docs.sparkSession.read.parquet(str(tmp_path / "m")).collect()
    assert sum(r["n_rows"] for r in matrices) == len(found)
    for r in matrices:
        positions = np.frombuffer(r["position_ids"], "<u4")
        assert len(positions) == r["n_rows"] * 64 == len(r["ids"]) // 2
        assert (positions == 0).sum() >= len(r["cu_seqlens"]) - 1


def test_best_fit_equals_plain_search():
    rng = random.Random(1)
    for _ in range(100):
        width = rng.choice([1, 2, 7, 8, 50])
        lengths = [rng.randint(1, width) for _ in range(rng.randint(0, 50))]
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - n)
            else:
                rooms.append(width - n)
        used = Counter()
        for row, n in zip(packing.best_fit(lengths, width), lengths):
            used[row] += n
        assert sorted(width - u for u in used.values()) == sorted(rooms)


def test_quality_edges(docs):
    found = {(r["doc_id"], r["n_words"]): r for r in quality.judge(docs).collect()}
    assert all(found[d, 0]["base_failed"] and not found[d, 0]["kept"] for d in (4, 5, 6))
    assert found[1, 80]["kept"] and found[7, 60_000]["kept"] and found[8, 1]["word_chars"] == 50_000
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 7, None}


def test_rule_order_changes_no_verdict(docs):
    m = quality.measures("text")
    one, other = (docs.select(quality.cascade(r, m).alias("x")).collect() for r in (quality.FURTHER, quality.FURTHER[::-1]))
    assert one == other


def test_mixing_meets_budgets(spark, docs, none):
    plan = mixing.Plan({"lang": F.col("lang"), "source": F.col("source")}, {"lang": {"en": 3.0}}, max_epochs=3)
    found = mixing.select(docs, plan, total=1000).collect()
    assert abs(sum(r["taken"] for r in found) - 1000) <= 6
    assert all(0 <= r["taken"] <= r["tokens"] for r in found)
    mixed = mixing.mix(docs, plan, total=1000)
    assert mixed.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in found)
    assert mixing.select(none, plan).collect() == [] and mixing.mix(none, plan).collect() == []


def test_shortages_go_to_siblings_before_ancestors(spark):
    rows = [("p", "a", 10), ("p", "b", 1000), ("q", "c", 1000)]
    leaves = spark.createDataFrame(rows, "g string, s string, tokens long")
    plan = mixing.Plan({"g": F.col("g"), "s": F.col("s")}, {})
    shares = {r["s"]: r["budget"] for r in mixing.budgets(leaves, plan, 400.0).collect()}
    assert shares == {"a": 10, "b": 190, "c": 200}
    shares = {r["s"]: r["budget"] for r in mixing.budgets(leaves.where("s <> 'b'"), plan, 400.0).collect()}
    assert shares == {"a": 10, "c": 390}


def test_shard_counts_by_target(docs):
    found = sharding.assign(docs, target_bytes=100_000).collect()
    assert {r["shard"] for r in found} <= set(range(4)) and len(found) == len(ROWS)
    one = sharding.assign(docs, shards=1).collect()
    assert sorted(r["slot"] for r in one) == list(range(len(ROWS)))


def test_passages_edges(spark, docs, none):
    found = passages.repeated_passages(docs).collect()
    pairs = {(r["doc_id"], r["other_id"]) for r in found}
    assert (2, 1) in pairs  # a copy
    assert any({3, 1} == {a, b} for a, b in pairs)  # the text with a word more
    assert not {4, 5, 6, 8, 9} & {d for p in pairs for d in p}
    assert passages.repeated_passages(none).collect() == []


def test_passages_inside_other_text(spark):
    rng = random.Random(2)
    fill = lambda n: " ".join(f"z{rng.randint(0, 10**6)}" for _ in range(n))
    shared = " ".join(f"s{k}" for k in range(60))
    near = " ".join(f"s{k}" if k != 30 else "changed" for k in range(60))
    texts = [fill(100) + " " + shared + " " + fill(40), fill(7) + " " + shared, fill(70) + " " + near, fill(300)]
    texts += [fill(60) + " " + " ".join(f"s{k}" for k in range(20))]  # too short to be one
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = passages.repeated_passages(docs).collect()
    assert {d for r in found for d in (r["doc_id"], r["other_id"])} == {0, 1, 2}
    spot = {0: (100, 160), 1: (7, 67), 2: (70, 130)}
    for r in found:
        assert (r["start_word"], r["end_word"]) == spot[r["doc_id"]]


def test_compact_windows_hold_each_long_range_once():
    rng = np.random.default_rng(4)
    for n in (0, 3, 4, 5, 40):
        hashes = rng.integers(0, 30, n).astype(np.uint64)
        windows = passages.compact_windows(hashes, 4)
        for low in range(n):
            for high in range(low + 3, n):
                holding = [c for a, c, b in windows if a <= low <= c <= high <= b]
                assert len(holding) == 1 and hashes[holding[0]] == hashes[low : high + 1].min()


def test_passage_whose_halves_lie_apart_in_the_other_text():
    a = np.concatenate([np.arange(50), np.arange(1000, 1400), np.arange(50, 100)])
    row = type("Row", (), {})()
    row.a_shingles, row.b_shingles, row.a_at, row.b_at = a, np.arange(100), 0, 0
    row.hits = [{"f": f, "al": 0, "ar": 499, "bl": 0, "br": 99} for f in range(2)]
    found = passages.verified_passages(row, 46, 5, 80)
    assert sorted(found) == [(0, 54, 0, 54, 1.0), (50, 104, 450, 504, 1.0)]


def test_chain_equals_forward_backward():
    rng = np.random.default_rng(0)
    e, starts = rng.normal(size=150) * 3, np.array([0, 10, 11, 100])
    model = toxicity.Model(None, rng.normal(size=(2, 2)), rng.normal(size=2), None)
    right = []
    for a, b in zip(starts, [*starts[1:], 150]):
        ahead = [model.start + [0, e[a]]]
        for v in e[a + 1 : b]:
            ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + model.transitions, axis=0) + [0, v])
        behind = [np.zeros(2)]
        for v in e[a + 1 : b][::-1]:
            behind.append(np.logaddexp.reduce(model.transitions + np.array([0, v]) + behind[-1], axis=1))
        z = np.array(ahead) + np.array(behind[::-1])
        right += list(np.exp(z[:, 1] - np.logaddexp(z[:, 0], z[:, 1])))
    assert np.abs(toxicity.chain(e, starts, model) - right).max() < 1e-9


def test_toxic_spans_and_odd_labels(spark, docs):
    bad = ["calm text here and there " * 4 + "you fool now"] * 30
    good = ["calm text here and there " * 4 + "you friend now"] * 60
    model = toxicity.fit(bad + good, [1] * 30 + [0] * 60)
    text = "a fool and a Fool  FOOL"
    frame = spark.createDataFrame([(1, text), (2, "a friend")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in toxicity.score(frame, model).collect()}
    assert [text[s["start"] : s["end"]] for s in found[1]["spans"]] == ["fool", "Fool  FOOL"]
    assert found[1]["score"] >= 0.5 > found[2]["score"] and found[2]["spans"] == []
    texts, marks = toxicity.sample(docs, labels(spark), toxicity.Bounds(toxic_rows=1, clean_rows=1))
    assert len(texts) == len(marks) <= 2 and set(marks) <= {0, 1}


def test_near_copies_are_dropped_by_row(spark):
    """Another text of a dropped id, and a null id beside another null id, stay."""
    more = " ".join(f"q{k}" for k in range(60))
    other = " ".join(f"z{k}" for k in range(60))
    rows = [(1, PROSE), (None, PROSE + " word"), (None, other), (5, PROSE + " word"), (5, other.upper() + more)]
    schema = "doc_id long, text string, root string, text_key long, id string, `row` int, first int, digest string"
    docs = spark.createDataFrame([(*r, "?", 0, "?", 0, 0, "?") for r in rows], schema)
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([rows[0], rows[2], rows[4]])
    only_null = spark.createDataFrame([(None, PROSE), (None, PROSE + " word"), (3, ""), (None, None)], "doc_id long, text string")
    assert sorted(str(r["text"])[:5] for r in minhash.drop_near_copies(only_null).collect()) == ["", "None", PROSE[:5]]
    same_id = spark.createDataFrame([(4, PROSE), (4, PROSE + " word"), (4, other)], "doc_id long, text string")
    assert minhash.drop_near_copies(same_id).count() == 2
    assert minhash.drop_near_copies(docs.where("false")).collect() == []


def test_copies_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    few = [sorted(map(str, f(docs).collect())) for f in (exact_dedup.mark_copies, exact_dedup.drop_copies)]
    near = sorted(map(str, minhash.drop_near_copies(docs).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(minhash, "BROADCAST_KEYS", 0)
    assert [r["kept"] for r in exact_dedup.mark_copies(docs).collect()].count(True) == sum("kept=True" in r for r in few[0])
    assert sorted(map(str, exact_dedup.drop_copies(docs).collect())) == few[1]
    assert sorted(map(str, minhash.drop_near_copies(docs).collect())) == near


def test_full_hash_is_taken_above_the_join(spark, docs):
    """Only groups that share length and prefix are hashed."""
    plan = exact_dedup._refine(docs, "doc_id", "text", 200, False)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan.split("Join")[0] and "sha2" not in plan.split("Join")[1]


def test_pipeline_stages(spark, docs, none):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for frame in (docs.select(*columns), none.select(*columns)):
        rows = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, "")
            assert rows.columns == columns
        out = corpus_pipeline.STAGES[-1][1](spark, rows, "").collect()
    assert out == []


def test_pipeline_decisions(spark, docs):
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    left = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        rows = stage(spark, rows, "")
        left.append(sorted(str(r["doc_id"]) for r in rows.collect()))
    assert left == [["1", "2", "2", "3", "7", "None"], ["2", "3", "7"], ["2", "7"]]


def test_pipeline_run_is_its_stages_and_the_library(spark, docs, tmp_path):
    """Through run, from a folder, with clashing column names; what comes out is checked by the library."""
    from tokenizers import Tokenizer

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(bpe.word_vocabulary())
    texts = {2: PROSE, 7: LONG}
    assert {r["doc_id"] for r in out} == texts.keys()
    for r in out:
        whole = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        ids = whole[: r["n_tokens"]]  # mixing may cut the last document of a leaf after a word
        assert r["ids"] == " ".join(map(str, ids)) and ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_stages_pass_clashing_columns(spark, docs, none):
    for frame in (docs, none):
        rows = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, "")
            assert rows.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, rows, "").collect()
