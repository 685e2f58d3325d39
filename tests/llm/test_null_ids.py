"""Rows with a null id lose, link and stand for others like any row."""
import corpus_pipeline
import pytest
from test_text_operators import plain_bytes, plain_components, plain_words, prose

from rebuyflow.llm import jaccard_join, seed_dedup, suffix_dedup
from rebuyflow.llm.jaccard_join import jaccard_components
from rebuyflow.llm.seed_dedup import remove_later_repeats
from rebuyflow.llm.suffix_dedup import remove_repeats

BIG = (1 << 60) + 1
"""Beyond the whole numbers that a float holds."""


def frame(spark, ids, texts):
    return spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def shared():
    """Two null-id documents and three others share a passage; one null-id document is the exact copy of another one."""
    passage = prose(3, 90, 3000)
    texts = [prose(i, 60, 9000) + " " + passage + " " + prose(20 + i, 60, 9000) for i in range(5)]
    return [None, None, BIG, BIG + 1, BIG + 2, None, BIG + 3], [*texts, prose(40, 150, 9000), prose(40, 150, 9000)]


@pytest.mark.parametrize("most", [1, 512])
def test_repeated_bytes(spark, shared, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_DIFFERENT", most)
    ids, texts = shared
    got = sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in remove_repeats(frame(spark, ids, texts)).collect()), key=repr)
    plain = plain_bytes(texts, 400)
    assert got == sorted(((i, *plain[d]) for d, i in enumerate(ids)), key=repr)
    assert all(len(kept) < n for _, n, kept in got)


@pytest.mark.parametrize("most", [1, 64])
def test_later_repeats(spark, shared, monkeypatch, most):
    monkeypatch.setattr(seed_dedup, "MOST_SEEDS", most)
    ids, texts = shared
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in remove_later_repeats(frame(spark, ids, texts)).collect()), key=repr)
    # null ids come first, among themselves by a hash of the text: either of the two may keep the passage
    orders = [[0, 1, 5, 2, 3, 4, 6], [1, 0, 5, 2, 3, 4, 6]]
    wanted = []
    for order in orders:
        plain = plain_words([texts[d] for d in order], 20)
        wanted.append(sorted(((ids[d], *plain[at]) for at, d in enumerate(order)), key=repr))
    assert got in wanted


@pytest.mark.parametrize("short", [1, 16])
def test_near_copies(spark, monkeypatch, short):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)
    words = prose(7, 120, 9000).split()
    near = [" ".join(words[:k] + [f"z{k}"] + words[k + 1:]) for k in (10, 60, 110)]
    other = prose(8, 120, 9000)
    ids = [9, None, 5, None, None, 7]
    texts = [near[0], near[1], near[2], other, other + " tail", prose(9, 50, 9000)]
    plain = plain_components(texts)
    assert [plain[d][1] for d in range(6)] == [0, 0, 0, 3, 3, 5]
    docs = frame(spark, ids, texts)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()), key=repr)
    named = {0: 5, 3: None, 5: 7}
    assert got == sorted(((i, plain[d][0], named[plain[d][1]]) for d, i in enumerate(ids)), key=repr)
    # the null-id row between 9 and 5 goes, one of the two nameless near copies stays
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(i for i, _ in left if i) == [5, 7] and len(left) == 3
    assert {t for i, t in left if i is None} < {other, other + " tail"}


def test_a_null_id_row_carries_a_link(spark):
    """Two documents too far from each other are linked by the null-id row between them."""
    words = [f"w{i}" for i in range(104)]
    chain = [" ".join(words[k:k + 80]) for k in (0, 10, 20)]
    ids = [1, None, 3]
    assert [c for _, c in plain_components(chain).values()] == [0, 0, 0]
    assert {r["component_id"] for r in jaccard_components(frame(spark, ids, chain)).collect()} == {1}
