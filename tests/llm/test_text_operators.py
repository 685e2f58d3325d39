"""Operators on texts against plain versions, over awkward rows: nulls, empty and long texts, ties, repeats, odd columns."""
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from rebuyflow.llm import suffix_dedup, windows
from rebuyflow.llm.hilbert_shards import hilbert_index, hilbert_shards
from rebuyflow.llm.jaccard_join import jaccard_components, tile_similar
from rebuyflow.llm.personal_data import KINDS, SpanModel, find_spans, fit_spans, redact, span_text
from rebuyflow.llm.piece_codec import PieceCodec, digests, encode_pieces, read_model
from rebuyflow.llm.seed_dedup import remove_later_repeats
from rebuyflow.llm.suffix_dedup import remove_repeats
from rebuyflow.llm.temperature_mix import MixTarget, mix_sources
from rebuyflow.llm.toxicity import fit_bags, fit_toxicity, hazard, held_out, noisy_or, score_toxicity, sentence_scores, word_features
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, body string, id long, h string, n string, u string, k string, s string"


def frame(spark, texts, sources=None):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(i, t, "en", (sources or ["a"])[i % len(sources or ["a"])], len(t or ""), "x", 7, "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    base, long = prose(1, 150, 5000), prose(2, 6000, 50_000)
    near = [" ".join(w if random.Random(i * 1000 + k).random() > .012 else f"z{i}" for k, w in enumerate(base.split())) for i in range(60)]
    passage = prose(3, 90, 3000)
    return [None, "", " ", "one", "One two", "a b c d e", base, base, base.upper(), *near, long, long + " tail", passage,
            *[prose(50 + i, 40, 900) + " " + passage + " " + prose(90 + i, 40, 900) for i in range(40)], "ab" * 900, "x y " * 400, "ß é 😀 " * 120, *[prose(200 + i, 200, 100_000) for i in range(30)]]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- repeated bytes ---------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc\x00\xff", bytes(range(256))])
def test_two_stage_order_is_the_sorted_order(alphabet):
    r = random.Random(len(alphabet))
    for _ in range(40):
        pieces = [bytes(r.choice(alphabet) for _ in range(r.randint(8, 70))) for _ in range(r.randint(1, 5))]
        starts = [len(p) - 7 for p in pieces]
        owner, offset = suffix_dedup.two_stage_order(pieces, starts, 64)
        got = [pieces[p][o:o + 64] for p, o in zip(owner, offset)]
        assert len(got) == sum(starts) and got == sorted(got)
        count = Counter(p[i:i + 8] for p, n in zip(pieces, starts) for i in range(n))
        for p, n, flags in zip(pieces, starts, suffix_dedup.repeated_starts(pieces, starts, 8)):
            assert flags.tolist() == [count[p[i:i + 8]] > 1 for i in range(n)]


def plain_bytes(texts, length):
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = {}
    for d, b in enumerate(bodies):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = True
        out[d] = len(b), bytes(np.frombuffer(b, np.uint8)[~gone])
    return out


@pytest.mark.parametrize("most", [1, 128])
def test_repeated_bytes(spark, corpus, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_DIFFERENT", most)
    got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"])) for r in remove_repeats(frame(spark, corpus), 400).collect()}
    assert got == plain_bytes(corpus, 400)


def test_long_documents_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(windows, "PIECE", 700)
    monkeypatch.setattr(windows, "LONGEST", 60)
    texts = [prose(1, 900), "q" + prose(1, 900), "zz " * 700]
    got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"])) for r in remove_repeats(frame(spark, texts), 400).collect()}
    assert got == plain_bytes(texts, 400)


def test_rows_read_twice_do_not_repeat_each_other(spark):
    once = frame(spark, [prose(5, 200, 9000), prose(6, 200, 9000)])
    assert [len(r["spans"]) for r in remove_repeats(once.union(once), 400).collect()] == [0] * 4
    assert [r["n_removed"] for r in remove_later_repeats(once.union(once)).collect()] == [0] * 4


@pytest.mark.parametrize("most", [0, 3])
def test_hot_anchors_keep_every_repeat_around_their_cores(spark, monkeypatch, most):
    """Passages just under, at and over the length, in other surroundings that agree for some bytes on one side or both, and anchors that come twice."""
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    left, core, right = word(300), word(420), word(300)
    texts = [word(r.randrange(300)) + left[-r.randrange(1, 60):] + core[r.randrange(50):420 - r.randrange(50)] + right[:r.randrange(1, 60)] + word(r.randrange(300)) for _ in range(25)]
    texts += [word(80) + left[-k:] + core[:400 - k] + word(90) for k in (0, 1, 30, 31, 32, 33, 64, 200)] * 2
    block = word(170)
    texts += [word(60 + k) + block * 2 + core[:k * 9] + block + word(50) for k in range(12)] + [block * 7, "xy" * 500, word(40) + "xy" * 300]
    monkeypatch.setattr(suffix_dedup, "MOST_DIFFERENT", most)
    got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"])) for r in remove_repeats(frame(spark, texts), 400).collect()}
    assert got == plain_bytes(texts, 400)


def test_cells_of_a_stretch_follow_from_their_own_bytes():
    """Periodic text has few different cells, and they and their places are the same wherever a stretch begins."""
    text = np.frombuffer(b"abcde" * 300, np.uint8)
    h = windows.byte_runs(text, 24).view(np.int64)
    found = [{cell[2:] for cell in suffix_dedup.anchor_cells(text[s:s + 900], h[2], 501, 400, 24) if cell[1] == 5} for s in (0, 1, 4)]
    assert len(found[0]) == 1 and found[0] == found[1] == found[2]


def test_only_cells_with_a_shared_core_are_looked_at_window_by_window(spark, monkeypatch):
    """A phrase in many different surroundings makes hot anchors, but none of its windows repeats: no table holds a row per window."""
    r = random.Random(5)
    phrase = "".join(r.choice("abcdefghij ") for _ in range(150))
    texts = ["".join(r.choice("klmnopqrst ") for _ in range(500)) + phrase + "".join(r.choice("klmnopqrst ") for _ in range(500)) for _ in range(70)]
    rows = {}

    def counting(df, name, store=windows.stage):
        out = store(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(windows, "stage", counting)
    monkeypatch.setattr(suffix_dedup, "stage", counting)
    monkeypatch.setattr(suffix_dedup, "MOST_DIFFERENT", 8)
    assert all(not row["spans"] for row in remove_repeats(frame(spark, texts), 400).collect())
    assert max(rows.values()) < 20 * rows["stretches-again"] and rows["stretches-again"] >= 60


# --- repeated words ---------------------------------------------------------------------------------------------------

def plain_words(texts, length):
    seen, out = set(), {}
    for d, t in enumerate(texts):
        w = words_of(t)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            key = tuple(w[i:i + length])
            gone[i:i + length] |= key in seen
            seen.add(key)
        out[d] = len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g)
    return out


@pytest.mark.parametrize("most", [1, 24])
def test_later_repeats(spark, corpus, monkeypatch, most):
    from rebuyflow.llm import seed_dedup
    monkeypatch.setattr(seed_dedup, "MOST_SEEDS", most)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in remove_later_repeats(frame(spark, corpus)).collect()}
    assert got == plain_words(corpus, 20)


def test_stretches_find_equal_windows():
    r = random.Random(4)
    for _ in range(30):
        words = [f"w{r.randrange(4)}" for _ in range(200)]
        h = windows.word_hashes(np.frombuffer(" ".join(words).encode(), np.uint8))
        anchor, first, size, twice = windows.stretches(windows.word_runs(h, 3), 18)
        assert size.sum() == 181
        all_windows, seen = [tuple(words[i:i + 20]) for i in range(181)], {}
        for w, a in zip(all_windows, np.repeat(anchor, size)):
            assert seen.setdefault(w, a) == a
        for f, n, t in zip(first, size, twice):
            assert t or len(set(all_windows[f:f + n])) == n


# --- near duplicates --------------------------------------------------------------------------------------------------

def plain_components(texts):
    sets = []
    for t in texts:
        w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in range(len(texts))}


@pytest.mark.parametrize("short", [1, 16])
def test_near_duplicates(spark, corpus, monkeypatch, short):
    from rebuyflow.llm import jaccard_join
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", 16)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, corpus)).collect()}
    assert got == plain_components(corpus)


def test_borderline_similarity(spark):
    texts = [" ".join(f"a{i}" for i in range(n)) for n in (10, 11, 12, 7, 8, 9, 5, 6)] + ["a0 a1 a2 a3", "A0 a1 a2 a3", "a0"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, texts)).collect()}
    assert got == plain_components(texts)


def test_tiles_count_exactly():
    r = np.random.default_rng(5)
    a, b = ([np.unique(r.integers(0, 60, 40).astype(np.int64)) for _ in range(9)] for _ in range(2))
    got = tile_similar(a, b, 75)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            assert got[i, j] == (100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y)))


# --- personal data ----------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "phone": 9 <= len(digits) <= 15,
                    "card": 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_base_spans_are_the_leftmost_matches(spark):
    r = random.Random(9)
    awkward = [None, "", "a@b.c_d@e.f g@h", "x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255", "4111 1111-1111 1111 4111111111111112", "+1 (555) 010-9999. +12 +1234567890123456",
               "😀 mail a.b+c@mail-1.example.com, 😀 10.0.0.1", "a" * 5000 + "@" + "b." * 3000 + "c", "1" * 4000 + ".2.3.4", "+1 " + "2 " * 3000, "." * 3000 + "@a.b",
               *["".join(r.choice("ab1.29 @+-()_%4") for _ in range(120)) for _ in range(300)]]
    found = find_spans(frame(spark, awkward), SpanModel((), (2.0,) * 4)).select("doc_id", span_text(F.col("base_spans")).alias("got")).collect()
    for row in found:
        assert row["got"] == plain_spans(awkward[row["doc_id"]]), awkward[row["doc_id"]]


def test_added_spans_never_touch_base_spans(spark):
    r = random.Random(2)
    texts = [f"write to u{i}@mail{i % 7}.example.com or call +1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)} at 10.{i % 200}.3.{i % 250} order {r.randrange(10**9)}, v1.2.{i}"
             for i in range(400)] + ["ask u7 [at] mail.example.com or u8 @ mail.example.com", "(555) 555-1234"]
    docs = frame(spark, texts)
    model = fit_spans(docs, rounds=4)
    assert model.trees
    for row in find_spans(docs, model).select("doc_id", "base_spans", "spans", redact(F.col("text"), F.col("spans")).alias("clean")).collect():
        base, spans = [tuple(s) for s in row["base_spans"]], [tuple(s) for s in row["spans"]]
        assert set(base) <= set(spans) and spans == sorted(spans)
        for s, _, e in set(spans) - set(base):
            assert all(e <= b or s >= f for b, _, f in base)
        assert "@mail" not in row["clean"].replace("u8 @ mail", "")


def test_redaction_of_overlaps_and_places_beyond_one_unit(spark):
    row = frame(spark, ["😀 a@b.cc é 10.0.0.1 end"])
    out = find_spans(row, SpanModel((), (2.0,) * 4)).select(redact(F.col("text"), F.col("spans"))).first()[0]
    assert out == "😀 [EMAIL] é [IP] end"


# --- toxicity ---------------------------------------------------------------------------------------------------------

def test_offending_sentences_are_found_from_document_labels(spark):
    texts = [". ".join(prose(i * 50 + k, 12, 300) for k in range(8)) for i in range(400)]
    bad = {i for i in range(400) if i % 4 == 0}
    texts = [t.replace(". ", f". {prose(i, 5, 300)} vileword{'s' * (i % 3)} {prose(i + 1, 5, 300)}. ", 1) if i in bad else t for i, t in enumerate(texts)] + [None, "", "..."]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i in bad)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    rows = {r["doc_id"]: r for r in score_toxicity(docs, model).withColumn("apart", held_out()).collect()}
    assert {i for i, r in rows.items() if r["apart"]} == {i for i in range(403) if zlib.crc32(str(i).encode()) % 4 == 2}
    apart = [i for i in range(400) if rows[i]["apart"]]
    assert all((rows[i]["score"] >= 0.3) == (i in bad) for i in apart)
    for i in bad & set(apart):
        assert any("vileword" in texts[i][p["start"]:p["end"]] for p in rows[i]["offending"])
    assert [rows[i]["score"] for i in (400, 401, 402)] == [0.0] * 3


def test_one_class_or_no_labels_score_nothing(spark):
    docs = frame(spark, ["a b. c d"] * 9)
    for labels in ([], [(i, 0) for i in range(9)]):
        model = fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {round(r["score"], 6) for r in score_toxicity(docs, model).collect()} == {0.0}


def test_the_slope_is_that_of_the_hazard_and_every_sentence_counts():
    z = np.linspace(-12, 6, 181)
    value, slope = hazard(z)
    assert np.allclose((hazard(z + 1e-5)[0] - hazard(z - 1e-5)[0]) / 2e-5, slope, rtol=1e-4)
    assert (np.diff(value) > 0).all() and (value > 0).all()
    assert noisy_or([]) == 0 and noisy_or([0.5, 0.5]) == pytest.approx(0.75)
    assert 0 < noisy_or([1e-4] * 30) < noisy_or([1e-4] * 60) < 0.01  # weak sentences rank documents without adding up


def test_the_weights_restore_a_rare_class():
    """Texts that say nothing score the true proportion, here 1 in 61, not the even sample's."""
    y = np.array([0, 1] * 400)
    weight = np.where(y == 1, 1.0, 60.0)
    model = fit_bags(["same words here"] * 800, y, weight / weight.mean())
    table = np.frombuffer(model.weights, np.float32)
    (_, _, p), = sentence_scores("same words here", lambda w: sum(table[f] for f in word_features(w)), model.bias)
    assert p == pytest.approx(1 / 61, abs=0.008)


def test_training_and_scoring_add_a_sentence_alike():
    """Words of four letters and words of one stem have slots in common; both sides must count them the same way."""
    y = np.array([0, 1] * 200)
    model = fit_bags(["abcd abcde abcdef"] * 400, y, np.ones(400))
    table = np.frombuffer(model.weights, np.float32)
    (_, _, p), = sentence_scores("abcd abcde abcdef", lambda w: sum(table[f] for f in word_features(w)), model.bias)
    assert p == pytest.approx(0.5, abs=0.1)


# --- shards and mixture -----------------------------------------------------------------------------------------------

def test_the_curve_visits_every_cell_by_unit_steps(spark):
    cells = spark.range(512).select((F.col("id") % 8).alias("x"), (F.floor(F.col("id") / 8) % 8).alias("y"), F.floor(F.col("id") / 64).alias("z"))
    order = cells.select("x", "y", "z", hilbert_index(F.col("x"), F.col("y"), F.col("z"), 3).alias("at")).orderBy("at").collect()
    assert [r["at"] for r in order] == list(range(512))
    assert all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) + abs(a["z"] - b["z"]) == 1 for a, b in zip(order, order[1:]))


def test_shards_are_even_and_gapless(spark, corpus):
    texts = corpus + [prose(i, 50) for i in range(300)] + ["copy of a third"] * 200
    rows = hilbert_shards(frame(spark, texts, ["a", "b", None]), 4).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows) + sum(sizes) // 32
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_mixture_meets_its_target_and_budget(spark):
    sources = ["hot"] * 6 + ["b", "c", "d", None]
    docs = frame(spark, [prose(i, 20 + i % 30) for i in range(1200)] + [None, ""], sources)
    out = mix_sources(docs, MixTarget(entropy=0.999, max_repetition=50.0)).collect()
    tokens = Counter()
    for r in out:
        tokens[r["source"]] += r["mix_tokens"]
        assert 0 <= r["mix_position"] <= 1
    assert max(tokens.values()) / min(tokens.values()) < 1.5 and len(tokens) == 5  # nearly flat
    limited = mix_sources(docs, MixTarget(entropy=0.999, max_repetition=1.5)).collect()
    copies = Counter(r["doc_id"] for r in limited)
    assert max(copies.values()) == 2
    total = sum(len(words_of(r["text"])) for r in docs.collect())
    assert total * 0.97 <= sum(r["mix_tokens"] for r in limited) <= total
    head = Counter(r["source"] for r in sorted(out, key=lambda r: r["mix_position"])[:len(out) // 3])
    whole = Counter(r["source"] for r in out)
    assert all(abs(head[s] * 3 / whole[s] - 1) < 0.35 for s in whole)


# --- pieces -----------------------------------------------------------------------------------------------------------

def test_pieces_equal_the_library(spark, corpus):
    model = read_model(public_tokenizers.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = corpus + ["  a  b ", " ", "\n\n a\n", "▁x ▁", "<s></s>", "\x00\x01", "a" * 3000, "日本語" * 90, "​ é ﬁ \U0001F600", "a\tb \r\n"]
    for r in digests(encode_pieces(frame(spark, texts), model)).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_eos=True)
        assert r["n_tokens"] == len(ids) and r["n_corrected"] == 0
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_list_and_heap_agenda_agree():
    codec = PieceCodec(read_model(public_tokenizers.path("piece_bpe_32k.model")))
    r = random.Random(1)
    for _ in range(500):
        segment = "▁" + "".join(r.choice("aeinrst▁hlé") for _ in range(r.randint(1, 30)))
        assert codec._by_list(segment) == codec._by_heap(segment)


# --- all of them ------------------------------------------------------------------------------------------------------

def test_empty_tables(spark):
    empty = frame(spark, [])
    model = read_model(public_tokenizers.path("piece_bpe_32k.model"))
    assert remove_repeats(empty).count() == remove_later_repeats(empty).count() == jaccard_components(empty).count() == 0
    assert hilbert_shards(empty).count() == mix_sources(empty).count() == encode_pieces(empty, model).count() == 0
    assert find_spans(empty, fit_spans(empty)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert score_toxicity(empty, fit_toxicity(empty, labels)).count() == 0


def test_rows_keep_their_other_columns(spark):
    docs = frame(spark, ["a b", None])
    model = read_model(public_tokenizers.path("piece_bpe_32k.model"))
    assert set(SCHEMA.replace(" long", "").replace(" string", "").split(", ")) <= set(encode_pieces(docs, model).columns) & set(mix_sources(docs).columns)
