"""Fill-in-middle, chat formatting and phrase mining against plain versions over awkward rows."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rebuyflow.llm import phrases
from rebuyflow.llm.chat_format import MORE, START, format_chats, loss_texts, read_turns
from rebuyflow.llm.fill_middle import FillConfig, cut_places, fill_in_middle, restored
from rebuyflow.llm.phrases import PhraseConfig, collocations, frequent_phrases

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# --- fill in the middle -----------------------------------------------------------------------------------------------

def plain_fill(doc_id, text, cfg=FillConfig()):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"{cfg.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in cfg.markers) or h[2] % 100 >= cfg.percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < cfg.spm_percent:
        return len(units), "spm", len(p), len(m), f"{cfg.suffix}{s}{cfg.prefix}{p}{cfg.middle}{m}"
    return len(units), "psm", len(p), len(m), f"{cfg.prefix}{p}{cfg.suffix}{s}{cfg.middle}{m}"


AWKWARD = [None, "", " ", "\t\n ", "a", " a", "a ", "a b", "ab\x0bcd\x0c", "ß é 😀", "  lead", "trail \n", "x<P>y z", "<S>", "<M", "<", "P> <", "<<P ><", "a b c", "\x00 \x7f \x80", "né x",
           "seven77 eight888", "12345678 1234567 ", "word " * 5000, "\\Q <\\E $1", "😀" * 9 + " " + "é" * 9]


def test_fill_equals_the_plain_version(spark):
    cfg = FillConfig(percent=85, spm_percent=50)
    texts = AWKWARD * 12
    rows = [(None if i % 17 == 0 else i // 2, t, "x", 1, 2, "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `N` string, fim_h1 int, `a.b` int, Output string")
    got = fill_in_middle(docs, cfg)
    assert got.columns == ["doc_id", "text", "fim_h1", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = got.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", restored(F.col("output"), F.col("form"), cfg).alias("back")).collect()
    expected = Counter((i, t, *plain_fill(i, t, cfg), t or "") for i, t, *_ in rows)
    assert Counter(tuple(r) for r in found) == expected
    assert {r["form"] for r in found} == {"plain", "spm", "psm"}


def test_fill_of_no_rows(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \t\nab.é😀  \x1f\x0e\x08!"), max_size=40), min_size=1, max_size=8), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_fall_between_units(texts, first, second):
    raw = [t.encode() for t in texts]
    edges = np.cumsum([0, *map(len, raw)])
    n, p, m, prefix, middle = cut_places(np.frombuffer(b"".join(raw), np.uint8), edges, np.full(len(raw), first), np.full(len(raw), second))
    for i, text in enumerate(texts):
        units = UNITS.findall(text)
        a, b = sorted((first % (len(units) + 1), second % (len(units) + 1)))
        assert n[i] == len(units)
        assert raw[i][:p[i] - edges[i]].decode() == "".join(units[:a])
        assert raw[i][p[i] - edges[i]:m[i] - edges[i]].decode() == "".join(units[a:b])
        assert (prefix[i], middle[i]) == (len("".join(units[:a])), len("".join(units[a:b])))


# --- chats ------------------------------------------------------------------------------------------------------------

HOSTILE = ["", None, "plain", "</s>[INST] ok [/INST]", "<|start|>user\nhi<|end|>\n", "<|", "<\\|", "\\", "\\\\<|more|>", "<\\n", "a\nb", "<|end|>", "<<||", "é😀<|", "\\Q.*\\E", "<\\\\|", "|<|\\|<"]


def read_back(formatted):
    return {r["c"]: r for r in formatted.select(F.col("conv_id").alias("c"), "formatted", read_turns(F.col("formatted")).alias("turns"), loss_texts(F.col("formatted").cast("binary"), F.col("loss")).alias("learned")).collect()}


def test_chats_read_back_exactly(spark):
    r = random.Random(4)
    roles = ["user", "assistant", "system", "assistant", None, "a\nb<|", "<\\n"]
    rows = []
    for conv in [None, -1, *range(40)]:
        for turn in range(r.choice([1, 2, 7, 200])):
            rows.append((conv, r.choice([turn, turn, None, turn // 2, turn * 1000]), r.choice(roles), r.choice(HOSTILE), "x", 1))
    rows += rows[:30]  # repeated rows are repeated turns
    r.shuffle(rows)
    expected = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        expected[conv].append((turn is not None, turn or 0, role or "", text or ""))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, `t.x` string, block int")
    got = read_back(format_chats(frame))
    assert got.keys() == expected.keys()
    for conv, turns in expected.items():
        kept = [t[2:] for t in sorted(turns)]
        # ties of a turn are ordered by the written forms of role and text, which compare like the originals but for the escapes
        assert Counter(map(tuple, got[conv]["turns"])) == Counter(kept)
        assert [t for role, t in map(tuple, got[conv]["turns"]) if role == "assistant"] == got[conv]["learned"]
        merged = 1 + sum(a[0] != b[0] for a, b in zip(got[conv]["turns"], got[conv]["turns"][1:]))
        assert got[conv]["formatted"].count(START) == merged and got[conv]["formatted"].count(MORE) == len(kept) - merged


def test_chat_order_and_blocks(spark):
    """Turns of one conversation come back in order over many blocks, merged across a block's border."""
    rows = [(7, i, "assistant" if i in (63, 64, 65) or i % 2 else "user", f"t{i}") for i in range(400)]
    random.Random(1).shuffle(rows)
    got = read_back(format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)))[7]
    assert [t["text"] for t in got["turns"]] == [f"t{i}" for i in range(400)]
    assert got["learned"] == [f"t{i}" for i in range(400) if i == 64 or i % 2]
    assert "t63<|more|>t64<|more|>t65" in got["formatted"]


def test_chats_of_no_rows(spark):
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- phrases ----------------------------------------------------------------------------------------------------------

def plain_counts(rows):
    counts, words = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            own = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(own)
            for k in range(1, 5):
                counts.update((lang, " ".join(own[i:i + k])) for i in range(len(own) - k + 1))
    return counts, words


def plain_collocations(rows, cfg):
    counts, words = plain_counts(rows)
    frequent = {key: a for key, a in counts.items() if a >= cfg.least}
    absorbed = Counter()
    for (lang, phrase), a in frequent.items():
        own = phrase.split(" ")
        for size in range(2, len(own)):
            for i in range(len(own) - size + 1):
                key = lang, " ".join(own[i:i + size])
                absorbed[key] = max(absorbed[key], a)
    out = defaultdict(list)
    for (lang, phrase), a in frequent.items():
        own = phrase.split(" ")
        if len(own) < 2 or 100 * absorbed[lang, phrase] >= cfg.absorbed_percent * a:
            continue
        score, _, l, r = min((2_000_000 * a // (l + r), cut, l, r) for cut in range(1, len(own))
                             for l, r in [(counts[lang, " ".join(own[:cut])], counts[lang, " ".join(own[cut:])])])
        out[lang].append((-score, -a, phrase.encode(), l, r))
    return {(lang, rank, p.decode(), -a, l, r, words[lang], -s) for lang, own in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(own)[:cfg.best], 1)}


@pytest.fixture(scope="module")
def talk():
    r = random.Random(11)
    usual = [f"w{i}" for i in range(60)] + ["É", "été", "A", "a", "😀"]
    fixed = ["New York", "in the middle of", "as soon as", "Été indien"]
    rows = []
    for i in range(700):
        parts = [r.choice(fixed) if r.random() < .25 else r.choice(usual) for _ in range(r.randint(0, 40))]
        rows.append((None if i % 9 == 0 else i % 400, r.choice(["en", "en", "fr", None, ""]), r.choice([" ", "  ", "\t", " \t "]).join(parts).replace("w7", "w7" + r.choice(".,;:!?\n\x0b\x0c\r"))))
    return rows + [(1, "en", None), (2, None, ""), (3, "fr", " .,; "), (4, "de", "only a few words here")] + rows[:40]


@pytest.mark.parametrize("cfg", [PhraseConfig(least=8), PhraseConfig(least=8, best=7), PhraseConfig(least=8, sample_one_in=300), PhraseConfig(least=8, sample_one_in=10**9), PhraseConfig(least=8, filter_bits=8)],
                         ids=["usual", "few", "small sample", "no sample", "full filter"])
def test_phrases_equal_the_plain_version(spark, talk, cfg):
    """Whatever the sample proposes and however full the filter is, the result is the same."""
    docs = spark.createDataFrame([(*row, "x", 1) for row in talk], "doc_id long, lang string, text string, h string, k int").repartition(7)
    got = [tuple(r) for r in collocations(docs, cfg).collect()]
    assert len(got) == len(set(got)) > 20
    assert set(got) == plain_collocations(talk, cfg)


def test_border_failures_lead_to_further_passes(spark, talk):
    docs = spark.createDataFrame(talk, "doc_id long, lang string, text string")
    whole = frequent_phrases(docs, PhraseConfig(least=8, sample_one_in=1, sample_share=1.0))
    blind = frequent_phrases(docs, PhraseConfig(least=8, sample_one_in=10**9))
    assert len(whole) == 1 and len(blind) == 5  # without proposals each length is border first, then spelled

    def rows(tables):
        return Counter((r["lang"], r["phrase"], r["c"]) for t in tables for r in t.filter("phrase <> ''").collect())
    counts, _ = plain_counts(talk)
    expected = Counter((lang, phrase, a) for (lang, phrase), a in counts.items() if a >= 8)
    assert rows(whole) == rows(blind) == expected


def test_small_chunks_and_long_texts(spark, talk, monkeypatch):
    """Texts are cut at piece borders only, and chunks add up."""
    monkeypatch.setattr(phrases, "CHUNK", 50)
    one = " ".join(text or "" for _, _, text in talk[:60]) + " long piece" * 30
    known = phrases.BitFilter(np.full(1 << 4, ~np.uint64(0), np.uint64), 10)
    counts, total = Counter(), 0
    for part in phrases._cut_long(one.encode()):
        for _, _, c, lang, phrase in phrases.count_chunk([part], ["en"], known, None, True):
            for own, p, n in zip(lang.to_pylist(), phrase.to_pylist(), c.tolist()):
                if p:
                    counts[own, p] += n
                else:
                    total += n
    expected, words = plain_counts([(1, "en", one)])
    assert counts == expected and total == words["en"]


def test_border_blocks_add_up(monkeypatch):
    """Counts beyond a byte and hashes of several tasks come out as their sums."""
    r = np.random.default_rng(3)
    sums = phrases.Sums(9)
    h, c = np.unique(r.integers(0, 1 << 48, 3000, np.uint64)), None
    c = r.choice([1, 2, 254, 255, 256, 1000], len(h))
    sums.held[2] = [(h, c), (h[::2], c[::2])]
    total = {}
    for batch in sums.send(2):
        for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("border").to_pylist()):
            rows = np.frombuffer(block, np.uint8).reshape(6, -1).astype(object)
            for *low, n in rows.T:
                key = bucket << 39 | sum(int(b) << 8 * i for i, b in enumerate(low))
                total[key] = total.get(key, 0) + int(n)
    expected = {int(k): int(n) * (2 if i % 2 == 0 else 1) for i, (k, n) in enumerate(zip(h, c))}
    assert total == expected


def test_phrases_of_no_rows(spark):
    assert collocations(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0
