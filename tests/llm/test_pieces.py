"""Packing, segmentation, vectors, pages and the pipeline."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from wakeline.llm import block_search, html_extraction, nbest_pieces, packing
from wakeline.llm.word_memory import WordMemory

DOCS = "doc_id long, text string, length string, `offset` string"


# ---- packing

@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=200, deadline=None)
def test_patterns_use_the_histogram(histogram):
    found = packing.patterns(histogram, 64)
    used = {}
    for lengths, count in found:
        assert sum(lengths) <= 64 and count > 0
        for n in lengths:
            used[n] = used.get(n, 0) + count
    assert used == histogram


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    tok = Tokenizer.from_file(packing.default_vocabulary())
    rows = [(i, " ".join(rng.choice(["the", "Ünder", "a\tb", "x1,", "<|endoftext|>", "it's", "\n", "é!"]) for _ in range(rng.choice([0, 3, 50, 3000])))) for i in range(60)]
    rows += [(70, None), (71, ""), (None, "a b"), (3, "a b"), (3, "a b")]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS)
    got = packing.pack(docs, with_ids=True).collect()
    want = [(i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows]
    texts, sequences = {}, {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        texts.setdefault(r.doc_id, []).append((r.start, tuple(r.ids), r.doc_tokens))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 2048
    single = {i: tuple(itertools.chain.from_iterable(ids for _, ids, _ in sorted(p))) for i, p in texts.items() if i != 3}
    assert single == {i: w for i, w in want if i != 3}
    assert sum(len(w) for _, w in want) == sum(r.length for r in got)
    assert packing.pack(docs.limit(0)).count() == 0


@given(st.lists(st.text("aB'stremvld 09-_.\"<|>é×ÀßŸµ÷Ø\u0301İ中\t\x1c\n", max_size=40) | st.sampled_from(["<|endoftext|>x", "it's 12'll", "'re--'s"]), max_size=20))
@settings(max_examples=150, deadline=None)
def test_ids_of_words_equal_those_of_the_whole_text(texts):
    tok = packing.worker_tokenizer(packing.default_vocabulary())
    for text, ids in zip(texts, tok.encode(texts)):
        assert ids.tolist() == [*tok.tokenizer.encode(text, add_special_tokens=False).ids, packing.END_MARK]


def test_word_memory_forgets_without_changing_results():
    memory = WordMemory(lambda words: ((list(map(ord, w)), float(len(w))) for w in words), 1, capacity=20)
    rng = random.Random(1)
    for _ in range(200):
        words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(4))) for _ in range(rng.randrange(40))]
        number = memory.numbers(words)
        ids, length = memory.ids(number)
        assert ids.tolist() == [ord(c) for w in words for c in w] and length.tolist() == list(map(len, words))
        assert memory.facts[0, number].tolist() == list(map(float, map(len, words)))


# ---- segmentation

def every_segmentation(pieces, word):
    into = pieces.edges(word)

    def back(at):
        if at == 0:
            return [(0.0, ())]
        return [(s + t, ids + x) for i, t, x in into[at] for s, ids in back(i)]

    return sorted(back(len(word)), key=lambda r: -r[0])


@pytest.fixture(scope="module")
def encoder():
    return nbest_pieces.Encoder(nbest_pieces.default_vocabulary(), 4)


@given(st.text("aeinorst▁é日\n0", max_size=8))
@settings(max_examples=150, deadline=None)
def test_n_best_of_a_word(encoder, word):
    want, got = every_segmentation(encoder.pieces, "▁" + word), encoder.pieces.best("▁" + word, 4)
    assert [round(s, 8) for s, _ in got] == [round(s, 8) for s, _ in want[:4]]
    assert len({ids for _, ids in got}) == len(got)
    assert all(encoder.pieces.decode(ids) == word for _, ids in got)


@given(st.lists(st.text("aest", max_size=4), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_n_best_of_a_text(encoder, words):
    text = " ".join(words)
    ids, _, ranked, right = encoder.encode(text)
    lists = [every_segmentation(encoder.pieces, "▁" + w)[:5] for w in words] if text else [[(0.0, ())]]
    want = sorted((sum(s for s, _ in c) for c in itertools.product(*lists)), reverse=True)[:4]
    assert right and [round(s, 8) for s, _ in ranked] == [round(s, 8) for s in want]
    assert encoder.pieces.decode(ids.tolist()) == text


def test_segment_table(spark):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (None, "▁ é"), (1, "Hello  world\n"), (5, "word " * 20_000)]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS)
    got = nbest_pieces.segment(docs, with_ids=True).collect()
    assert len(got) == 6 and all(r.round_trip for r in got)
    empty = [r for r in got if r.doc_id in (2, 3)]
    assert all(r.n_pieces == 0 and r.scores == [0.0] for r in empty)
    assert all(len(set(map(tuple, r.ids))) == len(r.ids) for r in got if r.n_pieces)
    assert nbest_pieces.segment(docs.limit(0)).count() == 0


def every_segmentation_of_the_file(text):
    """Scores and ids of all segmentations of a text, from the vocabulary file alone."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=nbest_pieces.default_vocabulary())
    size = model.vocab_size()
    spread = math.log(sum(1.0 / (r + 2) for r in range(size)))
    score = {}
    for i in range(size):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            rank = 0 if model.id_to_piece(i) == "▁" else -model.get_score(i)
            score[model.id_to_piece(i).replace("▁", " ")] = (i, -math.log(rank + 2) - spread)
    whole = " " + text
    reached = [[(0.0, ())]] + [[] for _ in whole]
    for i in range(len(whole)):
        for j in range(i + 1, len(whole) + 1):
            if whole[i:j] in score:
                k, s = score[whole[i:j]]
                reached[j] += [(t + s, (*ids, k)) for t, ids in reached[i]]
    return sorted(reached[-1], key=lambda r: -r[0])


@pytest.mark.parametrize("text", ["a  b", "a    b", " a", "a  ", "   ", "if a:     b", "at   as  a", "a" + " " * 9 + "b"])
def test_pieces_of_several_blanks(spark, text):
    got = nbest_pieces.segment(spark.createDataFrame([(1, text, "", "")], DOCS), with_ids=True).first()
    want = every_segmentation_of_the_file(text)
    assert [round(s, 8) for s in got.scores] == [round(s, 8) for s, _ in want[: nbest_pieces.N_BEST]]
    assert got.round_trip and got.n_pieces == len(got.ids[0])
    of = {ids: s for s, ids in want}
    assert [round(of[tuple(ids)], 8) for ids in got.ids] == [round(s, 8) for s in got.scores]


# ---- vectors

def test_nearest_cases(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(6)], "x") for i in range(130)]
    rows += [(200, None, "x"), (250, [0.0] * 6, "x"), (300, [1.0, None] + [0.0] * 4, "x"), (350, [float("nan")] * 6, "x"), (400, [1.0, 2.0], "x"), (None, [1.0] * 6, "x"), (50, rows[50][1], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    good = {i: np.array(v) for i, v, _ in rows if i is not None and v and None not in v and not np.isnan(v).any() and np.any(v) and len(v) == 6}
    want = []
    for q in (i for i in good if i % 50 == 0):
        near = sorted((-float(good[q] @ v / math.sqrt((good[q] @ good[q]) * (v @ v))), i) for i, v in good.items() if i != q)[:5]
        want += [(q, k + 1, round(-s, 12)) for k, (s, _) in enumerate(near)]
    got = block_search.nearest(frame, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], round(r.score, 12)) for r in got) == sorted(want)
    assert block_search.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(block_search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(block_search, "CANDIDATE_BLOCK", 20)
    monkeypatch.setattr(block_search, "STRIP", 4)
    rng = np.random.default_rng(3)
    data = rng.normal(size=(150, 12)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    got = {(r.query_id, r["rank"]): r.vec_id for r in block_search.nearest(frame, F.col("vec_id") % 10 == 0).collect()}
    for q in range(0, 150, 10):
        order = [i for i in np.argsort(-(unit @ unit[q]), kind="stable") if i != q][:5]
        assert [got[q, k + 1] for k in range(5)] == order


# ---- pages

def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@pytest.mark.parametrize("held", [1 << 27, 4])
def test_shared_lines_are_a_longest_common_subsequence(monkeypatch, held):
    monkeypatch.setattr(html_extraction, "HELD_BITS", held)
    rng = random.Random(0)
    for _ in range(1500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in "ab")
        shared = html_extraction.shared_lines(a, b)
        rest = iter(b)
        assert len(shared) == lcs(a, b) and all(x in rest for x in (a[i] for i in sorted(shared)))


def test_blocks():
    page = '<body><nav>Menu</nav><p>Hello <b>big\nworld</b> a&amp;b<p title="a>b">Two<span class="ad">AD</span> parts<ul><li>one<li>two</ul>'
    page += '<form>F</form><div id="comments"><p>bad</div><script>if (a<b) "</p>"</script><!-- x --><p>don\'t <a title=don\'t href=x>l</a> end</foo'
    D, K = html_extraction.DROP, html_extraction.FREE
    assert html_extraction.blocks_of(page) == [
        (D, "Menu"), (K, "Hello big world a&b"), (K, "Two parts"), (K, "one"), (K, "two"), (D, "F"), (D, "bad"), (K, "don't l end")
    ]
    assert html_extraction.blocks_of("") == []


def test_extract(spark):
    frame_html = "<p>Welcome to the site</p>{}<p>Imprint</p>"
    rows = [(i, f"https://Host.org/a/{i}.html?x=1", frame_html.format(f"<p>Own text {i}</p>"), "t") for i in range(6)]
    rows += [
        (10, "http://host.org/b/1", "<nav>Menu</nav><article><h1>T</h1><p>Welcome to the site</p></article><p>out</p>", "t"),
        (11, None, "<p>alone</p>", "t"), (12, "http://one.org/", "<p>a<p>b", "t"), (13, "http://x.org/", None, "t"), (None, "nonsense", "", "t"),
        (3, "https://Host.org/a/3.html?x=1", frame_html.format("<p>Own text 3</p>"), "t"),
        (14, "https://copy.org/1", "<p>same long text</p>", "t"), (15, "https://copy.org/2", "<p>same long text</p>", "t"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(4)
    got = html_extraction.extract(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert all(text[i] == f"Own text {i}" for i in range(6))
    assert text[10] == "T\n\nWelcome to the site" and text[11] == "alone" and text[12] == "a\n\nb"
    assert text[13] == text[None] == "" and text[14] == text[15] == "same long text"
    assert html_extraction.extract(pages.limit(0)).count() == 0


# ---- pipeline

def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "repeats", "packing"]
    extra = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "", None, None, None), (10_003, "123", "en", "s", 3)], docs.schema)
    docs = docs.unionByName(extra)
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert sorted(after.columns) == sorted(docs.columns), name
        assert 0 < after.count() <= before.count()
        before = spark.createDataFrame(after.toPandas(), docs.schema)
    left = {r.doc_id for r in before.collect()}
    assert not left & {10_001, 10_002, 10_003}
    assert corpus_pipeline.STAGES[-1][1](spark, before, sf).select("doc_id").distinct().count() == len(left)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


# ---- segmentation of long and mixed words

@given(st.lists(st.sampled_from(["at", "ing", "(", ");", "²", "².", "7", " ", "  ", "\n", "é", "日", "▁", "_", "://"]), max_size=6).map("".join))
@settings(max_examples=80, deadline=None)
def test_units_lose_no_segmentation(unit_encoder, text):
    """Cutting between letters and other signs gives the scores of the uncut lattice, bytes for characters without a piece."""
    _, _, ranked, right = unit_encoder.encode(text)
    want = sorted((s for s, _ in every_segmentation(unit_encoder.pieces, "▁" + text)), reverse=True)[:4] if text else [0.0]
    assert right and [s for s, _ in ranked] == want


@pytest.fixture(scope="module")
def unit_encoder():
    return nbest_pieces.Encoder(nbest_pieces.default_vocabulary(), 4, runs=True)


@pytest.mark.parametrize("text", ["a" * 100_000, "=" * 100_000, "ab" * 50_000, "日本語の文章" * 5_000, "a1" * 20_000])
def test_long_words_without_blanks(unit_encoder, text):
    ids, _, ranked, right = unit_encoder.encode(text)
    assert right and unit_encoder.pieces.decode(ids.tolist()) == text
    assert [s for s, _ in ranked] == sorted((s for s, _ in ranked), reverse=True) and unit_encoder.encode(text)[2] == ranked


def test_memory_is_bounded_by_length(monkeypatch):
    from wakeline.llm import word_memory

    monkeypatch.setattr(word_memory, "HELD", 1000)
    memory = WordMemory(lambda words: ((list(map(ord, w)),) for w in words), 0, capacity=100)
    for k in range(60):
        number = memory.numbers(["x" * (200 + k), "short", "short"])
        ids, length = memory.ids(number)
        assert length.tolist() == [200 + k, 5, 5] and len(ids) == 210 + k
        assert memory.used <= 1000 + 300
