"""Text operators against brute force, with nulls, empty and long texts, repeated rows and empty tables."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wakeline.llm import imatch, license_scan, minhash_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, n_words string, label string"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(5)


# ---- license scans

def brute_license(text):
    low = (text or "").translate(LOWER)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts = {k: [i for i in range(len(words)) if words[i : i + len(p)] == p] for k, p in license_scan.PHRASES.items()}
    base = sorted(k for k, s in starts.items() if s)
    every = sorted(itertools.chain.from_iterable(starts.values()))
    found, best = set(base), 0.0
    lines = low.split("\n")
    for k in range(len(lines)):
        own = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "\n".join(lines[k : k + license_scan.LINES])))
        for label, template in license_scan.template_words(license_scan.TEMPLATES).items():
            both = len(own & set(template))
            if both >= license_scan.needed(len(template), license_scan.THRESHOLD):
                found.add(label)
                best = max(best, both / len(template))
    return (
        len(words), len(every), every[0] if every else None, every[-1] if every else None,
        ",".join(base), ",".join(sorted(found)), 1.0 if every else best,
    )


def test_license_scan(spark):
    rng = random.Random(3)
    bits = [*license_scan.TEMPLATES.values(), "CC BY", "cc-by cc by", "All Rights\nReserved.", "General Public License", "wörter é1", "the mit", "\n", ""]
    rows = [(i, rng.choice(["", " ", "\n", ". "]).join(rng.choices(bits, k=rng.randrange(7)))) for i in range(80)]
    rows += [(None, "cc by"), (80, None), (81, ""), (82, "x " * 50_000 + "all rights reserved"), (3, "cc by"), (3, "cc by")]
    want = sorted(((i, *brute_license(t)) for i, t in rows), key=repr)
    got = license_scan.license_scan(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_wrapped_notice_and_many_lines(spark):
    bsd = "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted"
    grant = "Permission is\nhereby granted, free of charge, to any person\nobtaining a copy of this software"
    prose = "the word is a part of this and in the text to the public\n"
    rows = [(1, "int x;\n" + bsd), (2, grant), (3, bsd.replace("\n", "\n\n\n")), (4, prose * 20_000 + bsd + "\n" + prose * 20_000)]
    got = {r.doc_id: r.labels for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert got == {1: "bsd", 2: "mit-grant", 3: "", 4: "bsd"}


def test_license_scan_of_nothing(spark):
    assert license_scan.license_scan(frame(spark, [])).count() == 0


# ---- near duplicates

def brute_sets(rows, shingle):
    out = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        if len(words) >= shingle:
            out[i] = {tuple(words[k : k + shingle]) for k in range(len(words) - shingle + 1)}
        else:
            out[i] = {tuple(words)} if words else set()
    return out


def brute_components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(spark, shingle):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(900)]
    bases = [[rng.choice(vocabulary) for _ in range(n)] for n in (120, 120, 60, 300)]
    rows = []
    for i in range(160):  # copies of four texts, some far beyond the threshold, and texts of their own
        words = list(rng.choice(bases)) if i % 4 else [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        for _ in range(rng.choice([0, 0, 1, 3, 6, 12])):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words).capitalize()))
    rows += [(200, None), (201, ""), (202, "  \t"), (203, "one"), (204, "ONE "), (205, "word " * 30_000)]
    sets = brute_sets(rows, shingle)
    want = {i: (len(sets[i]), c, c == i) for i, c in brute_components(sets).items()}
    got = minhash_dedup.near_duplicates(frame(spark, rows), shingle).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert len(got) == len(rows)


def test_large_bucket_is_joined_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SMALL", 4)
    monkeypatch.setattr(minhash_dedup, "TILE", 8)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(90):
        words = list(base)
        for k in rng.sample(range(100), rng.choice([1, 2, 4, 8, 10, 12])):
            words[k] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(words)))
    want = brute_components(brute_sets(rows, 2))
    got = minhash_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicates_null_ids_and_repeats(spark):
    got = minhash_dedup.near_duplicates(frame(spark, [(None, "a b c"), (None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c")])).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got) == [
        ("1", 1, True), ("1", 1, True), ("2", 1, False), ("None", None, True), ("None", None, True)
    ]
    assert minhash_dedup.near_duplicates(frame(spark, [])).count() == 0


# ---- repeated spans

def brute_cut(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(raw[p : p + length])
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_spans(spark, monkeypatch, seed):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)  # texts longer than a piece
    monkeypatch.setattr(suffix_dedup, "BATCH", 64)  # many levels
    rng = random.Random(seed)
    base = "".join(rng.choice("ab ") for _ in range(500))
    parts = ["ab" * 80, base[:150], base[50:320], "x" * 130, "é" * 70, base[101:230] + "z", "\0" * 120]
    rows = [(i, "".join(rng.choice([*parts, base[rng.randrange(300):], "y" * rng.randrange(160)]) for _ in range(rng.randrange(6)))) for i in range(90)]
    rows += [(100, None), (101, ""), (102, "q" * 99), (103, base * 8)]
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_cut(rows, 100)


def test_repeated_rows_and_null_ids_of_spans(spark):
    text = "".join(random.Random(6).choices("abcdefgh ", k=300))
    rows = [(5, text), (5, text), (None, text), (5, "other " + text[:200])]
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    twins = [r for r in got if r.doc_id == 5 and r.n_bytes == 300]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert [r.n_removed for r in got if r.doc_id is None] == [300]
    other = next(r for r in got if r.doc_id == 5 and r.n_bytes != 300)
    assert {twins[0].n_removed, other.n_removed} == {0, 200}
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def phrase_rows():
    rng = random.Random(4)
    line = "this line of sixty-odd bytes stands in very many documents."
    rows = [(i, "".join(rng.choices("abcdefgh ", k=120)) + line + "".join(rng.choices("abcdefgh ", k=120))) for i in range(300)]
    # some share the line and one side of it, so that single windows repeat
    return rows + [(300 + i, text[40:220] + str(i)) for i, text in rows[::10]]


def test_windows_of_a_common_gram_spread(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", 40, raising=False)
    dealt = []
    for name in ("scanned", "scanned_windows"):
        def seen(found, *args, run=getattr(suffix_dedup, name)):
            dealt.append(found)
            return run(found, *args)

        monkeypatch.setattr(suffix_dedup, name, seen)
    rows = phrase_rows()
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_cut(rows, 100)
    assert sum(r.n_removed > 0 for r in got) == 30
    most = [d.groupBy("k1").count().agg({"count": "max"}).first()[0] or 0 for d in dealt]
    assert len(most) == 2 and max(most) < 40


@pytest.mark.parametrize("many", [1, 5])
def test_common_grams_change_no_result(spark, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many, raising=False)
    test_repeated_spans(spark, monkeypatch, 3)


# ---- fingerprints

def test_imatch_edits(spark):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(300)]
    rows = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.choice([5, 40, 200])))) for i in range(60)]
    rows += [(1, None), (2, ""), (4, "é" * 7), (5, rows[0][1]), (7, "!!")]
    got = {r.doc_id: r for r in imatch.imatch(frame(spark, rows), least=0.02, most=0.5).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[5].fingerprint == got[0].fingerprint
    longer = [i for i, t in rows if t and len(t) > 300]
    assert sum(got[i].near_edited > got[i].near_next for i in longer) > 0.9 * len(longer)


@pytest.mark.parametrize("broadcast_rows", [imatch.BROADCAST_ROWS, 0])
def test_imatch_likeness_against_brute_force(spark, monkeypatch, broadcast_rows):
    """Subsets agree where the sets of lexicon terms in them are equal; texts without such terms compare as a whole."""
    monkeypatch.setattr(imatch, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 8, 60, 200]))) for _ in range(80)]
    texts += [texts[0], "only here", "only here", "!!", "", None]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    least, most = 0.03, 0.3
    sets = {i: set(re.findall("[a-z0-9]+", t or "")) for i, t in rows}
    seen = Counter(w for s in sets.values() for w in s)
    band = {w for w, n in seen.items() if max(2, least * len(rows)) <= n <= most * len(rows)}
    named = spark.createDataFrame([(w,) for w in sorted(seen)], "w string")
    subsets = {r.w: r.s for r in named.select("w", imatch.subsets_of(F.xxhash64("w")).alias("s")).collect()}

    def prints(words):
        out = {}
        for w in words & band:
            for j in subsets[w]:
                out.setdefault(j, set()).add(w)
        return out or {"whole": words}

    def like(a, b):
        a, b = prints(a), prints(b)
        return sum(a[j] == b.get(j) for j in a) / len(a.keys() | b.keys())

    got = {r.doc_id: r for r in imatch.imatch(frame(spark, rows), least, most).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for k, (i, text) in enumerate(order):
        text, (j, after) = text or "", order[(k + 1) % len(order)]
        half = len(text) // 2
        edited = set(re.findall("[a-z0-9]+", text[: len(text) - half] + (after or "")[:half]))
        # words cut by the edit are in no lexicon of the corpus unless they stand there too
        assert got[i].near_edited == pytest.approx(like(sets[i], edited)), i
        assert got[i].near_next == pytest.approx(like(sets[i], sets[j])), i
    assert got[0].fingerprint == got[80].fingerprint and got[81].fingerprint == got[82].fingerprint


@pytest.mark.parametrize("borders", [1, 2, 3, 50])
def test_ranges_of_places(spark, borders):
    places = [(False, k, h) for k in range(10) for h in (-5, 0, 2**62)] + [(True, 0, h) for h in range(30)]
    firsts = places[:: max(1, len(places) // borders)]
    rows = spark.createDataFrame([(p,) for p in places], "at struct<none:boolean,down:bigint,th:bigint>")
    for r in imatch.range_of(rows, firsts).collect():
        assert r.range == sum(f <= tuple(r["at"]) for f in firsts) - 1


def test_imatch_small_tables(spark):
    assert imatch.imatch(frame(spark, [])).count() == 0
    one = imatch.imatch(frame(spark, [(None, "a b c d")])).collect()
    assert one[0].doc_id is None and one[0].near_next == 1.0
    twice = imatch.imatch(frame(spark, [(1, "a b"), (1, "a b"), (None, "c"), (None, "c")])).collect()
    assert len(twice) == 4
