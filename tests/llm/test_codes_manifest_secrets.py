"""Vector codes, Merkle manifest and secret scans against plain versions of the same rules."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from wakeline.llm import merkle_manifest, secret_scan, vector_codes
from wakeline.llm.vector_codes import equal_average

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# vector codes


def test_search_equals_all_distances_with_ties():
    rng = np.random.default_rng(1)
    for dim, spread in ((1, 3), (4, 4), (8, 60), (8, 2**25)):
        book, x = rng.integers(-spread, spread, (16, dim)), rng.integers(-spread, spread, (3000, dim))
        index, apart = equal_average(x, book)
        gaps = ((x[:, None, :] - book) ** 2).sum(axis=2)
        assert (index == gaps.argmin(axis=1)).all() and (apart == gaps.min(axis=1)).all()


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[int(np.floor(4096 * c)) for c in r[1]] for r in kept]
    dim = len(whole[0])
    cut = [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]
    books = [[v[a:b] for v in whole[:entries]] for a, b in cut]

    def nearest(v, book):
        return min((sum((x - y) ** 2 for x, y in zip(v, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            mine = defaultdict(list)
            for v in whole:
                mine[nearest(v[a:b], books[p])[1]].append(v[a:b])
            books[p] = [[sum(c) // len(mine[i]) for c in zip(*mine[i])] if mine[i] else e for i, e in enumerate(books[p])]
    found = [[nearest(v[a:b], books[p]) for p, (a, b) in enumerate(cut)] for v in whole]
    errors, labels = [sum(d for d, _ in f) for f in found], defaultdict(int)
    for r, e in zip(kept, errors):
        labels[r[2]] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(r[0], "".join(f"{i:02x}" for _, i in f), e, labels[r[2]], sha) for r, f, e in zip(kept, found, errors)]


VECTORS = "vec_id long, embedding array<double>, label int, code string, error long"


@pytest.mark.parametrize("dim", [16, 11, 3])
def test_codes_equal_plain_version(spark, dim):
    rng = random.Random(dim)
    rows = [(k, [round(rng.gauss(0, 0.3), 2) for _ in range(dim)], rng.choice([None, 1, 2])) for k in range(70)]
    rows += [(5, [0.25] * dim, 1), (5, [0.25] * dim, 1), (None, [-0.5] * dim, None), (900, None, 1), (901, [None] * dim, 2)]
    rows += [(902, [float("nan")] * dim, 2), (903, [float("inf")] * dim, 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(3)
    got = rows_of(vector_codes.compress(df), "vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert got == sorted(plain_codes(rows), key=repr)


def test_codes_of_odd_tables(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    few = [(1, [0.5] * 8, 1), (2, [0.5] * 8, 1), (3, [0.1] * 4, 1), (4, [1e300] * 8, None)]
    got = {r.vec_id: r for r in vector_codes.compress(spark.createDataFrame([(*r, "", 0) for r in few], VECTORS)).collect()}
    assert got[1].code == got[2].code == "00" * 8 and got[1].error == 0 and got[1].label_error == 0
    assert got[3].code is None and got[4].error is None and got[4].label_error is None
    unfit = vector_codes.compress(spark.createDataFrame([(1, [1e300] * 8, 1, "", 0)], VECTORS)).collect()
    assert [(r.vec_id, r.code) for r in unfit] == [(1, None)]


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def plain_climb(levels, i, node):
    passed = []
    for row in levels[:-1]:
        first = i - i % 3
        left, right = row[first:i], row[i + 1 : first + 3]
        passed += left + right
        node, i = sha(*left, node, *right), i // 3
    return passed, node


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
    trees = {s: plain_tree([plain_leaf(r) for r in groups[s]]) for s in names}
    upper = plain_tree([trees[s][-1][0] for s in names])
    root, out = upper[-1][0], []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            bad = list(r)
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                bad[4] = r[4].replace("\n", "")
            a, node = plain_climb(trees[s], i, plain_leaf(bad))
            b, node = plain_climb(upper, k, node)
            out.append((r[0], plain_leaf(r), trees[s][-1][0], root, sha(*a, *b), node, node == root))
    return sorted(out, key=repr)


def some_documents():
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "a", "a", "b", "é", "", None]), "en", 3, rng.choice(["x\ny", "", None, "naïve\n", "plain"])) for k in range(120)]
    rows += [(7, "a", None, None, "twice\n")] * 4 + [(None, "a", "de", 1, "q\n"), (None, None, None, None, None), (10**12, "alone", "en", 10**6, "z\n" * 200_000)]
    return rows + [(k, f"s{k % 40}", "en", 1, "many sources") for k in range(200, 240)]


@pytest.mark.parametrize("tier", [1, 2, 7])
def test_manifest_equals_plain_version(spark, tier):
    rows = some_documents()
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS).repartition(4)
    got = merkle_manifest.manifest(df, tier=tier)
    assert rows_of(got, "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified") == plain_manifest(rows)


def test_manifest_of_odd_tables(spark):
    assert merkle_manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0
    (one,) = merkle_manifest.manifest(spark.createDataFrame([(1, None, None, None, "a\nb", "", "")], DOCS)).collect()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")


def test_folding_resumes_kept_states():
    nodes = [sha(str(k)).encode() for k in range(11)]
    tree = merkle_manifest.Subtree(nodes, None)
    assert [len(level) for level in tree.levels] == [11, 4, 2, 1]
    assert [[len(run) for run in kept] for kept in tree.states] == [[3, 3, 3, 2], [3, 1], [2]]
    for i in range(11):
        other = [*nodes[:i], b"f" * 64, *nodes[i + 1 :]]
        assert tree.fold(i, nodes[i]) == tree.top
        assert tree.fold(i, b"f" * 64) == merkle_manifest.Subtree(other, None).top


# secret scans


def plain_secrets(text, reach=secret_scan.REACH):
    text, spans = text or "", []
    for k, kind in enumerate(secret_scan.KINDS):
        for m in re.finditer(kind.pattern, text):
            if len(m.group(kind.group)) >= kind.least and all(re.search(h, m.group()) for h in kind.holds):
                spans.append((m.start(), k, m.end()))
    strong = [s for s in spans if s[1] < 3]
    weak = [s for s in spans if s[1] >= 3 and not any(b[0] < s[2] and s[0] < b[2] for b in strong)]
    blanks = [m.start() for m in re.finditer(secret_scan.BLANK.pattern, text)]
    scope = {s: sum(b <= s[0] for b in blanks) for s in spans}

    def of(names):
        return [s for s in strong + weak if secret_scan.KINDS[s[1]].name in names]

    def near(s, o):
        return scope[s] == scope[o] and s[0] - reach <= o[0] <= s[2] + reach

    out = set()
    for s in of(secret_scan.SECRETS):
        partners = [a for a in of(secret_scan.ACCOUNTS) if near(s, a) and (a[2] <= s[0] or s[2] <= a[0])]
        if partners:
            out |= {s, *partners, *[e for e in of(secret_scan.ENDPOINTS) if near(s, e)]}

    def say(some):
        return ",".join(f"{secret_scan.KINDS[k].name}:{a}:{b}" for a, k, b in sorted(some))

    counts = [sum(s[1] == k for s in strong) for k in range(3)]
    return (*counts, hashlib.sha256(say(strong).encode()).hexdigest(), say(strong + [s for s in out if s[1] >= 3]))


KEY = "AKIA" + "Q7" * 8
PIECES = [
    "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", KEY, "AKIA", "AKIASHORT", "user: bob", "login=é", "pwd = abcd", "pass:1234", "\n", "\n\n", "\n \t\n",
    "https://db.example.org/x", "Zx9Zx9Zx9Zx9Zx9Zx9Zx9Q", "PASSWORD: 'hunter22'", "api_key==abc", "token: token: abcdefgh", "ſecret=longenough", "é" * 90, "word " * 30,
    "deadbeef" * 3, "deadbeef" * 2, "ApiKey\"=\"short", "ftp://h", "account = \"ann@example.org\"", "😀",
]


def test_secrets_equal_plain_version(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(150)] + ["", None, "a", "".join(PIECES)]
    texts += [f"user: bob pwd = abcd {'x' * gap}" for gap in (0, 3)] + [f"user: bob {'.' * gap} pwd = abcd https://h.example" for gap in range(180, 205, 3)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[5])] * 5 + [(3, texts[3])]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, text string, spans string, kind int, row int").repartition(5)
    got = rows_of(secret_scan.secret_scan(df), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert got == sorted([(i, *plain_secrets(t)) for i, t in rows], key=repr)
    assert sum("account" in r[5] for r in got) > 20


def test_weak_parts_need_their_complement(spark):
    texts = {1: "pwd = abcd", 2: "user: bob", 3: "user: bob\npwd = abcd", 4: "user: bob\n\npwd = abcd", 5: f"{KEY} pwd = abcd ftp://h.example"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.secret_scan(df).collect()}
    assert got[1] == got[2] == got[4] == ""
    assert got[3] == "account:0:9,short_secret:10:20"
    assert got[5] == "access:0:20,short_secret:21:31,endpoint:32:47"


def test_secrets_of_very_long_texts_and_no_rows(spark):
    long = "user: bob pwd = abcd " * 20_000 + "a" * 300_000 + " " + "0f" * 100_000
    (row,) = secret_scan.secret_scan(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()
    assert row.n_hex == 2 and row.spans.count("short_secret") == 20_000
    assert secret_scan.secret_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
