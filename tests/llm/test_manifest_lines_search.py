"""Brute-force cases of the manifest, the line filter and the reversed search."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cladeframe.llm import lines, manifest, reversed_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, tree string, key string, pos int, term string, item string"
SHARED = "This line is long enough to count and many documents hold it."


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = "alpha Beta gamma DELTA été Straße 漢字 x1 2024 foo_bar naïve".split()
    out = []
    for i in range(70):
        text = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 12, 30]))) for _ in range(rng.randrange(1, 6))]
        if i % 3 == 0:
            text.insert(rng.randrange(len(text) + 1), rng.choice([SHARED, f"\t {SHARED.upper()}\r", f"{SHARED}\x0b "]))
        if i % 9 == 0:
            text += ["", "ÉTÉ " * 12, "ÉTÉ " * 12]
        if 10 < i < 15:
            text.append("exactly four documents hold this other long line")
        out.append((i * 3, "\n".join(text), rng.choice(["en", "de", None, "fr"]), f"s{i % 2}", len(text[0])))
    out += [(300, None, "one", None, None), (301, "", "en", "s", 0), (302, "\n\n", "en", "s", 2), (None, SHARED, "en", "s", 5), (None, f"{SHARED}\nmore", None, "s", 5)]
    out += [(303, (SHARED + "\n" + "tail word\n" * 3) * 400, "de", "s", 9), (0, out[0][1], out[0][2], out[0][3], out[0][4]), (3, "same id, other text\n" + SHARED, "en", "s", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "h", "t", "k", 3, "x", "y") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def test_shared_lines_against_brute_force(docs, rows, nothing):
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(plain_key(line)) >= 40:
                holders[plain_key(line)].add(-1 if i is None else i)
    frequent = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    assert plain_key(SHARED) in frequent and not any("exactly four" in k for k in frequent)
    want = Counter()
    for i, text, *_ in rows:
        parts = (text or "").split("\n")
        kept = [p for p in parts if frequent.get(plain_key(p), i) == i]
        want[i, "\n".join(kept), len(parts), len(parts) - len(kept)] += 1
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in lines.drop_shared_lines(docs).collect())
    assert got == want
    assert lines.drop_shared_lines(nothing).count() == 0


def test_line_filter_stays_in_the_jvm(docs):
    plan = lines.drop_shared_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def plain_tree(leaves, arity):
    """Root, and for each leaf the list of (before, after) on its way up."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = level[i // arity * arity:i // arity * arity + arity]
            paths[leaf].append(("".join(run[:i % arity]), "".join(run[i % arity + 1:])))
            at[leaf] = i // arity
        level = [sha(*level[i:i + arity]) for i in range(0, len(level), arity)]
    return level[0], paths


def climb_plain(leaf, path):
    for before, after in path:
        leaf = sha(before, leaf, after)
    return leaf


def plain_leaf(i, text, lang, source, n):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*map(enc, (i, source, lang, n, text)))


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_against_brute_force(docs, rows, arity):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda t: t[:3])
        trees[g] = plain_tree([t[2] for t in groups[g]], arity)
    root, upper = plain_tree([trees[g][0] for g in names], arity)
    want = Counter()
    for n, g in enumerate(names):
        for (_, _, leaf, r), path in zip(groups[g], trees[g][1]):
            path = path + upper[n]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            folded = climb_plain(plain_leaf(*r[:4], r[4] + 1) if hit else leaf, path)
            want[r[0], leaf, trees[g][0], root, sha(*[b + a for b, a in path]), folded, folded == root] += 1
    leaves = manifest.document_leaves(docs).selectExpr("group", "place", "hash", "doc_id", "coalesce(struck, hash) AS shown")
    found = manifest.build(leaves, arity)
    got = Counter(tuple(r) for r in found.checked("shown").select("doc_id", "hash", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert got == want and {True, False} == {k[-1] for k in got}


def test_manifest_of_nothing_and_of_deep_trees(spark, nothing):
    assert manifest.build(manifest.document_leaves(nothing).drop("struck")).checked().count() == 0
    big = spark.range(700).selectExpr("'g' AS `group`", "id AS place", "sha2(cast(id AS string), 256) AS hash")
    root, paths = plain_tree([sha(str(i)) for i in range(700)], 2)
    got = manifest.build(big).checked().select("hash", "proof_sha256", "verified", "root").collect()
    assert {(r[0], r[1]) for r in got} == {(sha(str(i)), sha(*[b + a for b, a in p])) for i, p in enumerate(paths)}
    assert all(r["verified"] and r["root"] == root for r in got)


def plain_terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(rows, items, k=20):
    texts = [Counter(plain_terms(r[1])) for r in rows]
    n_docs, n_words = sum(map(bool, texts)), sum(t.total() for t in texts)
    df = Counter(w for t in texts for w in t)
    out = Counter()
    for item, text in items:
        scored = []
        for r, tf in zip(rows, texts):
            m = 75 + 25 * tf.total() * n_docs // n_words if n_words else 75
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 12 * m)) for w in plain_terms(text) if tf[w])
            if score > 0:
                scored.append((-score, r[0] is None, r[0] or 0))
        out.update((item, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scored)[:k]))
    return out


ITEMS = [(1, "alpha ALPHA été 漢字"), (2, "tail word, foo_bar 2024"), (3, None), (4, "!!"), (None, "Straße"), (5, "unseen"), (1, "gamma x1"), (6, "alpha ALPHA été 漢字")]


def test_reversed_search_against_brute_force(spark, docs, rows, nothing, monkeypatch):
    items = spark.createDataFrame([(*i, "x", 1) for i in ITEMS], "item_id long, text string, term string, rank int")
    want = plain_search(rows, ITEMS)
    got = Counter(tuple(r) for r in reversed_search.search(docs, items).select("item_id", "rank", "doc_id", "score").collect())
    assert got == want
    monkeypatch.setattr(reversed_search, "ITEMS", 3)
    monkeypatch.setattr(reversed_search, "POSTINGS", 4)
    again = Counter(tuple(r) for r in reversed_search.search(docs, items).select("item_id", "rank", "doc_id", "score").collect())
    assert again == want
    assert reversed_search.search(nothing, items).count() == 0
    assert reversed_search.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_across_pieces():
    text = ("Größe abc,DEF " * 50 + "x" * 90).encode()
    for step in (1, 7, 64, 10_000):
        assert reversed_search.words_of(text, step) == Counter(w.encode() for w in plain_terms(text.decode()))
    assert reversed_search.words_of(b"") == Counter()
