"""Brute-force cases of the text operators: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cladeframe.llm import common, dedup, forest, mixing, packing, quality, secrets, simhash, tokens, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h string, start string"
VOCABULARY = [a + b for a in "ba ke lo mi nu ra so ti".split() for b in "na de ri fo lu".split()] + list("abcdefgh")


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "s", "ed"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, prose(rng, rng.choice([3, 40, 120])), f"s{i % 3}" if i % 7 else None) for i in range(60)]
    out += [(60, None, "s0"), (61, "", "s1"), (62, prose(rng, 6000), "s2"), (63, "  two\n words ", "s0"), (None, "no id here at all", "s1")]
    out += [(5, out[5][1], out[5][2]), (64, out[7][1], "s1"), (65, out[8][1] + " tail", "s2"), (66, "ünïcödé ßtraße 漢字 " * 3, "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "k", "h", "x") for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_permutation_is_one_and_buckets_follow_order(spark):
    for n in (1, 2, 5, 64, 1000):
        assert sorted(common.permuted(np.arange(n), n, 9)) == list(range(n))
    df = spark.range(50)
    got = df.select(common.bucket_of(F.col("id"), [3, 10, 40])).collect()
    assert [r[0] for r in got] == [sum(c < i for c in (3, 10, 40)) for i in range(50)]


def test_components(spark):
    rng, n = random.Random(1), 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {v: r for v, r in root.items() if v != r}


def test_simhash_against_brute_force(docs, rows, nothing):
    got = simhash.edited(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t, _ in order]
    want = []
    for k, text in enumerate(texts):
        half, after = len(text) // 2, texts[(k + 1) % len(texts)]
        want.append((order[k][0], len(text), hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest()))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == Counter(want)
    by_text = defaultdict(set)
    of = {i: t or "" for i, t, _ in rows}
    for r in got:
        by_text[of[r["doc_id"]]].add(r["fingerprint"])
        bits = bin(int(r["fingerprint"], 16) ^ int(r["edited_fingerprint"], 16)).count("1")
        assert r["near_edited"] == 1 - bits / 128
    assert max(map(len, by_text.values())) == 1
    assert simhash.edited(nothing).count() == 0


def test_permuted_tables_find_every_fingerprint_in_the_radius(spark):
    rng = random.Random(2)
    prints = [(i, rng.getrandbits(64), rng.getrandbits(64)) for i in range(40)]
    for i in range(40, 200):
        _, high, low = rng.choice(prints)
        for bit in rng.sample(range(128), rng.randrange(10)):
            high, low = (high ^ (1 << bit), low) if bit < 64 else (high, low ^ (1 << (bit - 64)))
        prints.append((i, high, low))
    signed = [(i, h - (1 << 64) if h >> 63 else h, x - (1 << 64) if x >> 63 else x) for i, h, x in prints]
    df = spark.createDataFrame(signed, "id long, high long, low long")
    got = {(r["query"], r["id"], r["apart"]) for r in simhash.within_radius(df, df).collect()}
    first = {}
    for i, h, x in prints:
        first.setdefault((h, x), i)
    want = set()
    for (h, x), i in first.items():
        for (g, y), j in first.items():
            apart = bin(h ^ g).count("1") + bin(x ^ y).count("1")
            if 0 < apart <= 6:
                want.add((i, j, apart))
    assert got == want and want


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>" * 60_000
    pages = [(1, "http://a/ b", "x" * 150), (2, None, "x" * 150), (3, "u\r\nv", None), (4, "", ""), (5, "http://e", big), (6, "http://e", big), (7, "q", "x"), (8, "q", "x"),
             (None, "n", "x" * 150), (9, "crlf", "a\r\n\r\nb" * 40), (9007199254740993, "large", "y" * 120)]
    df = spark.createDataFrame([(*p, "dup") for p in pages], "page_id long, url string, html string, payload_digest string").drop("payload_digest")
    archives = warc.write_archives(warc.record_kinds(df).repartition(2), str(tmp_path), archive_bytes=2000)
    chunks = warc.read_archives(archives, chunk_bytes=5000)
    last = {r["page_id"]: r for r in chunks.filter("last").collect()}
    for page, url, html in pages:
        payload = (html or "").encode()
        same = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        revisit = len(payload) >= 100 and page != min(same)
        r = last[page]
        assert (r["payload_bytes"], r["digest_so_far"], r["uri"]) == (len(payload), hashlib.sha256(payload).hexdigest(), url)
        assert (r["record_type"], r["refers_to"]) == (("revisit", min(same)) if revisit else ("response", None))
    assert chunks.agg(F.max("chunk_bytes")).first()[0] <= 5000
    bodies = {r["page_id"]: r["payload"] for r in warc.join_chunks(chunks).collect()}
    assert bodies[5] == big and bodies[9] == "a\r\n\r\nb" * 40
    none = warc.write_archives(warc.record_kinds(df.limit(0)), str(tmp_path / "none"))
    assert warc.read_archives(none).count() == 0


def test_damaged_archive_is_reported(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "z" * 500)], "page_id long, url string, html string")
    path = warc.write_archives(warc.record_kinds(df), str(tmp_path)).first()["path"]
    whole = open(path, "rb").read()
    open(path, "wb").write(whole[:-9])
    with pytest.raises(ValueError):
        list(warc.archive_chunks(open(path, "rb"), 100, True))


def test_mix_meets_targets(docs, rows, nothing):
    got = mixing.mix(docs).taken().select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    budget, free, target = 1.5 * sum(sizes.values()), set(names), {}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if budget * weight[s] / total > 2 * sizes[s]]
        for s in over or free:
            target[s] = 2 * sizes[s] if over else budget * weight[s] / total
        budget -= sum(target[s] for s in over)
        free = free - set(over) if over else set()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in names)
    again = mixing.mix(docs.repartition(5)).taken().select("doc_id", "size", "taken").collect()
    assert sorted(map(str, again)) == sorted(map(str, [r for r in mixing.mix(docs).taken().select("doc_id", "size", "taken").collect()]))
    assert mixing.mix(nothing).taken().count() == 0


def test_mixed_blocks_hold_the_words_taken(docs):
    plan = mixing.mix(docs, block_words=16, shard_slots=50)
    blocks = plan.blocks(docs).collect()
    words = Counter()
    for b in blocks:
        words[b["source"]] += len(b["text"].split())
    want = {r["source"]: r["n"] for r in plan.taken().groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert dict(words) == {s: n for s, n in want.items() if n}
    assert len({b["shard"] for b in blocks}) > 3 and len({(b["shard"], b["position"]) for b in blocks}) == len(blocks)


def test_packing_against_tokenizers(docs, rows, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs).toPandas()
    for i, text, _ in rows:
        if i in (None, 5):
            continue
        ids = exact.encode(text or "", add_special_tokens=False).ids + [2]
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and list(own.start) == list(own.length.cumsum() - own.length)
        assert all(n == 1024 for n in own.length[1:])
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert ordered.groupby("sequence_id").length.sum().max() <= 1024
    assert len(got[got.doc_id == 5]) == 2 and packing.pack(nothing).count() == 0


@pytest.mark.parametrize("text", ["a  b", "x \n y", "it's 12% <|endoftext|> ok", "tab\t end ", " lead", "  odd  space", "nul\x00 in"])
def test_units_give_the_ids_of_whole_texts(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.UnitEncoder(path).encode(text) == want


def fewest(items, capacity):
    """Exact number of bins by search over sorted items."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= items[i]:
                left = list(bins)
                left.remove(room)
                go(i + 1, left + [room - items[i]])
        go(i + 1, bins + [capacity - items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimum_and_runs_place_all():
    rng = random.Random(8)
    for _ in range(150):
        capacity = rng.choice([10, 17, 24])
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        fixed, rest = packing.dominated(dict(Counter(items)), capacity)
        bins = sum(n for n, _ in fixed)
        left = [w for w, n in rest.items() for _ in range(n)]
        assert Counter(items) == Counter(left) + Counter(w for n, ws in fixed for w in ws * n)
        assert bins + (fewest(left, capacity) if left else 0) == fewest(items, capacity)
        runs, n_seq = packing.plan_runs(dict(Counter(items)), capacity)
        room = Counter()
        for r in runs.itertuples():
            for k in range(r.pieces):
                room[r.sequence + k // r.per] += r.length
        assert sum(room.values()) == sum(items) and max(room.values()) <= capacity and len(room) == n_seq


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_matches_edit_distance():
    rng = random.Random(3)
    lexicon = {"".join(rng.choice("abc") for _ in range(rng.randrange(3, 14))): 1.0 for _ in range(60)}
    names, trie, finder = list(lexicon), toxicity.LexiconTrie(lexicon), toxicity.HitFinder(lexicon)
    for _ in range(400):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 15)))
        for most in (0, 1, 2):
            want = sorted((i, d) for i, w in enumerate(names) if (d := brute_distance(w, word)) <= most)
            assert sorted(trie.within(word, most)) == want
        ok = [d for w in names if (d := brute_distance(w, word)) <= toxicity.allowed_edits(len(w))]
        assert (finder[word] or (0, None))[1] == (min(ok) if ok else None)


def test_quotation_weighs_less_than_abuse():
    finder = toxicity.HitFinder({"scoundrel": 3.0})
    (quoted,), (abuse,) = toxicity.spans_of('he wrote "the scoundrel ran" then', finder), toxicity.spans_of("you scoundrell go", finder)
    assert quoted[5] and quoted[4] < 1 < abuse[4] and abuse[3] == 1


def test_hits_where_lower_case_changes_the_length():
    finder, text = toxicity.HitFinder({"scum": 2.0, "moron": 3.0, "idiotic": 3.0}), "\u0130stanbul: Scum and MORON, \u0130D\u0130OT\u0130C"
    assert [text[s[0]:s[1]] for s in toxicity.spans_of(text, finder)] == ["Scum", "MORON", "\u0130D\u0130OT\u0130C"]
    assert toxicity.features_of(text, finder) == toxicity.features_of(text.replace("\u0130", "I"), finder)
    assert all(len(toxicity.lowered(chr(c))) == 1 for c in range(0x110000))


def test_toxicity_learns_held_out_labels(spark, nothing):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = prose(rng, 40).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scoundrel", "villainous", "wretch"]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    docs += [(900, None, "x"), (901, "", "x"), (None, "you scoundrel", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(900, None), (None, 1)], "doc_id long, toxic int")
    held = toxicity.fold(5, 0)
    model = toxicity.ToxicityModel.fit(toxicity.label_rows(d, lab, "toxic", held, 10_000))
    got = {r["doc_id"]: r["score"] for r in model.score(d.drop("score")).collect()}
    out = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in out]) > 0.95
    assert got[900] == got[901] < 0.5 and got[None] > 0.5
    empty = toxicity.ToxicityModel.fit(toxicity.label_rows(nothing, lab.limit(0), "toxic", held, 100))
    assert empty.score(d.drop("score")).filter("score > 0.5").count() == 0 and empty.score(nothing).count() == 0


def test_boosted_trees_learn_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.BoostedTrees.fit(x[:1000], y[:1000])
    assert ((model.probability(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95

    def walk(row):
        raw, inner = model.base, model.feature.shape[1]
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            k = 0
            while k < inner:
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            raw += leaf[k - inner]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose(model.probability(x[:20]), [walk(r) for r in x[:20]])
    assert quality.BoostedTrees.fit(x[:0], y[:0]).probability(x[:2]).tolist() == [0.5, 0.5]


def test_quality_handles_odd_texts(docs, rows, nothing):
    model = quality.BoostedTrees.fit(np.zeros((0, len(quality.STATISTICS))), np.zeros(0))
    assert quality.score_quality(docs, model).count() == len(rows) and quality.score_quality(nothing, model).count() == 0
    assert all(np.isfinite(quality.statistics_of(t or "")).all() for _, t, _ in rows)


def greedy(word, starts, continues):
    at, count = 0, 0
    while at < len(word):
        pieces = continues if count else starts
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, count = end, count + 1
    return count


def test_token_counts_against_greedy_search(docs, rows, nothing):
    rng = random.Random(5)
    for _ in range(60):
        starts = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(8)}
        continues = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(8)}
        counter = tokens.PieceCounter(starts, continues)
        for _ in range(60):
            word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))
            assert counter[word] == greedy(word, starts, continues), (word, starts, continues)
    import public_tokenizers

    starts, continues = map(set, tokens.vocabulary_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    got = Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in tokens.token_counts(docs).collect())
    want = Counter((i, len((t or "").split()), sum(greedy(w, starts, continues) for w in (t or "").split())) for i, t, _ in rows)
    assert got == want and tokens.token_counts(nothing).count() == 0


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(7)
    element = rng.integers(1, 2**63, 400, dtype=np.uint64)
    w1, w2 = rng.integers(1, 9, 400), rng.integers(1, 9, 400)
    signed = dedup.signatures(np.repeat([0, 1], 400), np.r_[element, element], np.r_[w1, w2], 3)
    truth = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((signed[0] == signed[1]).mean() - truth) < 0.12 and not signed[2].any()
    scaled = dedup.signatures(np.zeros(400, int), element, w1, 1)
    assert (scaled[0] == signed[0]).all()


def test_near_classes_against_brute_force(spark, rows, nothing):
    rng = random.Random(12)
    docs = [(i, t) for i, t, _ in rows]
    for g in range(6):
        base = prose(rng, 150).split()
        for k in range(2 + 5 * g):
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(150)] = f"edit{rng.random()}"
            docs.append((1000 + 100 * g + k, " ".join(words)))
    shared = prose(rng, 100)
    docs += [(3000 + i, shared + " " + prose(rng, 70)) for i in range(25)]
    df = spark.createDataFrame([(i, t, "r", "s") for i, t in docs], "doc_id long, text string, rep string, sha string")

    def shingles(text):
        w = (text or "").split()
        return Counter(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()

    sets = [(i, t or "", shingles(t)) for i, t in docs if i is not None]
    root = {i: i for i, _, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, t, a) in enumerate(sets):
        for j, u, b in sets[:n]:
            both, any_ = sum((a & b).values()), sum((a | b).values())
            if t == u or (any_ and both / any_ >= 0.8 - 1e-9):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = Counter((r["doc_id"], r["class_id"]) for r in dedup.near_classes(df).collect())
    assert got == Counter((i, find(i) if i is not None else None) for i, _ in docs)
    kept = dedup.keep_first(df)
    assert kept.columns == df.columns and kept.count() == len({find(i) for i in root}) + 1
    assert dedup.near_classes(nothing).count() == 0


def base_by_hand(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 6:
            out.append((m.start(), "assign", m.end()))
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    kinds = ("assign", "access", "hex", "model")
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(out, key=lambda x: (x[0], kinds.index(x[1]))))


def test_secrets_against_patterns_and_a_planted_shape(spark, nothing):
    rng = random.Random(9)
    key = lambda n, a="abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMN0123456789": "".join(rng.choice(a) for _ in range(n))
    texts = [None, "", "secret: token=abcdefgh", 'Password = "hunter2xx" é AKIA' + key(16, "ABCDEF0123"), "AKIA123", "x" * 30_000 + " api_key:" + key(900), "toKen=short", "ſecret=abcdefg",
             "AKIAAKIA" + "Z" * 9, key(30, "0123456789abcdef") + " 0123456789abcdef"]
    texts += [f"{prose(rng, 20)} token = {key(40)} {prose(rng, 10)}" for _ in range(120)]
    texts += [f"{prose(rng, 20)} see page-{rng.randrange(10)}/of-the-{prose(rng, 3).replace(' ', '-')}-2 {prose(rng, 5)}" for _ in range(120)]
    texts += [f"{prose(rng, 20)} {key(40)} {prose(rng, 5)}"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "token=abcdef1", "z"), (3, texts[3], "z")], "doc_id long, text string, base string").drop("base")
    got = secrets.find_secrets(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "token=abcdef1" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        base = base_by_hand(text)
        kinds = Counter(x.split(":")[0] for x in base.split(",") if x)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("model")] == [x for x in base.split(",") if x]
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert "model" in spans[len(texts) - 1], "a key without keyword looks like the labelled ones"
    assert sum("model" in spans[i] for i in range(len(texts) - 121, len(texts) - 1)) <= 6
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[0] is None and "hunter2xx" not in clean[3] and clean[6] == texts[6]
    assert secrets.find_secrets(nothing.select("doc_id", "text")).count() == 0


def test_secrets_scores_every_candidate(spark):
    rng = random.Random(12)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    half = "ghp_" + key(24, "0123456789abcdef") + "ZZZZ"
    text = f'login {half} then "xK9pQ2vT7m" code: "p@9X!z7#Qw$4kL%2" qWmZkXvBnTrPdFgHjLsQ end plain words here'
    found = {text[s:e] for s, e in zip(*secrets.candidates_of(text, secrets.base_spans(text))[:2])}
    assert {half, "xK9pQ2vT7m", "p@9X!z7#Qw$4kL%2", "qWmZkXvBnTrPdFgHjLsQ"} <= found
    docs = [(0, text), *((i, prose(rng, 60)) for i in range(1, 40))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {r["doc_id"]: [x.split(":") for x in r["spans"].split(",") if x] for r in secrets.find_secrets(df).collect()}
    model = {text[int(s):int(e)] for k, s, e in spans[0] if k == "model"}
    assert half in model and "p@9X!z7#Qw$4kL%2" in model, "few findings: the network is fitted all the same"
    assert sum(len(spans[i]) for i in range(1, 40)) <= 5
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert "ZZZZ" not in clean[0] and clean[0].endswith("plain words here")
    net = secrets.CharNet.fit(*secrets.made_up(100, 100))
    codes = secrets.made_up(20, 20, seed=5)[0]
    assert np.allclose(net.pooled_logit(codes), net.forward(codes)[3], atol=1e-3)


def test_secrets_learn_from_every_text_and_window(spark):
    rng = random.Random(21)
    texts = [f"{prose(rng, 150)} token = {rng.getrandbits(64):x}{i}" for i in range(100)]
    learning = [t for t in texts if zlib.crc32(t.encode()) % 5]
    # the last by hash of those that are learnt from: one more text than a bounded sample of texts would hold
    last = max(learning, key=lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big", signed=True))
    of = lambda rows: secrets.learn(spark.createDataFrame([(t,) for t in rows], "text string").coalesce(1))
    whole, again, without = of(texts), of(texts), of([t for t in texts if t != last])
    assert all(np.array_equal(a, b) for a, b in zip(whole.params(), again.params())) and whole.threshold == again.threshold
    assert not np.array_equal(whole.conv, without.conv), "no text is left out of the fit"
    windows = sum(int(secrets.windows_of(secrets.encode(t), *secrets.candidates_of(t, [])[:2])[1].sum()) for t in learning)
    keys = secrets.made_up(20, 0)[0]
    assert secrets.learn_along(whole, learning, keys)[0] == windows


def test_secrets_score_along_the_text_like_cut_out_windows():
    rng = random.Random(22)
    net = secrets.CharNet.fit(*secrets.made_up(100, 100))
    texts = ["", "a:bcdefg", "\0abcdefgh\0 é" * 3, prose(rng, 5000)] + [f"password: '{'x9' * n}y' {'Ab3' * n}" for n in range(2, 60)]
    laid = secrets.Laid.of(texts, [secrets.base_spans(t) for t in texts])
    at, stop, _ = secrets.pieces_of(laid.start, laid.end)
    codes = np.concatenate([secrets.windows_of(secrets.encode(t), *secrets.candidates_of(t, secrets.base_spans(t))[:2])[0] for t in texts])
    assert np.array_equal(secrets.cut_out(laid.codes, at, stop), codes)
    assert np.allclose(net.logits(laid.codes, at, stop), net.forward(codes)[3], atol=1e-3)
    assert np.allclose(net.logits(laid.codes, at, stop, blank=True), net.forward(secrets.blanked(codes))[3], atol=1e-3)
    assert secrets.spans_of(texts, net) == [secrets.spans_of([t], net)[0] for t in texts]


def test_secrets_candidates_of_a_group_are_those_of_the_patterns():
    rng = random.Random(23)
    parts = ["token=", "AKIA", "0123456789abcdef", 'secret: "', "password", "==", "deadbeef" * 3, "é", "\0", "\ud800", "\n", " ", "'", ":=", "\x7f", "+/_.-", "Zz9", "\U0001f600"]
    texts = ["", "=", "abcdef", "abcdef=="] + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    laid = secrets.Laid.of(texts)
    assert laid.spans == [secrets.base_spans(t) for t in texts]
    for i, text in enumerate(texts):
        runs = {m.span() for m in re.finditer(r"[A-Za-z0-9+/_.-]{6,}=*", text)}
        values = {m.span(m.lastindex) for m in re.finditer(r"""[:=]\x20*(?:"([^"\n]{6,})"|'([^'\n]{6,})'|([^\s"']{6,}))""", text)}
        own = laid.text == i
        got = [*zip((laid.start[own] - laid.base[i]).tolist(), (laid.end[own] - laid.base[i]).tolist())]
        assert got == sorted(runs | values)
        covered = np.zeros(len(text) + 1, bool)
        for s, _, e in laid.spans[i]:
            covered[s:e] = True
        assert laid.touched[own].tolist() == [bool(covered[s:e].any()) for s, e in got]
        assert laid.whole[own].tolist() == [bool(covered[s:e].all()) for s, e in got]


def test_secrets_take_no_python_call_for_each_candidate():
    rng = random.Random(24)
    texts = [" ".join("".join(rng.choice("bdlmnrst") + rng.choice("aeiou") for _ in range(4)) for _ in range(20_000))]
    net = secrets.CharNet.fit(*secrets.made_up(100, 100))
    net.threshold = 2.0
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        secrets.spans_of(texts, net)
    finally:
        sys.setprofile(None)
    assert 0 < 4 * calls < len(secrets.candidates_of(texts[0], [])[0])


def test_forest_finds_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 900)] + 0.3 * rng.normal(size=(900, 16))
    x[::7] *= 2.5
    vectors = [list(map(float, v)) for v in x]
    for i in range(300, 500):
        vectors[i] = vectors[300]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] + [0.0] * 14), (None, vectors[0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, h int, rank int")
    got = forest.nearest(df, trees=12, bucket_rows=64, effort=3.0).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 900, 20):
        s = x[[300 if 300 <= i < 500 else i for i in range(900)]] @ np.array(vectors[q])
        order = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        mine = found[q]
        assert len(mine) == 20 and all(abs(v - s[i]) < 1e-9 for i, v in mine)
        assert mine == sorted(mine, key=lambda p: (-p[1], p[0])) or all(abs(a[1] - b[1]) < 1e-9 or a[1] > b[1] for a, b in zip(mine, mine[1:]))
        hits += len({i for i, _ in mine} & set(order))
    assert set(found) == set(range(0, 900, 20)) and hits >= 0.9 * 20 * 45
    assert forest.nearest(df.limit(0)).count() == 0


def test_forest_answers_are_whole(spark):
    rng = np.random.default_rng(1)
    unit = lambda n, d: (v := rng.normal(size=(n, d))) / np.linalg.norm(v, axis=1)[:, None]
    pole = unit(1500, 8)
    pole[3] *= 100
    cases = [np.array([[1.0, 0.0], [-1.0, 0.0]]), rng.normal(size=(21, 64)), rng.normal(size=(40, 64)), np.repeat(unit(4, 8), 10, axis=0) + 1e-3 * rng.normal(size=(40, 8)), pole]
    for x, every in zip(cases, (1, 1, 1, 1, 20)):
        df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = forest.nearest(df, query_every=every, bucket_rows=256).groupBy("query_id").agg(F.countDistinct("vec_id").alias("n"), F.max("rank").alias("r")).collect()
        assert {r["query_id"] for r in got} == set(range(0, len(x), every))
        assert all(r["n"] == r["r"] == min(20, len(x) - 1) for r in got)


def test_pipeline_stages(spark, rows):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = common.table(spark, folder, "documents")
    columns = docs.columns
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = common.cut(stage(spark, at, folder))
        assert at.columns == columns, name
    packed = corpus_pipeline.run(spark, folder)
    assert packed.select("doc_id").distinct().join(at.select("doc_id").distinct(), "doc_id", "left_anti").count() == 0
    assert packed.groupBy("doc_id").agg(F.sum(F.when(F.col("piece") == 0, 1)).alias("n")).agg(F.sum("n")).first()[0] == at.count()


def test_texts_of_one_id_are_kept_apart(spark):
    rng = random.Random(31)
    a, b, c = (prose(rng, 80) for _ in range(3))
    data = [(1, a), (1, b), (7, b), (7, c), (7, c), (None, c), (None, None), (9, "")]
    df = spark.createDataFrame([(i, t, "k", 1, "r") for i, t in data], "doc_id long, text string, sha string, first int, row string")
    kept = dedup.keep_first(df)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, a), (1, b), (7, c), (9, "")])
    assert dedup.keep_first(df.limit(0)).count() == 0


def test_long_quoted_values_are_candidates():
    for size in (6, 150, 260, 5000):
        text = f'the code: "{"k$" * (size // 2)}" ends'
        start, end, _, _ = secrets.candidates_of(text, [])
        assert (11, 11 + size) in set(zip(start.tolist(), end.tolist()))


def test_pipeline_stages_with_odd_rows_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    texts = [prose(rng, 60) for _ in range(12)]
    data = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s1", 1), (None, texts[4], None, None, None), (20, None, "en", "s0", None), (21, "", "en", None, 0)]
    labels = [(i, 1, i % 2) for i in range(6)] + [(None, 1, 1), (7, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    extra = ["f", "score", "h", "copies", "row", "sha", "id", "col"]
    df = spark.createDataFrame([(*d, *["x"] * len(extra)) for d in data], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, df, str(tmp_path)))
        assert out.columns == df.columns and out.filter("f <> 'x' or score <> 'x' or copies <> 'x'").isEmpty(), name
        assert common.cut(stage(spark, df.limit(0), str(tmp_path))).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).select("doc_id").distinct().count() == 15
