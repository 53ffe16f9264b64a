"""Every operator against a brute-force version, and on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tracelark.llm import bpe, classifier, components, levenshtein, license_scan, mixing, nearest, ngram_join, quality_rules, suffix_dedup, toxicity, trie_join, url_filter

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- 1 quality rules


def test_quality_counts_equal_brute_force(docs, corpus, bad, empty):
    got = by_id(quality_rules.judge(docs))
    for i, text, _, _ in corpus:
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        seen, covered = Counter(grams), set()
        for k, g in enumerate(grams):
            if seen[g] > 1:
                covered |= {k, k + 1, k + 2}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(covered))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["kept"] is False if r["base_failed"] else isinstance(r["kept"], bool)
    rows = quality_rules.judge(bad).collect()
    assert len(rows) == 8 and all(r["base_failed"] for r in rows)
    assert next(r for r in rows if r["doc_id"] == 5)["n_repeat_words"] == 40_000
    assert quality_rules.judge(empty).count() == 0


def test_fences_follow_their_group(spark):
    """What is common in one source is far out in another; the sketches' fences equal those of sorted lists, up to a bucket's width."""
    rng = random.Random(21)
    rows = []
    for i in range(400):
        n, code = rng.randint(60, 90), i % 2 == 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(6, 14) if code else rng.randint(2, 8))) for _ in range(n)]
        words = [w + "$" if code and rng.random() < 0.3 else w for w in words]
        if i in (101, 103):  # prose with the symbols and long words of code
            words = [w + "abcdefg$" for w in words]
        rows.append((i, " ".join(words), "en", "code" if code else "prose"))
    got = by_id(quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert sorted(i for i, r in got.items() if not r["kept"]) == [101, 103]
    limits = {src: {tuple(r[f"max_{m}"] for m in quality_rules.MEASURES) for r in got.values() if r["source"] == src} for src in ("code", "prose")}
    assert all(len(x) == 1 for x in limits.values()) and limits["code"] != limits["prose"]
    for src, fence in limits.items():
        for (m, (percent, size)), value in zip(quality_rules.MEASURES.items(), next(iter(fence)), strict=True):
            own, sizes = (sorted(r[c] for r in got.values() if r["source"] == src) for c in (m, size))
            at = lambda p, own=own: own[(len(own) * p + 99) // 100 - 1]
            typical = at(50, sizes)
            noise = {"repeat_rate": 30_000 // typical, "mean_word": int(at(50) / typical**0.5)}.get(m, 10_000 // typical)
            want = at(percent) + 3 * max(at(percent) - at(50), noise)
            assert abs(value - want) <= 0.04 * (4 * at(percent) + 3 * at(50)) + 1


def test_sketch_buckets_order_numbers_and_keep_small_ones(spark):
    values = sorted({*range(300), *(2**k + d for k in range(6, 40) for d in (-1, 0, 1))})
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bucket("v").alias("b")).select("v", "b", quality_rules.lower_edge(quality_rules.F.col("b")).alias("low")).orderBy("v").collect()
    assert all(a["b"] <= b["b"] for a, b in zip(rows, rows[1:], strict=False))
    assert all(r["low"] <= r["v"] < max(r["low"] + 1, r["low"] * 1.04) for r in rows)


# --- 2 URL filters


def test_hosts_paths_and_rules(spark):
    urls = {
        1: ("HTTPS://WWW.Example.ORG/es/1?x#y", ("www.example.org", "/es/1", "example.org/es/", "block")), 2: ("http://a.com/fr/", ("a.com", "/fr/", "com/fr/", "allow")), 3: (None, ("", "", None, "allow")), 4: ("no scheme", ("", "", None, "allow")),
        5: ("x://example.org", ("example.org", "", None, "block")), 6: ("x://example.org/en/12", ("example.org", "/en/12", "example.org/en/1", "block")), 7: ("x://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow")), 8: ("http://é.com?a/b", ("é.com", "", None, "allow")),
    }
    pages = spark.createDataFrame([(k, u, None, 1) for k, (u, _) in urls.items()], "page_id long, url string, html string, host int")
    assert {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages).collect()} == {k: v for k, (_, v) in urls.items()}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_ranks_equal_power_iteration(spark):
    rng = random.Random(3)
    hosts = [f"h{i}" for i in range(12)]
    edges = sorted({(rng.choice(hosts), rng.choice(hosts)) for _ in range(30)} - {(h, h) for h in hosts})
    seeds = {"h0": 2.0, "h3": 1.0}
    got = {r["host"]: r["rank"] for r in url_filter.personalised_rank(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(list(seeds.items()), "host string, weight double"), 8).collect()}
    restart = {h: w / 3 for h, w in seeds.items()}
    rank, out = dict(restart), Counter(s for s, _ in edges)
    for _ in range(8):
        new = defaultdict(float)
        for s, d in edges:
            new[d] += 0.85 * rank.get(s, 0) / out[s]
        left = 1 - sum(new.values())
        for h, w in restart.items():
            new[h] += left * w
        rank = new
    assert sum(got.values()) == pytest.approx(1) and got == pytest.approx({h: r for h, r in rank.items() if r or h in got}, abs=1e-12)


def test_ranks_reach_the_solution_of_the_linear_system(spark):
    n = 30
    edges = [(i, i + 1) for i in range(n - 1)] + [(n - 1, 0), (4, 9), (9, 4), (12, 3)]  # a ring: ways of 29 links
    seeds = {0: 1.0, 5: 3.0}
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    ranks = url_filter.personalised_rank(make([(f"h{a}", f"h{b}") for a, b in edges], "src string, dst string"), make([(f"h{h}", w) for h, w in seeds.items()], "host string, weight double"), within=1e-6)
    pass_on, restart = np.zeros((n, n)), np.zeros(n)
    for a, b in edges:
        pass_on[b, a] = 1 / sum(s == a for s, _ in edges)
    for h, w in seeds.items():
        restart[h] = w / 4
    want = np.linalg.solve(np.eye(n) - 0.85 * pass_on, 0.15 * restart)
    got = {r["host"]: r["rank"] for r in ranks.collect()}
    assert sum(abs(got.get(f"h{i}", 0.0) - want[i]) for i in range(n)) <= 1e-6


def test_distrust_flows_against_links(spark):
    page = lambda i, url, *to: (i, url, "".join(f'<a href="http://{h}/">x</a><a HREF=//{h}/y>x</a>' for h in to))
    rows = [page(1, "http://bad.com/de/1"), page(2, "http://farm.net/1", "bad.com"), page(3, "http://good.org/1", "fine.net"), page(4, "http://fine.net/2"), page(5, "http://far.net/1", "farm.net"), page(6, "http://alone.net/")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow"}


# --- 3 license scans


def test_license_phrases_and_templates(spark, bad, empty):
    rows = [(1, "x Released under the MIT License. Licensed under the Apache License, Version 2.0.\nGNU general PUBLIC license"), (2, "the mit of licenses"), (3, "Licensed under CC BY-NC 4.0."), (4, "words " * 50 + license_scan.TEMPLATES[1][1] + " tail")]
    got = by_id(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    r = got[1]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (18, 3, 4, 15, "apache,gpl,mit")
    assert (got[2]["n_base"], got[2]["labels"], got[2]["score"], got[2]["first_word"]) == (0, "", 0.0, None)
    assert (got[3]["labels"], got[3]["base_labels"], got[3]["score"]) == ("cc-by-nc", "", 1.0)
    assert got[4]["labels"] == "mit" and got[4]["score"] == 1.0
    rows = license_scan.scan(bad).collect()
    assert len(rows) == 8 and {r["n_words"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0} and license_scan.scan(empty).count() == 0


def test_license_labels_do_not_depend_on_other_files(spark):
    few = [(1, "under the terms of the Mozilla Public License, v. 1.1, see there"), (2, "Licensed under CC BY-NC 3.0."), (3, "Redistribution and use in source and binary forms, with or without modification, are allowed"), (4, "mozilla public or licensed under cc by")]
    full = " ".join(t for _, t, _ in license_scan.TEMPLATES) + " v 2 0 4"
    hot = [(100 + i, full) for i in range(8)] + [(200 + i, "plain words") for i in range(8)]
    schema = "doc_id long, text string"
    alone = by_id(license_scan.scan(spark.createDataFrame(few, schema)))
    crowd = by_id(license_scan.scan(spark.createDataFrame(few + hot, schema)))
    assert [alone[i]["labels"] for i, _ in few] == ["mpl", "cc-by-nc", "bsd", ""]
    assert all(alone[i] == crowd[i] for i, _ in few)
    assert set(crowd[100]["labels"].split(",")) == {label for label, *_ in license_scan.TEMPLATES}


def brute_licenses(templates, words):
    """Labels and best score by trying each template at each place."""
    labels, score = set(), 0.0
    for label, t, phrases in templates:
        for start in range(-len(t), len(words)):
            window = words[max(0, start) : max(0, start + len(t))]
            if all(any(window[k : k + len(p)] == p for k in range(len(window))) for p in phrases):
                labels.add(label)
                score = max(score, sum(0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(t)) / len(t))
    return labels, score


def some_licenses(rng, texts):
    """Parts of texts with words changed, left out and put in."""
    words = []
    for _ in range(rng.randint(1, 4)):
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(t))
            t[k : k + rng.randint(0, 1)] = [b"x"] * rng.randint(0, 1)
        words += t[rng.randint(0, 2) :]
    return words


def test_license_places_equal_brute_force():
    rng = random.Random(7)
    index = license_scan.Index(license_scan.TEMPLATES, 10, {})
    templates = [(label, license_scan.words_of(t.encode()), [license_scan.words_of(p.encode()) for p in phrases]) for label, t, phrases in license_scan.TEMPLATES]
    for _ in range(300):
        words = some_licenses(rng, [t for _, t, _ in templates])
        assert index.scan(words, index.lead_words.intersection(words)) == brute_licenses(templates, words)


def test_hundreds_of_templates_cost_what_a_file_has():
    """300 templates over few words, with shared phrases; looked at are only those whose phrases a file has."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(120)]
    raw = []
    for i in range(300):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(4, 14))]
        cut = lambda text=text: " ".join(text[(k := rng.randrange(len(text) - 2)) : k + rng.randint(1, 3)])
        raw.append((f"l{i % 90}", " ".join(text), tuple(cut() for _ in range(rng.randint(1, 2)))))
    index = license_scan.Index(raw, 1000, {w.encode(): i for i, w in enumerate(vocabulary)})
    templates = [(label, t.encode().split(), [p.encode().split() for p in phrases]) for label, t, phrases in raw]
    for _ in range(40):
        words = some_licenses(rng, [t for _, t, _ in templates]) + [rng.choice(vocabulary).encode() for _ in range(10)]
        assert index.scan(words, index.lead_words.intersection(words)) == brute_licenses(templates, words)
    looked_at = Counter()

    class Seen(list):
        def __getitem__(self, t):
            looked_at[t] += 1
            return super().__getitem__(t)

    index.templates = Seen(index.templates)
    index.scan(templates[0][1], index.lead_words.intersection(templates[0][1]))
    assert 0 < len(looked_at) < 40


# --- 4 BPE


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_tokens_equal_the_library(vocabulary, corpus):
    import tiktoken

    ranks = bpe.read_ranks(vocabulary[0])
    own, other = bpe.Codec(ranks, vocabulary[1]), tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = [t for _, t, _, _ in corpus[:40]] + ["", " ", "\n\n  x", "a" * 5000, "<|endoftext|>", "it's we'll 12 345", "\u2028\x85\xa0 \u3000"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x3000, 0xD7FF), rng.randrange(0x10000, 0x3FFFF)])) for _ in range(60)) for _ in range(200)]
    texts += [f"a{chr(c)}a {chr(c)}1" for low, high in bpe.NEWER for c in (low, high)]
    for t in texts:
        ids = own.encode(t)
        assert ids == other.encode_ordinary(t) and own.decode(ids) == t.encode()


def test_perfect_hash_is_minimal():
    keys = [bytes([a, b]) for a in range(40) for b in range(30)]
    table = bpe.PerfectHash(keys, list(range(len(keys))))
    assert table.n == len(keys) and all(table.get(k) == i for i, k in enumerate(keys)) and table.get(b"zz") is None and table.get(b"") is None


def test_bpe_round_trip_in_spark(spark, docs, corpus, bad, empty, vocabulary):
    got = by_id(bpe.decode(bpe.encode(docs, *vocabulary), *vocabulary))
    assert all(bytes(got[i]["text"]).decode() == t for i, t, _, _ in corpus)
    rows = bpe.digests(bad, *vocabulary).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 8 and all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (0, nothing, nothing) for r in rows if r["doc_id"] in (1, 2))
    assert bpe.digests(empty, *vocabulary).count() == 0


# --- 5 classifier


def test_classifier_learns_and_copes(spark, bad, empty):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma."]) + ("***" if i % 3 == 0 else "") for _ in range(60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, quality int")
    stats = classifier.statistics(docs)
    model = classifier.learn(stats, labels, "quality")
    got = by_id(classifier.score(stats, model))
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.5) == (i % 3 != 0) for i, r in got.items())
    assert classifier.score(classifier.statistics(bad), model).count() == 8
    assert classifier.score(classifier.statistics(empty), model).count() == 0
    flat = classifier.learn(stats, labels.where("quality = 1"), "quality")
    assert {r["score"] for r in classifier.score(stats, flat).collect()} == {1.0}


def test_classifier_equals_a_direct_solve(spark, docs, corpus):
    """Weights of the summed normal equations against one solve over all training rows, and scores against the cosines taken one by one."""
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i, *_ in corpus], "doc_id long, quality int")
    stats = classifier.statistics(docs)
    model = classifier.learn(stats, labels, "quality")
    rows = {r["doc_id"]: [r[c] for c in classifier.STATISTICS] for r in stats.collect()}
    training = [i for i in sorted(rows) if zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([rows[i] for i in training]), np.array([float(i % 3 != 0) for i in training])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    k = model.kernel
    assert np.allclose(k.mean, mean) and np.allclose(k.scale, scale)

    def features(v):
        v = np.clip((v - mean) / scale, -8, 8)
        return np.array([1.0, *v, *[np.sqrt(2 / classifier.FEATURES) * np.cos(sum(v * k.w[:, j]) + k.b[j]) for j in range(classifier.FEATURES)]])

    z = np.array([features(v) for v in x])
    weights = np.linalg.solve(z.T @ z + classifier.RIDGE * len(y) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(model.weights, weights, atol=1e-6)
    got = by_id(classifier.score(stats, model))
    for i, v in rows.items():
        assert got[i]["score"] == pytest.approx(min(1.0, max(0.0, float(np.interp(features(np.array(v)) @ weights, model.places, model.values)))), abs=1e-5)


def test_cosines_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(5)
    d = len(classifier.STATISTICS)
    x = rng.normal(size=(60, d)) * 0.7
    z = classifier.Kernel(np.zeros(d), np.ones(d))(x)[:, 1 + d :]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * d))
    assert np.abs(z @ z.T - exact).mean() < 0.1


def test_pooling_is_monotone():
    places, values = classifier.pool(np.arange(6.0), np.array([1.0, 1, 2, 1, 1, 1]), np.array([0.0, 1, 0, 1, 0, 1]))
    assert (np.diff(values) >= 0).all() and (np.diff(places) > 0).all()


# --- 6 n-gram join


def brute_components(rows, k, num, den):
    sets = {}
    for i, text, *_ in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "num", "tokens"), [(3, 90, 2_000_000), (5, 80, 2_000_000), (3, 50, 400)])
def test_components_equal_brute_force(docs, corpus, monkeypatch, k, num, tokens):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", tokens)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(docs, k, num, 100).collect()}
    assert got == brute_components(corpus, k, num, 100)


def test_join_copes(bad, empty):
    rows = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.linked(bad, 3, 90, 100).collect())
    assert [r for r in rows if r[0] in "1234"] == [("1", 0, 1), ("2", 0, 2), ("3", 0, 3), ("4", 2, 4), ("4", 2, 4)] and ("None", 8, None) in rows
    assert ngram_join.linked(empty).count() == 0
    left = ngram_join.drop_near_copies(bad)
    assert left.columns == bad.columns and left.count() == 7


def test_trie_groups_equal_pairs():
    rng = random.Random(1)
    for _ in range(60):
        num = rng.choice([90, 80, 50])
        bases = [[rng.getrandbits(64) for _ in range(rng.randint(1, 50))] for _ in range(3)]
        sets = []
        for _ in range(rng.randint(2, 70)):
            x = list(rng.choice(bases))
            for _ in range(rng.randint(0, 5)):
                x.pop(rng.randrange(len(x))) if rng.random() < 0.5 and len(x) > 1 else x.append(rng.getrandbits(64))
            sets.append(np.unique(np.array(x, dtype=np.uint64)))
        own = [set(x.tolist()) for x in sets]
        root = list(range(len(sets)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a in range(len(sets)):
            for b in range(a):
                n = len(own[a] & own[b])
                if 100 * n >= num * (len(own[a]) + len(own[b]) - n):
                    root[find(a)] = find(b)
        got = trie_join.groups(sets, num, 100)
        assert len(set(zip(got, map(find, range(len(sets))), strict=True))) == len(set(got)) == len({find(i) for i in range(len(sets))})


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        most = ngram_join._differ(2 * len(a), 80, 100) // 2
        b = np.unique(np.concatenate([rng.permutation(a)[most:], rng.integers(0, 2**63, most).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert set(ngram_join.signatures(a, 80, 100)[0].tolist()) & set(ngram_join.signatures(b, 80, 100)[0].tolist())


def lookalikes():
    """Texts that share passages of a small stock, by fives and by chance, and copies of some of them with a few to many words changed."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    stock = [[word() for _ in range(30)] for _ in range(40)]
    rows = []
    for i in range(90):
        words = [w for _ in range(rng.choice([4, 12])) for w in (rng.choice(stock) + [word() for _ in range(30)])]
        if i % 3 == 2:
            words = list(rng.choice(rows[: i // 2])[1])
            for _ in range(rng.randint(0, len(words) // 25)):
                words[rng.randrange(len(words))] = word()
        rows.append((i, words))
    return [(i, " ".join(words)) for i, words in rows]


def texts_of(spark, rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


@pytest.mark.parametrize(("k", "num", "tokens", "few"), [(5, 80, 1_000_000, 8), (3, 90, 1_000_000, 8), (2, 60, 2_500, 8), (2, 60, 2_500, 2), (2, 60, 2_500, 1_000)])
def test_lookalikes_equal_brute_force(spark, monkeypatch, k, num, tokens, few):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(ngram_join, "FEW", few)
    rows = lookalikes()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(texts_of(spark, rows), k, num, 100).collect()}
    assert got == brute_components(rows, k, num, 100) and len({c for _, c in got.values()}) < len(rows)


def test_passages_string_no_blocks_together(spark, monkeypatch):
    rng, sizes = random.Random(8), []
    stock = [[f"w{rng.randrange(3000)}" for _ in range(30)] for _ in range(60)]
    texts = [" ".join(w for _ in range(40) for w in rng.choice(stock) + [f"w{rng.randrange(3000)}" for _ in range(30)]) for _ in range(60)]
    keep = ngram_join.materialize

    def noted(df, name):
        out = keep(df, name)
        if name == "blocks":
            sizes.extend(r["count"] for r in out.groupBy("block").count().collect())
        return out

    monkeypatch.setattr(ngram_join, "materialize", noted)
    got = ngram_join.linked(texts_of(spark, enumerate([*texts, texts[7] + " end"])), 5, 80, 100)
    assert [r["component_id"] for r in got.orderBy("doc_id").collect()] == [*range(60), 7]
    assert sizes == [2]


def test_large_groups_take_no_time_for_each_pair():
    import time

    rng = np.random.default_rng(2)
    base, sets = rng.integers(0, 2**63, 400).astype(np.uint64), []
    for i in range(2000):  # half of them beyond the threshold
        keep = rng.random(400) >= (0.02, 0.08)[i % 2] * rng.random() * 2
        sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**63, int((~keep).sum())).astype(np.uint64)])))
    began = time.process_time()
    got = trie_join.groups(sets, 90, 100)
    assert time.process_time() - began < 10  # a walk for each set took far longer
    near = {i for i in range(2000) if len(np.intersect1d(sets[i], base)) >= 390}
    assert len({got[i] for i in near}) == 1 and len(set(got)) > 200


def test_connected_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(200, 260)] + [(300, 300)]
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, **{i: 100 for i in range(200, 260)}}


# --- 7 toxicity


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if a == b:
        return True
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_automaton_equals_edit_distance():
    terms = [("wretch", True), ("scum", True), ("vilex", False)]
    lex = levenshtein.Lexicon(terms)
    lut = levenshtein.classes(lex.letter)
    rng = random.Random(8)
    words = ["wretch", "wretcg", "wrtech", "wreth", "wrettch", "scum", "scun", "vilexen", "vilxen", "vielxa", "vile", "", "WRETCH", "wr3tch"]
    words += ["".join(rng.choice("wretchscumvilexq") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    words = [w for w in words if w]
    text = " ".join(words)
    own = lut[np.frombuffer(text.encode(), np.uint8)]
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    got = levenshtein.walk(lex.table, lex.found, own, starts, starts + [len(w) for w in words])
    for w, g in zip(words, got.tolist(), strict=True):
        w = "".join(levenshtein.LEET.get(c, c) for c in w.lower())
        hits = [(0 if w == t else 1, k) for k, (t, whole) in enumerate(terms) if whole and (w == t or (len(t) >= 5 and one_edit(t, w)))]
        hits += [(0 if w.startswith(t) else 1, k) for k, (t, whole) in enumerate(terms) if not whole and (w.startswith(t) or any(one_edit(t, w[:n]) for n in range(len(t) - 1, len(t) + 2)))]
        assert g == (2 * min(hits)[1] + min(hits)[0] if hits else -1), w


def test_lexicon_over_several_tables_equals_one(monkeypatch):
    rng = random.Random(13)
    terms = [("".join(rng.choice("abcd") for _ in range(rng.randint(4, 7))), bool(rng.getrandbits(1))) for _ in range(12)]
    one = levenshtein.Lexicon(terms)
    monkeypatch.setattr(levenshtein, "STATES", len(one.table) // 3)
    several = levenshtein.Tables(terms)
    words = ["".join(rng.choice("abcdx") for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    own = levenshtein.classes(one.letter)[np.frombuffer(" ".join(words).encode(), np.uint8)]
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    ends = starts + [len(w) for w in words]
    a, b = levenshtein.walk(one.table, one.found, own, starts, ends), several.walk(own, starts, ends)
    assert len(several.parts) > 1 and several.letter == one.letter and (a >= 0).sum() > 50
    assert ((a >= 0) == (b >= 0)).all() and (a % 2 == b % 2)[a >= 0].all() and (a == b).mean() > 0.99


def test_toxicity_keeps_every_telling_term(spark):
    rng = random.Random(14)
    insults = ["".join(rng.choice("aeioubdgkmnqrstvxz") for _ in range(7)) for _ in range(240)]
    rows = [(i, " ".join(f"plain{rng.randrange(300)}" for _ in range(20)) + (" " + " ".join(rng.sample(insults, 30)) if i % 3 == 0 else "")) for i in range(600)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    terms = toxicity.learn_lexicon(toxicity.sample(docs, labels, "toxic"))
    missed = [w for w in insults if not any(w == t if whole else w.startswith(t) for t, whole in terms)]
    assert not missed


def test_toxicity_tells_quotation_from_abuse_and_keeps_impure_terms(spark):
    rng = random.Random(15)
    rows, labels = [], []
    for i in range(1600):
        words = [f"plain{rng.randrange(300)}" for _ in range(30)]
        toxic = i % 8 == 0
        if toxic:
            words.insert(7, "wretchful" if i % 16 else "scoundrel")
        elif i % 8 == 1:
            words[7:7] = ["he", "said", '"wretchful"', "and", "left"]
        elif i % 80 == 2:
            words.insert(7, "scoundrel")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert {("wretchful", True), ("scoundrel", True)} <= set(model.lexicon.terms)
    assert all(got[i] >= 0.5 for i in range(0, 1600, 8)) and all(got[i] < 0.5 for i in range(1, 1600, 8))


def test_toxicity_learns_words_beginnings_and_misspellings(spark, bad, empty):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abdegilmnoprtu") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            words.insert(5, rng.choice(["wretchful", "scoundrelx", "zyxo" + rng.choice(["ab", "ed", "ino"])]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(9001, "what a wretchfull thing " * 3), (9002, 'he said "wretchful" and left the room'), (9003, "plain words only")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    assert ("wretchful", True) in model.lexicon.terms and any(t.startswith("zyx") and not whole for t, whole in model.lexicon.terms)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 6 == 0) for i in range(900))
    assert got[9001] >= 0.5 > got[9002] > got[9003]
    assert toxicity.reject(docs, model).count() == 750 + 2
    assert toxicity.score(bad, model).count() == 8 and toxicity.reject(bad, model).columns == bad.columns and toxicity.score(empty, model).count() == 0
    none = toxicity.learn(docs, marks.limit(0))
    assert {r["score"] for r in toxicity.score(bad, none).collect()} == {0.0}


def test_toxicity_score_equals_brute_force(spark, docs, corpus):
    """Scores of a given lexicon and weights: every word against every term by edit distance, context looked up by hand."""
    terms = [("wretch", True), ("vilex", False), ("scum", True)]
    weight = {f: 0.9 / (1 + f % 7) for f in range(8 * len(terms))}
    model = toxicity.Model(levenshtein.Tables(terms), 0.05, weight)
    rng, rows = random.Random(6), []
    forms = ["wretch", "wretcg", "wrtech", "Wretch", "vilex", "vilexen", "vixlex", "scum", "scun", "wr3tch"]
    for i in range(150):
        words = [rng.choice(["plain", "he", "said", "word", "you", "are", "and", *forms]) for _ in range(rng.randint(0, 25))]
        words = [f'"{w}"' if rng.random() < 0.2 else w for w in words]
        rows.append((i, "".join(w + rng.choice([" ", " ", ", ", "\n"]) for w in words)))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        seen = Counter()
        for m in re.finditer(r"[^\W_]+", text):
            w = "".join(levenshtein.LEET.get(c, c) for c in m.group().lower())
            hits = [(0 if w == t else 1, k) for k, (t, whole) in enumerate(terms) if whole and (w == t or (len(t) >= 5 and one_edit(t, w)))]
            hits += [(0 if w.startswith(t) else 1, k) for k, (t, whole) in enumerate(terms) if not whole and (w.startswith(t) or any(one_edit(t, w[:n]) for n in range(len(t) - 1, len(t) + 2)))]
            if not hits:
                continue
            left = text[max(0, m.start() - toxicity.CONTEXT) : m.start()].split("\n")[-1]
            right = text[m.end() : m.end() + toxicity.CONTEXT].split("\n")[0]
            marks = any(q in left for q in toxicity.QUOTES) and any(q in right for q in toxicity.QUOTES)
            bare = lambda ws: [x.strip(toxicity.QUOTES + ",.") for x in ws]
            near = bare(left.lower().replace(":", " ").split()[-6:])
            value = 0.6 * marks + 0.3 * any(x in toxicity.REPORTING for x in near) - 0.3 * any(x in toxicity.ADDRESS for x in near[-3:] + bare(right.lower().split()[:3]))
            edits, term = min(hits)
            seen[term, edits, value >= 0.5] += 1
        rest = 0.95
        for (term, edits, quoted), n in seen.items():
            rest *= 1 - weight[8 * term + 4 * edits + 2 * quoted + (n > 1)]
        assert got[i] == pytest.approx(1 - rest), (i, text)


# --- 8 suffix dedup


def covered(raw, length, seen):
    cover = bytearray(len(raw))
    for s in range(len(raw) - length + 1):
        if seen[raw[s : s + length]] > 1:
            cover[s : s + length] = b"\1" * length
    return cover


def brute_repeats(rows, length, passage):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = {n: Counter(b[s : s + n] for _, b in raw for s in range(len(b) - n + 1)) for n in (length, passage)}
    out = []
    for i, b in raw:
        cover = covered(b, length, seen[length])
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        runs = [m.span() for m in re.finditer(b"\1+", covered(b, passage, seen[passage]))]
        words = [sum(x <= m.start() and m.end() <= y for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)) for x, y in runs]
        row = (i, len(b), sum(cover), sum(bool(c) and (p == 0 or not cover[p - 1]) for p, c in enumerate(cover)), hashlib.sha256(kept).hexdigest())
        out.append((*row, max((y - x for x, y in runs), default=0), sum(w > 50 for w in words)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "passage", "crowd"), [(400, 200, 4_000), (60, 60, 4_000), (120, 50, 0)])
def test_repeats_equal_brute_force(docs, corpus, monkeypatch, length, passage, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 20_000)
    assert sorted((tuple(r) for r in suffix_dedup.digest(docs, length, passage).collect()), key=str) == brute_repeats(corpus, length, passage)


@pytest.mark.parametrize("crowd", [4_000, 0])
def test_first_copies_stay(docs, corpus, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    length, seen, want = 60, set(), {}
    for i, t, *_ in sorted(corpus):
        b, cover = t.encode(), bytearray(len(t.encode()))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                cover[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        want[i] = bytes(x for x, c in zip(b, cover, strict=True) if not c).decode()
    got = {r["doc_id"]: r for r in suffix_dedup.cleaned(docs, length).collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: t for i, t in want.items() if t.strip()}
    assert all(r["n_chars"] == (len(r["text"]) if want[i] != corpus[i][1] else 7) for i, r in got.items())


@pytest.mark.parametrize("first", [False, True])
def test_factors_equal_brute_force(first):
    """Longest previous and other factors of random segments, periodic ones and ones cut short by a text's end among them."""
    rng = random.Random(3)
    for _ in range(200):
        alphabet, low = rng.choice(["ab", "abc", "abcdefgh", "a"]), rng.choice([3, 5, 9])
        levels = tuple(sorted({low, rng.choice([low, low + 2, 2 * low, 4 * low])}))
        base, pieces = "".join(rng.choice(alphabet) for _ in range(60)), []
        for i in range(rng.randint(2, 8)):
            at, n = rng.randrange(30), rng.randint(low, low + 25)
            p = list(base[at : at + n]) if rng.random() < 0.7 else [rng.choice(alphabet) for _ in range(n)]
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "z"
            pieces.append((10 * rng.randint(0, 3) + i, rng.randint(0, 5), rng.randint(1, len(p) - low + 1), "".join(p).encode()))
        strings = [(i, s + o, p[o:]) for i, s, n, p in pieces for o in range(n)]
        want = {
            (i, s, level)
            for level, length in enumerate(levels)
            for x, (i, s, t) in enumerate(strings)
            for y, (j, r, u) in enumerate(strings)
            if x != y and len(t) >= length and t[:length] == u[:length] and (not first or (j, r) < (i, s))
        }
        assert {(i, s, level) for i, a, b, level in suffix_dedup.factor_runs(pieces, levels, first) for s in range(a, b + 1)} == want


def test_longest_factors_of_one_text():
    rng = random.Random(4)
    for _ in range(30):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(2, 120))).encode()
        starts = np.arange(len(text))
        got = suffix_dedup.Factors(np.frombuffer(text + suffix_dedup.END, np.uint8), starts, starts, len(text) - starts, 50)
        common = lambda i, j, text=text: next((k for k in range(50) if i + k >= len(text) or j + k >= len(text) or text[i + k] != text[j + k]), 50)
        assert got.previous.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in range(len(text))]
        assert got.other.tolist() == [max((common(i, j) for j in range(len(text)) if j != i), default=0) for i in range(len(text))]


def test_only_starts_of_shared_strings_are_sorted(monkeypatch):
    """Of segments that share an anchor, but hardly a string, few bytes go into the suffix order; before, all of them did."""
    rng, sorted_bytes, real = random.Random(5), [], suffix_dedup.Factors
    monkeypatch.setattr(suffix_dedup, "Factors", lambda data, *rest: sorted_bytes.append(len(data)) or real(data, *rest))
    some = lambda n: bytes(rng.choices(range(97, 123), k=n))
    pieces = [(i, 7, 60, some(60) + b"anchor" + some(120)) for i in range(50)]
    for first in (False, True):
        assert suffix_dedup.factor_runs(pieces, (40, 90), first) == [] and not sorted_bytes
    both = [*pieces, (60, 3, 60, pieces[4][3][20:80] + b"#" + some(125)), (61, 0, 60, pieces[9][3][:140] + b"#" + some(45))]
    assert sorted(suffix_dedup.factor_runs(both, (40, 90), False)) == sorted([(4, 27, 47, 0), (60, 3, 23, 0), (9, 7, 66, 0), (61, 0, 59, 0), (9, 7, 57, 1), (61, 0, 50, 1)])
    assert sorted(suffix_dedup.factor_runs(both, (40, 90), True)) == sorted([(60, 3, 23, 0), (61, 0, 59, 0), (61, 0, 50, 1)])
    assert max(sorted_bytes) <= 2 * (60 + 149 + 2) < sum(len(p[3]) for p in both) / 20


def test_strings_of_crowded_anchors_are_hashed_a_batch_at_a_time():
    """Two Arrow batches for a slice of segments, not two for each segment; equal strings have equal hashes wherever they lie."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab", k=rng.randint(12, 30))).encode() for _ in range(300)]
    rows = [(i, 5 * i, rng.randint(1, 12), t) for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["id", "first", "n", "piece"])
    out = list(suffix_dedup._string_hashes((8, 12))(iter([batch])))
    assert len(out) == 2
    got = [r for b in out for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    want = {(level, i, s + o): p[o : o + z] for level, z in enumerate((8, 12)) for i, s, n, p in rows for o in range(min(n, len(p) - z + 1))}
    assert {(level, i, s) for level, _, _, i, s in got} == set(want) and len(got) == len(want)
    assert len({(level, g1, g2, want[level, i, s]) for level, g1, g2, i, s in got}) == len(set(want.values())) == len({r[:3] for r in got})


def test_suffix_dedup_copes(spark, bad, empty):
    from .conftest import BAD

    assert sorted((tuple(r) for r in suffix_dedup.digest(bad, 400, 200).collect()), key=str) == brute_repeats(BAD, 400, 200)
    assert suffix_dedup.digest(empty).count() == 0 and suffix_dedup.cleaned(empty).columns == empty.columns
    assert suffix_dedup.cleaned(bad, 400).count() == 8
    text = "".join(random.Random(1).choice("abc") for _ in range(500))
    rows = [(None, text), (7, text + "x"), (7, "y" + text), (None, "z" + text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in suffix_dedup.digest(df, 400, 200).collect()), key=str) == brute_repeats(rows, 400, 200)


# --- 9 nearest neighbours


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 7)
    monkeypatch.setattr(nearest, "CANDIDATE_BLOCK", 40)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[100:140] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] * 8), (None, x[3].tolist()), (904, []), (950, [1e30] * 16), (951, [1e-30] * 16), (1000, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in nearest.nearest(df, nearest.F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ids = np.array([*range(300), 950, 951])
    v = np.vstack([x, np.full((2, 16), 1.0)]).astype(np.float64)
    norm = np.sqrt((v * v).sum(1))
    for q in [0, 50, 100, 150, 200, 250, 950]:
        k = int(np.flatnonzero(ids == q)[0])
        score = (v * v[k]).sum(1) / (norm * norm[k])
        want = sorted((-round(s, 12), i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if i != q)[:5]
        assert [i for i, _ in got[q]] == [i for _, i in want] and np.allclose([s for _, s in got[q]], [-s for s, _ in want], atol=1e-12)
    assert 1000 not in got and nearest.nearest(df.limit(0), nearest.F.col("vec_id") % 50 == 0, 5).count() == 0


def test_rows_of_one_vector_take_one_place_of_the_bound(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1, (x[0] * (2.0 + i)).tolist()) for i in range(5)] + [(2, (x[0] + 0.01 * rng.normal(size=16)).tolist()) for _ in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    best = {}
    for i, v in rows[1:]:
        v = np.array(v)
        best[i] = max(best.get(i, -1.0), float(v @ x[0] / np.sqrt((v @ v) * (x[0] @ x[0]))))
    want = sorted(best, key=lambda i: (-best[i], i))[:5]
    got = nearest.nearest(df, nearest.F.col("vec_id") == 0, 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == want and np.allclose([r["score"] for r in got], [best[i] for i in want], atol=1e-12)


# --- 10 mixing


def test_targets_and_taken(docs, corpus, bad, empty):
    rows = mixing.plan(docs).collect()
    size = defaultdict(int)
    for _, t, _, s in corpus:
        size[s] += len(WORD.findall(t))
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(size))}
    target, free = {}, set(size)
    while True:
        left, total = sum(size.values()) - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * size[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 3.0 * size[s] for s in over}
        free -= set(over)
    taken = Counter()
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) < 1 for s in target)
    again = {(r["doc_id"], r["taken"], r["first_position"]) for r in mixing.plan(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"], r["first_position"]) for r in rows}
    assert mixing.plan(bad).count() == 8 and mixing.plan(empty).count() == 0 and mixing.mix(bad).columns == bad.columns


def test_positions_invert_the_demand(spark):
    knots = ((0.0, 1.0), (0.3, 2.0), (0.7, 0.5), (1.0, 1.5))
    df = spark.createDataFrame([(k / 50,) for k in range(51)], "u double").select("u", mixing.inverse_demand(mixing.F.col("u"), knots).alias("t"))
    total = sum((a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in zip(knots, knots[1:], strict=False))

    def demand(t):
        out = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            x = min(max(t - t0, 0.0), t1 - t0)
            out += w0 * x + (w1 - w0) / (2 * (t1 - t0)) * x * x
        return out / total

    assert all(demand(r["t"]) == pytest.approx(r["u"], abs=1e-12) for r in df.collect())


def test_mixed_documents_come_in_order_of_position(docs):
    planned = {r["doc_id"]: r for r in mixing.plan(docs).collect()}
    got = [r["doc_id"] for r in mixing.mix(docs).collect()]
    assert Counter(got) == Counter({i: r["copies"] for i, r in planned.items() if r["copies"]})
    firsts = [planned[i]["first_position"] for i in dict.fromkeys(got)]
    assert firsts == sorted(firsts)
