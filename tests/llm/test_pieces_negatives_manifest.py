"""Piece encoding against the library, hard negatives and the Merkle manifest against brute force, and the cases that their modules state."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracelark.llm import hard_negatives, merkle, piece_bpe

sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")


# --- 11 SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return piece_bpe.Codec(f.read())


def test_pieces_equal_the_library(library, own, corpus):
    rng = random.Random(17)
    bits = [*"aeinrst ▁\n\t0159éü中文字😀<>_-.,;qzAB\0ﬁ\r", "the", "ing", "  ", " ", "\xa0", "<0x41>", "<s>", "।", "»."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x7FF), rng.randint(0x800, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(15)) for _ in range(1000)]
    texts += [" " * k for k in range(40)] + ["a" * k for k in range(40)] + ["x" * 30_000, "ab" * 20_000, "abcdefgh12" * 3000, " " * 30_000, *[t for _, t, _, _ in corpus]]
    ids = [own.encode(t) for t in texts]
    assert ids == [list(x) for x in library.encode(texts)]
    assert all(own.decode(x) == library.decode(x) for x in ids)


def test_any_ids_decode_as_in_the_library(library, own):
    rng = random.Random(18)
    for _ in range(5000):
        ids = [rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids)


def test_backtracking_equals_plain_merging(own):
    """Greedy longest pieces would be wrong here: the merges decide, whatever the units are cut into."""
    rng = random.Random(19)

    def merged(text):
        cut = list(text)
        while len(cut) > 1:
            best, i = min((own.rank.get(cut[i] + cut[i + 1], 1 << 60), i) for i in range(len(cut) - 1))
            if best == 1 << 60:
                break
            cut[i : i + 2] = [cut[i] + cut[i + 1]]
        return cut

    words = ["".join(rng.choice("▁▁enrstaioulchdg.é") for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    assert all(own.parts(w) == merged(w) for w in words)
    greedy = 0
    for w in words:
        at, out = 0, []
        while at < len(w):
            size = next((k for k in range(min(16, len(w) - at), 1, -1) if w[at : at + k] in own.ids), 1)
            out.append(w[at : at + size])
            at += size
        greedy += out == own.parts(w)
    assert greedy < len(words)
    for w in words[:500]:  # cuts change nothing
        assert [p for u in own.cut(w) for p in own.parts(u)] == own.parts(w)


def test_piece_tables_stay_bounded(own, monkeypatch):
    monkeypatch.setattr(piece_bpe, "MEMORY", 50)
    monkeypatch.setattr(piece_bpe, "PAIRS", 50)
    rng = random.Random(20)
    texts = [" ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(20)) for _ in range(30)]
    want = [own.encode(t) for t in texts]
    own.forget()
    assert [own.encode(t) for t in texts] == want and len(own.recent) <= 50 and len(own.pairs) <= 50
    own.forget()


def test_piece_digests_of_all_kinds_of_rows(spark, bad, docs, empty, library):
    for df in (bad, docs):
        got = sorted(map(tuple, piece_bpe.digests(df, PATH).collect()), key=repr)
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = library.encode(r["text"] or "")
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
        assert got == sorted(want, key=repr)
    assert piece_bpe.digests(empty, PATH).count() == 0
    back = piece_bpe.decode(piece_bpe.encode(docs, PATH), PATH)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.select("doc_id", "text").collect()))


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="BPE model"):
        piece_bpe.Codec(b"\x12\x02\x18\x01")


# --- 12 hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, row long, v string, dim int, rank int, score double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 7, "x", 7, 7, 7.0) for i, v, lab in rows], VECTORS)


def brute_negatives(rows, scale, is_anchor, n_pos, n_neg, window):
    least, whole, most = window
    rows = [(i, [int(np.floor(x * scale)) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (ai, av, al) in enumerate(rows):
        if not is_anchor(ai):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(av, v, strict=True)), i, lab == al) for b, (i, v, lab) in enumerate(rows) if b != a and len(v) == len(av)), key=lambda r: r[:2])
        for p, pi in [(-s, i) for s, i, same in scored if same][:n_pos]:
            found = [(-s, i) for s, i, same in scored if not same and least * p <= whole * -s <= most * p][:n_neg]
            out += [(ai, pi, k, i, p, s) for k, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("scale", "dim", "n"), [(256.0, 12, 300), (2.0**26, 5, 120), (3.0, 1, 60), (256.0, 1500, 40)])
def test_negatives_equal_brute_force(spark, monkeypatch, scale, dim, n):
    """Small scales make many ties; large ones need many moduli; long vectors are multiplied in strips."""
    rng = np.random.default_rng(dim)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0.4, 1, dim), 3)], int(rng.integers(0, 3))) for i in range(n)]
    rows += rows[:20]  # repeated rows
    got = hard_negatives.mine(hard_negatives.integers(vectors(spark, rows), F.col("label"), scale), F.col("vec_id") % 5 == 0, 4, 3, (50, 100, 95))
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, scale, lambda i: i % 5 == 0, 4, 3, (50, 100, 95))


def test_tiles_of_any_size_give_the_same_negatives(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(0.3, 1, 8)], int(rng.integers(0, 2))) for i in range(200)]
    table = hard_negatives.integers(vectors(spark, rows), F.col("label"), 256.0)
    mine = lambda: sorted(map(tuple, hard_negatives.mine(table, F.col("vec_id") % 4 == 0, 3, 2, (50, 100, 95)).collect()))
    want = mine()
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "CANDIDATE_BLOCK", 40)
    assert mine() == want and len(want) > 100


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.8, 1.0], 0), (3, None, 1), (4, [], 1), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (None, [1.0, 1.0], 0), (7, [1.0, 2.0], None)]
    rows += [(8, [None, 1.0], 0), (9, [1.0, 1.0, 1.0], 0), (10, [0.0, 0.0], 1), (10, [0.0, 0.0], 0), (11, [-5.0, 0.1], 0), (12, [1e300, 0.0], 0)]
    got = hard_negatives.mine(hard_negatives.integers(vectors(spark, rows), F.col("label"), 256.0), F.col("vec_id") % 10 == 0, 5, 3, (50, 100, 95))
    want = brute_negatives([r for r in rows if r[0] != 12], 256.0, lambda i: i % 10 == 0, 5, 3, (50, 100, 95))
    assert sorted(map(tuple, got.collect())) == want and want
    empty = hard_negatives.integers(vectors(spark, []), F.col("label"), 256.0)
    assert hard_negatives.mine(empty, F.col("vec_id") % 10 == 0, 5, 3, (50, 100, 95)).count() == 0


def test_residues_multiply_exactly():
    rng = np.random.default_rng(5)
    for top, width in ((1, 1), (2**9, 64), (2**27, 64), (2**30, 3), (2**25, 3000)):
        a, b = (rng.integers(-top, top + 1, (7, width)) for _ in range(2))
        a[0], b[0] = top, -top
        primes = hard_negatives.moduli(min(width, hard_negatives.DEPTH), top * top * width)
        assert all(min(width, hard_negatives.DEPTH) * (p // 2) ** 2 < 1 << 24 for p in primes) and len(set(primes)) == len(primes)
        got = hard_negatives.Residues(a, primes).times(hard_negatives.Residues(b, primes), 0, 7)
        assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]


# --- 13 Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    leaf = lambda i, t, lang, src, n: sha("".join(map(enc, (i, src, lang, n, t))))
    trees = defaultdict(list)
    for i, t, lang, src, n in rows:
        forged = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        trees[src].append((i, leaf(i, t, lang, src, n), leaf(i, low(t), lang, src, n) if forged else None))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
        return out

    def path(tree, i):
        out = []
        for level in tree[:-1]:
            a = i // 16 * 16
            out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 16])))
            i //= 16
        return out

    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for n in names:
        trees[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    own = {n: levels([r[1] for r in trees[n]]) for n in names}
    over = levels([own[n][-1][0] for n in names]) if names else []
    out = []
    for k, n in enumerate(names):
        for i, (doc, node, forged) in enumerate(trees[n]):
            steps, h = path(own[n], i) + path(over, k), forged or node
            for a, b in steps:
                h = sha(a + h + b)
            out.append((doc, node, own[n][-1][0], over[-1][0], sha("".join(a + b for a, b in steps)), h, h == over[-1][0]))
    return sorted(out, key=repr)


def manifest_rows():
    rng, rows = random.Random(6), []
    for src, n in {None: 1, "a": 2, "B": 16, "ä": 17, "": 5, "hot": 257, "big": 4300}.items():
        for j in range(n):
            rows.append((rng.choice([j * 7, j * 7, j * 7, None, 3]), rng.choice(["Text A", "lower", None, "", "ÄB"]), rng.choice(["en", None]), src, rng.choice([5, None])))
    return rows + [(j, "T", None, f"s{j}", 1) for j in range(30)]


@pytest.mark.parametrize("step", [1, 2, 3])
def test_manifest_equals_brute_force(spark, step):
    """Trees of no, one and several levels, and more than sixteen sources; what is stored makes no difference."""
    rows = manifest_rows()
    df = spark.createDataFrame([(*r, "x", 7, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, pos long, tree int")
    assert sorted(map(tuple, merkle.audit(df, step).collect()), key=repr) == brute_manifest(rows)


def test_manifest_of_odd_rows(spark, bad, empty):
    rows = [tuple(r) for r in bad.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = sorted(map(tuple, merkle.audit(bad).collect()), key=repr)
    assert got == brute_manifest(rows) and len(got) == 8
    assert merkle.audit(empty).count() == 0
    assert merkle.audit(bad.limit(1)).count() == 1


def test_a_changed_row_changes_all_above_it(spark, docs):
    one = {r["doc_id"]: r for r in merkle.audit(docs).collect()}
    other = {r["doc_id"]: r for r in merkle.audit(docs.withColumn("n_chars", F.when(F.col("doc_id") == 30, 8).otherwise(F.col("n_chars")))).collect()}
    assert one[30]["leaf"] != other[30]["leaf"] and all(one[i]["root"] != other[i]["root"] for i in one)
    assert {i for i in one if one[i]["leaf"] != other[i]["leaf"]} == {30}
    same = {r["source"]: r["doc_id"] for r in docs.collect()}
    assert sum(one[i]["subroot"] != other[i]["subroot"] for i in same.values()) == 1
    forged = {i for i, r in one.items() if not r["verified"]}
    assert forged == {i for i in one if zlib.crc32(str(i).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in docs.where(F.col("doc_id") == i).first()["text"])}
