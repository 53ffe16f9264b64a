"""The pipeline's stages one after the other against brute-force versions, and on awkward rows."""

import hashlib
import re

import pytest

import corpus_pipeline
from tracelark.llm import bpe, mixing, toxicity

from .test_operators import brute_components

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    """documents and labels of a small corpus: every ninth text is made toxic by one of two words."""
    path = tmp_path_factory.mktemp("corpus")
    rows = []
    for i, text, lang, source in corpus:
        insult = "wretchful" if i % 2 else "scoundrelly"
        rows.append((i, f"{text} {insult} and {insult}" if i % 9 == 4 else text, lang, source, len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 4)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def without_later_copies(rows, length):
    """The texts of rows (doc_id, text) without strings of so many bytes that began earlier, in order of doc_id and place."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                cover[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        out[i] = bytes(x for x, c in zip(b, cover, strict=True) if not c).decode()
    return {i: t for i, t in out.items() if t.strip() or not dict(rows)[i].strip()}


def test_stages_equal_brute_force(spark, folder, tmp_path):
    path, rows = folder
    docs, outs = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, path).write.parquet(out)
        docs = outs[name] = spark.read.parquet(out)
    assert all(outs[name].columns == NAMES for name, _ in corpus_pipeline.STAGES[:-1])
    # every toxic document goes, and no other
    kept = {i: t for i, t, *_ in rows if not re.search("wretchful|scoundrelly", t)}
    assert {r["doc_id"]: r["text"] for r in outs["toxicity"].collect()} == kept
    # of each component of five-word shingles at 0.8 the smallest doc_id stays
    parts = brute_components(list(kept.items()), 5, 80, 100)
    kept = {i: kept[i] for i, (_, root) in parts.items() if i == root}
    assert {r["doc_id"]: r["text"] for r in outs["ngram_join"].collect()} == kept
    kept = without_later_copies(list(kept.items()), corpus_pipeline.PASSAGE)
    assert {r["doc_id"]: r["text"] for r in outs["suffix_dedup"].collect()} == kept
    # as many copies of each document as the plan says, and each encodes to the library's tokens
    planned = {r["doc_id"]: r["copies"] for r in mixing.plan(outs["suffix_dedup"]).collect() if r["copies"]}
    got = [r["doc_id"] for r in outs["mixing"].collect()]
    assert {i: got.count(i) for i in got} == planned and all(n >= 1 for n in planned.values())
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in outs["bpe"].collect()]
    want = []
    for i in got:
        ids = library.encode_ordinary(kept[i])
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(kept[i].encode()).hexdigest()))
    assert sorted(encoded) == sorted(want)
    assert sorted(tuple(r)[:4] for r in corpus_pipeline.run(spark, path).collect()) == sorted(want)


def test_stages_cope(spark, folder, bad, empty):
    path, _ = folder
    for name, stage in corpus_pipeline.STAGES:
        for docs in (bad, empty):
            out = stage(spark, docs, path)
            assert name == "bpe" or out.columns == docs.columns
            assert 0 < out.count() <= 3 * 8 if docs is bad else out.count() == 0
    assert toxicity.REJECT == 0.5
