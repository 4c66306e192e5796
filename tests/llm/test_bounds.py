"""Memory and work that don't grow with the input."""

from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np

from quoteloom.llm import packing, tokens


def test_words_age_and_asked_ones_stay(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 50)
    e = tokens.Encoder(tokens.vocabulary_path())
    learnt = []
    merge = e._merge
    e._merge = lambda words: (learnt.extend(words), merge(words))[1]
    want = e.tokenizer.encode("of the house", add_special_tokens=False).ids
    for i in range(300):
        assert e.encode(f"of the house {'ab' * (i % 7)}x{i} \ty{i}  z").size > 3
        assert e.encode("of the house").tolist() == want
        assert len(e.known) + len(e.older) <= 2 * 50 + 20
    assert learnt.count("house") == 1  # a frequent word isn't forgotten with the rare ones
    e.clear()
    assert not e.known and not e.older


def test_pack_gets_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word ', id, '.') AS text").coalesce(1)
        whole = [tuple(r) for r in packing.pack_documents(docs).collect()]
        assert int(spark.conf.get(name)) == 1000
        spark.conf.set(name, "7")
        assert [tuple(r) for r in packing.pack_documents(docs).collect()] == whole  # what is packed doesn't depend on the batches
        assert spark.conf.get(name) == "7"
        assert np.unique([r[0] for r in whole]).size == 3000
    finally:
        spark.conf.set(name, before)


def test_re_pair_rounds_leave_settled_places_alone(monkeypatch):
    from quoteloom.llm import token_files

    # a phrase that doubles needs a round a doubling; the other places have pairs that occur once
    phrase = np.arange(50_000, 50_002, dtype=np.uint32)
    rare = np.random.default_rng(1).integers(0, 40_000, 60_000).astype(np.uint32)
    docs = [(1, rare), (2, np.tile(phrase, 1 << 12)), (3, np.zeros(0, np.uint32))]
    sorted_places = []
    unique = np.unique
    monkeypatch.setattr(token_files.np, "unique", lambda x, **kw: (sorted_places.append(len(x)), unique(x, **kw))[1])
    s = token_files.re_pair(docs)
    assert [d.tolist() for d in s.documents()] == [d.tolist() for _, d in docs]
    assert len(sorted_places) >= 10 and sum(sorted_places[2:]) < 10_000


def test_words_of_many_texts_are_learnt_together():
    e = tokens.Encoder(tokens.vocabulary_path())
    runs, model = [], e.model
    e.model = SimpleNamespace(tokenize=lambda run: (runs.append(run), model.tokenize(run))[1])
    name = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(4))
    texts = [f"on {name(3 * k)}, {name(3 * k + 1)}é.\n{name(3 * k)} 12{name(3 * k + 2)}" for k in range(200)]
    got = [ids.tolist() for ids in e.encode_each(texts)]
    assert got == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(runs) < 60  # some 800 distinct words, 50 in a run; a text by itself needs at least one


def test_words_are_cut_only_where_the_library_cuts(monkeypatch):
    chance = random.Random(7)
    signs = [*"aabcdeslt  \n\n\t\r\x0b''..,!?#|0123é’ñ\u00a0\u2003\u3000\u0085\x1c\x00²½日本\u0308😀👍🏽ǅªⅧ٣\u200d", "<|endoftext|>", " the", "'s", "'ll", "\r\n"]
    texts = ["".join(chance.choices(signs, k=chance.choice([0, 1, 2, 3, 5, 9, 30, 80]))) for _ in range(3000)]
    for e in (tokens.Encoder(tokens.vocabulary_path()), tokens.Encoder(tokens.vocabulary_path(), special=False)):
        want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [ids.tolist() for ids in e.encode_each(texts)] == want
        monkeypatch.setattr(tokens, "STEP", 20)
        assert [ids.tolist() for ids in e.encode_each(texts)] == want


def test_large_rounds_leave_no_pair_waiting(monkeypatch):
    from quoteloom.llm import token_files

    # 79,999 pairs that occur twice, thousands of which share a slot of the hash with another
    half = np.random.default_rng(3).permutation(80_000).astype(np.uint32)
    docs = [(1, half), (2, half.copy())]
    rounds = []
    monkeypatch.setattr(token_files, "_ranked", lambda *a, own=token_files._ranked: (rounds.append(own(*a)), rounds[-1])[1])
    s = token_files.re_pair(docs)
    assert [d.tolist() for d in s.documents()] == [d.tolist() for _, d in docs] and len(s.symbols) == 2
    a, b, rank, whole = rounds[0]
    assert whole and len(a) == 79_999 and (rank[:79_999] == rank[79_999:]).all()
    assert (a[rank[:79_999]] == half[:-1]).all() and (b[rank[:79_999]] == half[1:]).all()
