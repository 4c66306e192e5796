"""The pipeline stage by stage, each on its predecessor's output, against plain Python; targets of the mix against water-filling."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_near_clusters import components

import corpus_pipeline
from quoteloom.llm import langid, mixing, tokens
from quoteloom.llm.common import stored

KIND = "doc_id long, text string, lang string, source string, n_chars long, key string, row int"
EN = "the of and in to a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie".split()


def rows():
    rng = random.Random(5)
    say = lambda words, n: " ".join(rng.choices(words, k=n))
    out = [(i, say(EN if i % 3 else DE, rng.randint(20, 90)), "en" if i % 3 else "de", f"s{i % 4}") for i in range(120)]
    base = say(EN, 80).split()
    out += [(200 + i, " ".join(base), "en", "s1") for i in range(5)]  # copies
    for i in range(5):  # near copies
        w = list(base)
        w[3 * i] = "changed"
        out.append((300 + i, " ".join(w), "en", "s2"))
    out += [(400, None, "en", "s0"), (401, "", None, None), (402, "123 456 !!", "en", "s0"), (403, "日本語 テスト 文章 です", None, "s1"), (404, say(EN, 9_000), None, None), (None, say(EN, 40), "en", "s3"), out[0], (405, out[1][1], "en", None)]
    return [(*r, len(r[1] or ""), "k", i) for i, r in enumerate(out)]


def plain(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_stages_on_their_predecessors(spark):
    docs = stored(spark.createDataFrame(rows(), KIND).repartition(3))
    columns = docs.columns
    model = langid.fit(docs)
    given = plain(docs)

    first = stored(corpus_pipeline.language_id(spark, docs, ""))
    want = [(i, t, lang if lang is not None else model.predict(t)[0], s) for i, t, lang, s in given if not model.predict(t)[2]]
    assert first.columns == columns and Counter(plain(first)) == Counter(want)
    assert not {400, 401, 402, 403} & {r[0] for r in plain(first)} and 404 in {r[0] for r in plain(first)}

    second = stored(corpus_pipeline.exact_dedup(spark, first, ""))
    best = {}
    for i, t, _, _ in plain(first):
        best[t] = max(best.get(t, (-1,)), (-1,) if i is None else (i,))
    got = plain(second)
    assert second.columns == columns and Counter(t for _, t, _, _ in got) == Counter(best.keys())
    assert all((-1 if i is None else i) == best[t][0] for i, t, _, _ in got)

    third = stored(corpus_pipeline.near_dedup(spark, second, ""))
    number = {k: r for k, r in enumerate(sorted(got, key=lambda r: (r[0] is None, r[0] or 0)))}
    keep = Counter()
    for k, _, low in components([(k, r[1]) for k, r in number.items()], 5, 80):
        if k == low:  # numbered by doc_id, so the component's smallest number is its smallest doc_id
            keep[number[k]] += 1
    assert third.columns == columns and Counter(plain(third)) == keep
    assert len(set(range(300, 305)) & {r[0] for r in plain(third)}) + (204 in {r[0] for r in plain(third)}) < 6

    fourth = stored(corpus_pipeline.mix_sources(spark, third, ""))
    sizes = Counter()
    for _, t, _, s in plain(third):
        sizes[s] += len(t.split())
    targets = water_fill(sizes)
    taken, copies = Counter(), Counter(plain(fourth))
    for _, t, _, s in plain(fourth):
        taken[s] += len(t.split())
    assert fourth.columns == columns and set(copies) <= set(plain(third)) and max(copies.values()) <= 3
    longest = {s: max(len(t.split()) for _, t, _, o in plain(third) if o == s) for s in sizes}
    assert all(abs(taken[s] - targets[s]) <= longest[s] for s in sizes)

    enc = tokens.encoder()
    whole = Counter()
    for _, t, _, _ in plain(fourth):
        whole[np.append(np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32), np.uint32(1)).tobytes()] += 1
    pieces = corpus_pipeline.pack(spark, fourth, "").collect()
    assert sum(r["length"] for r in pieces) == sum(len(k) // 4 * n for k, n in whole.items())
    crcs = Counter({zlib.crc32(k): 0 for k in whole})
    for k, n in whole.items():
        crcs[zlib.crc32(k)] += n
    uncut = Counter(r["ids_crc32"] for r in pieces if r["start"] == 0 and r["length"] == r["doc_tokens"])
    assert all(crcs[c] >= n for c, n in uncut.items())
    filled = Counter()
    for r in pieces:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048


def water_fill(sizes, cap=3):
    """Targets by the definition: shares by weight, what stands above cap times the size shared anew until none does."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / open_ for s in order}
        new = {s for s in order if s not in full and target[s] > cap * sizes[s]}
        if not new:
            return target
        full |= new


@pytest.mark.parametrize("seed", range(3))
def test_targets_are_water_filling(spark, seed):
    rng = random.Random(seed)
    sizes = {(None if i == 7 else f"s{i:02d}"): rng.choice([1, 5, 40, 900, 10_000]) for i in range(2 + 6 * seed)}
    frame = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, nodes long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    want = water_fill(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_equal_rows_are_spread(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", None)] * 900 + [(2, "g h", "y", None)] * 10, "doc_id long, text string, source string, lang string").repartition(4)
    got = mixing.mix(df).collect()
    taken = Counter()
    for r in got:
        taken[r["doc_id"]] += r["taken"]
    want = water_fill({"x": 5400, "y": 20})
    assert len(got) == 910 and abs(taken[1] - want["x"]) <= 6 and abs(taken[2] - want["y"]) <= 2
    again = Counter((r["doc_id"], r["taken"]) for r in mixing.mix(df.repartition(7)).collect())
    assert again == Counter((r["doc_id"], r["taken"]) for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], KIND)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, ""))
        assert docs.columns == [c.split()[0] for c in KIND.split(", ")] and docs.count() == 0
    assert corpus_pipeline.pack(spark, docs, "").count() == 0
