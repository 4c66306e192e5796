"""Ranked search, whitening and personal data against brute force, on nulls, empty and long texts, ties, repeated rows and odd columns."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quoteloom.llm import pii, pii_examples, wavelet_search, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k=20):
    """The contract, literally."""
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        rows = []
        for i, b, n in bags:
            m = 75 + (25 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t in words(text) if t in b)
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes", [200, 1 << 20])
def test_search(spark, shard_bytes):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "STRASSE", "x-y", "日本", "a" * 70, "A" * 70, "b" * 70]
    docs = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (1 + j) for j in range(len(vocabulary))], k=rng.randint(1, 60)))) for i in range(150)]
    docs += [(200 + i, docs[7][1]) for i in range(40)] + [docs[7], docs[7], (None, docs[7][1]), (400, None), (401, ""), (402, "-- !!"), (403, "w1 " * 3_000), (-5, docs[7][1])]
    items = [(1, docs[7][1]), (2, "w1 w1 w2"), (3, None), (4, ""), (5, "nothing here"), (6, "x y 日本 über STRASSE"), (7, "a" * 70 + " w59"), (2, "w1 w1 w2"), (8, docs[7][1])]
    d = spark.createDataFrame([(x, i, t, 0) for i, t in docs for x in [9]], "df int, doc_id long, text string, item int").repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    got = [tuple(r) for r in wavelet_search.search(d, q, shard_bytes=shard_bytes).collect()]
    assert sorted(got, key=str) == ranked(docs, items)
    assert [tuple(r) for r in wavelet_search.search(d, q, k=3, block=2).where("item_id = 1").orderBy("rank").collect()] == sorted((r for r in ranked(docs, items, 3) if r[0] == 1), key=lambda r: r[1])
    assert wavelet_search.search(d.where("false"), q).count() == 0 and wavelet_search.search(d, q.where("false")).count() == 0


def test_hashes_that_meet_take_another_seed(monkeypatch):
    data = np.frombuffer(b"aa bb aa cc", np.uint8)
    real = wavelet_search.hashes
    monkeypatch.setattr(wavelet_search, "hashes", lambda d, s, e, seed: np.full(len(s), 7, np.uint64) if seed < 2 else real(d, s, e, seed))
    row = wavelet_search.build_shard(np.array([1]), data, np.array([0, len(data)]), 1, 4)
    assert row["seed"] == 2 and len(row["hashes"]) == 3 * 8


def test_whitening(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 12)) * np.linspace(1, 3, 12) * 0.05
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5, [float(v) for v in x[5]])]
    bad = [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, [0.5] * 3)]
    df = spark.createDataFrame([(i, v, 0, "c") for i, v in rows + bad], "vec_id long, embedding array<float>, n int, x string").repartition(3)
    got = whitening.whiten(df, k=4).collect()
    c = np.array([[float(np.float32(v)) for v in r] for _, r in rows])
    v = np.floor(1024 * c).astype(np.int64) + 100_000
    n, s = len(v), v.sum(0)
    dev = n * v - s
    cov = (dev / n).T @ (dev / n) / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = (dev / n) @ vectors[:, :4] / np.sqrt(values[:4])
    assert len(got) == 4 * n and {r["n"] for r in got} == {n} and got[0]["identity_error"] < 1e-9
    by = {(r["vec_id"], r["component"]): r for r in got}
    for j in range(4):
        mine = np.array([by[i, j + 1]["whitened"] for i, _ in rows])
        assert np.abs(mine * np.sign(mine @ want[:, j]) - want[:, j]).max() < 1e-8
        assert abs(by[0, j + 1]["explained"] - values[j] / np.trace(cov)) < 1e-9
    assert all(by[i, 1]["deviation"] == int((dev[k] ** 2).sum()) for k, (i, _) in enumerate(rows))
    assert whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(df.where("vec_id IN (900, 901)")).count() == 0
    assert whitening.whiten(df.where("vec_id = 5")).count() == 0  # equal vectors: no variance


def test_whitening_iterates_where_the_block_stays_narrow(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 40)) * np.array([2.0**-k for k in range(40)])
    rows = spark.createDataFrame([([int(v) for v in np.floor(1024 * r) + 100_000],) for r in x], "x array<long>").repartition(4)
    f = whitening.fit(rows, k=3, first_block=6, widest=6)
    v = np.floor(1024 * x)
    values, vectors = np.linalg.eigh(np.cov(v.T, bias=True))
    assert f.passes > 3 and np.allclose(f.values, values[::-1][:3], rtol=1e-9)
    assert np.allclose(np.abs((f.components @ vectors[:, ::-1][:, :3]).diagonal()), 1, atol=1e-9)


def test_whitening_of_entries_that_no_long_holds(spark):
    df = spark.createDataFrame([(i, [1e14 * i, float(i * i)]) for i in range(6)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert len(got) == 6 and {r["deviation"] for r in got if r["vec_id"] == 5} == {None}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def patterns(text):
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if luhn(m[0])],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15],
    }


def test_base_spans_are_the_patterns():
    rng = random.Random(5)
    pieces = ["a.b@c.de", "@", "x@y", "x@y.z@w.v", "a@b..c", "1.2.3.4", "999.1.1.1", "001.002.003.004", "1.2.3.4.5.6.7.8", "00000.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "4111  1111", "+1 (743) 555-3824", "+12", "+123456789", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", " ", "-", ".", "7", "ü", "日", "\n", "%", "+", "(", ")"]
    for _ in range(4_000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 9)))
        assert pii.base_spans(text) == patterns(text), text
    pii.base_spans("a" * 200_000 + "@ " + "1" * 200_000 + ". " + "1." * 50_000 + "@" * 50_000 + "+" * 50_000)  # linear


@pytest.fixture(scope="module")
def model():
    return pii.fit([pii.parse_line(x) for x in pii_examples.LINES.strip().splitlines()])


def whole(model, text):
    """Tags by an exhaustive table over each sentence, without any pruning."""
    raw = np.frombuffer(text.encode(), np.uint8)
    w = pii.split_words(raw, np.array([0, len(raw)]))
    kind, out, low = model.types(raw, w), [], 0
    for high in w.stops.tolist():
        k, n = kind[low:high], high - low
        emit = np.array([sum(model.tables[o + pii.REACH][k[t + o] if 0 <= t + o < n else 0] for o in range(-pii.REACH, pii.REACH + 1)) for t in range(n)])
        score, back = model.first + emit[0], []
        for t in range(1, n):
            through = score[:, None] + model.from_
            back.append(through.argmax(0))
            score = through.max(0) + emit[t]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        out += path[::-1]
        low = high
    return raw, w, out


def test_viterbi_is_exact(model):
    rng = random.Random(7)
    pool = pii_examples.LINES.replace("[", "").replace("]", "").split()
    some = 0
    for _ in range(200):
        raw, w, want = whole(model, " ".join(rng.choices(pool, k=rng.randint(1, 50))))
        got = model.tag(raw, w).tolist()
        assert got == want
        some += sum(v > 0 for v in want)
    assert some > 100


def test_training_is_of_the_largest_likelihood():
    """The gradient at the end is near 0: the likelihood summed over all paths of short rows, by brute force, doesn't rise near the model."""
    rows = [(["call", "555-0101"], ["O", "B-phone"]), (["Mr", "Smith"], ["O", "B-name"]), (["the", "12"], ["O", "O"])]
    m = pii.fit(rows, steps=600, penalty=0.1, caution=0.0)

    def objective(weights, steps, start):
        total = -0.05 * ((weights**2).sum() + (steps[steps > -1e3] ** 2).sum() + (start[start > -1e3] ** 2).sum())
        for words_, tags in rows:
            raw = np.frombuffer(" ".join(words_).encode(), np.uint8)
            w = pii.split_words(raw, np.array([0, len(raw)]))
            feats = [pii.features(x, pii._CUE_KEY[int(pii._CUE_KEYS[c - 1])] if c else "") for x, c in zip(words_, w.cues.tolist(), strict=True)]
            at = lambda t: sum(weights[o + pii.REACH][[m.names[f] for f in (feats[t + o] if 0 <= t + o < len(words_) else ["edge"])]].sum(0) for o in range(-pii.REACH, pii.REACH + 1))  # noqa: B023, E731
            emit = [at(t) for t in range(len(words_))]
            score = lambda p: start[p[0]] + sum(emit[t][y] for t, y in enumerate(p)) + sum(steps[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
            every = [score(p) for p in itertools.product(range(len(pii.TAGS)), repeat=len(words_))]
            total += score([pii.TAGS.index(t) for t in tags]) - np.log(np.exp(np.array(every) - max(every)).sum()) - max(every)
        return total

    base, rng = objective(m.weights, m.steps, m.start), np.random.default_rng(0)
    for _ in range(8):
        step = 0.02 * rng.standard_normal(m.weights.shape)
        assert objective(m.weights + step, m.steps, m.start) < base + 1e-3
    assert base > -1.5


def test_held_out_lines():
    rows = [pii.parse_line(x) for x in pii_examples.LINES.strip().splitlines()]
    hit = found = true = 0
    for fold in range(3):
        m = pii.fit([r for i, r in enumerate(rows) if i % 3 != fold])
        for i, (w, tags) in enumerate(rows):
            if i % 3 == fold:
                raw = np.frombuffer(" ".join(w).encode(), np.uint8)
                got = [pii.TAGS[k] for k in m.tag(raw, pii.split_words(raw, np.array([0, len(raw)])))]
                hit += sum(a == b != "O" for a, b in zip(got, tags, strict=True))
                found += sum(a != "O" for a in got)
                true += sum(b != "O" for b in tags)
    assert hit / found > 0.7 and hit / true > 0.6, (hit, found, true)


TEXTS = [None, "", " \n ", "x", "Please call (212) 555-0187 now, or write to a.b@mail.example.org.", "Frau Anna Schmidt hat angerufen +49 (30) 1234-5678", "ü日 Dr. Emily Stone 10.0.0.1", "plain words and nothing else. " * 40, "call 555-867-5309\n" * 3_000, "z" * 3_000_000 + " SSN 123-45-6789 ü " + "q " * 400_000 + "ssn is 219-09-9999"]


def test_personal_data(spark, model):
    rows = [(i, t, "en", "x", i) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], None, None, None), (None, TEXTS[4], "en", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, spans string, n_email int").repartition(2)
    got = pii.find(df, model).collect()
    assert len(got) == len(rows)
    import hashlib

    for r in got:
        text = (TEXTS[4] if r["doc_id"] is None else TEXTS[r["doc_id"]]) or ""
        base = patterns(text) if len(text) < 100_000 else pii.base_spans(text)
        own = ",".join(f"{k}:{s}:{e}" for k in pii.BASE for s, e in base[k])
        assert [r[f"n_{k}"] for k in pii.BASE] == [len(base[k]) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(own.encode()).hexdigest()
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert set(own.split(",")) - {""} <= set(r["spans"].split(","))
        assert len(spans) == sum(map(len, base.values())) + r["n_model"]
    by = {r["doc_id"]: {f"{k}={(TEXTS[r['doc_id']] or '')[int(s):int(e)]}" for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)} for r in got if r["doc_id"] is not None}
    assert by[4] == {"phone=(212) 555-0187", "email=a.b@mail.example.org"} and "name=Anna Schmidt" in by[5] and {"name=Emily Stone", "ip=10.0.0.1"} <= by[6]
    assert by[8] == {"phone=555-867-5309"} and by[9] == {"id=123-45-6789", "id=219-09-9999"}
    assert not by[0] and not by[7]
    assert pii.find(df.where("false"), model).count() == 0


def test_labelled_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = pii.labelled_table(docs, sample=20)
    assert 174 < table.count() <= 2 * 200 + 40
    assert pii.train(table.limit(0)).tag(np.frombuffer(b"call 555-0101", np.uint8), pii.split_words(np.frombuffer(b"call 555-0101", np.uint8), np.array([0, 13]))).tolist() == [0, 0]
