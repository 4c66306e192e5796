"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored
from .textkit import BLOCK, _blocks, mix64, prefix_sums, powers, window_hashes, word_bounds

#: Words of the windows that repetition is judged by.
WINDOW = 8
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Posterior probability of good quality from which a document is kept.
KEEP = 0.5
#: Chance of good quality before any vote.
PRIOR = 0.5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_distinct")

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_WS = " \t\n\x0b\x0c\r"


def measure(text: str | None) -> tuple[int, ...]:
    """The counts named in STATS, of a whole text."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    hashes, chars, symbols = [], 0, 0
    for block in _blocks(raw):
        data = np.frombuffer(block, np.uint8)
        symbols += int(_IS_SYMBOL[data].sum())
        starts, ends = word_bounds(data)
        if not len(starts):
            continue
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        chars += int((heads[ends] - heads[starts]).sum())
        sums = prefix_sums(data)
        hashes.append(mix64((sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts] + (ends - starts).astype(np.uint64)))
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    repeat = 0
    windows = window_hashes(words, WINDOW)
    if len(windows):
        _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
        step = np.zeros(len(words) + 1, np.int64)
        twice = np.flatnonzero(times[back] > 1)
        np.add.at(step, twice, 1)
        np.add.at(step, twice + WINDOW, -1)
        repeat = int((np.cumsum(step)[:-1] > 0).sum())
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(_WS):
            lines += 1
            dup += line in seen
            seen.add(line)
    letters = upper = 0
    for at in range(0, len(text), BLOCK):
        part = text[at : at + BLOCK]
        if part.isascii():
            b = np.frombuffer(part.encode(), np.uint8)
            up = int(((b >= 65) & (b <= 90)).sum())
            letters += up + int(((b >= 97) & (b <= 122)).sum())
            upper += up
        else:
            letters += sum(map(str.isalpha, part))
            upper += sum(map(str.isupper, part))
    return len(words), chars, symbols, dup, repeat, lines, letters, upper, len(np.unique(words))


def _measure(batches):
    for b in batches:
        got = [measure(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([g[k] for g in got], pa.int64()) for k in range(len(STATS)))], ["doc_id", *STATS])


def _when(condition: str, vote: int) -> Column:
    return F.expr(f"CASE WHEN {condition} THEN {vote} ELSE 0 END").cast("int")


def rules() -> dict[str, Column]:
    """Name -> vote: 1 good, -1 bad, 0 abstains.

    A rule that looks for one defect abstains where it finds none, as other
    defects may be there; rules that vote for good ask for several traits of prose.
    """
    plain = "100 * n_symbols <= n_words AND 10 * n_upper < n_letters"
    return {
        "symbols": _when("10 * n_symbols > n_words", -1),
        "repeated_lines": _when("n_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines", -1),
        "capitals": _when("10 * n_upper > 3 * n_letters", -1),
        "few_letters": _when("10 * n_letters < 8 * word_chars", -1),
        "repetition": _when("100 * n_repeat_words > 20 * n_words", -1),
        "odd_words": _when("word_chars > 10 * n_words OR word_chars < 3 * n_words", -1),
        "small_vocabulary": _when("n_words >= 50 AND n_distinct * n_distinct < 8 * n_words", -1),
        "prose": _when(f"100 * n_letters >= 92 * word_chars AND 2 * word_chars BETWEEN 7 * n_words AND 16 * n_words AND {plain}", 1),
        "fresh_lines": _when(f"n_dup_lines = 0 AND n_lines > 0 AND 100 * n_repeat_words <= 5 * n_words AND {plain}", 1),
        "rich_vocabulary": _when(f"10 * n_distinct >= 5 * n_words AND {plain}", 1),
    }


@dataclass
class LabelModel:
    """Odds before any vote, and how often each rule is right where it votes."""

    prior: float
    accuracy: np.ndarray

    def weights(self) -> tuple[float, np.ndarray]:
        """Log odds of the prior and of a vote by rule."""
        return math.log(self.prior / (1 - self.prior)), np.log(self.accuracy / (1 - self.accuracy))


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and how often each occurs.

    Rules start as right four times in five and stay better than chance, which
    settles which class is the good one. One pseudo-vote each way keeps chances
    off 0 and 1. The prior stays as it is: the model takes abstentions to say
    nothing, and with an estimated prior the many documents that only good rules
    vote on would outweigh the one or two votes that a defect gets.
    """
    r = votes.shape[1] if votes.ndim == 2 else 0
    model = LabelModel(PRIOR, np.full(r, 0.8))
    if not len(votes):
        return model
    for _ in range(rounds):
        prior, weight = model.weights()
        p = 1 / (1 + np.exp(-np.clip(prior + votes @ weight, -500, 500)))
        good, bad = counts * p, counts * (1 - p)
        right = good @ (votes > 0) + bad @ (votes < 0)
        new = LabelModel(PRIOR, np.clip((right + 1) / (counts @ (votes != 0) + 2), 0.55, 0.995))
        step = np.abs(new.accuracy - model.accuracy).max(initial=0)
        model = new
        if step < 1e-9:
            break
    return model


def judge(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """One row a row of docs (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality.

    The votes of all documents are counted by pattern (3 ** rules at most, however
    many documents), a label model is estimated from the counts, and ``quality``
    is each document's posterior probability of being good. A document is kept
    if it isn't below ``keep`` and the base rule (n_words < 20 or 100 *
    n_repeat_words > 30 * n_words) doesn't fail it. Null texts count as empty.
    Equal texts get equal results; other columns aren't read; an empty table
    gives an empty result.
    """
    stats = docs.select("doc_id", "text").mapInArrow(_measure, "doc_id long, " + ", ".join(f"{s} long" for s in STATS))
    named = rules()
    voted = stored(stats.select("*", *[v.alias(f"v_{n}") for n, v in named.items()]))
    cols = [f"v_{n}" for n in named]
    patterns = voted.groupBy(*cols).count().collect()
    model = estimate(np.array([[p[c] for c in cols] for p in patterns], float).reshape(len(patterns), len(cols)), np.array([p["count"] for p in patterns], float))
    prior, weight = model.weights()
    odds = F.lit(prior)
    for c, w in zip(cols, weight.tolist(), strict=True):
        odds = odds + F.col(c) * F.lit(w)
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    out = voted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.select("doc_id", *STATS[:5], "base_failed", (~failed & (F.col("quality") >= keep)).alias("kept"), "quality")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents."""
    return judge(documents(spark, sf_dir))
