"""A language model asked about batches of lines: prompts, retries, and every answer kept."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.erp import tsv_payload
from .caches import held, key, through
from .snapshots import SnapshotTable

#: Lines of a prompt, tries of a call, and seconds before the second try (doubled for each further one).
LINES, TRIES, PAUSE = 20, 4, 0.5
COLUMNS = ("line", "item_no", "item_description", "unit_cost", "unit", "po_number", "po_order_date", "vendor", "project_name")
TASK = """For each line below choose the row of the table that is the same product, or none.
Answer with JSON only: {"matches": [{"item_no": the line's code, "matched": true or false, "reference_item_no": the row's code,
"reference_unit_cost": the row's unit_cost, "reference_vendor", "reference_unit", "reference_po_number", "reference_po_date",
"matched_description_snippet": the row's description, "confidence": 0 to 1}]}, one object a line, and no row that isn't in the table."""


def prompts(lines: DataFrame, cands: DataFrame, per: int = LINES, limit: int = 120_000) -> DataFrame:
    """lines (line, item_no, description) and their candidates (line, rank, item columns) -> batch, prompt.

    Lines are dealt by hash to batches of about ``per``; a prompt has the task, the
    batch's lines as JSON, and its candidates as tab-separated text cut at ``limit``.
    """
    lines = cut(lines.select("line", "item_no", "description"))
    n = max(1, -(-lines.count() // per))
    dealt = lines.withColumn("batch", F.pmod(F.xxhash64("line"), F.lit(n)))
    asked = dealt.groupBy("batch").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("line", "item_no", "description"))), lambda x: F.struct(x.item_no.alias("item_no"), x.description.alias("description")))).alias("asked"))
    rows = cands.join(dealt.select("line", "batch"), "line").withColumn("rank", F.struct(F.col("line").alias("l"), F.col("rank").alias("r")))
    table = tsv_payload(rows, "batch", [c for c in COLUMNS if c in cands.columns], limit)
    text = F.concat_ws("\n\n", F.lit(TASK), F.concat(F.lit("Lines:\n"), "asked"), F.concat(F.lit("Table:\n"), F.coalesce("tsv", F.lit(""))))
    return asked.join(table, "batch", "left").select("batch", text.alias("prompt"))


def call(ask: Callable[[str], str], prompt: str, tries: int, pause: float) -> tuple[str | None, int, str | None]:
    """(answer, tries, last error): again after a growing, jittered pause; no answer after the last try."""
    error = None
    for i in range(tries):
        try:
            return ask(prompt), i + 1, error
        except Exception as e:  # noqa: BLE001  # whatever a client raises
            error = f"{type(e).__name__}: {e}"[:500]
            if i + 1 < tries:
                time.sleep(pause * 2**i * (0.5 + random.random()))
    return None, tries, error


class AnswerStore:
    """Answers of a model by version and prompt, with what each call took. Failed calls aren't kept, so that a later run asks again."""

    SCHEMA = "key string, answer string, tries int, error string, seconds double, chars_in long, chars_out long"

    def __init__(self, table: SnapshotTable, name: str, version: str, load: Callable[[], Callable[[str], str]], tries: int = TRIES, pause: float = PAUSE):
        self.table, self.name, self.version, self.load, self.tries, self.pause = table, name, version, load, tries, pause

    @classmethod
    def fresh(cls, spark, name: str, version: str, load: Callable[[], Callable[[str], str]], **more) -> AnswerStore:
        """A store in a new folder of the shared storage."""
        return cls(SnapshotTable.fresh(spark, cls.SCHEMA, ("key",)), name, version, load, **more)

    def answers(self, asked: DataFrame) -> tuple[DataFrame, int]:
        """asked (batch, prompt) -> (batch, answer, tries, error, seconds, chars_in, chars_out; prompts that were sent and answered).

        A prompt that was answered before isn't sent again, nor is one that comes twice; one that
        failed ``tries`` times has a null answer.
        """
        name, load, tries, pause = f"{self.name}/{self.version}", self.load, self.tries, self.pause

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                ask, out = held(name, load) if len(pdf) else None, []
                for k, p in zip(pdf["key"], pdf["prompt"], strict=True):
                    began = time.monotonic()
                    answer, n, error = call(ask, p, tries, pause)
                    out.append((k, answer, n, error, time.monotonic() - began, len(p), len(answer or "")))
                yield pd.DataFrame(out, columns=["key", "answer", "tries", "error", "seconds", "chars_in", "chars_out"])

        rows = asked.withColumn("key", key(self.name, self.version, F.col("prompt")))
        ask_all = lambda new: new.select("key", "prompt").mapInPandas(run, self.SCHEMA).where("answer IS NOT NULL")
        out, n = through(self.table, rows, ask_all)
        return out.drop("prompt", "key"), n
