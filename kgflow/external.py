"""The boundary to models: functions a user plugs in, and deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as T


def hashed_embedding(c: Column, size: int = 16) -> Column:
    """A vector of `size` numbers in [-1, 1) that depends on the text alone."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.pmod(F.xxhash64(c, i), F.lit(2_000_001)) / 1_000_000 - 1)


def map_rows(df: DataFrame, fn: Callable[[dict], str], inputs: list[str], output: str = "response", retries: int = 2, workers: int = 8, per_minute: float | None = None, tasks: int | None = None, strict: bool = False) -> DataFrame:
    """df with output and error from a function called for each row: at most `workers` calls at a time in a task, retried; a failing row keeps its error.

    per_minute bounds the calls of the whole job, shared out among `tasks` partitions (needed with it). strict: once a task's rows have all run, any
    error among them fails the task. Extra columns pass through.
    """
    if per_minute and not tasks:
        raise ValueError("a rate needs the number of tasks that share it")
    pause = 60.0 * tasks / per_minute if per_minute else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import threading
        import time
        from concurrent.futures import ThreadPoolExecutor

        gate, due = threading.Lock(), [0.0]

        def wait() -> None:
            if not pause:
                return
            with gate:
                now = time.monotonic()
                due[0] = max(due[0], now) + pause
                at = due[0] - pause
            time.sleep(max(0.0, at - now))

        def call(row: dict) -> tuple[str | None, str | None]:
            for n in range(retries + 1):
                try:
                    wait()
                    return fn(row), None
                except Exception as e:  # the row's error is its result
                    last = f"{type(e).__name__}: {e}"
            return None, last

        failed: list[str] = []
        with ThreadPoolExecutor(workers) as pool:
            for pdf in batches:
                got = list(pool.map(call, pdf[inputs].to_dict("records")))
                failed += [g[1] for g in got if g[1]][:1]
                yield pdf.assign(**{output: [g[0] for g in got], "error": [g[1] for g in got]})
        if strict and failed:
            raise RuntimeError(f"a row failed: {failed[0]}")

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", {output} string, error string"
    return (df.repartition(tasks) if tasks else df).mapInPandas(run, schema)


def text_batches(df: DataFrame, id_col: str, text_col: str, most: int, tokens: int, groups: int | None = None) -> DataFrame:
    """group, batch, ids, texts: texts for an embedder in greedy batches, in order of id, of at most `most` texts and `tokens` tokens (a longer text is alone).

    Texts are dealt to groups by the hash of their ids, one for each 10,000 texts unless given; batches don't cross groups. NULL texts are left out.
    """
    groups = groups or max(1, df.count() // 10_000)
    rows = df.filter(F.col(text_col).isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(groups)).cast("int").alias("group"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.size(T.tokens(F.col(text_col))).alias("n"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        out: list[list] = []
        used = 0
        for i, t, n in zip(pdf["id"], pdf["text"], pdf["n"]):
            if not out or len(out[-1]) >= most or used + n > tokens:
                out.append([])
                used = 0
            out[-1].append((i, t))
            used += n
        return pd.DataFrame([(int(pdf["group"].iloc[0]), b, [i for i, _ in x], [t for _, t in x]) for b, x in enumerate(out)], columns=["group", "batch", "ids", "texts"])

    return rows.groupBy("group").applyInPandas(fold, f"group int, batch int, ids array<{dict(df.dtypes)[id_col]}>, texts array<string>")


def static_responses(texts: list[str]) -> Callable[[dict], str]:
    """A stand-in model: a row's answer is one of the texts, chosen by the hash of the row alone, so it is the same wherever it runs."""
    from zlib import crc32

    return lambda row: texts[crc32(repr(sorted(row.items())).encode()) % len(texts)]


# What can be embedded, and what must be.
EMBEDDINGS = ("entity.title", "entity.description", "relationship.description", "document.text", "community.title", "community.summary", "community.full_content", "text_unit.text")
NEEDED_EMBEDDINGS = ("entity.description", "community.full_content", "text_unit.text")


def embedded_fields(which: str, selected: tuple[str, ...] = ()) -> list[str]:
    """The fields to embed: all, required, selected or none."""
    if unknown := set(selected) - set(EMBEDDINGS):
        raise ValueError(f"unknown fields {sorted(unknown)}")
    return {"all": sorted(EMBEDDINGS), "required": sorted(NEEDED_EMBEDDINGS), "selected": sorted(selected), "none": []}[which]


def extracted(units: DataFrame, model: Callable[[dict], str], more: int = 1, goes_on: Callable[[dict], bool] = lambda row: False, **options) -> DataFrame:
    """units(id, text) with response: an extraction model's answer, and those of up to `more` further rounds on it while `goes_on`, joined by the record mark."""

    def run(row: dict) -> str:
        said = model({"text": row["text"], "round": 0, "said": ""})
        for n in range(1, more + 1):
            if not goes_on({"text": row["text"], "round": n, "said": said}):
                break
            said += "##" + model({"text": row["text"], "round": n, "said": said})
        return said

    return map_rows(units.select("id", "text"), run, ["text"], **options)


def _summary(texts: list[str]) -> str:
    return "\n".join(texts)


REGISTRY: dict[str, dict[str, Callable]] = {
    "embed": {"mock": hashed_embedding}, "summarize": {"join": _summary}, "extract": {"static": static_responses}, "report": {"titles": lambda names: F.array_join(names, ", ")},
    "chunk": {"tokens": T.tokens, "sentence": T.sentences_simple}, "noun_phrases": {"names": T.noun_phrases, "grammar": lambda c: T.tagged_phrases(T.rule_tags(c))},
}


def register(kind: str, name: str, fn: Callable) -> None:
    REGISTRY.setdefault(kind, {})[name] = fn


def strategy(kind: str, name: str) -> Callable:
    try:
        return REGISTRY[kind][name]
    except KeyError:
        raise ValueError(f"no {kind} strategy named {name!r}") from None
