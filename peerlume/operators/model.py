"""Seams for models: a client is handed in, runs per Arrow batch, and is never needed offline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlume.operators.parse import answer_texts

Client = Callable[[str], str]


def offline_client(prompt: str) -> str:
    """A stand-in that raises one concern per section it sees."""
    return "\n".join(f"{i}. {line.rstrip(':').title()} should be described in more detail." for i, line in enumerate((x for x in prompt.split("\n") if x.isupper() or x.endswith(":")), 1))


def reviewed(prompts: DataFrame, key: str, prompt: str, client: Client = offline_client, retries: int = 3) -> DataFrame:
    """(key, concerns, error): a client's concerns for each prompt; a failing prompt is retried, then reported."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, p in zip(b[key], b[prompt]):
                error, found = None, None
                for _ in range(retries):
                    try:
                        found, error = answer_texts(client(p)), None
                        break
                    except Exception as e:  # whatever a client raises is that row's error
                        error = str(e)
                rows.append((k, found, error))
            yield pd.DataFrame(rows, columns=[key, "concerns", "error"])

    return prompts.select(key, prompt).mapInPandas(run, f"{key} {dict(prompts.dtypes)[key]}, concerns array<string>, error string")


def resumed(prompts: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Prompts that have no answer yet."""
    return prompts.join(done.select(key), key, "left_anti")


def embedded(texts: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(text, embedding) once per distinct text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({text: b[text], "embedding": embed(b[text].tolist())})

    return texts.select(text).where(F.col(text).isNotNull()).distinct().mapInPandas(run, f"{text} string, embedding array<float>")
