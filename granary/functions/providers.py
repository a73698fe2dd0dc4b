"""Models behind Arrow batches: embeddings, cross-encoders, generation, judges. Each loads its model once per worker."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType

DIMENSIONS = 64


def hashed_embedding(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A model-free embedding: signed hashes of character bigrams, at length 1. For tests and offline use."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for row, t in zip(out, texts, strict=True):
        for i in range(len(t) - 1):
            h = zlib.crc32(t[i : i + 2].encode())
            row[h % dimensions] += 1 if h >> 31 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedder(load: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hashed_embedding):
    """A column function text -> vector at length 1; load gives the model's encode."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in parts:
            yield pd.Series(list(encode(texts.fillna("").tolist())))

    return embed


def cross_encoder(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]):
    """A function for retrieval.search(model=...): scores of (query, rerank_text); a wrong number of scores is an error."""

    @F.pandas_udf(DoubleType())
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = load()
        for queries, texts in parts:
            found = list(predict(list(zip(queries, texts, strict=True)))) if len(queries) else []
            if len(found) != len(queries):
                raise ValueError("Model rerank scores count must match candidates count.")
            yield pd.Series([float(x) for x in found])

    return lambda candidates: candidates.withColumn("model_score", score("query", "rerank_text"))


def generator(load: Callable[[], Callable[[list[str]], list[str]]]):
    """A column function prompt -> text, as for replies, plans and judges."""

    @F.pandas_udf(StringType())
    def generate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = load()
        for prompts in parts:
            yield pd.Series(run(prompts.tolist()))

    return generate


def replies(load: Callable[[], Callable[[list[str]], list[str]]]):
    """A column function prompt -> (reply, error) for chat.answers: what a model raises is the error of that prompt, with a null reply, and not the end of the job.

    A batch that fails is tried again prompt by prompt, so that one prompt doesn't fail its neighbours.
    """

    @F.pandas_udf("reply string, error string")
    def generate(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            run, broken = load(), None
        except Exception as e:  # the model itself is missing: every reply fails, with the reason
            run, broken = None, str(e)
        for prompts in parts:
            asked = prompts.tolist()
            yield pd.DataFrame([(None, broken)] * len(asked) if run is None else _answered(run, asked), columns=["reply", "error"])

    return generate


def _answered(run: Callable[[list[str]], list[str]], prompts: list[str]) -> list[tuple[str | None, str | None]]:
    try:
        found = list(run(prompts))
        if len(found) != len(prompts):
            raise ValueError("The number of replies must match the number of prompts.")
        return [(r, "empty reply" if r is None else None) for r in found]
    except Exception as e:  # whatever a provider raises is that prompt's failure
        return [(None, str(e))] if len(prompts) == 1 else [_answered(run, [p])[0] for p in prompts]


def provider(name: str, local=None, online=None):
    """The generator of a provider's name."""
    known = {"local": local, "online": online}
    if name not in known or known[name] is None:
        raise ValueError(f"Unsupported generation provider: {name}")
    return known[name]


def with_generation(df: DataFrame, generate, prompt: str = "final_prompt", reply: str = "reply") -> DataFrame:
    return df.withColumn(reply, generate(prompt))


def online(model: str, base: str, key_env: str, system: str = "", seconds: int = 60):
    """load for generator(): chat completions of an API over HTTP, at temperature 0. The key is read from the environment, on the executors."""

    def load():
        import json
        import os
        import urllib.request

        from granary.functions.text import completions_url

        url, key = completions_url(base), os.environ.get(key_env)
        if not key:
            raise ValueError(f"{key_env} is not set")

        def run(prompts: list[str]) -> list[str]:
            out = []
            for p in prompts:
                body = {"model": model, "temperature": 0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": p}]}
                request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
                with urllib.request.urlopen(request, timeout=seconds) as answer:
                    out.append(json.load(answer)["choices"][0]["message"]["content"].strip())
            return out

        return run

    return load


def rendered(load: Callable[[], Callable[[list[dict]], str]]):
    """A column function from an array of (role, content) to a training text, by a tokenizer's chat template."""

    @F.pandas_udf(StringType())
    def render(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        template = load()
        for rows in parts:
            yield pd.Series([template([dict(t) for t in turns]) for turns in rows])

    return render
