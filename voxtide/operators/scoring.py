"""Plug-in surface for model scorers.

A scorer is a function from a list of texts to a list of {label: score}. It is
built once per Python worker by `load` and fed batch by batch; Spark spreads the
batches over the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Scorer = Callable[[list[str]], list[dict[str, float]]]
_LOADED: dict[str, Scorer] = {}


def loaded(token: str, load: Callable[[], Scorer]) -> Scorer:
    """The scorer of a token, built once in this Python process. Tasks reach the
    module's own table through this function, not a copy that travels with them."""
    if token not in _LOADED:
        _LOADED[token] = load()
    return _LOADED[token]


def cut_tokens(text: str, limit: int | None) -> str:
    """A model's own input limit, counted in white-space tokens."""
    if not limit:
        return text
    words = text.split()
    return text if len(words) <= limit else " ".join(words[:limit])


def score_with(df: DataFrame, load: Callable[[], Scorer], text: str, keys: list[str], name: str = "scorer",
               batch_size: int = 64, max_tokens: int | None = None) -> DataFrame:
    """keys plus `scores` (map label -> score) for every row of df.

    max_tokens is the input window of a scorer that has one (512 for the usual
    encoders); by default whole texts are scored.
    """
    key_fields = [df.schema[k] for k in keys]
    token = f"{name}-{uuid.uuid4().hex}"  # two scorers of one name do not meet
    schema = T.StructType([*key_fields, T.StructField("scores", T.MapType(T.StringType(), T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = loaded(token, load)
        for pdf in batches:
            texts = [cut_tokens(t or "", max_tokens) for t in pdf[text]]
            scores: list[dict[str, float]] = []
            for start in range(0, len(texts), batch_size):
                scores.extend(scorer(texts[start:start + batch_size]))
            out = pdf[keys].copy()
            out["scores"] = scores
            yield out

    return df.select(*keys, text).mapInPandas(run, schema)
