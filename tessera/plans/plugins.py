"""What a user plugs in: embedders, language models, scorers, enrichers; with offline versions for tests."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[list[str]], list[list[float]]]
Model = Callable[[str], str]


def hashing_embedder(size: int = 64) -> Embedder:
    """Signed hashed word counts, normalised."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(size)
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % size] += 1 if h >> 31 else -1
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        return out

    return run


def embed(df: DataFrame, embedder: Embedder, text: str = "text", prefix: str = "", batch: int = 64) -> DataFrame:
    """Adds embedding. A batch that fails or comes back misaligned is embedded one by one; what still fails is null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        for i in range(0, len(texts), batch):
            part = [prefix + (t or "") for t in texts.iloc[i : i + batch]]
            try:
                got = embedder(part)
            except Exception:
                got = []
            if len(got) != len(part):
                got = []
                for t in part:
                    try:
                        got.append(embedder([t])[0])
                    except Exception:
                        got.append(None)
            out += got
        return pd.Series(out)

    return df.withColumn("embedding", run(text))


def ask(prompt: Column, model: Model) -> Column:
    """The model's answer to a prompt; null if it fails."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        def one(p):
            try:
                return model(p)
            except Exception:
                return None

        return prompts.map(one)

    return run(prompt)


def parse_answer(c: Column) -> Column:
    """text and confidence (between 0 and 1) of an answer with a CONFIDENCE line."""
    confidence = F.regexp_extract(c, r"(?im)^\s*CONFIDENCE\s*:\s*([0-9]*\.?[0-9]+)", 1)
    value = F.when(confidence == "", 0.5).otherwise(F.least(F.greatest(confidence.try_cast("double"), F.lit(0.0)), F.lit(1.0)))
    said = F.regexp_replace(F.regexp_replace(c, r"(?im)^\s*CONFIDENCE\s*:.*$", ""), r"^\s+|\s+$", "")
    return F.struct(said.alias("text"), value.alias("confidence"))


def enrich(df: DataFrame, enricher: Callable[[str], dict], text: str = "text", protected: tuple = ("text", "source", "offset", "tenant_id")) -> DataFrame:
    """Adds what the enricher says about a text to payload (map), protected keys left out; failures add nothing."""

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return {str(k): str(v) for k, v in enricher(t or "").items() if k not in protected}
            except Exception:
                return {}

        return texts.map(one)

    extra = run(text)
    kept = F.map_filter("payload", lambda k, v: ~F.map_contains_key(F.col("__extra"), k))
    return df.withColumn("__extra", extra).withColumn("payload", F.map_concat(kept, "__extra")).drop("__extra")
