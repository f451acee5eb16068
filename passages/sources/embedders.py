"""Embedding providers: objects with model and embed_batch(list of texts).

embed() applies one to a column in Arrow batches. HTTP providers post to an
OpenAI-style or a single-prompt endpoint; the fakes are deterministic.
"""

from __future__ import annotations

import hashlib
import json
import re
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EmbeddingModel, EngineError
from .generators import loaded


class EmbeddingProvider(Protocol):
    model: EmbeddingModel

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class ConstantEmbedder:
    """v[i] = 0.01 * i + seed, the seed a stable hash of the text from 1 to 256."""

    def __init__(self, dimension: int = 4, model_id: str = "fake") -> None:
        self.model = EmbeddingModel(model_id, dimension)

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [[0.01 * i + hashlib.sha256(t.encode()).digest()[0] + 1 for i in range(self.model.dimension)] for t in texts]


class _Places(dict):
    """The place of a word in a bag of n components, n more if it counts as -1; a word is hashed once while it is held."""

    def __init__(self, n: int) -> None:
        super().__init__()
        self.n = n

    def __missing__(self, word: str) -> int:
        h = hashlib.sha256(word.encode()).digest()
        out = self[word] = int.from_bytes(h[:4], "big") % self.n + (0 if h[4] & 1 else self.n)
        return out


#: Words that a worker holds, and their places for each number of components.
HELD_WORDS = 1 << 18
_held: dict[int, _Places] = {}


class BagEmbedder:
    """Hashed bag of words, of unit length: related texts are near each other."""

    def __init__(self, dimension: int = 64, model_id: str = "bag") -> None:
        self.model = EmbeddingModel(model_id, dimension)

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out, n = [], self.model.dimension
        places = _held.setdefault(n, _Places(n))
        if len(places) > HELD_WORDS:
            places.clear()
        for t in texts:
            counts = np.bincount(np.fromiter(map(places.__getitem__, re.findall(r"\w+", t.lower())), np.int64), minlength=2 * n)
            v = (counts[:n] - counts[n:]).astype(np.float64)
            size = np.linalg.norm(v)
            out.append((v / size if size else v).tolist())
        return out


def _post(url: str, body: dict, headers: dict[str, str], timeout: float, code: int) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        raise EngineError(e.code, f"the embedding service answered {e.code}") from None
    except ValueError:
        raise EngineError(code, "the embedding service's answer is no JSON") from None


class HttpEmbedder:
    """POST v1/embeddings with many inputs; answers are put in order by their index."""

    def __init__(self, base: str, model: EmbeddingModel, api_key: str | None = None, batch: int = 64, timeout: float = 60) -> None:
        self.url, self.model, self.batch, self.timeout = f"{base.rstrip('/')}/v1/embeddings", model, batch, timeout
        self.headers = {"Authorization": f"Bearer {api_key}"} if api_key else {}

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for a in range(0, len(texts), self.batch):
            part = texts[a : a + self.batch]
            data = _post(self.url, {"model": self.model.model_id, "input": part}, self.headers, self.timeout, 540).get("data")
            if not isinstance(data, list):
                raise EngineError(540, "the embedding service's answer has no data")
            if len(data) != len(part):
                raise EngineError(541, "the embedding service gave another number of vectors")
            out += [[float(np.float32(x)) for x in d["embedding"]] for d in sorted(data, key=lambda d: d["index"])]
        return out


class PromptEmbedder:
    """POST api/embeddings, one request for each text."""

    def __init__(self, base: str, model: EmbeddingModel, timeout: float = 60) -> None:
        self.url, self.model, self.timeout = f"{base.rstrip('/')}/api/embeddings", model, timeout

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            vector = _post(self.url, {"model": self.model.model_id, "prompt": t}, {}, self.timeout, 523).get("embedding")
            if not vector:
                raise EngineError(523, "the embedding service gave no vector")
            out.append([float(np.float32(x)) for x in vector])
        return out


class LocalEmbedder:
    """A model in the worker process: ``factory`` loads it on first use, and it maps a list of texts to vectors.

    Vectors are cut to the model's dimension and scaled to unit length, as models with nested dimensions allow.
    """

    def __init__(self, model: EmbeddingModel, factory, query_prefix: str = "", batch: int = 32) -> None:
        self.model, self.factory, self.query_prefix, self.batch = model, factory, query_prefix, batch

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        encode, out = loaded(self.model.model_id, self.factory), []
        for a in range(0, len(texts), self.batch):
            for v in np.asarray(encode([self.query_prefix + t for t in texts[a : a + self.batch]]), np.float32)[:, : self.model.dimension]:
                size = np.linalg.norm(v)
                out.append((v / size if size else v).tolist())
        return out


def embed(rows: DataFrame, provider: EmbeddingProvider, text: str, out: str = "vec") -> DataFrame:
    """rows with a column of vectors of the text; fails with 411 if the provider gives another number of them."""
    names = rows.columns
    place = names.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` array<float>"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            vectors = provider.embed_batch(texts) if texts else []
            if len(vectors) != len(texts):
                raise EngineError(411, "the provider gave another number of vectors than of texts")
            if any(len(v) != provider.model.dimension for v in vectors):
                raise EngineError(530, "a vector has another dimension than the model")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*names, out])

    return rows.mapInArrow(run, schema)


def fake_vector(text, dimension: int):
    """ConstantEmbedder as a native expression."""
    seed = F.conv(F.substring(F.sha2(text, 256), 1, 2), 16, 10).cast("double") + 1
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (i * 0.01 + seed).cast("float"))
