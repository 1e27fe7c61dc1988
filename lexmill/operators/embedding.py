"""Dense embeddings of texts: a protocol, a model-free embedder and one for ONNX models.

An embedder is made once in each Python worker and gets batches of texts, so a
model is loaded once a worker and its memory is that of one batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts a model sees at once.
BATCH = 64

_WORDS = re.compile(r"\w+").findall


class Embedder(Protocol):
    """Hashable and picklable, so that workers can keep what they loaded."""

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row of floats for each text."""
        ...


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed hashed word counts; the same text gives the same vector everywhere."""

    dimensions: int = 64

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts):
            for word in _WORDS(text.lower()):
                digest = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
                row[int(digest[:6], 16) % self.dimensions] += 1 if digest[6] < "8" else -1
        return out


@dataclass(frozen=True)
class OnnxEmbedder:
    """Mean of a transformer's last layer over the words of a text, of unit length.

    Takes the paths of an ONNX model and of its tokenizer file, which every
    worker must be able to read.  Needs onnxruntime and tokenizers.
    """

    model: str
    tokenizer: str
    most_tokens: int = 256

    def embed(self, texts: list[str]) -> np.ndarray:
        session, encoder = _loaded(self.model, self.tokenizer, self.most_tokens)
        got = encoder.encode_batch(texts)
        ids, mask = np.array([e.ids for e in got], np.int64), np.array([e.attention_mask for e in got], np.int64)
        known = {i.name for i in session.get_inputs()}
        feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        hidden = session.run(None, {k: v for k, v in feed.items() if k in known})[0]
        mean = (hidden * mask[:, :, None]).sum(axis=1) / np.maximum(1, mask.sum(axis=1, keepdims=True))
        return mean / np.maximum(1e-12, np.linalg.norm(mean, axis=1, keepdims=True))


@lru_cache(maxsize=2)
def _loaded(model: str, tokenizer: str, most_tokens: int):
    import onnxruntime
    from tokenizers import Tokenizer

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1  # one task a core
    encoder = Tokenizer.from_file(tokenizer)
    encoder.enable_truncation(most_tokens)
    encoder.enable_padding()
    return onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"]), encoder


def embed(texts: DataFrame, embedder: Embedder, text: str = "text", out: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``out`` array<float>; a null text gives null."""
    keep = keep or [c for c in texts.columns if c not in (text, out)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors: list = [None] * len(f)
            there = [k for k, t in enumerate(f[text]) if t is not None]
            for s in range(0, len(there), BATCH):
                part = there[s : s + BATCH]
                for k, v in zip(part, embedder.embed([f[text].iloc[j] for j in part])):
                    vectors[k] = np.asarray(v, np.float32)
            yield f[keep].assign(**{out: pd.Series(vectors, dtype=object, index=f.index)})

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])]).mapInPandas(run, f"{kinds}, `{out}` array<float>")
