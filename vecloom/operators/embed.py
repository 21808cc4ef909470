"""Embedding models as plug-ins. The installed one hashes k-mers and needs no weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from vecloom.functions.arrow import mix64
from vecloom.functions.sequences import glm2_input, t5_input

# The number types that a configuration may name, and the built-in configurations.
DTYPES = {"float16": "float16", "fp16": "float16", "bfloat16": "bfloat16", "bf16": "bfloat16", "float32": "float32", "fp32": "float32"}
TEMPLATES = {
    "esm2": {"model_type": "esm2", "hub_id": "facebook/esm2_t33_650M_UR50D", "dtype": "float16", "layer": "last"},
    "glm2": {"model_type": "glm2", "hub_id": "tattabio/gLM2_650M_embed", "dtype": "bfloat16", "layer": "last"},
    "t5": {"model_type": "t5", "hub_id": "Rostlab/prot_t5_xl_half_uniref50-enc", "dtype": "float16", "layer": "middle"},
    "kmer": {"model_type": "kmer", "hub_id": "", "dtype": "float32", "layer": "last"},
}
DEFAULT = "kmer"


@dataclass(frozen=True)
class EmbedderConfig:
    model_type: str
    hub_id: str
    device: str | None = None
    dtype: str | None = None
    batch_size: int = 8
    max_length: int = 2048
    layer: str | int = "last"
    trust_remote_code: bool = True

    def __post_init__(self) -> None:
        if self.dtype is not None:
            if self.dtype not in DTYPES:
                raise ValueError(f"no such dtype: {self.dtype}")
            object.__setattr__(self, "dtype", DTYPES[self.dtype])

    @classmethod
    def from_template(cls, name: str) -> EmbedderConfig:
        if name not in TEMPLATES:
            raise FileNotFoundError(f"no template {name}; available: {', '.join(TEMPLATES)}")
        return cls(**TEMPLATES[name])

    @classmethod
    def from_yaml(cls, path: str) -> EmbedderConfig:
        import yaml

        with open(path) as f:
            data = yaml.safe_load(f) or {}
        if not isinstance(data, dict):
            raise ValueError("the file must hold one mapping of fields")
        return cls(**data)

    @classmethod
    def resolve(cls, config: EmbedderConfig | dict | str | None) -> EmbedderConfig:
        """A configuration from an object, a mapping, a template's name or a YAML path; the default template for None."""
        if config is None:
            return cls.from_template(DEFAULT)
        if isinstance(config, EmbedderConfig):
            return config
        if isinstance(config, dict):
            return cls(**config)
        return cls.from_template(config) if config in TEMPLATES else cls.from_yaml(config)

    def to_dict(self) -> dict:
        return asdict(self)

    def save_yaml(self, path: str) -> None:
        import yaml

        with open(path, "w") as f:
            yaml.safe_dump(self.to_dict(), f, sort_keys=False)


#: model_type -> maker of a function from a list of texts to a float32 matrix; made once for each worker and task.
MODELS: dict[str, Callable[[EmbedderConfig], Callable[[list[str]], np.ndarray]]] = {}
#: model_type -> how a sequence is written for the model.
INPUTS: dict[str, Callable[[str | Column], Column]] = {"t5": t5_input, "glm2": glm2_input}
#: model types without an input limit, which read whole texts.
UNLIMITED: set[str] = set()


def register(model_type: str, maker: Callable[[EmbedderConfig], Callable[[list[str]], np.ndarray]], limited: bool = True) -> None:
    """A model that is not `limited` gets whole texts, whatever max_length is."""
    MODELS[model_type] = maker
    (UNLIMITED.discard if limited else UNLIMITED.add)(model_type)


def kmer_vectors(texts: list[str], k: int = 3, dim: int = 64) -> np.ndarray:
    """Signed counts of hashed k-mers of the letters, scaled to length 1; zero for texts shorter than k."""
    out = np.zeros((len(texts), dim), dtype=np.float32)
    for i, text in enumerate(texts):
        raw = np.frombuffer((text or "").upper().encode("ascii", "ignore"), dtype=np.uint8).astype(np.uint64)
        if len(raw) >= k:
            code = np.zeros(len(raw) - k + 1, dtype=np.uint64)
            for j in range(k):
                code = code * np.uint64(128) + raw[j : len(raw) - k + 1 + j]
            h = mix64(code, 17)
            np.add.at(out[i], (h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0))
            n = np.sqrt((out[i] ** 2).sum())
            out[i] /= n if n else 1.0
    return out


register("kmer", lambda config: kmer_vectors, limited=False)


def pick_layer(n_layers: int, layer: str | int) -> int:
    """Which hidden state to use: the last, the middle one ((n - 1) // 2), or a number, which must be in range."""
    if layer == "last":
        return n_layers - 1
    if layer == "middle":
        return (n_layers - 1) // 2
    at = int(layer)
    if not -n_layers <= at < n_layers:
        raise ValueError(f"layer {at} is out of range for {n_layers} layers")
    return at % n_layers


def masked_mean(hidden: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Mean over the tokens of (batch, tokens, dim), over those of the mask if there is one; zero for an empty mask."""
    if mask is None:
        return hidden.mean(axis=1)
    m = mask[:, :, None].astype(hidden.dtype)
    return (hidden * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-6)


def embed(sequences: DataFrame, config: EmbedderConfig | dict | str | None = None, embedder: Callable[[list[str]], np.ndarray] | None = None, text_col: str = "sequence") -> DataFrame:
    """Adds `embedding`. A given embedder, a function from texts to a matrix, wins over the configuration.

    Texts are written as the model wants them, and cut at max_length characters if the model has an input limit. A null
    text has a null embedding.
    """
    own = EmbedderConfig.resolve(config)
    maker = (lambda _: embedder) if embedder is not None else MODELS.get(own.model_type)
    if maker is None:
        raise ValueError(f"no model registered for {own.model_type}; register one with vecloom.operators.embed.register")
    size = own.batch_size

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = maker(own)
        for texts in batches:
            out = pd.Series([None] * len(texts), dtype=object)
            there = np.flatnonzero(texts.notna().to_numpy())
            for s in range(0, len(there), max(size, 256)):
                at = there[s : s + max(size, 256)]
                for i, v in zip(at, model(texts.iloc[at].tolist())):
                    out.iloc[i] = v
            yield out

    write = INPUTS.get(own.model_type, lambda c: F.col(c))
    text = write(text_col)
    if own.model_type not in UNLIMITED:
        text = F.substring(text, 1, own.max_length if own.model_type != "t5" else 2 * own.max_length)
    return sequences.withColumn("embedding", F.pandas_udf(run, ArrayType(FloatType()))(text))


def embed_texts(texts: list[str] | str, config: EmbedderConfig | dict | str | None = None) -> np.ndarray:
    """Vectors of a few texts on the driver: a matrix for a list, one vector for a single text."""
    own = EmbedderConfig.resolve(config)
    if own.model_type not in MODELS:
        raise ValueError(f"no model registered for {own.model_type}; register one with vecloom.operators.embed.register")
    out = MODELS[own.model_type](own)([texts] if isinstance(texts, str) else list(texts))
    return out[0] if isinstance(texts, str) else out
