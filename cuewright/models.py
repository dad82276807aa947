"""Models behind small interfaces, with deterministic stand-ins that need no network."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_DIM = 384


class Encoder(Protocol):
    """Turns texts into vectors of one length."""

    dim: int

    def encode(self, texts: Sequence[str | None]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashingEncoder:
    """Words hashed to signed places of a vector of length one. It knows words, not meanings."""

    dim: int = TEXT_DIM

    def encode(self, texts: Sequence[str | None]) -> np.ndarray:
        import regex
        import xxhash

        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            for word in regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower()):
                h = xxhash.xxh64_intdigest(word)
                out[i, h % self.dim] += 1.0 if (h >> 40) & 1 else -1.0
        length = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(length > 0, length, 1)


def encode_texts(texts: str | Sequence[str], encoder: Encoder | None = None) -> list[list[float]]:
    """Vectors of one text or of several."""
    many = [texts] if isinstance(texts, str) else list(texts)
    return (encoder or HashingEncoder()).encode(many).tolist() if many else []


def with_vectors(df: DataFrame, text: str, encoder: Encoder | None = None, column: str = "embedding") -> DataFrame:
    """Adds the vector of a text column; null for null texts. Batches are encoded where they lie."""
    encoder = encoder or HashingEncoder()

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = encoder.encode(batch.fillna("").tolist())
            yield pd.Series([None if missing else row for row, missing in zip(rows, batch.isna())], index=batch.index)

    return df.withColumn(column, vectors(F.col(text)))


class Prober(Protocol):
    """Gives what a media file's container tells, as JSON: media (path) with a column probe; null where it cannot be read."""

    def probe(self, media: DataFrame) -> DataFrame: ...


class SubtitleExtractor(Protocol):
    """Gives subtitle files inside media files: path, content (the bytes of an SRT file)."""

    def embedded(self, media: DataFrame) -> DataFrame: ...


class Transcriber(Protocol):
    """Recognises the speech of media files (path): segments (path, segment, text, start, end) and their
    words (path, segment, word_idx, word, start, end), which may be empty."""

    def recognised(self, media: DataFrame) -> tuple[DataFrame, DataFrame]: ...


class Captioner(Protocol):
    """Describes frames (video_path, frame_idx, timestamp, name): the frames with a column action; failures as null."""

    def describe(self, frames: DataFrame) -> DataFrame: ...


class FaceFinder(Protocol):
    """Finds faces in frames: video_path, timestamp, box (top, right, bottom, left), embedding."""

    def faces(self, frames: DataFrame) -> DataFrame: ...


class Diariser(Protocol):
    """Gives voice segments of media files (path): media_path, start, end, speaker_label, embedding."""

    def voices(self, media: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Adapters:
    """The models that ingestion asks; what is missing gives nothing."""

    prober: Prober | None = None
    subtitles: SubtitleExtractor | None = None
    transcriber: Transcriber | None = None
    captioner: Captioner | None = None
    face_finder: FaceFinder | None = None
    diariser: Diariser | None = None


class LanguageModel(Protocol):
    """Answers prompts."""

    def generate(self, prompt: str) -> str: ...


@dataclass
class Settings:
    """Defaults of ingestion; ``from_env`` takes those that the environment names."""

    frame_interval: float = 15.0
    batch_size: int = 24
    language: str = "ta"
    voices: bool = True
    face_eps: float = 0.5
    face_min_samples: int = 3
    #: Recognition models by language.
    model_map: dict[str, list[str]] = field(default_factory=lambda: {"ta": ["large-v3", "large-v2"], "en": ["medium.en", "small.en"]})
    fallback_model: str = "medium"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Settings by the names of their variables, in any case; values that cannot be read are an error."""
        known = {k.upper(): v for k, v in (os.environ if env is None else env).items()}
        out = cls()
        yes = lambda v: v.strip().lower() in ("1", "true", "yes", "on")
        kinds = {"FRAME_INTERVAL": ("frame_interval", float), "BATCH_SIZE": ("batch_size", int), "LANGUAGE": ("language", str), "ENABLE_VOICE_ANALYSIS": ("voices", yes), "WHISPER_MODEL_MAP": ("model_map", json.loads), "FALLBACK_MODEL_ID": ("fallback_model", str)}
        for name, (field_name, read) in kinds.items():
            if name in known:
                setattr(out, field_name, read(known[name]))
        return out

    def models_for(self, language: str) -> list[str]:
        return self.model_map.get(language) or [self.fallback_model]


@lru_cache(maxsize=64)
def load_prompt(name: str, folder: str = "prompts") -> str:
    """A prompt file's text, read once; FileNotFoundError if there is none."""
    return (Path(folder) / name).read_text(encoding="utf-8")
