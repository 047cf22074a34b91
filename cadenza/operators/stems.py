"""Stem separation: chunks with overlap, a separator for each chunk, crossfaded and added up again."""

from __future__ import annotations

import fcntl
import hashlib
import os
import re
import shutil
import sys
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from cadenza.errors import InferenceError, StemUnavailable
from cadenza.sources import audio

# The order in which models give stems.
STEMS = ("vocals", "drums", "bass", "other")
# Providers by platform; all others run on the CPU.
PROVIDERS = {"darwin": "CoreMLExecutionProvider", "win32": "DmlExecutionProvider"}
MODEL_NAME = "separator.onnx"


@dataclass(frozen=True)
class Chunking:
    """Sample counts; by default 7.8 s with 1 s in common at 44.1 kHz."""

    chunk: int = 343_980
    overlap: int = 44_100
    rate: int = audio.STEM_RATE

    @property
    def stride(self) -> int:
        return max(0, self.chunk - self.overlap)

    def plan(self, n: int) -> list[tuple[int, int]]:
        if self.stride <= 0:
            raise ValueError("a chunk must be longer than its overlap")
        if n <= 0:
            return []
        if n <= self.chunk:
            return [(0, n)]
        return [(s, min(s + self.chunk, n)) for s in range(0, n, self.stride) if s == 0 or n - s >= self.overlap]


def crossfade(length: int, overlap: int, first: bool, last: bool) -> np.ndarray:
    fade, w = min(overlap, length), np.ones(length)
    ramp = np.arange(fade) / fade if fade else np.zeros(0)
    if not first:
        w[:fade] *= ramp
    if not last and fade:
        w[length - fade :] *= 1 - ramp
    return w


def overlap_add(chunks: list[tuple[int, np.ndarray]], how: Chunking, total: int) -> np.ndarray:
    """Weighted mean of chunks (start, ... x samples) where they overlap."""
    if not chunks:
        raise InferenceError("no chunks to put together")
    out, weight = np.zeros((*chunks[0][1].shape[:-1], total)), np.zeros(total)
    for i, (start, x) in enumerate(chunks):
        n = min(x.shape[-1], total - start)
        w = crossfade(n, how.overlap, i == 0, i == len(chunks) - 1)
        out[..., start : start + n] += w * x[..., :n]
        weight[start : start + n] += w
    return (out / np.where(weight > 1e-8, weight, 1.0)).astype(np.float32)


class ScaledCopies:
    """A stand-in for a model: each stem is a share of the mix, so the stems add up to it."""

    shares = (0.4, 0.3, 0.2, 0.1)

    def __call__(self, mix: np.ndarray) -> np.ndarray:
        return np.stack([mix * s for s in self.shares])


class Unavailable:
    def __call__(self, mix: np.ndarray) -> np.ndarray:
        raise StemUnavailable("no separator is configured")


class OnnxModel:
    """A model that takes (1, 2, chunk) and gives (1, 4, 2, chunk), its stems in `order`."""

    def __init__(self, path: str, chunk: int = Chunking.chunk, order: tuple[str, ...] = STEMS):
        if sorted(order) != sorted(STEMS):
            raise ValueError(f"a model gives {', '.join(STEMS)} in some order, not {order}")
        if not os.path.isfile(path):
            raise StemUnavailable(f"no model at {path}")
        import onnxruntime

        self.session = onnxruntime.InferenceSession(path, providers=providers(onnxruntime.get_available_providers()))
        self.input, self.chunk, self.places = self.session.get_inputs()[0].name, chunk, [order.index(x) for x in STEMS]

    def __call__(self, mix: np.ndarray) -> np.ndarray:
        n = mix.shape[1]
        x = np.zeros((1, 2, self.chunk), np.float32)
        x[0, :, :n] = mix
        y = np.asarray(self.session.run(None, {self.input: x})[0])
        if y.ndim != 4 or y.shape[:3] != (1, len(STEMS), 2) or y.shape[3] < n:
            raise InferenceError(f"the model gave {y.shape}")
        return y[0, self.places, :, :n]


def providers(available: list[str], platform: str = sys.platform) -> list[str]:
    """What a model runs on: the platform's accelerator where it is there, and the CPU after it."""
    return [p for p in (PROVIDERS.get(platform), "CPUExecutionProvider") if p in available]


def cache_dir() -> str:
    return f"{os.environ.get('XDG_CACHE_HOME', os.path.expanduser('~/.cache'))}/cadenza"


def model_path(name: str = MODEL_NAME) -> str:
    return f"{cache_dir()}/{name}"


def is_cached(name: str = MODEL_NAME) -> bool:
    return os.path.isfile(model_path(name))


def has_hash(path: str, sha256: str) -> bool:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest() == sha256.lower()


def ensure_model(source: str, sha256: str, name: str = MODEL_NAME) -> str:
    """The cached model's path, fetched from the URL `source` unless a file with the right hash is there.

    One process fetches at a time.  What is fetched gets its name only when it is whole and its hash is right.
    """
    path = model_path(name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if os.path.isfile(path) and has_hash(path, sha256):
            return path
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        try:
            with urllib.request.urlopen(source) as r, open(part, "wb") as f:
                shutil.copyfileobj(r, f)
            if not has_hash(part, sha256):
                raise StemUnavailable(f"{source} has another hash than {sha256}")
            os.replace(part, path)
        except OSError as e:
            raise StemUnavailable(f"{source}: {e}") from e
        finally:
            if os.path.exists(part):
                os.remove(part)
    return path


def find_model(env: str = "CADENZA_STEM_MODEL", name: str = MODEL_NAME) -> str:
    """The model's file: named by the environment, or in the cache, the data folder, ./models or ~/.cadenza/models."""
    home = os.path.expanduser("~")
    places = [os.environ.get(env, ""), model_path(name), f"{os.environ.get('XDG_DATA_HOME', home + '/.local/share')}/cadenza/{name}", f"models/{name}", f"{home}/.cadenza/models/{name}"]
    for p in places:
        if p and os.path.isfile(p):
            return p
    raise StemUnavailable("no model in " + ", ".join(p for p in places if p))


SEPARATORS: dict[str, Callable[[], Callable[[np.ndarray], np.ndarray]]] = {"copies": ScaledCopies, "none": Unavailable, "onnx": lambda: OnnxModel(find_model())}


def register(name: str, make: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> None:
    """Add a separator: make() is called once a task, what it returns maps a stereo chunk to (stem, channel, sample)."""
    SEPARATORS[name] = make


def separator(name: str) -> Callable[[np.ndarray], np.ndarray]:
    return SEPARATORS[name]()


def separate(mix: np.ndarray, model, how: Chunking = Chunking()) -> np.ndarray:
    """(stem, channel, sample) of a stereo mix."""
    n = mix.shape[1]
    return overlap_add([(a, model(mix[:, a:b])) for a, b in how.plan(n)], how, n)


def write_stems(stems: np.ndarray, folder: str, base: str, rate: int) -> dict[str, str]:
    """WAV files by stem name.  A file is renamed when whole, so a task that runs again replaces it."""
    os.makedirs(folder, exist_ok=True)
    out = {}
    for name, x in zip(STEMS, stems, strict=True):
        path = f"{folder}/{re.sub(r'[/]', '_', base) or 'track'}_{name}.wav"
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(part, "wb") as f:
            f.write(audio.wav_bytes(x, rate))
        os.replace(part, path)
        out[name] = path
    return out


def stft(x: np.ndarray, window: int = 4096, hop: int = 1024) -> np.ndarray:
    """(frames, bins) of a Hann-windowed buffer; a short one is padded to one frame."""
    frames = max(0, len(x) - window) // hop + 1
    x = np.pad(np.asarray(x, float), (0, max(0, (frames - 1) * hop + window - len(x))))
    w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(window) / window))
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, window)[::hop][:frames] * w, axis=1)


def shape(samples: int, window: int = 4096, hop: int = 1024) -> tuple[int, int, int]:
    """(channels, bins, frames) of a stereo buffer's spectra."""
    return 2, window // 2 + 1, max(0, samples - window) // hop + 1


def istft(spectra: np.ndarray, length: int, window: int = 4096, hop: int = 1024) -> np.ndarray:
    w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(window) / window))
    out, weight = np.zeros(max(length, (len(spectra) - 1) * hop + window)), np.zeros(max(length, (len(spectra) - 1) * hop + window))
    for i, y in enumerate(np.fft.irfft(spectra, window, axis=1)):
        out[i * hop : i * hop + window] += y * w
        weight[i * hop : i * hop + window] += w**2
    return (out / np.where(weight > 1e-8, weight, 1.0))[:length]
