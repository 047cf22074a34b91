"""Tempo and key of sample buffers.

The detectors take mono samples and their rate.  Both use one set of short-time spectra per track.  `DETECTORS` names
what a run can choose from: the spectral ones, and placeholders that depend on the buffer's length only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import arrays
from cadenza.functions.keys import NOTES

# Key profiles by scale degree (Krumhansl and Kessler, 1982).
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]

LOW_BPM, HIGH_BPM = 60.0, 200.0
KEY_WINDOW, ONSET_WINDOW, ONSET_HOP = 4096, 1024, 256
# Tempo around which a genre's tracks lie, for the optional prior.
GENRE_BPM = {"dnb": 174.0, "house": 124.0, "techno": 130.0, "trance": 138.0, "dubstep": 140.0, "hiphop": 90.0, "pop": 118.0, "rock": 120.0}


@dataclass
class Tempo:
    value: float = 120.0
    confidence: float = 0.0
    candidates: list[tuple[float, float]] = field(default_factory=list)


@dataclass
class Key:
    pitch_class: int = 0
    is_minor: bool = False
    confidence: float = 0.0

    @property
    def number(self) -> int:
        return (self.pitch_class * 7 + (4 if self.is_minor else 7)) % 12 + 1

    @property
    def camelot(self) -> str:
        return f"{self.number}{'A' if self.is_minor else 'B'}"

    @property
    def open_key(self) -> str:
        return f"{self.number}{'m' if self.is_minor else 'd'}"

    @property
    def standard(self) -> str:
        return NOTES[self.pitch_class] + ("m" if self.is_minor else "")


def magnitudes(x: np.ndarray, window: int, hop: int) -> np.ndarray:
    """Hann-windowed spectra, a row per frame; a short buffer is padded to one frame."""
    if len(x) < window:
        x = np.pad(x, (0, window - len(x)))
    w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(window) / window))
    frames = np.lib.stride_tricks.sliding_window_view(x, window)[::hop]
    return np.concatenate([np.abs(np.fft.rfft(frames[i : i + 512] * w, axis=1)) for i in range(0, len(frames), 512)])


def _with_candidates(bpm: float, confidence: float, share: float = 0.5) -> Tempo:
    return Tempo(bpm, confidence, [(bpm / 2, confidence * share), (bpm * 2, confidence * share)])


def spectral_tempo(x: np.ndarray, rate: int, genre: str | None = None) -> Tempo:
    """The lag between 60 and 200 beats a minute at which the spectral flux repeats best; 120 when nothing changes."""
    flux = np.maximum(np.diff(np.log1p(magnitudes(np.asarray(x, float), ONSET_WINDOW, ONSET_HOP)), axis=0), 0).sum(axis=1)
    if len(flux) < 8 or flux.std() < 1e-9:
        return _with_candidates(120.0, 0.0)
    local = np.convolve(flux, np.ones(31) / 31, "same")
    flux = np.maximum(flux - local, 0)
    flux = flux - flux.mean()
    n = 1 << (2 * len(flux) - 1).bit_length()
    auto = np.fft.irfft(np.abs(np.fft.rfft(flux, n)) ** 2, n)[: len(flux)]
    if auto[0] <= 0:
        return _with_candidates(120.0, 0.0)
    per_second = rate / ONSET_HOP
    lags = np.arange(int(np.ceil(60 * per_second / HIGH_BPM)), min(len(auto) - 2, int(60 * per_second / LOW_BPM)) + 1)
    if len(lags) < 3:
        return _with_candidates(120.0, 0.0)
    score = auto[lags] / auto[0]
    bpm = 60 * per_second / lags
    if genre in GENRE_BPM:
        score = score * np.exp(-0.5 * (np.log2(bpm / GENRE_BPM[genre]) / 0.4) ** 2)
    # of lags that repeat almost as well as the best, the shortest is the beat
    peaks = [i for i in range(1, len(lags) - 1) if score[i] >= score[i - 1] and score[i] >= score[i + 1]] or [int(score.argmax())]
    best = max(score[i] for i in peaks)
    k = min(i for i in peaks if score[i] >= 0.85 * best)
    lag = float(lags[k])
    if 0 < k < len(lags) - 1 and (bend := score[k - 1] - 2 * score[k] + score[k + 1]) < 0:
        lag += 0.5 * (score[k - 1] - score[k + 1]) / bend
    value = float(np.clip(60 * per_second / lag, LOW_BPM, HIGH_BPM))
    return _with_candidates(value, float(np.clip(score[k], 0, 1)))


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    mags = magnitudes(np.asarray(x, float), KEY_WINDOW, KEY_WINDOW // 2).sum(axis=0)
    hz = np.arange(len(mags)) * rate / KEY_WINDOW
    use = (hz >= 55) & (hz <= 5000)
    pitch = np.rint(12 * np.log2(hz[use] / 440.0) + 9).astype(int) % 12
    return np.bincount(pitch, mags[use], 12)


def key_of(histogram: np.ndarray) -> Key:
    """The key whose profile correlates best."""
    if histogram.std() < 1e-12:
        return Key()
    scores = np.array([[np.corrcoef(histogram, np.roll(profile, p))[0, 1] for p in range(12)] for profile in (MAJOR, MINOR)])
    m, p = np.unravel_index(scores.argmax(), scores.shape)
    return Key(int(p), bool(m), float(np.clip(scores.max(), 0, 1)))


def spectral_key(x: np.ndarray, rate: int) -> Key:
    return key_of(chroma(x, rate))


def placeholder_tempo(x: np.ndarray, rate: int, genre: str | None = None) -> Tempo:
    value = 70.0 + int(len(x) / rate * 1000) % 110 if rate else 70.0
    return Tempo(value, 0.0, [(value / 2, 0.3), (value * 2, 0.3)])


def placeholder_key(x: np.ndarray, rate: int) -> Key:
    h = len(x) % 24
    return Key(h % 12, h >= 12, 0.0)


DETECTORS = {"spectral": (spectral_tempo, spectral_key), "placeholder": (placeholder_tempo, placeholder_key)}


def register(name: str, tempo, key) -> None:
    """Add detectors: tempo(samples, rate, genre) -> Tempo, key(samples, rate) -> Key."""
    DETECTORS[name] = (tempo, key)


def spectra(df: DataFrame, id_col: str, samples_col: str, n: int) -> DataFrame:
    """(id, x): magnitudes of the windowed first n samples, batch by batch in numpy; null samples give null."""

    def run(batches):
        w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / n))
        for pdf in batches:
            given = pdf.pop(samples_col)
            x = np.zeros((len(given), n))
            for row, v in zip(x, given, strict=True):
                if v is not None:
                    row[: len(v)] = v[:n]
            made = np.abs(np.fft.rfft(x * w, axis=1))
            pdf["x"] = [None if v is None else y for v, y in zip(given, made, strict=True)]
            yield pdf

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, samples_col).mapInPandas(run, f"`{id_col}` {kind}, x array<double>")


def key_scores(histogram: Column) -> Column:
    """array<struct<pitch_class, is_minor, score>>: correlations of a 12-bin histogram with all rotated profiles."""
    centre = lambda c: arrays.bound(F.aggregate(c, F.lit(0.0), lambda a, b: a + b) / 12, lambda mean: F.transform(c, lambda v: v - mean))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)

    def scores(h: Column, square: Column) -> Column:
        out = []
        for minor, profile in ((False, MAJOR), (True, MINOR)):
            for p in range(12):
                w = np.roll(profile, p) - np.mean(profile)
                score = dot(h, F.array(*map(F.lit, w.tolist()))) / F.sqrt(square * F.lit(float((w**2).sum())))
                out.append(F.struct(F.lit(p).alias("pitch_class"), F.lit(minor).alias("is_minor"), score.alias("score")))
        return F.array(*out)

    return arrays.bound(centre(histogram), lambda h: arrays.bound(dot(h, h), lambda square: scores(h, square)))
