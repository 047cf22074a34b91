"""Sample buffers as array columns: channels, resampling, chunks, windows, spectra, levels.  Arithmetic is in double."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PCM_MAX, PCM_MIN, PCM_SCALE = 32767.0, -32768.0, 32767.0
TINY = 1e-8


def _upto(n: Column) -> Column:
    """0, 1, ... n - 1; sequence(0, -1) would count down."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _at(x: Column, i: Column) -> Column:
    return F.get(x, i.cast("int"))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once; an expression that lambdas name is computed wherever they name it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def frames(x: Column, channels: int) -> Column:
    """Runs of `channels` samples; the last may be shorter."""
    n = F.ceil(F.size(x) / F.lit(channels))
    return F.transform(_upto(n), lambda i: F.slice(x, i * channels + 1, F.lit(channels)))


def to_mono(x: Column, channels: int) -> Column:
    """The mean of each frame; a shorter last frame counts with its own length."""
    if channels == 0:
        return F.array().cast("array<double>")
    if channels == 1:
        return x.cast("array<double>")
    return F.transform(frames(x.cast("array<double>"), channels), lambda f: _total(f) / F.size(f))


def downmix(x: Column, channels: int) -> Column:
    """Stereo of the first two channels of each frame; a lone sample stands for both."""
    if channels == 0:
        return F.array().cast("array<double>")
    if channels <= 2:
        return x.cast("array<double>")
    return F.flatten(F.transform(frames(x.cast("array<double>"), channels), lambda f: F.array(_at(f, F.lit(0)), F.coalesce(_at(f, F.lit(1)), _at(f, F.lit(0))))))


def interleave(left: Column, right: Column) -> Column:
    """L, R, L, R, ... as long as both last."""
    n = F.least(F.size(left), F.size(right))
    return F.flatten(F.transform(_upto(n), lambda i: F.array(_at(left, i), _at(right, i))))


def deinterleave(x: Column, channel: int) -> Column:
    """Every other sample; an odd one at the end is dropped."""
    return F.transform(_upto(F.floor(F.size(x) / 2)), lambda i: _at(x, i * 2 + channel))


def resample_linear(x: Column, rate_from: int, rate_to: int) -> Column:
    """Interpolated at steps of from / to; the last sample is held; at most ten times as long."""
    if rate_from == rate_to or not rate_from or not rate_to:
        return x.cast("array<double>")
    ratio, y = rate_from / rate_to, x.cast("array<double>")
    n = F.least(F.floor(F.size(x) / F.lit(ratio)), F.size(x).cast("bigint") * 10)

    def value(i: Column) -> Column:
        at = i.cast("double") * F.lit(ratio)
        k = F.floor(at)
        a, b = _at(y, k), _at(y, k + 1)
        return F.coalesce(a + (b - a) * (at - k), a, F.element_at(y, -1))

    return F.transform(_upto(n), value)


def chunk_plan(total: Column, chunk: int, overlap: int) -> Column:
    """array<struct<index, start, end>>: chunks at steps of chunk - overlap, until less than an overlap is left."""
    stride = chunk - overlap
    if stride <= 0:
        raise ValueError("a chunk must be longer than its overlap")
    starts = F.when(total <= 0, F.array().cast("array<bigint>")).when(total <= chunk, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), (total - 1).cast("bigint"), F.lit(stride).cast("bigint")))
    kept = F.filter(starts, lambda s, i: (i == 0) | (total - s >= overlap))
    return F.transform(kept, lambda s, i: F.struct(i.alias("index"), s.alias("start"), F.least(s + chunk, total.cast("bigint")).alias("end")))


def crossfade(length: Column, overlap: int, first: Column, last: Column) -> Column:
    """Weights of a chunk: up over the overlap unless it is the first, down unless it is the last."""
    fade = F.least(F.lit(overlap).cast("bigint"), length.cast("bigint"))

    def weight(i: Column) -> Column:
        up = F.when(~first & (i < fade), i / fade).otherwise(F.lit(1.0))
        down = F.when(~last & (i >= length - fade), (length - i) / fade).otherwise(F.lit(1.0))
        return up * down

    return F.transform(_upto(length), weight)


def hann(n: int) -> Column:
    return F.transform(_upto(F.lit(n)), lambda i: F.lit(0.5) * (1 - F.cos(F.lit(2 * math.pi) * i / n)))


def spectrum(x: Column, n: int, part: str = "magnitude") -> Column:
    """Magnitude or phase of the discrete Fourier transform of the windowed first n samples, by its definition."""
    y, w = x.cast("array<double>"), hann(n)
    wave = F.zip_with(F.slice(y, 1, n), w, lambda a, b: a * b)

    def side(wave: Column, k: Column, f) -> Column:
        return _total(F.transform(wave, lambda v, i: v * f(F.lit(2 * math.pi / n) * ((k * i) % n))))

    def bin_(wave: Column, k: Column) -> Column:
        re, im = side(wave, k, F.cos), -side(wave, k, F.sin)
        return F.hypot(re, im) if part == "magnitude" else F.atan2(im, re)

    return bound(wave, lambda v: F.transform(_upto(F.lit(n // 2 + 1)), lambda k: bin_(v, k)))


def from_polar(magnitude: Column, phase: Column) -> Column:
    return F.zip_with(magnitude, phase, lambda m, p: F.struct((m * F.cos(p)).alias("re"), (m * F.sin(p)).alias("im")))


def pcm16(x: Column) -> Column:
    """Samples as 16-bit numbers: scaled, clamped, cut toward zero."""
    return F.transform(x.cast("array<double>"), lambda v: F.least(F.greatest(v * PCM_SCALE, F.lit(PCM_MIN)), F.lit(PCM_MAX)).cast("smallint"))


def autocorrelation(x: Column, low: int, high: int) -> Column:
    """Sums of products at lags low .. high of the samples less their mean."""

    def sums(z: Column) -> Column:
        n = F.size(z)
        both = lambda k: F.zip_with(F.slice(z, F.lit(1), F.greatest(n - k, F.lit(0))), F.slice(z, k + 1, F.greatest(n - k, F.lit(0))), lambda a, b: a * b)
        return F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: _total(both(k)))

    y = x.cast("array<double>")
    centred = bound(_total(y) / F.size(y), lambda mean: F.transform(y, lambda v: v - mean))
    return bound(centred, sums)


def duration(samples: Column, rate: Column) -> Column:
    return F.when(rate > 0, F.size(samples) / rate).otherwise(F.lit(0.0))
