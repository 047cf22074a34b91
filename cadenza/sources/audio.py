"""Decoding of audio bytes to samples, and their tags.

WAV (8 to 32 bit PCM, 32 and 64 bit float) and AIFF are read here.  FLAC and MP3 need the optional `soundfile` package;
without it they are decode errors, never silence.
"""

from __future__ import annotations

import io
import struct
from dataclasses import dataclass

import numpy as np

from cadenza.errors import DecodeError

ANALYSIS_RATE, STEM_RATE = 22050, 44100
_CHUNK = 1024


@dataclass
class Buffer:
    """Samples by channel (channels x frames, single precision) and their rate."""

    channels: np.ndarray
    rate: int

    @property
    def seconds(self) -> float:
        return self.channels.shape[1] / self.rate if self.rate else 0.0


def _pcm(raw: bytes, bits: int, channels: int, big: bool, float_: bool = False, unsigned8: bool = True) -> np.ndarray:
    width = (bits + 7) // 8
    raw = raw[: len(raw) // (width * channels) * width * channels]
    end = ">" if big else "<"
    if float_:
        x = np.frombuffer(raw, f"{end}f{width}").astype(np.float32)
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128 if unsigned8 else np.frombuffer(raw, np.int8).astype(np.float32) / 128
    elif width in (2, 4):
        x = (np.frombuffer(raw, f"{end}i{width}") / float(1 << (8 * width - 1))).astype(np.float32)
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        b = b[:, ::-1] if big else b
        x = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = (np.where(x >= 1 << 23, x - (1 << 24), x) / float(1 << 23)).astype(np.float32)
    else:
        raise DecodeError(f"{bits} bits a sample")
    return x.reshape(-1, channels).T


def _chunks(data: bytes, at: int, big: bool):
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "big" if big else "little")
        yield name, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def _wav(data: bytes) -> Buffer:
    layout = body = None
    for name, chunk in _chunks(data, 12, False):
        if name == b"fmt " and len(chunk) >= 16:
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", chunk[:16])
            if kind == 0xFFFE and len(chunk) >= 26:
                kind = int.from_bytes(chunk[24:26], "little")
            layout = kind, channels, rate, bits
        elif name == b"data":
            body = chunk
    if layout is None or body is None or not layout[1]:
        raise DecodeError("no audio in the file")
    kind, channels, rate, bits = layout
    if kind not in (1, 3):
        raise DecodeError(f"codec {kind}")
    return Buffer(_pcm(body, bits, channels, False, kind == 3), rate)


def _extended(b: bytes) -> float:
    exponent, mantissa = int.from_bytes(b[:2], "big") & 0x7FFF, int.from_bytes(b[2:10], "big")
    return mantissa * 2.0 ** (exponent - 16383 - 63)


def _aiff(data: bytes) -> Buffer:
    layout = body = None
    for name, chunk in _chunks(data, 12, True):
        if name == b"COMM" and len(chunk) >= 18:
            kind = chunk[18:22] if data[8:12] == b"AIFC" else b"NONE"
            layout = int.from_bytes(chunk[:2], "big"), int.from_bytes(chunk[6:8], "big"), round(_extended(chunk[8:18])), kind
        elif name == b"SSND":
            body = chunk[8 + int.from_bytes(chunk[:4], "big") :]
    if layout is None or body is None or not layout[0]:
        raise DecodeError("no audio in the file")
    channels, bits, rate, kind = layout
    if kind not in (b"NONE", b"twos", b"sowt", b"fl32", b"FL32"):
        raise DecodeError(f"codec {kind!r}")
    return Buffer(_pcm(body, bits, channels, kind != b"sowt", kind.lower() == b"fl32", False), rate)


def decode(data: bytes) -> Buffer:
    """All channels at the file's own rate."""
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return _wav(data)
    if data[:4] == b"FORM" and data[8:12] in (b"AIFF", b"AIFC"):
        return _aiff(data)
    if data[:4] == b"fLaC" or data[:3] == b"ID3" or (len(data) > 1 and data[0] == 0xFF and data[1] & 0xE0 == 0xE0):
        try:
            import soundfile
        except ImportError:
            raise DecodeError("FLAC and MP3 need the soundfile package") from None
        try:
            x, rate = soundfile.read(io.BytesIO(data), dtype="float32", always_2d=True)
        except RuntimeError as e:
            raise DecodeError(str(e)) from None
        return Buffer(x.T, rate)
    raise DecodeError("no known audio format")


def mono(b: Buffer) -> np.ndarray:
    return b.channels.mean(axis=0, dtype=np.float64).astype(np.float32) if len(b.channels) > 1 else b.channels[0]


def stereo(b: Buffer) -> np.ndarray:
    """The two front channels; mono stands for both."""
    return b.channels[:2] if len(b.channels) > 1 else np.repeat(b.channels, 2, axis=0)


def resample(x: np.ndarray, rate_from: int, rate_to: int) -> np.ndarray:
    """Band-limited resampling by cutting or extending the spectrum of overlapping blocks."""
    if not len(x) or not rate_from or not rate_to or rate_from == rate_to:
        return x
    g = int(np.gcd(rate_from, rate_to))
    up, down = rate_to // g, rate_from // g
    size = max(1, -(-8 * _CHUNK // down)) * down  # a block becomes a whole number of samples
    out_size, edge = size * up // down, size // 8 // down * down
    out_edge = edge * up // down
    total = int(np.ceil(len(x) * rate_to / rate_from))
    step = size - 2 * edge
    padded = np.concatenate([np.zeros(edge), x, np.zeros(size + step)])
    parts = []
    for at in range(0, len(x), step):
        f = np.fft.rfft(padded[at : at + size])
        spectrum = np.zeros(out_size // 2 + 1, complex)
        keep = min(len(f), len(spectrum))
        spectrum[:keep] = f[:keep]
        y = np.fft.irfft(spectrum, out_size) * (out_size / size)
        parts.append(y[out_edge : out_size - out_edge])
    return np.concatenate(parts)[:total].astype(np.float32)


def to_pcm16(x: np.ndarray) -> np.ndarray:
    return np.clip(x * np.float32(32767.0), -32768.0, 32767.0).astype(np.int16)


def wav_bytes(channels: np.ndarray, rate: int) -> bytes:
    """A 16-bit WAV file."""
    body = np.ascontiguousarray(to_pcm16(channels).T).astype("<i2").tobytes()
    n = len(channels)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, n, rate, rate * n * 2, n * 2, 16, b"data", len(body))
    return head + body


TAGS = ("title", "artist", "album", "genre", "year")
_ID3 = {b"TIT2": "title", b"TPE1": "artist", b"TALB": "album", b"TCON": "genre", b"TDRC": "year", b"TYER": "year", b"TT2": "title", b"TP1": "artist", b"TAL": "album", b"TCO": "genre", b"TYE": "year"}
_INFO = {b"INAM": "title", b"IART": "artist", b"IPRD": "album", b"IGNR": "genre", b"ICRD": "year"}
_VORBIS = {"TITLE": "title", "ARTIST": "artist", "ALBUM": "album", "GENRE": "genre", "DATE": "year"}


def _id3(data: bytes) -> dict[str, str]:
    version = data[3]
    seven = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    size, at, out = seven(data[6:10]), 10, {}
    if data[5] & 0x40 and version > 2:
        at += seven(data[10:14]) if version == 4 else 4 + int.from_bytes(data[10:14], "big")
    head, name_len = (6, 3) if version == 2 else (10, 4)
    while at + head <= 10 + size:
        name, length = data[at : at + name_len], data[at + name_len : at + 2 * name_len]
        n = seven(length) if version == 4 else int.from_bytes(length, "big")
        body = data[at + head : at + head + n]
        if not name.strip(b"\0") or not n:
            break
        if name in _ID3 and body:
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            out.setdefault(_ID3[name], body[1:].decode(coding, "replace").split("\0")[0])
        at += head + n
    return out


def read_tags(data: bytes) -> dict[str, str | int | None]:
    """title, artist, album, genre and year; what can't be read is None."""
    found: dict[str, str] = {}
    try:
        if data[:3] == b"ID3":
            found = _id3(data)
        elif data[:4] in (b"RIFF", b"FORM"):
            for name, chunk in _chunks(data, 12, data[:4] == b"FORM"):
                if name in (b"id3 ", b"ID3 ") and chunk[:3] == b"ID3":
                    found = _id3(chunk)
                    break
                if name == b"LIST" and chunk[:4] == b"INFO":
                    found = {_INFO[k]: v.split(b"\0")[0].decode("utf-8", "replace") for k, v in _chunks(chunk, 4, False) if k in _INFO}
        elif data[:4] == b"fLaC":
            at = 4
            while at + 4 <= len(data):
                kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
                if kind & 0x7F == 4:
                    b, p = data[at + 4 : at + 4 + size], 4 + int.from_bytes(data[at + 4 : at + 8], "little")
                    n, p = int.from_bytes(b[p : p + 4], "little"), p + 4
                    for _ in range(n):
                        k = int.from_bytes(b[p : p + 4], "little")
                        key, _, value = b[p + 4 : p + 4 + k].decode("utf-8", "replace").partition("=")
                        if key.upper() in _VORBIS:
                            found.setdefault(_VORBIS[key.upper()], value)
                        p += 4 + k
                if kind & 0x80:
                    break
                at += 4 + size
    except (IndexError, struct.error, ValueError):
        pass
    year = found.get("year", "")[:4]
    return {t: found.get(t) for t in TAGS[:4]} | {"year": int(year) if year.isdigit() else None}
