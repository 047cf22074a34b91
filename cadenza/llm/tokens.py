"""Token ids of whole texts, by a public tokenizer file.

A tokenizer that lower-cases its input and drops white space treats each run of other characters by itself, so runs are
encoded once and remembered (`Encoder.LIMIT` of them; then the memory is emptied and filled again).  For any other
tokenizer, and for texts that hold a special token's string, the whole text is encoded.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cadenza.llm.textvec import spans

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: ASCII white space is what bytes.split() splits at; the tokenizer drops it, and no piece reaches across it.
_PART = 1 << 20
#: A mark after a letter is a piece of its own: the tokenizer splits between letters and what is none.
_STOPS = frozenset(b".,;:!?")
_LETTER_END = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf]).\Z", re.DOTALL).search


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    LIMIT = 500_000

    def __init__(self, path: str, end_id: int | None = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and len(splits) == 1 and splits[0]["behavior"] == "Removed" and r"[^\s\p{L}\p{N}]+" in splits[0]["pattern"].get("Regex", "")
        self.special = [x["content"].encode().lower() for x in spec.get("added_tokens", [])]
        self.end = b"" if end_id is None else np.uint32(end_id).tobytes()
        self.words: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        known = self.words
        new = set(words).difference(known)
        if len(known) + len(new) > self.LIMIT:
            known.clear()
            new = set(words)
        ended = {w for w in new if w[-1] in _STOPS and _LETTER_END(w)}
        plain = list((new - ended).union([w[:-1] for w in ended], [w[-1:] for w in ended]).difference(known))
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            known.update(zip(part, self._whole([w.decode() for w in part]), strict=True))
        for w in ended:
            known[w] = known[w[:-1]] + known[w[-1:]]

    def encode(self, column: pa.Array) -> Iterator[bytes]:
        """Each row's ids as little-endian unsigned 32-bit integers, the end id last; a null text is empty."""
        data, start, end = spans(column)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + _PART, "right")))
            texts = [data[a:b].tobytes() for a, b in zip(start[i:j].tolist(), end[i:j].tolist(), strict=True)]
            plain = [self.by_word and not any(s in t.lower() for s in self.special) for t in texts]
            split = [t.lower().split() if p else None for t, p in zip(texts, plain, strict=True)]
            if j == i + 1 and plain[0] and len(split[0]) > self.LIMIT:  # one very long text
                out = []
                for k in range(0, len(split[0]), self.LIMIT // 4):
                    part = split[0][k : k + self.LIMIT // 4]
                    self._learn(part)
                    out.append(b"".join(map(self.words.__getitem__, part)))
                yield b"".join(out) + self.end
            else:
                self._learn([w for s in split if s for w in s])
                for t, s in zip(texts, split, strict=True):
                    yield (self._whole([t.decode()])[0] if s is None else b"".join(map(self.words.__getitem__, s))) + self.end
            i = j


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None = END_ID) -> Encoder:
    """This process's encoder: workers are used again, and so is what theirs has learnt."""
    if (path, end_id) not in _encoders:
        _encoders.clear()
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def crc(ids: bytes | np.ndarray | memoryview) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids if isinstance(ids, (bytes, memoryview)) else np.ascontiguousarray(ids, "<u4").tobytes())
