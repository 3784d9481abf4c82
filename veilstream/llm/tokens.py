"""Exact, cached token encoding shared by the token operators.

A text is cut at ASCII white space only. The tokenizer drops white space and never merges
across it, so the ids of a text are the ids of its chunks in a row. Each chunk is encoded
once per worker and kept in a bounded cache.

Chunks of plain Latin letters, digits and punctuation go through a byte-pair engine built from
the tokenizer file itself; every other chunk, and every chunk that might hold a special token, is
encoded by the tokenizers library as it is. Both give the library's ids.
"""

from __future__ import annotations

import json
import os

import numpy as np

#: Chunks that a worker keeps, in two generations; about 200 bytes each.
CACHE_ENTRIES = 1_000_000
#: Texts are taken together up to this size, so that new chunks are encoded in few calls.
BATCH_BYTES = 1 << 20

_open: dict = {}


def word_table_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {chr(b): b for b in plain}
    shifted = 256
    for b in range(256):
        if b not in plain:
            chars[chr(shifted)] = b
            shifted += 1
    return chars


class Encoder:
    """Encodes whole texts with one tokenizer file into packed uint32 ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocab_size = self.library.get_vocab_size(with_added_tokens=True)
        self.fast, self.pattern = self._engine(spec)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks = sorted({t["content"][:2] for t in spec.get("added_tokens", [])})

    def _engine(self, spec: dict):
        import re

        import regex
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers") or []
        names = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        known = (
            model.get("type") == "BPE"
            and model.get("end_of_word_suffix") == "</w>"
            and not model.get("ignore_merges")
            and model.get("dropout") is None
            and names == ["NFC", "Replace", "Lowercase"]
            and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
        )
        if not known:
            return None, None
        chars, ranks = _byte_chars(), {}
        for piece, n in model["vocab"].items():
            ended = piece.endswith("</w>") and len(piece) > 4
            body = bytes(chars[c] for c in (piece[:-4] if ended else piece))
            if not ended and b"\n" in body and body != b"\n":
                continue
            ranks[body + b"\n" if ended else body] = n
        self.safe = re.compile("[!-~À-ÖØ-öø-įı-ſ]+").fullmatch
        # A line end stands for the end of a word: no chunk holds one.
        engine = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})
        self.gap = ranks[b"\x01\n"]
        return engine.encode_ordinary, regex.compile(parts[0]["pattern"]["Regex"]).findall

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """The packed ids of each chunk; plain chunks are encoded in one call."""
        if not self.fast:
            return [self._by_library(c) for c in chunks]
        texts = [c.decode("utf-8", "replace") for c in chunks]
        joined = "".join(texts)
        if not self.safe(joined) or any(m in joined for m in self.marks):
            plain = [bool(self.safe(t)) and not any(m in t for m in self.marks) for t in texts]
            known = iter(self._plain([t for t, p in zip(texts, plain) if p]))
            return [next(known) if p else self._by_library(c) for c, p in zip(chunks, plain)]
        return self._plain(texts)

    def _by_library(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _plain(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        # U+0001 is a word of one id here, and no plain text holds it.
        words = self.pattern(" \x01 ".join(texts).lower() + " \x01")
        ids = np.asarray(self.fast("\n".join(words) + "\n"), dtype="<u4")
        ends = np.flatnonzero(ids == self.gap)
        packed, starts = ids.tobytes(), np.concatenate(([0], ends[:-1] + 1))
        return [packed[a:b] for a, b in zip((starts * 4).tolist(), (ends * 4).tolist())]

    def encode_many(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of whole UTF-8 texts as little-endian uint32; null counts as empty."""
        out = []
        for batch in _batches(texts):
            chunks = [t.split() for t in batch]
            self._learn(set().union(*chunks))
            get = self.young.__getitem__
            out += [b"".join(map(get, c)) for c in chunks]
        return out

    def _learn(self, chunks: set[bytes]) -> None:
        """Two generations: when the young one is full it becomes the old one, and what is used again moves over."""
        missing = chunks.difference(self.young)
        if len(self.young) + len(missing) > CACHE_ENTRIES // 2:
            self.old, self.young, missing = self.young, {}, chunks
        again = missing.intersection(self.old)
        self.young.update((c, self.old[c]) for c in again)
        fresh = list(missing - again)
        self.young.update(zip(fresh, self.encode_chunks(fresh)))

    def encode(self, text: bytes | None) -> bytes:
        return self.encode_many([text])[0]


def _batches(texts: list[bytes | None]):
    batch, size = [], 0
    for t in texts:
        batch.append(t or b"")
        size += len(batch[-1])
        if size >= BATCH_BYTES:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def encoder(path: str) -> Encoder:
    """One encoder per process and file."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]
