"""Token ids of whole texts by a public word-BPE vocabulary, exactly as the tokenizers library gives them.

Texts are split at ASCII white space, where this tokenizer always splits; ids of frequent chunks are kept.
The library costs tens of microseconds a call, so new chunks of plain Latin letters go through tiktoken in one
call, with the merges as ranks and the word end as a byte of its own; any other chunk goes to the library itself.
"""

from __future__ import annotations

import json

import numpy as np
import regex

KEPT_CHUNKS = 150_000
_PLAIN = regex.compile(r"[\x21-\x7e¡-¬®-įı-ž]+")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_END, _BREAK = "\x01", " "  # end of a piece, end of a chunk; neither is a plain character


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use for the 256 bytes."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path) as f:
            model = json.load(f)["model"]
        letters, vocab = _byte_letters(), model["vocab"]

        def raw(token: str) -> bytes:
            end = token.endswith("</w>") and token != "</w>"
            return bytes(letters[c] for c in (token[:-4] if end else token)) + (b"\x01" if end else b"")

        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        ids: list[int] = [-1] * 256
        for letter, b in letters.items():
            ids[b] = vocab[letter]
        for letter, b in letters.items():
            ranks[bytes([b, 1])] = len(ids)
            ids.append(vocab[letter + "</w>"])
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            if (key := raw(a) + raw(b)) in ranks:
                continue
            ranks[key] = len(ids)
            ids.append(vocab[a + b])
        self.ids_of = np.array(ids, "<u4")
        self.stop = ranks[b" "]
        self.fast = tiktoken.Encoding("words", pat_str=r" |[^\x01 ]+\x01", mergeable_ranks=ranks, special_tokens={})
        self.kept: dict[bytes, bytes] = {}

    def _new(self, chunks: list[bytes]) -> list[bytes]:
        text = [c.decode("utf-8", "replace") for c in chunks]
        plain = [bool(_PLAIN.fullmatch(t)) and "<|" not in t for t in text]
        out: list[bytes] = [b""] * len(chunks)
        if easy := [i for i, p in enumerate(plain) if p]:
            joined = _PIECE.sub(r"\g<0>" + _END, _BREAK.join(text[i].lower() for i in easy))
            ranks = np.array(self.fast.encode_ordinary(joined), np.int64)
            ends = np.append(np.flatnonzero(ranks == self.stop), len(ranks)).tolist()
            data, at = self.ids_of[ranks].tobytes(), 0
            for i, e in zip(easy, ends, strict=True):
                out[i], at = data[4 * at : 4 * e], e + 1
        if hard := [i for i, p in enumerate(plain) if not p]:
            for i, e in zip(hard, self.slow.encode_batch_fast([text[i] for i in hard], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [t.encode("utf-8", "replace").split() for t in texts]
        fresh = list(set().union(*split).difference(self.kept)) if split else []
        made = dict(zip(fresh, self._new(fresh), strict=True))
        if len(self.kept) < KEPT_CHUNKS:
            self.kept.update(made)
            made = {} if len(made) < KEPT_CHUNKS else made
        if not made:
            return [b"".join(map(self.kept.__getitem__, chunks)) for chunks in split]
        kept = self.kept.get
        return [b"".join([x if (x := kept(c)) is not None else made[c] for c in chunks]) for chunks in split]
