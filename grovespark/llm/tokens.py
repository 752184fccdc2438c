"""Token ids of a byte-level BPE vocabulary file: those of the ``tokenizers`` library, without its slow offsets.

``tiktoken`` runs the same merges about five times as fast. Two things it does
otherwise, or not at all, are done here: strings of the file's added tokens get
these tokens' ids, as the library gives them, and a long run of white space is cut
off before the split, for which ``tiktoken``'s pattern would overflow its stack.
``verify`` compares both libraries on samples, once in each driver.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: How this kind of vocabulary splits text before merging; a fixed part of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern's white space, and runs of it that are cut off.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = 10_000
_RUN = re.compile(rf"(?<!{SPACE}){SPACE}{{{LONG_RUN}}}{SPACE}*")
SAMPLES = (
    "",
    "It's the 1st of ten; we'll see.  Two  blanks\n\n and\tlines\r\n",
    "Größe été niño ñ ß Ωμέγα Привет 你好 שלום ١٢٣ ½ 𝒳 👩‍👩‍👧 é   ​",
    "a  <|endoftext|> b<|endoftext|><|endof !!!??? x" + "ab" * 300,
    "a" + " \n" * LONG_RUN + "b" + " " * LONG_RUN + "　c" + "\t" * LONG_RUN,
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such a file: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        added = content["added_tokens"]
        if content.get("normalizer") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} is not a vocabulary of the expected kind")
        self.added = {t["content"]: t["id"] for t in added}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in t): rank for t, rank in content["model"]["vocab"].items() if t not in self.added}
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = 1 + max([*ranks.values(), *self.added.values()])

    def encode(self, text: str) -> list[int]:
        if self.parts is None or not any(t in text for t in self.added):
            return self.ordinary(text)
        out: list[int] = []
        for i, part in enumerate(self.parts.split(text)):
            out += [self.added[part]] if i % 2 else self.ordinary(part)
        return out

    def ordinary(self, text: str) -> list[int]:
        """Ids of text without added tokens. Of a run of white space before a word, the last character goes with the word."""
        if len(text) < LONG_RUN:
            return self.bpe.encode_ordinary(text)
        out: list[int] = []
        at = 0
        for m in _RUN.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.bpe.encode_ordinary(text[at : m.start()])
            out += self.bpe._encode_single_piece(text[m.start() : end])
            at = end
        return out + self.bpe.encode_ordinary(text[at:])


@functools.lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    """The encoder of a file, once for each worker."""
    return Encoder(path)


@functools.lru_cache(maxsize=8)
def verify(path: str) -> int:
    """The number of ids, if the encoder agrees with the library on ``SAMPLES``. For the driver, before a job starts."""
    from tokenizers import Tokenizer

    own, library = load(path), Tokenizer.from_file(path)
    for text in SAMPLES:
        if library.encode(text, add_special_tokens=False).ids != own.encode(text):
            raise ValueError(f"{path} is not a vocabulary of the expected kind")
    return own.size


def token_ids(encoder: Encoder, text: str | None, end_id: int = 0) -> np.ndarray:
    """The text's ids and then ``end_id``, as little-endian 32-bit numbers. Null: as empty."""
    ids = encoder.encode(text) if text else []
    ids.append(end_id)
    return np.array(ids, dtype="<u4")
