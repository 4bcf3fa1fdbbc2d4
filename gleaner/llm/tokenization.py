"""Encoding with public tokenizers inside Arrow functions.

Texts are cut at safe boundaries, places where no token can cross, and each
distinct piece of a batch is encoded once.  A tokenizer that drops white space
(its rules match no white space, and its special strings hold none) cannot make
a token across ASCII white space, so each word may be encoded by itself.
For other tokenizers the whole text is one piece.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import regex

WHITE_SPACE = "\t\n\x0b\x0c\r "
#: Marks that a word may lose at its end, to be encoded apart.
MARKS = ".,;:!?|"
_MARKS = MARKS.encode()
#: Pieces remembered by a Python worker at most, and the longest that is remembered, in bytes.
REMEMBERED, LONGEST = 1_000_000, 48
#: Stands between words that are encoded in one go: a character that is one token by itself between spaces. Words that hold it are encoded alone.
SEPARATOR = " ~ "

def words_alone(rules: dict) -> bool:
    """Whether a tokenizer file's rules let each word be encoded by itself, in lower case and without its last marks.

    Its normaliser lowers letters and otherwise only composes characters and
    replaces white space; its splitter keeps what one expression matches, which
    is never white space nor a letter or digit with a mark after it; and no
    special string holds white space.
    """
    normal, pre = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
    steps, splits = normal.get("normalizers", [normal]), pre.get("pretokenizers", [pre])
    kinds = {x.get("type") for x in steps}
    pattern = splits[0].get("pattern", {}).get("Regex")
    if not pattern or "Lowercase" not in kinds or not kinds <= {"NFC", "Lowercase", "Replace"} or any(x["type"] == "Replace" and x["pattern"] != {"Regex": r"\s+"} for x in steps):
        return False
    kept = splits[0].get("behavior") == "Removed" and splits[0].get("invert") and all(x.get("type") == "ByteLevel" and not x.get("use_regex") and not x.get("add_prefix_space") for x in splits[1:])
    blank = any(c in pattern for c in WHITE_SPACE) or any(regex.search(pattern, c) for c in WHITE_SPACE) or any(c in x["content"] for x in rules.get("added_tokens", []) for c in WHITE_SPACE)
    return bool(kept and not blank and all(regex.findall(pattern, c + m) == [c, m] for c in "a0" for m in MARKS))


_encoders: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """Pieces of text to token counts, or to their ids as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str, want_ids: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.want_ids, self.known = want_ids, {}
        path = name if os.path.isabs(name) else public_tokenizers.path(name)
        self.by_word = name.endswith(".json") and words_alone(json.loads(Path(path).read_text()))
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=str(path))
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(str(path))
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            if self.by_word:
                (self.separator,) = self.encode([SEPARATOR])[0]
                bare = Tokenizer.from_str(json.dumps(json.loads(Path(path).read_text()) | {"normalizer": None}))
                self.encode_lower = lambda texts: [x.ids for x in bare.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, raw: bytes) -> list[bytes]:
        """bytes.split() cuts at ASCII white space only."""
        return raw.split() if self.by_word else [raw]

    def learn(self, pieces: set[bytes]) -> list[bytes]:
        """Encode what isn't known yet; returns the pieces to forget after this batch."""
        new = pieces.difference(self.known)
        if len(self.known) + 2 * len(new) > REMEMBERED:
            self.known.clear()
            new = pieces
        if not self.by_word:
            for piece in new:
                self.known[piece] = self.value(np.array(self.encode([piece.decode("utf-8", "replace")])[0], "<u4"))
            return list(new)
        parts = {x: self.parts(x) for x in new}
        cores = list({y for x in parts.values() for y in x}.difference(self.known))
        apart = {x for x in cores if b"<|" in x or b"~" in x}
        plain = [x for x in cores if x not in apart]
        # the normaliser leaves printable ASCII in lower case as it is
        lower = [x for x in plain if x.isascii() and x == x.lower() and x.decode().isprintable()]
        other = list(set(plain).difference(lower))
        for words, encode in ((lower, self.encode_lower), (other, self.encode)):
            for at in range(0, len(words), 4096):
                part = words[at : at + 4096]
                ids = np.array(encode([SEPARATOR.join(x.decode("utf-8", "replace") for x in part)])[0], "<u4")
                ends = [*np.flatnonzero(ids == self.separator).tolist(), len(ids)]
                starts = [0, *(x + 1 for x in ends[:-1])]
                if self.want_ids:
                    raw = ids.tobytes()
                    values = [raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]
                else:
                    values = [b - a for a, b in zip(starts, ends, strict=True)]
                self.known.update(zip(part, values, strict=True))
        for piece in apart:
            self.known[piece] = self.value(np.array(self.encode([piece.decode("utf-8", "replace")])[0], "<u4"))
        for piece, (core, *tail) in parts.items():
            self.known[piece] = self.known[core] + self.known[tail[0]] if tail else self.known[core]
        return [x for held in (new, cores) for x in held if len(x) > LONGEST]

    def value(self, ids: np.ndarray) -> bytes | int:
        return ids.tobytes() if self.want_ids else len(ids)

    @staticmethod
    def parts(word: bytes) -> tuple[bytes, ...]:
        """A word without its last punctuation, and that: letters and digits never share a token with it.  ASCII words in lower case."""
        core = word.rstrip(_MARKS)
        if not core or b"<" in word or not core[-1:].isalnum():
            return (word,)
        low = core.lower() if core.isascii() else core
        return (low, word[len(core) :]) if len(core) < len(word) else (low,)

    def batch(self, raws: list[bytes]) -> Iterator:
        """Per text its number of tokens, or its ids."""
        split = [self.pieces(x) for x in raws]
        forget = self.learn(set().union(*split))
        get = self.known.__getitem__
        if self.want_ids:
            yield from (b"".join(map(get, x)) for x in split)
        else:
            yield from (sum(map(get, x)) for x in split)
        for piece in forget:
            self.known.pop(piece, None)


def encoder(name: str, want_ids: bool = False) -> Encoder:
    """One encoder for each Python worker and tokenizer."""
    if (name, want_ids) not in _encoders:
        _encoders[name, want_ids] = Encoder(name, want_ids)
    return _encoders[name, want_ids]


def by_bytes(rows: Iterable[tuple], most: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows whose last item is a byte string, in lists of about as many bytes each."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def arrow_rows(batches: Iterable) -> Iterator[tuple]:
    """Rows of Arrow batches whose last column is text: each as (..., UTF-8 bytes), null text as empty."""
    import pyarrow as pa

    for batch in batches:
        *first, text = batch.columns
        raw = text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary())
        for at in range(0, len(raw), 256):
            part = [x.slice(at, 256).to_pylist() for x in (*first, raw)]
            part[-1] = [x or b"" for x in part[-1]]
            yield from zip(*part, strict=True)
