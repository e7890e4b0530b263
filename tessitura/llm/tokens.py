"""Token ids of whole texts, with the ids of recurring pieces remembered.

The split before the merges never joins what stands on two sides of a single space, so the ids of a text are
the ids of its pieces one after another: the byte vocabulary's pieces start with their space, the word
vocabulary drops spaces. It also parts ASCII letters and digits from marks that end a piece, and single line ends from
both their sides. Texts with runs of white space are cut only at single spaces apart from runs, so a piece may
hold a run; texts with strings of special tokens, or the character that parts pieces here, are encoded whole. ASCII texts
are lowered first where the vocabulary lowers.

Arrow cuts the texts of a slice and numbers their distinct pieces; each is looked up once and numpy lines the ids
up. New words of ASCII letters and digits go to the tokenizer many at a time as one text, parted by a token that no
such word contains. What is remembered is bounded in bytes.
"""

from __future__ import annotations

import os
import re
import sys
import types
from array import array
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What the remembered pieces of one encoder may take, about; two generations share it.
MEMO_BYTES = 288 << 20
#: Bytes of a remembered piece besides its text and ids.
ENTRY = 200
#: Pieces and characters a call of the tokenizer; more only hold more encodings at once.
BATCH, CHARACTERS = 500, 1 << 14
_RUN = re.compile(r"\s\s")
_APART = re.compile(r"(?<=\S) (?=\S)")
_WORD = re.compile(r" ?[A-Za-z0-9]{1,100}")
PART = "\x1f"
_MARKS = rf"([A-Za-z0-9])([.,;:!?]+)({PART}|\s|$)"


def public_file(name: str) -> str:
    """Place of a public tokenizer's file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered:
    """Ids by piece: those of this generation, and those of the one before."""

    def __init__(self) -> None:
        self.now: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0

    def age(self, most: int) -> None:
        """Beyond ``most`` bytes, these become the older ones and the ones before are forgotten."""
        if self.size > most:
            self.older, self.now, self.size = self.now, {}, 0

    def learn(self, pieces: Sequence[str], ids: Sequence[bytes]) -> None:
        """Remembers the ids of new pieces."""
        self.now.update(zip(pieces, ids, strict=True))
        self.size += sum(map(len, pieces)) + sum(map(len, ids)) + ENTRY * len(pieces)


class PieceEncoder:
    """Encodes texts with a ``tokenizers`` file into little-endian unsigned 16-bit ids."""

    def __init__(self, name: str, spaces_kept: bool, memo_bytes: int = MEMO_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(name if os.path.isabs(name) else public_file(name))
        if self.model.get_vocab_size() > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.spaces_kept, self.memo_bytes = spaces_kept, memo_bytes
        self.memo = Remembered()
        self.parting = "\n" if spaces_kept else " . "
        parting = self.model.encode("\n" if spaces_kept else ".", add_special_tokens=False).ids
        self.parted_by = parting[0] if len(parting) == 1 else None

    def _array(self, ids: Sequence[int]) -> array:
        out = array("H", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out

    def _ids(self, texts: Iterable[str]) -> list[bytes]:
        return [self._array(e.ids).tobytes() for e in self.model.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _ids_of_words(self, texts: list[str]) -> list[bytes]:
        """The same for words of ASCII letters and digits, as one text."""
        if self.parted_by is not None:
            ids = np.frombuffer(self._array(self.model.encode(self.parting.join(texts), add_special_tokens=False).ids), np.uint16)
            ends = [*np.flatnonzero(ids == self.parted_by).tolist(), len(ids)]
            if len(ends) == len(texts):
                raw = ids.tobytes()
                return [raw[2 * a : 2 * b] for a, b in zip([0, *(e + 1 for e in ends)], ends)]
        return self._ids(texts)

    def _learn(self, pieces: Sequence[str]) -> list[bytes]:
        """The ids of distinct pieces, new ones remembered."""
        memo = self.memo
        new = [p for p in pieces if p not in memo.now]
        if memo.older and new:
            older = [p for p in new if p in memo.older]
            memo.learn(older, [memo.older[p] for p in older])
            new = [p for p in new if p not in memo.now]
        is_word = [_WORD.fullmatch(p) is not None for p in new]
        for kind, ids in ((True, self._ids_of_words), (False, self._ids)):
            part, size = [], 0
            for p in (p for p, word in zip(new, is_word, strict=True) if word is kind):
                part.append(p)
                size += len(p)
                if len(part) == BATCH or size > CHARACTERS:
                    memo.learn(part, ids(part))
                    part, size = [], 0
            if part:
                memo.learn(part, ids(part))
        return list(map(memo.now.__getitem__, pieces))

    def _parted(self, text: str) -> str:
        """The text with ``PART`` before each piece but the first."""
        if not self.spaces_kept:
            return (text.lower() if text.isascii() else text).replace("\n", " ").replace(" ", PART)
        if _RUN.search(text):
            return _APART.sub(f"{PART} ", text)
        return text.replace(" ", f"{PART} ").replace("\n", f"{PART}\n{PART}")

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text."""
        self.memo.age(self.memo_bytes // 2)
        out: list[bytes] = [b""] * len(texts)
        usual = []
        for i, text in enumerate(texts):
            if "<|" in text or PART in text:
                out[i] = self._ids([text])[0]
            else:
                usual.append(i)
        if not usual:
            return out
        marked = pc.replace_substring_regex(pa.array([self._parted(texts[i]) for i in usual], pa.large_string()), _MARKS, rf"\1{PART}\2\3")
        pieces = pc.split_pattern(marked, PART)
        ends = np.asarray(pieces.offsets, np.int64) - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        found = self._learn(coded.dictionary.to_pylist())
        index = np.asarray(coded.indices)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 2
        size, begin = sizes[index], (np.cumsum(sizes) - sizes)[index]
        upto = np.cumsum(size)
        ids = np.frombuffer(b"".join(found), np.uint16)[np.repeat(begin - (upto - size), size) + np.arange(upto[-1])]
        raw, limits = ids.tobytes(), np.concatenate([[0], upto])[ends] * 2
        for i, a, b in zip(usual, limits[:-1].tolist(), limits[1:].tolist(), strict=True):
            out[i] = raw[a:b]
        return out


def worker_encoder(name: str, spaces_kept: bool) -> PieceEncoder:
    """The encoder of this Python worker: Spark gives one worker many tasks, and what it remembers serves them all.

    Functions travel to workers by value, with globals of their own each time, so the encoders stay in a module of
    the process. A lost worker costs only its memory.
    """
    held = sys.modules.setdefault("tessitura_worker", types.ModuleType("tessitura_worker"))
    encoders = held.__dict__.setdefault("encoders", {})
    key = (name, spaces_kept)
    if key not in encoders:
        encoders.clear()
        encoders[key] = PieceEncoder(name, spaces_kept)
    return encoders[key]
