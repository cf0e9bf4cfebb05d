"""Whole-text token ids of a public byte-level BPE, for batches of texts inside a task."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

#: Runs of white space are cut by the vocabulary's own rule; a single blank opens the next piece.
_RUN = re.compile(r"(\s{2,}|^\s|\s$)")
_BLANKS = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: White space on which the library and Python might disagree: such texts are encoded in one piece.
_ODD = re.compile("[\x00\x1c-\x1f\x85\u180e\u200b\ufeff]")
#: A letter before one of these at a part's end ends a piece.
_MARKS = ".,;:!?"
_PLAIN = bytes(b for b in range(256) if b in (10, 32) or b > 32)
_PAIRS = ("  ", "\n\n", " \n", "\n ")


def _simple(text: str) -> bool:
    """No white space but single blanks and line ends between other characters."""
    if any(x in text for x in _PAIRS) or text[0] in " \n" or text[-1] in " \n" or text.encode("utf-8", "surrogatepass").translate(None, _PLAIN):
        return False
    return text.isascii() or not _BLANKS.search(text) and not _ODD.search(text)


def _words(text: str) -> list[str]:
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").removeprefix("\0").split("\0")


def _cut(text: str) -> list[str]:
    """Split a text where the vocabulary's pattern always ends a piece, so that parts encode alone as in the whole.

    Such places lie before a blank that a non-blank follows, around any other single white space between
    non-blanks, and before the last character of a longer run.
    """
    if _simple(text):
        return _words(text)
    if _ODD.search(text):
        return [text]
    out: list[str] = []
    head = ""
    parts = _RUN.split(text)
    for k, part in enumerate(parts):
        if not part:
            continue
        if k % 2 == 0:
            out += _words(head + part)
            head = ""
            continue
        if head:
            out.append(head)
            head = ""
        if not any(parts[k + 1 :]):
            out.append(part)
            continue
        if len(part) > 1:
            out.append(part[:-1])
        head = part[-1]
        if head != " ":
            out.append(head)
            head = ""
    if head:
        out.append(head)
    return out


class _Slots(dict):
    """Numbers parts in the order in which they are first asked for, and lists those that are new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        k = self[part] = len(self)
        self.new.append(part)
        return k


class Encoder:
    """Ids of whole texts by the tokenizers library; a part seen before is looked up.

    Before a batch that finds more than ``keep`` parts the memory starts anew.
    """

    def __init__(self, path: str, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        self.keep = keep
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        plain = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the characters by which the vocabulary writes bytes, asked of the library
        self.written = {b: plain.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        for lead, rest in ((0xC2, 0x80), (0xC3, 0xC0)):
            for b in range(rest, rest + 64):
                two = plain.pre_tokenize_str(chr(b))[0][0]
                self.written[lead], self.written[b if lead == 0xC2 else b - 64] = two[0], two[1]
        for b in range(0xC4, 0xF5):
            low = 0xA0 if b == 0xE0 else 0x90 if b == 0xF0 else 0x80
            tail = {2: [low], 3: [low, 0x80], 4: [low, 0x80, 0x80]}[2 if b < 0xE0 else 3 if b < 0xF0 else 4]
            self.written[b] = plain.pre_tokenize_str(bytes([b, *tail]).decode())[0][0][0]
        self._clear()

    def _clear(self) -> None:
        self.slot = _Slots()
        self.ids = np.zeros(0, dtype=self.dtype)
        self.start = self.length = np.zeros(0, dtype=np.int64)

    def _piece(self, piece: str) -> list[int]:
        text = piece.encode().decode("latin-1").translate(self.written) if not piece.isascii() else self.written[32] + piece[1:] if piece[0] == " " and piece[1:].isalnum() else piece.translate(self.written)
        return [t.id for t in self.model.tokenize(text)]

    def _known(self, word: str, before: int) -> list[int]:
        """Ids of a word, looked up if it is one of the first ``before`` parts."""
        k = dict.get(self.slot, word, before)
        return self.ids[self.start[k] : self.start[k] + self.length[k]].tolist() if k < before else self._piece(word)

    def _learn(self) -> None:
        ids: list[int] = []
        learned = len(self.length)
        lengths = np.zeros(len(self.slot.new), dtype=np.int64)
        for k, part in enumerate(self.slot.new):
            before = len(ids)
            if (part[1:] if part[0] == " " else part).isalpha():
                ids += self._piece(part)
            elif part[-1] in _MARKS and (part[1:-1] if part[0] == " " else part[:-1]).isalpha():
                ids += self._known(part[:-1], learned)
                ids += self._known(part[-1], learned)
            elif any(x in part for x in self.added) or _ODD.search(part):
                ids += self.tokenizer.encode(part, add_special_tokens=False).ids
            else:
                for piece in self.pieces(part):
                    ids += self._piece(piece)
            lengths[k] = len(ids) - before
        self.slot.new = []
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.ids = np.concatenate([self.ids, np.array(ids, dtype=self.dtype)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many of them each text has; a null text has none."""
        if len(self.slot) > self.keep:
            self._clear()
        cut = [([t] if any(x in t for x in self.added) else _cut(t)) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.slot.__getitem__, flat), dtype=np.int64, count=len(flat))
        if self.slot.new:
            self._learn()
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.start[at] - (ends - lengths), lengths) + np.arange(total)
        sums = np.concatenate([[0], ends])
        edges = np.cumsum([0, *map(len, cut)])
        return self.ids[source], sums[edges[1:]] - sums[edges[:-1]]

    def byte_lengths(self) -> np.ndarray:
        """UTF-8 bytes that each id stands for: a byte-level vocabulary writes one character for each byte."""
        out = np.zeros(self.vocabulary, dtype=np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            out[k] = len(token)
        for k, added in self.tokenizer.get_added_tokens_decoder().items():
            out[k] = len(added.content.encode())
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def batches(texts: list[str | None], characters: int = 1_000_000):
    """Index ranges of about so many characters: what is worked on at once is bounded but for a single text."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= characters:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
