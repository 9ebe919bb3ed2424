"""Token ids of whole texts by the tokenizers library, with words looked up before they are encoded.

A byte-level BPE tokenizer first cuts a text into words and then works on each word alone.  No word of
its reaches over the place before a run of blanks or line feeds, so a text cut at those places gives
the same ids piece by piece.  Pieces seen before come from a bounded table; new words go to the
library's model and other new pieces to the whole library, many in one text.  Texts with any other
white space go to the library whole.
"""

from __future__ import annotations

import gc
import os
import re
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from twinscript.llm import common

PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Put before a text, so that its first word is told from the words that follow a blank.
FIRST = "\x01"
#: Put before marks that end a word, which are words of their own to the tokenizer.
MARK = "\x02"
#: How byte-level vocabularies write a blank and a line feed.
BLANK, FEED = "\u0120", "\u010a"
#: White space, or what some library takes for it, other than blank and line feed.
SPACES = ("\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
          "\u2009\u200a\u200b\u200c\u200d\u200e\u200f\u2028\u2029\u202f\u205f\u3000\ufeff")
OTHER_SPACE = re.compile(f"[{SPACES}]")
#: Texts that are not plain words with one blank or line feed between them.
ODD = f"[{SPACES}{FIRST}{MARK}]|  |\n\n| \n|\n |^[ \n]|[ \n]\\z"
#: Keys of pieces that the tokenizer takes as one word, or as a line feed and one word.
WORD = re.compile(f"[\n{FIRST}]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
TRIED = ("the", "Strasse", "stra\u00dfe", "\u00e9t\u00e9", "Na\u00efvet\u00e9", "x", "QZXKJWV", "antidisestablishmentarianism")
#: Marks that are cut from the word before them if white space or the end follows: the tokenizer never joins them with a letter.
MARKS = r"[!-/:-@\[-`{-~]"
KEPT = 300_000
PER_CALL = 64
_SHARED: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_signs() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the others by signs from 256 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


def key_of(piece: str) -> str:
    """What a piece is known by: without the blank that most begin with, the others are told from these by their first sign."""
    if piece[0] == " " and piece[1:2] not in ("", " ", "\n", FIRST, MARK):
        return piece[1:]
    return piece if piece[0] == "\n" else FIRST + piece


def piece_of(key: str) -> str:
    return key[1:] if key[0] in (FIRST, MARK) else key if key[0] == "\n" else " " + key


class Encoder:
    """``encode(texts)`` gives one array of unsigned 32-bit ids per text, as the library's own ``encode``."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        # the library's model alone, for words that are told apart already
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        self.kept = kept
        # pieces by key, in the order of their numbers; all ids; by number: where a piece's ids start, how many, how many batches had it
        self.known: dict[str, int] = {}
        self.pool = np.zeros(0, dtype="<u4")
        self.first, self.size, self.met = (np.zeros(0, dtype=np.int32) for _ in range(3))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.head = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.head[[i for t, i in vocabulary.items() if t[:1] in (BLANK, FEED)]] = True
        signs = {chr(b): sign for b, sign in byte_signs().items()}
        self.signs = str.maketrans(signs | {" ": f" {BLANK}", "\n": f" {FEED} "})
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.direct = not any(WORD.fullmatch(t.strip()) for t in self.added) and self._agrees()

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """The encoder of this worker, which later tasks find with the words of earlier ones."""
        if path not in _SHARED:
            # a table of words is no garbage that would be worth looking through so often
            gc.set_threshold(100_000)
            _SHARED[path] = cls(path)
        return _SHARED[path]

    def _agrees(self) -> bool:
        """Whether the model alone gives the whole library's ids of some words."""
        for heads in (("",), ("\n", FIRST)):
            keys = [head + word for head in heads for word in TRIED]
            ids, first, size = self._words(keys)
            if [ids[a:a + n].tolist() for a, n in zip(first.tolist(), size.tolist())] != [
                    x.tolist() for x in self._library([piece_of(k) for k in keys])]:
                return False
        return True

    def _make_room(self, numbers: np.ndarray, new: int) -> np.ndarray:
        """If the table is full, this batch's pieces stay and those that most batches had, if that leaves enough room; returns the
        batch's new numbers (-1: not known)."""
        if len(self.known) + new <= self.kept:
            return numbers
        needed = np.zeros(len(self.known), dtype=bool)
        needed[numbers[numbers >= 0]] = True
        stay = needed.copy()
        often = np.argsort(-self.met, kind="stable")[:self.kept // 2]
        stay[often[self.met[often] > 1]] = True  # most words are met once
        if np.count_nonzero(stay) + new > self.kept:
            stay = needed
        at = np.flatnonzero(stay)
        self.known = dict(zip(compress(self.known, stay.tolist()), range(len(at))))
        self.pool, ends = self._ids(at)
        # what was frequent long ago gives way
        self.first, self.size, self.met = ends[:-1], self.size[at], (self.met[at] + 1) // 2
        moved = np.cumsum(stay, dtype=np.int32) - 1
        out = np.full(len(numbers), -1, dtype=np.int32)
        out[numbers >= 0] = moved[numbers[numbers >= 0]]
        return out

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def _split(self, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces whose only blank or line feed is their first byte, which the first of their ids holds; where each piece's start, and how many."""
        ids = np.concatenate([np.zeros(0, dtype="<u4"), *[np.array(e.ids, dtype="<u4") for e in found]])
        first = np.flatnonzero(self.head[ids]).astype(np.int32)
        return ids, first, np.diff(first, append=np.int32(len(ids)))

    def _words(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words by the library's model alone, as from ``_split``; all of them follow a blank, or none does."""
        blank, texts = keys[:1] and keys[0][0] not in (FIRST, "\n"), []
        for at in range(0, len(keys), PER_CALL):
            some = keys[at:at + PER_CALL]
            text = " " + " ".join(some) if blank else "".join(["\n" + k[1:] for k in some])
            texts.append(text.encode().decode("latin-1").translate(self.signs))
        ids, first, size = self._split(self.model.encode_batch_fast(texts, add_special_tokens=False))
        if not blank and len(first) == len(keys):
            # a text's first word has no line feed before it
            lone = np.array([k[0] == FIRST for k in keys], dtype=np.int32)
            first, size = first + lone, size - lone
        return ids, first, size

    def _add(self, keys: list[str], ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(first)), strict=True))
        self.first = np.concatenate([self.first, first + np.int32(len(self.pool))])
        self.size = np.concatenate([self.size, size])
        self.met = np.concatenate([self.met, np.zeros(len(first), dtype=np.int32)])
        self.pool = np.concatenate([self.pool, ids])

    def _learn(self, new: list[str]) -> None:
        """Ids of new pieces: words by the model, if it agrees with the whole library on such, other pieces many in one text of the library's."""
        if self.direct:
            words = [bool(WORD.fullmatch(k)) for k in new]
            found, new = list(compress(new, words)), [k for k, w in zip(new, words, strict=True) if not w]
            for some in ([k for k in found if k[0] not in (FIRST, "\n")], [k for k in found if k[0] in (FIRST, "\n")]):
                self._add(some, *self._words(some))
        alone = [k[0] in (FIRST, MARK, "\n") or any(t in f" {k}" for t in self.added) for k in new]
        rest = list(compress(new, alone))
        ids = self._library([piece_of(k) for k in rest])
        size = np.array([len(x) for x in ids], dtype=np.int32)
        self._add(rest, np.concatenate([np.zeros(0, dtype="<u4"), *ids]), np.cumsum(size, dtype=np.int32) - size, size)
        spaced = [k for k, a in zip(new, alone, strict=True) if not a]
        self._add(spaced, *self._split(self.tokenizer.encode_batch_fast(
            ["".join([f" {k}" for k in spaced[at:at + PER_CALL]]) for at in range(0, len(spaced), PER_CALL)],
            add_special_tokens=False)))

    def _ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known pieces one after another, and where those of each start and the last ones end."""
        each = self.size[numbers]
        # a batch has fewer than 2**31 ids: half the memory of 64-bit places
        ends = np.zeros(len(each) + 1, dtype=np.int32)
        np.cumsum(each, out=ends[1:])
        shift = self.first[numbers]
        shift -= ends[:-1]
        place = np.repeat(shift, each)
        place += np.arange(len(place), dtype=np.int32)
        return self.pool[place], ends

    def _numbers(self, keys: list[str]) -> np.ndarray:
        """The numbers of different pieces, all of which are known afterwards."""
        numbers = np.fromiter(map(self.known.get, keys, repeat(-1)), dtype=np.int32, count=len(keys))
        at = np.flatnonzero(numbers < 0)
        new = [keys[i] for i in at.tolist()]
        numbers = self._make_room(numbers, len(new))
        self._learn(new)
        numbers[at] = np.fromiter(map(self.known.__getitem__, new), dtype=np.int32, count=len(new))
        self.met[numbers] += 1
        return numbers

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and where those of each text start and the last ones end."""
        column = common.compact(column)
        odd = pc.match_substring_regex(column, ODD)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(column, token))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = column.filter(pa.array(~odd))
        # one blank or line feed between any two words: each word takes the one before it along
        spaced = pc.replace_substring_regex(pc.replace_substring(plain, "\n", " \n"),
                                            rf"(\pL)({MARKS}+)( |\z)", rf"\1 {MARK}\2\3")
        cut = pc.split_pattern(pc.binary_join_element_wise(
            pa.scalar(FIRST, pa.large_string()), spaced, pa.scalar("", pa.large_string())), " ")
        words = cut.flatten().dictionary_encode()
        keys = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        whole = column.filter(pa.array(odd)).to_pylist()
        rest = [[key_of(p) for p in PIECE.findall(t)] if not OTHER_SPACE.search(t) else None for t in whole]
        places = {k: i for i, k in enumerate(keys)} if any(rest) else {}
        for ks in rest:
            for k in ks or ():
                if places.setdefault(k, len(keys)) == len(keys):
                    keys.append(k)
        numbers = self._numbers(keys)
        ids, ends = self._ids(numbers[words.indices.to_numpy()])
        bounds = ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()] if len(plain) else np.zeros(1, np.int64)
        if not rest:
            return ids, bounds.astype(np.int64)
        extra = [self._ids(numbers[[places[k] for k in ks]])[0] if ks else self._library([t])[0]
                 for ks, t in zip(rest, whole, strict=True)]
        out, p, x = [], 0, 0
        for o in odd:
            if o:
                out.append(extra[x])
                x += 1
            else:
                out.append(ids[bounds[p]:bounds[p + 1]])
                p += 1
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(o) for o in out])])
