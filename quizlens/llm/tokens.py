"""Token ids of whole texts by the tokenizers library, piece by piece.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so
the ids of the pieces put together are the ids of the text.  Arrow cuts a
batch of texts and numbers its distinct pieces; a bounded memory of pieces
then saves the library most of its work, and numpy puts the ids together.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Between a character that is not white space and a space before another such character.
_SPACE = re.compile(r" (?=\S)(?<=\S )")


class Memory(NamedTuple):
    """What a worker may hold: pieces kept, and bytes of text cut at a time (or one text, where it is longer)."""

    pieces: int
    step_bytes: int


#: About 500 MB a worker; and about 350 MB, for workers that other stages have filled before.
WHOLE, SHARED = Memory(1_000_000, 8_000_000), Memory(500_000, 3_000_000)
#: Longest piece kept.
LONGEST = 40
#: Marks that are tokens of their own where one follows a letter and ends a piece.
AFTER = ".,;:!?"
#: Latin, Greek and Cyrillic letters lie before it.
SURE = "\u0530"
#: Words that are encoded as one text, and characters that the library gets at a time.
LOT, AT_ONCE = 500, 250_000


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``cut`` says where a tokenizer always cuts: ``"words"`` at any ASCII white
    space, which it drops (it lower-cases too, so pieces are kept in lower
    case); ``"spaces"`` before a single space, which goes with what follows;
    ``None`` nowhere (texts are encoded whole).  The strings of special tokens
    are ordinary text.
    """

    def __init__(self, path: str, cut: str | None, memory: Memory = WHOLE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cut = cut
        self.memory = memory
        # Pieces as they are cut, and their ids.  A text's first piece has no
        # space before it: its key is the piece with a space, as no other piece starts with one.
        self.known: dict[str, bytes] = {}
        # Ids that a word's tokens hold exactly one of: with the sign of a word's end, or of the space before it.
        marks = (lambda t: t.endswith("</w>")) if cut == "words" else (lambda t: t.startswith("\u0120"))
        vocabulary = self.tokenizer.get_vocab()
        self.mark = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.mark[[i for t, i in vocabulary.items() if marks(t)]] = True
        self.after = dict(zip(AFTER, self._direct(list(AFTER))))

    def _string(self, piece: str) -> str:
        """What a piece stands for: with the space before it, unless it is a text's first."""
        if self.cut == "words":
            return piece
        return piece[1:] if piece[:1] == " " else " " + piece

    def _encodings(self, strings: list[str]) -> Iterator:
        """The library's encodings, some at a time: each holds far more than its ids."""
        start = 0
        while start < len(strings):
            stop, size = start + 1, len(strings[start])
            while stop < len(strings) and size < AT_ONCE:
                size += len(strings[stop]) + 40
                stop += 1
            yield from self.tokenizer.encode_batch_fast(strings[start:stop], add_special_tokens=False)
            start = stop

    def _direct(self, strings: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._encodings(strings)]

    def _alone(self, string: str) -> bool:
        """A word of letters alone, with the space before it if pieces have one, that is one word to the tokenizer too.

        In lower case it must still be letters (``İ`` becomes a letter and a
        mark), and from scripts whose letters all tables of characters agree on.
        """
        if self.cut != "words":
            if string[:1] != " ":
                return False
            string = string[1:]
        return string.isalpha() and (string.isascii() or (max(string) < SURE and string.lower().isalpha()))

    def _learn(self, pieces: list) -> None:
        """Words of letters are encoded many at a time, as one text; a word with a mark after it is put together."""
        words, others, marked = {}, [], []
        for piece in pieces:
            string = self._string(piece)
            if self._alone(string):
                words[piece] = string
            elif string[-1:] in self.after and self._alone(string[:-1]):
                marked.append((piece, piece[:-1], string[-1]))
                if piece[:-1] not in self.known:
                    words[piece[:-1]] = string[:-1]
            else:
                others.append((piece, string))
        glue, items = " " if self.cut == "words" else "", list(words.items())
        lots = [items[k:k + LOT] for k in range(0, len(items), LOT)]
        for lot, one in zip(lots, self._encodings([glue.join(s for _, s in lot) for lot in lots])):
            ids = np.array(one.ids, dtype="<u4")
            at = np.flatnonzero(self.mark[ids])
            if len(at) != len(lot):
                others += lot
                continue
            stops = 4 * (at + 1 if self.cut == "words" else np.append(at[1:], len(ids)))
            data, start = ids.tobytes(), 0
            for (piece, _), stop in zip(lot, stops.tolist()):
                self.known[piece] = data[start:stop]
                start = stop
        self.known.update(zip([p for p, _ in others], self._direct([s for _, s in others])))
        for piece, word, mark in marked:
            self.known[piece] = self.known[word] + self.after[mark]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        found = list(map(self.known.get, pieces))
        places = [k for k, ids in enumerate(found) if ids is None]
        missing = [pieces[k] for k in places]
        self._learn(missing)
        for k, p in zip(places, missing):
            found[k] = self.known[p]
        for p in missing:
            if len(p) > LONGEST:
                del self.known[p]
        if len(self.known) > self.memory.pieces:
            self.known.clear()
        return found

    def _step(self, texts: pa.Array) -> list[bytes]:
        if self.cut == "words":
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        else:
            lists = pc.split_pattern(texts, " ")
        ends = lists.offsets.to_numpy()
        numbered = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        ends = ends - ends[0]
        pieces, which = numbered.dictionary.to_pylist(), numbered.indices.to_numpy().copy()
        if self.cut == "spaces":
            # Beside other white space a space is no sure cut: such texts are cut one by one.
            odd = np.array([not p or p[0].isspace() or p[-1].isspace() for p in pieces], dtype=bool)
            strange = np.flatnonzero(np.add.reduceat(odd[which], ends[:-1])).tolist()
            found = self._ids(pieces)
            firsts = [" " + pieces[k] for k in which[ends[:-1]].tolist()]
            which[ends[:-1]] = len(pieces) + np.arange(len(firsts))
            distinct = dict.fromkeys(firsts)
            distinct.update(zip(distinct, self._ids(list(distinct))))
            found += [distinct[p] for p in firsts]
        else:
            strange = []
            found = self._ids(pieces)
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        taken = sizes[which]
        stops = np.cumsum(taken)
        # A step's ids are counted in 32 bits where they fit, as they do but for one very long text.
        kind = np.int32 if len(stops) and stops[-1] < 1 << 31 else np.int64
        from_ = np.repeat((starts[which] - (stops - taken)).astype(kind), taken)
        from_ += np.arange(len(from_), dtype=kind)
        at = (4 * np.concatenate([[0], stops])[ends]).tolist()
        data = flat[from_].tobytes()
        out = [data[a:b] for a, b in zip(at, at[1:])]
        for k in strange:
            first, *rest = _SPACE.split(texts[k].as_py())
            out[k] = b"".join(self._ids([" " + first, *rest]))
        return out

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; a null counts as empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = texts.cast(pa.string()).fill_null("")
        if self.cut is None:
            yield from self._direct(texts.to_pylist())
            return
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.empty(0)
        start = 0
        while start < len(texts):
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + self.memory.step_bytes, side="right")))
            yield from self._step(texts.slice(start, stop - start))
            start = stop
        pa.default_memory_pool().release_unused()


@lru_cache(maxsize=4)
def encoder(path: str, cut: str | None, memory: Memory = WHOLE) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, cut, memory)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
