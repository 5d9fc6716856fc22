"""Token ids of whole texts by a public tokenizer file.

Byte-level BPE never merges across the pieces that the file's own splitting
pattern makes, and a piece begins at every single blank or line feed between
two other characters.  So a worker keeps the ids of what stands between them
and asks the library only for what it has not met, many words in one call.
Texts with white space in a row go piece by piece, and texts with
characters outside the ranges below, where splitters might disagree on a
character's class, are given to the library whole.  ``path`` names the
tokenizer file on every machine.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share a machine's cores already

#: Words and pieces that a worker knows, words that it keeps between tasks, words of one call, characters of texts that are looked up at once.
WORDS, PIECES, KEPT, CALL, SLICE = 500_000, 50_000, 120_000, 20_000, 3_000_000
#: What may end a word of letters: a run of these is a piece of its own.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters whose class is beyond doubt: ASCII without separators 1C-1F, Latin, Greek, Cyrillic, general punctuation.
_ODD = re.compile(r"[^\t\n\r\x20-\x7E¡-¬®-ɏΑ-ΡΣ-ϿЀ-ҁ‐-‧‰-⁞€]")
_ENCODERS: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, one run after the other."""
    after = np.cumsum(sizes, dtype=np.int32)
    out = np.repeat(starts - (after - sizes), sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Words:
    """Known words with their ids, which lie one after the other in an array; place 0 is a word without ids."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.start, self.size, self.met = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.used, self.n = 0, 1

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.n + len(words) > len(self.start):
            self.start, self.size, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.met))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        at = slice(self.n, self.n + len(words))
        self.start[at], self.size[at], self.met[at] = np.cumsum(sizes) - sizes + self.used, sizes, 0
        self.ids[self.used : self.used + len(ids)] = ids
        self.place.update(zip(words, range(at.start, at.stop)))
        self.n, self.used = at.stop, self.used + len(ids)

    def places(self, words: list[str], unknown: int) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, itertools.repeat(unknown)), np.int32, len(words))

    def packed(self, most: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The words that most batches had, and that more than one had, with their ids, sizes and counts; at most ``most``, in a few flat arrays."""
        enough = 2
        while np.count_nonzero(self.met[: self.n] >= enough) > most:
            enough += 1
        words = [w for w, i in self.place.items() if self.met[i] >= enough]
        at = self.places(words, 0)
        return pa.array(words, pa.string()), self.ids[_ragged(self.start[at], self.size[at])], self.size[at], self.met[at]

    @classmethod
    def unpacked(cls, words: pa.Array, ids: np.ndarray, sizes: np.ndarray, met: np.ndarray) -> Words:
        out = cls()
        out.add(words.to_numpy(zero_copy_only=False).tolist(), ids, sizes)
        out.met[1 : out.n] = met
        return out


class Encoder:
    def __init__(self, path: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        #: words with the blank before them, or with the line feed that they begin with
        self.words: Words | None = Words()
        self.idle: tuple | None = None  # the words that wait for the next task
        self.parts: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros((2, max(vocabulary.values()) + 1), bool)  # tokens that begin with a blank, with a line feed
        for token, i in vocabulary.items():
            self.opens[:, i] = token[0] == "\u0120", token[0] == "\u010a"

    def _whole(self, words: list[str], lines: bool) -> int:
        """Ids of words after blanks or line feeds: one call for many, cut where a token begins with that character.  The first word's place."""
        first = self.words.n
        for lo in range(0, len(words), CALL):
            some = words[lo : lo + CALL]
            text = "".join(some) if lines else " " + " ".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.r_[np.flatnonzero(self.opens[int(lines)][ids]), len(ids)]
            if len(cuts) != len(some) + 1 or cuts[0]:
                raise ValueError("the tokenizer does not begin a token at each blank and line feed")
            self.words.add(some, ids, np.diff(cuts))
        return first

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Places of words that were not known: none for white space alone or inside.

        Letters and a tail of other characters are two pieces, and the library is asked for each of them once.
        """
        words, names = self.words, new.to_numpy(zero_copy_only=False).tolist()
        mask = lambda x: x.to_numpy(zero_copy_only=False)
        line = mask(pc.starts_with(new, "\n"))
        bare = pc.utf8_ltrim(new, characters="\n")
        size = pc.utf8_length(bare).to_numpy()
        head = pc.utf8_rtrim(bare, characters=_TAIL)
        head_size = pc.utf8_length(head).to_numpy()
        sound = mask(pc.utf8_is_printable(bare)) & (size > 0)
        two = sound & ~line & (head_size < size) & mask(pc.utf8_is_alpha(head))
        out = np.zeros(len(names), np.int32)
        for lines in (False, True):
            at = np.flatnonzero(sound & ~two & (line == lines))
            out[at] = self._whole([names[i] for i in at.tolist()], lines) + np.arange(len(at))
        at = np.flatnonzero(two)
        if len(at):
            heads = head.filter(pa.array(two)).dictionary_encode()
            some = heads.dictionary.to_numpy(zero_copy_only=False).tolist()
            known = words.places(some, -1)
            ask = np.flatnonzero(known < 0)
            known[ask] = self._whole([some[i] for i in ask.tolist()], False) + np.arange(len(ask))
            first = known[heads.indices.to_numpy()]
            joined = [names[i] for i in at.tolist()]
            tails = pa.array([w[k:] for w, k in zip(joined, head_size[at].tolist())], pa.string()).dictionary_encode()
            pieces = [self._piece(x) for x in tails.dictionary.to_pylist()]
            lengths = np.fromiter(map(len, pieces), np.int32, len(pieces)) // 4
            second = tails.indices.to_numpy()
            n = np.stack([words.size[first], lengths[second]], 1)
            begin = np.stack([words.start[first], (np.cumsum(lengths, dtype=np.int32) - lengths + np.int32(words.used))[second]], 1)
            pool = np.concatenate([words.ids[: words.used], np.frombuffer(b"".join(pieces), "<u4")])
            out[at] = words.n + np.arange(len(at))
            words.add(joined, pool[_ragged(begin.ravel(), n.ravel())], n.sum(1))
        return out

    def _piece(self, piece: str) -> bytes:
        found = self.parts.get(piece)
        if found is None:
            self.parts[piece] = found = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        return found

    def _pieces(self, text: str) -> bytes:
        pieces, parts = self.pieces(text), self.parts
        new = [p for p in dict.fromkeys(pieces) if p not in parts]
        if new:
            if len(parts) > PIECES:
                parts.clear()
                new = list(dict.fromkeys(pieces))
            for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                parts[p] = np.array(e.ids, "<u4").tobytes()
        return b"".join(map(parts.__getitem__, pieces))

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """Each text's ids and the end id, as little-endian unsigned 32-bit integers."""
        tail, out, plain, size = np.uint32(end).astype("<u4").tobytes(), [], [], 0
        for i, t in enumerate(texts):
            if not t:
                out.append(tail)
            elif _ODD.search(t):
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() + tail)
            else:
                out.append(None)
                plain.append(i)
                size += len(t)
            if plain and (size >= SLICE or i == len(texts) - 1):
                for k, ids in zip(plain, self._by_words([texts[k] for k in plain], end)):
                    out[k] = self._pieces(texts[k]) + tail if ids is None else ids
                plain, size = [], 0
        return out

    def rest(self) -> None:
        """Forget between tasks all but the words that batches share, and pack those: other work on this machine needs the memory."""
        if self.words is not None:
            self.idle, self.words = self.words.packed(KEPT), None
        self.parts.clear()

    def _by_words(self, texts: list[str], end: int) -> list[bytes | None]:
        """Ids of texts from their distinct words; None where white space stands in a row."""
        # a line feed before a text makes its first word like any other; its token gives way to the end id
        split = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        met, place, ends = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), split.offsets.to_numpy()
        if self.words is None:
            self.words, self.idle = Words.unpacked(*self.idle), None
        at = self.words.places(met, -1)
        if at.min(initial=0) < 0:
            if len(self.words.place) > WORDS:
                kept, self.words = self.words.packed(WORDS // 2), None
                self.words = Words.unpacked(*kept)
                at = self.words.places(met, -1)
            new = at < 0
            at[new] = self._learn(coded.dictionary.filter(pa.array(new)))
        words = self.words
        words.met[at] += 1
        n = words.size[at][place]
        flat = words.ids[_ragged(words.start[at][place], n)]  # a slice has far fewer than 2**31 ids
        after = np.cumsum(n)
        stop = after[ends[1:] - 1]
        begin = np.r_[0, stop[:-1]]
        bad = np.logical_or.reduceat(n == 0, ends[:-1])
        flat[:-1] = flat[1:].copy()
        flat[stop - 1] = end
        raw = flat.astype("<u4", copy=False).tobytes()
        return [None if x else raw[4 * a : 4 * b] for a, b, x in zip(begin.tolist(), stop.tolist(), bad.tolist())]


def encoder(path: str) -> Encoder:
    """One for each worker process and file; its pieces serve all of the worker's tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
