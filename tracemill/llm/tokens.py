"""Token ids of many texts at once, the same as the tokenizer's own but computed once for each different chunk.

A text is cut where the tokenizer always cuts: for a byte-level vocabulary before each single space between two
characters that are no white space, for a word vocabulary at ASCII white space. Ids of a chunk do not depend on its
neighbours, so each different chunk of a slice is encoded once and kept in a bounded memo. Texts for which this does
not hold (white space in a row, special tokens' strings) are encoded whole.
"""

from __future__ import annotations

import gc
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks in a generation of the memo.
MEMO = 100_000
#: Chunks that are one word of Latin letters and one run of punctuation at most, which a tokenizer never merges.
SIMPLE, MARKS = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+[.,;:!?]*$", ".,;:!?"
#: Texts that are encoded whole: a space at an end or beside other white space, or what may be a special token.
WHOLE_BYTES = r"^ | $|[\s\x0b\x1c-\x1f\x{85}\p{Z}] | [\s\x0b\x1c-\x1f\x{85}\p{Z}]|<\|"
WHOLE_WORDS = r"<\|"

_loaded: dict[str, "Encoder"] = {}


class Encoder:
    def __init__(self, path: str, byte_level: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are Spark's to run side by side
        from tokenizers import Tokenizer

        self.tokenizer, self.byte_level = Tokenizer.from_file(path), byte_level
        # ids (as unsigned 32-bit integers) of chunks met lately, and of those met before them
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, list[int]] = {"": []}
        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.alphabet = {b: chr(b) if b in own else chr(next(other)) for b in range(256)}

    def encode_all(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def of_words(self, words: list[str], spaced: list[bool]) -> list[bytes]:
        """Ids of words of SIMPLE form, by the tokenizer's own merges: its other steps leave such words whole."""
        merges, alphabet, tails, space, out = self.tokenizer.model.tokenize, self.alphabet, self.tails, self.alphabet[32], []
        for word, after in zip(words, spaced, strict=True):
            core = word.rstrip(MARKS)
            if core is not word:
                tail = word[len(core) :]
                if tail not in tails:
                    tails[tail] = self.tokenizer.encode(tail, add_special_tokens=False).ids
            else:
                tail = ""
            if not self.byte_level:
                core = core.lower()
            if not core.isascii():
                core = core.encode().decode("latin-1").translate(alphabet)
            ids = [t.id for t in merges(space + core if after else core)]
            out.append(array("I", ids + tails[tail] if tail else ids).tobytes())
        return out

    def of_chunks(self, names: list[str], spaced: list[bool], simple: list[bool]) -> list[bytes]:
        """Ids of different chunks; a spaced one begins with a space."""
        memo, older = self.memo, self.older
        chunks = [" " + c if after else c for c, after in zip(names, spaced, strict=True)] if self.byte_level else names
        out = [memo.get(c) or older.get(c) for c in chunks]
        new = [i for i, ids in enumerate(out) if ids is None]
        words, rest = [i for i in new if simple[i]], [i for i in new if not simple[i]]
        for i, ids in zip(words, self.of_words([names[i] for i in words], [spaced[i] for i in words]), strict=True):
            out[i] = ids
        if rest:
            for i, ids in zip(rest, self.encode_all([chunks[i] for i in rest]), strict=True):
                out[i] = array("I", ids).tobytes()
        if len(memo) > MEMO:
            self.older, self.memo = memo, {}
        self.memo.update(zip(chunks, out, strict=True))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the first id's index of each text (one more at the end). Null is empty."""
        gc.disable()  # the memo's many small lists hold no cycles; walking them again and again costs more than encoding
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.asarray(pc.match_substring_regex(texts, WHOLE_BYTES if self.byte_level else WHOLE_WORDS))
        lists = pc.split_pattern(texts, " ") if self.byte_level else pc.ascii_split_whitespace(texts)
        flat, starts = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
        starts = starts - starts[0]
        coded = flat.dictionary_encode()
        at, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
        if self.byte_level:  # all but a text's first chunk begin with their space
            key = at * 2 + 1
            key[starts[:-1]] -= 1
        else:
            key = at * 2
        if whole.any():
            key = key[~np.repeat(whole, np.diff(starts))]
        used = np.flatnonzero(np.bincount(key, minlength=2 * len(names)))
        simple = np.asarray(pc.match_substring_regex(coded.dictionary, SIMPLE))[used >> 1] if len(used) else used
        ids = self.of_chunks([names[k] for k in (used >> 1).tolist()], ((used & 1) > 0).tolist(), simple.tolist())
        sizes = np.zeros(2 * len(names), dtype=np.int64)
        sizes[used] = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat_ids = np.frombuffer(b"".join(ids), dtype=np.uint32)
        first = np.cumsum(sizes) - sizes
        n = sizes[key]
        begin = np.cumsum(n) - n
        out = flat_ids[np.repeat(first[key] - begin, n) + np.arange(n.sum())]
        chunks = np.where(whole, 0, np.diff(starts))
        lengths = np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(chunks)])])
        if not whole.any():
            return out, np.concatenate([[0], np.cumsum(lengths)])
        own = dict(zip(np.flatnonzero(whole).tolist(), self.encode_all(texts.filter(pa.array(whole)).to_pylist()), strict=True))
        ends = np.cumsum(lengths)
        pieces = [np.array(own[i], dtype=np.uint32) if i in own else out[ends[i] - lengths[i] : ends[i]] for i in range(len(texts))]
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])


def encoder(path: str, byte_level: bool) -> Encoder:
    """One for each worker process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path, byte_level)
    return _loaded[path]
