"""Encoding with the tokenizers library, one word at a time with a bounded cache.

A text is cut only where the tokenizer itself always cuts, so the ids equal
those of encoding the whole text; distinct words are encoded once per task and
batch instead of at every occurrence. Two kinds of vocabulary are known:

- ``words``: white space is dropped, so any space or newline is a safe cut;
- ``spaces``: a word takes the one space before it. Cuts are made before single
  spaces and around single newlines; a text with any other white space, with
  two such signs in a row, or with one at an end, is encoded whole.

The words of a batch are numbered by Arrow; Python sees each distinct word once,
and numpy lays out the ids of all occurrences.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words in each of the two halves of a worker's cache: when the new one is full it becomes the old one, from which words still in use move over.
CACHE_WORDS = 200_000
#: Stands between words that are encoded in one call; words that hold it are encoded alone.
MARK = "\x01"
#: Words that are encoded in one call.
GROUP_WORDS = 500
#: Stands where a text of the kind ``spaces`` is cut; a text that holds it is encoded whole.
CUT = "\x02"
#: White space that the kind ``spaces`` does not cut.
PAIRS = ("  ", " \n", "\n ", "\n\n")
#: Signs that are one unit, however many stand in a row behind letters; the apostrophe begins units of its own, and < special tokens.
SIGNS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
#: All white space but space and newline (of either Python or the tokenizers' expressions).
OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies: itself where it is printable, else the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)).difference(plain)))}


BYTE_SIGNS = byte_signs()


def letters(unit: str) -> bool:
    """Whether these are letters that stay letters, each by itself, when they are normalised: then the tokenizer takes them as one unit.

    Beyond Latin letters nothing is taken for granted; of these the capital dotted I becomes two signs in lower case.
    """
    return unit.isalpha() and (unit.isascii() or (max(unit) < "\u0250" and "\u0130" not in unit))


class Encoder:
    """``encode(texts)`` gives one uint32 array of ids for each text."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.small = self.tokenizer.get_vocab_size() <= 65536
        self.dtype = np.uint16 if self.small else np.uint32
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        mark = self._ids([MARK])[0]
        inside = [t for t in self.tokenizer.get_vocab() if "ā" in t]  # the byte's sign in byte-level vocabularies
        self.mark = int(mark[0]) if len(mark) == 1 and len(inside) <= 1 + (kind == "words") else None
        self.code, self.tokenize = "H" if self.small else "I", self.tokenizer.model.tokenize
        for unit in ("Éa", "#%"):
            if self._unit(unit) != self._ids([unit])[0].astype(self.dtype).tobytes():
                raise ValueError(f"{path} has no byte-level vocabulary")

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Encode words into the cache; letters with signs behind them are two units, which are learnt apart."""
        cache, other = self.cache, []
        for w in words:
            unit = w.rstrip(SIGNS)
            if letters(unit[1:] if unit[:1] == " " else unit):
                if len(unit) == len(w):
                    cache[w] = self._unit(w)
                else:
                    cache[w] = self._unit(unit) + self._unit(w[len(unit) :])
            else:
                other.append(w)
        self._learn_plain(other)

    def _unit(self, unit: str) -> bytes:
        """The ids of a unit, from the vocabulary's model alone, which takes bytes as signs."""
        ids = self.cache.get(unit)
        if ids is None:
            ids = self.old.get(unit)
            if ids is None:
                text = unit.lower() if self.kind == "words" else unit
                text = text.replace(" ", BYTE_SIGNS[32]) if text.isascii() else text.encode().decode("latin-1").translate(BYTE_SIGNS)
                ids = array(self.code, [t.id for t in self.tokenize(text)]).tobytes()
            self.cache[unit] = ids
        return ids

    def _learn_plain(self, words: list[str]) -> None:
        """Many words in one call where their ids can be told apart."""
        plain = [w for w in words if MARK not in w and "'" not in w and "<|" not in w] if self.mark is not None else []
        alone = [w for w in words if MARK in w or "'" in w or "<|" in w] if self.mark is not None else words
        groups = [plain[i : i + GROUP_WORDS] for i in range(0, len(plain), GROUP_WORDS)]
        glue = f" {MARK} " if self.kind == "words" else MARK
        for group, ids in zip(groups, self._ids([glue.join(g) for g in groups]), strict=True):
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(group) - 1:
                alone = alone + group
                continue
            data, width = ids.astype(self.dtype).tobytes(), self.dtype().itemsize
            edges = [-1, *cuts.tolist(), len(ids)]
            for w, a, b in zip(group, edges[:-1], edges[1:], strict=True):
                self.cache[w] = data[(a + 1) * width : b * width]
        for w, ids in zip(alone, self._ids(alone), strict=True):
            self.cache[w] = ids.astype(self.dtype).tobytes()

    def _cut(self, text: str) -> str | None:
        """The text with CUT (white space for ``words``) where the tokenizer always cuts, or None."""
        if self.kind == "words":
            return text.replace("\n", " ")
        if not text or text[0] in " \n" or text[-1] in " \n" or CUT in text or any(map(text.__contains__, PAIRS)) or any(map(text.__contains__, OTHER_SPACE)):
            return None
        return text.replace(" ", CUT + " ").replace("\n", f"{CUT}\n{CUT}")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self._cut(t) for t in texts]
        known = [i for i, t in enumerate(cut) if t is not None]
        out: list = [None] * len(texts)
        lists = pc.split_pattern(pa.array([cut[i] for i in known], pa.large_string()), " " if self.kind == "words" else CUT)
        flat, bounds = self._words(lists.values.dictionary_encode(), lists.offsets.to_numpy())
        for i, a, b in zip(known, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = flat[a:b].astype(np.uint32)
        whole = [i for i, t in enumerate(cut) if t is None]
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out

    def _words(self, coded: pa.DictionaryArray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where those of each text begin and end."""
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.cache) + len(distinct) > CACHE_WORDS:
            self.cache, self.old = {}, self.cache
        cache, old, new = self.cache, self.old, []
        for w in distinct:
            if w not in cache:
                if w in old:
                    cache[w] = old[w]
                else:
                    new.append(w)
        self._learn(new)
        values = [cache[w] for w in distinct]
        data = np.frombuffer(b"".join(values), dtype=self.dtype)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype().itemsize
        starts, codes = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        return data[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])], ends[offsets]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder a Python worker, kept between tasks."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
