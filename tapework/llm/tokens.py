"""Token ids of whole texts, by the tokenizers library.

The given vocabulary splits texts at blanks first, and then between letters and signs, so a text's ids are its pieces' ids one
after the other. A group of texts is cut into words and those into pieces, both numbered by Arrow; the group's distinct pieces
are encoded by the library, once for as long as a worker remembers them, and the texts' ids are gathered from those.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces of each of the two generations that a worker remembers: a full one becomes the older, whose pieces come back when met.
MOST_PIECES = 250_000
#: How many pieces go to the library as one text, and a sign that stands between them there.
TOGETHER = 512
BETWEEN = "\x01"
#: Words in which the library's pieces begin and end where signs do, whatever stands beside them; an apostrophe can be of a letter's.
PLAIN = "^[A-Za-z0-9À-ÖØ-öø-ÿ!-&(-/:-@\\[-`{-~]*$"
SIGNS = "([!-&(-/:-@\\[-`{-~]+)"


def gather(values: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values holds runs of these sizes; the runs of all codes, one after the other, and where each begins, with the end as one more."""
    n = sizes[codes]
    upto = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=upto[1:])
    at = np.arange(upto[-1], dtype=np.int32)
    at += np.repeat(((np.cumsum(sizes) - sizes)[codes] - upto[:-1]).astype(np.int32), n)
    return values[at], upto


class TextEncoder:
    """path: a file of the tokenizers library that lower-cases, drops white space and splits there and at signs; others raise ValueError."""

    def __init__(self, path: str, most_pieces: int = MOST_PIECES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 2**16 else "<u4")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.most_pieces, self.known, self.older = most_pieces, {}, {}
        alone, probe = self._ids(BETWEEN), [("Ab", ",", "c"), ("it's",), ("É1ß", "."), ("x" * 40,), ("a", "--", "9", "!*")]
        joined = [i for k, w in enumerate(probe) for i in [*alone[: k > 0], *(i for piece in w for i in self._ids(piece.lower()))]]
        if len(alone) != 1 or self._ids(f" {BETWEEN} ".join(map("".join, probe))) != joined:
            raise ValueError(f"{path} doesn't encode the words between blanks, and their letters and signs, by themselves")
        self.between = alone[0]

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that nothing is known of."""
        out: list[bytes] = []
        groups, size = [pieces[at : at + TOGETHER] for at in range(0, len(pieces), TOGETHER)], self.dtype.itemsize
        for group, encoded in zip(groups, self.library.encode_batch_fast([f" {BETWEEN} ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, self.dtype)
            ends = np.flatnonzero(ids == self.between)
            if len(ends) == len(group) - 1:
                data = ids.tobytes()
                starts, stops = [0, *((ends + 1) * size).tolist()], [*(ends * size).tolist(), len(data)]
                out += [data[a:b] for a, b in zip(starts, stops, strict=True)]
            else:  # a piece has the sign itself
                out += [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(group, add_special_tokens=False)]
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        ids = list(map(self.known.get, pieces))
        new = {pieces[k]: self.older.get(pieces[k]) for k, found in enumerate(ids) if found is None}
        if not new:
            return ids
        missing = [p for p, i in new.items() if i is None]
        new.update(zip(missing, self._learn(missing), strict=True))
        if len(self.known) + len(new) > self.most_pieces:
            self.older, self.known = self.known, {}
        self.known |= new
        return [new[p] if i is None else i for p, i in zip(pieces, ids, strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin, with the end as one more. No text is null."""
        whole = {}
        for token in self.added:  # a text with such a token is more than its words
            for k in np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)).tolist():
                whole[k] = texts[k].as_py()
        if whole:
            texts = pa.array(["" if k in whole else t for k, t in enumerate(texts.to_pylist())], pa.string())
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = split.flatten().dictionary_encode()
        apart = pc.if_else(pc.match_substring_regex(words.dictionary, PLAIN), pc.replace_substring_regex(words.dictionary, SIGNS, r" \1 "), words.dictionary)
        apart = pc.ascii_split_whitespace(apart)
        pieces = apart.flatten().dictionary_encode()
        data = self._pieces(pieces.dictionary.to_pylist())
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // self.dtype.itemsize
        of_words, upto = gather(np.frombuffer(b"".join(data), self.dtype), sizes, pieces.indices.to_numpy())
        of_texts, starts = gather(of_words, np.diff(upto[apart.offsets.to_numpy()]), words.indices.to_numpy())
        pa.default_memory_pool().release_unused()  # else what texts needed stays with the worker
        starts = starts[split.offsets.to_numpy()]
        if whole:
            parts = np.split(of_texts, starts[1:-1])
            for k, text in whole.items():
                parts[k] = np.array(self._ids(text), self.dtype)
            of_texts, starts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return of_texts, starts

    def with_end(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with end_id at the end of each text."""
        ids, starts = self.encode(texts)
        return np.insert(ids, starts[1:], end_id), starts + np.arange(len(starts))


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """A worker's encoder of a vocabulary file; later tasks of the worker use it again."""
    return TextEncoder(path)

