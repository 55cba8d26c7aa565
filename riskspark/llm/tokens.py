"""Token ids of whole texts with a public tokenizer, through a cache of words and of their pieces.

The vocabulary works on pre-tokens that never cross white space. For texts whose characters lie in
the plain Latin range the pre-tokens are cut here, and only pieces not seen before by this Python
worker go through the library's model. Any other text goes through the library as a whole. Both give
the library's own ids (tested against it).
"""

from __future__ import annotations

import functools
import re
import sys
from array import array

import numpy as np
import pyarrow as pa

#: Words and pieces that a Python worker remembers at most; a full cache starts anew.
MAX_WORDS, MAX_PIECES = 700_000, 300_000

_LETTERS = "a-zªµºÀ-ÖØ-öø-ɏ"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9²³¹¼-¾]|[^\s{_LETTERS}0-9²³¹¼-¾]+")
#: Outside the plain range, or a special token's string, or a control character that \s may or may not hold.
_WHOLE = re.compile("[^\t\n\r -~¡-¬®-įı-ɏ]|<\\|")
#: The white space of that range; any other makes a text one of those.
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x09, 0x0A, 0x0D, 0x20]] = True


#: The model reads bytes as characters: visible ones of Latin-1 as they are, the others from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}


@functools.lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def caches(path: str) -> tuple[dict[str, bytes], dict[str, bytes]]:
    return {}, {}


def forget() -> None:
    """Drop this worker's caches: Spark uses it again for later stages, beside a larger heap."""
    caches.cache_clear()


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 16-bit integers. NULL and empty texts: no ids.

    The words of all texts are numbered at once, and only distinct words are looked up. The vocabulary must have at
    most 65,536 ids.
    """
    tokenizer, (words, pieces) = load(path), caches(path)
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("the vocabulary has more than 65,536 ids")
    if sys.byteorder != "little":
        raise RuntimeError("ids are stored in little-endian order")
    raw = [(t or "").encode() for t in texts]
    begins = np.cumsum([0, *(len(t) + 1 for t in raw)])
    line = np.frombuffer(b"\n".join(raw).lower(), dtype=np.uint8)
    del raw
    word = ~_GAP[line]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return [b""] * len(texts)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(edge == -1) - starts)])
    coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(line[word])).dictionary_encode()
    own = np.searchsorted(starts, begins)  # the first word of each text
    del line, word, edge, starts, offsets
    code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    for known, most in ((words, MAX_WORDS), (pieces, MAX_PIECES)):
        if len(known) > most:
            known.clear()
    model, found, odd = tokenizer.model, [], []
    for at, w in enumerate(names):
        if (got := words.get(w)) is None:
            if _WHOLE.search(w):
                odd.append(at)
                got = b""
            else:
                got = words[w] = _word(w.lower(), pieces, model)
        found.append(got)
    size = np.fromiter(map(len, found), np.int64, len(found)) // 2
    flat, first = np.frombuffer(b"".join(found), dtype="<u2"), np.cumsum(size) - size
    ends = np.concatenate([[0], np.cumsum(size[code])])
    ids = np.empty(ends[-1], dtype="<u2")
    for at in range(0, len(code), 1 << 18):  # some words at a time: a place takes 16 bytes for each id
        part = code[at:at + (1 << 18)]
        into = slice(ends[at], ends[at + len(part)])
        ids[into] = flat[np.repeat(first[part] - ends[at:at + len(part)], size[part]) + np.arange(into.start, into.stop)]
    cut = ends[own].tolist()
    out = [ids[a:b].tobytes() for a, b in zip(cut, cut[1:])]
    if odd:
        strange = np.zeros(len(names), dtype=bool)
        strange[odd] = True
        for i in np.unique(np.searchsorted(own, np.flatnonzero(strange[code]), side="right") - 1).tolist():
            out[i] = np.array(tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype="<u2").tobytes()
    return out


def _word(word: str, pieces: dict[str, bytes], model) -> bytes:
    """Ids of a lower-cased word in the plain range."""
    ids = []
    for p in _PIECES.findall(word):
        if (got := pieces.get(p)) is None:
            raw = p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES)
            got = pieces[p] = array("H", [t.id for t in model.tokenize(raw)]).tobytes()
        ids.append(got)
    return b"".join(ids)
