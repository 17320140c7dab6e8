"""Token ids of whole Arrow text columns: repeated pieces of text are encoded once per worker and gathered with numpy.

Two kinds of tokenizers never join text across certain bytes. A byte-level one with the usual split pattern begins a
token at a single space or line feed between two characters that are not white space. One that drops white space before
it splits never joins words. Texts are cut there, pieces are told apart by a 64-bit hash, and each unseen piece goes
through the tokenizers library. Any other tokenizer gets whole texts.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from quire.llm import words as W

CACHE_PIECES = 1_000_000  # pieces a worker keeps, some 30 MB; beyond them it starts anew

# fixed values: the split pattern of tokenizers that drop white space
_DROPPING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_encoders: dict[str, Encoder] = {}


def tokenizer(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def cut_kind(config: dict) -> str:
    """Where a tokenizer of this configuration may be given pieces of a text: "space", "word", or "" for nowhere."""
    split, normal = config.get("pre_tokenizer") or {}, config.get("normalizer")
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in config.get("added_tokens") or [])
    if not plain or (config.get("model") or {}).get("type") != "BPE" or (config.get("model") or {}).get("dropout"):
        return ""
    if split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and normal is None:
        return "space"
    steps = split.get("pretokenizers") or []
    if ([s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0].get("pattern") == {"Regex": _DROPPING} and steps[0].get("invert")
            and steps[0].get("behavior") == "Removed" and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")
            and {s.get("type") for s in (normal or {}).get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"}):
        return "word"
    return ""


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True


def _blank_bytes(data: np.ndarray) -> np.ndarray:
    """Whether a byte belongs to white space of any script."""
    out = _BLANK[data]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        padded = np.append(data, np.zeros(2, dtype=np.uint8))
        a, b, c = padded[lead], padded[lead + 1], padded[lead + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (
            ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F))))
        for hit, size in ((two, 2), (three, 3)):
            for k in range(size):
                out[lead[hit] + k] = True
    return out


_CLASS = np.zeros(256, dtype=np.uint8)  # 1 letter, 2 digit, 3 apostrophe, 4 other visible ASCII; 0 for white space and what is not told apart
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[c for c in range(0x21, 0x7F) if not _CLASS[c]]] = 4
_CLASS[0x27] = 3
# whether a text may be cut between two characters of these classes: never between letters, beside class 0, or after an
# apostrophe, which may begin a contraction
_CUTS = np.array([[0, 0, 0, 0, 0], [0, 0, 1, 1, 1], [0, 1, 0, 1, 1], [0, 0, 0, 0, 0], [0, 1, 1, 0, 0]], dtype=bool)


def _class_cuts(data: np.ndarray, digits: bool) -> np.ndarray:
    """Whether each byte begins with another kind of character than the byte before it, so that no token spans both; ``digits``: also between digits."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # two-byte Latin letters, but for two signs
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    cuts = _CUTS
    if digits:
        cuts = _CUTS.copy()
        cuts[2, 2] = True
    out = np.zeros(len(data), dtype=bool)
    out[1:] = cuts.ravel()[kind[:-1] * np.uint8(5) + kind[1:]]
    return out


def _spaces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a byte is a single space or line feed between two other characters of its document."""
    blank = _blank_bytes(data)
    out = (data == 0x20) | (data == 0x0A)
    out[:1] = out[-1:] = False
    out[1:-1] &= ~blank[:-2] & ~blank[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    out[edges] = out[edges - 1] = False
    return out


class Encoder:
    """A worker's tokenizer with the ids of the pieces it has seen."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        with open(path, encoding="utf-8") as f:
            self.kind = cut_kind(json.load(f))
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        # a word's last token, or the token that begins with the space or line feed before a word
        self.edge = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), dtype=bool)
        for text, i in self.tok.get_vocab(with_added_tokens=True).items():
            if i < len(self.edge):
                self.edge[i] = text.endswith("</w>") if self.kind == "word" else text[:1] in ("Ġ", "Ċ")
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)   # of the pieces, ascending: arrays take a fifth of what a dict of numbers takes
        self.number = np.zeros(0, dtype=np.int32)  # of each key's piece
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.begin = np.zeros(1 << 14, dtype=np.int64)  # of a piece's ids in the pool, and one end more
        self.used = 0

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of texts encoded each by itself."""
        ids = [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        return np.array([t for x in ids for t in x], dtype=np.uint32), np.cumsum([len(x) for x in ids], dtype=np.int64)

    def _one_word(self, text: str) -> bool:
        """Whether a piece's ids can be told from its neighbours' when several are encoded as one text."""
        if self.kind == "word":
            return text.isalpha() and max(text) < "\u0100"
        return text[0] in " \n" and text[1:].split() == [text[1:]]

    def _encode_joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that are one word each, encoded together: cheaper than one by one."""
        ids = np.array(self.tok.encode((" " if self.kind == "word" else "").join(texts), add_special_tokens=False).ids, dtype=np.uint32)
        at = np.flatnonzero(self.edge[ids])
        ends = at + 1 if self.kind == "word" else np.append(at[1:], len(ids))
        return (ids, ends) if len(ends) == len(texts) and ends[-1] == len(ids) else self._encode(texts)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Keep the ids of unseen pieces; ``keys`` ascend."""
        groups: tuple[list, list] = ([], [])
        for i, text in enumerate(texts):
            groups[self._one_word(text)].append(i)
        numbers, n = np.zeros(len(keys), dtype=np.int32), len(self.keys)
        for how, group in zip((self._encode, self._encode_joined), groups):
            for at in range(0, len(group), 1024):  # so that few encodings are alive at once
                some = group[at:at + 1024]
                self._keep(n, *how([texts[i] for i in some]))
                numbers[some] = np.arange(n, n + len(some))
                n += len(some)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.number = np.insert(self.keys, at, keys), np.insert(self.number, at, numbers)

    def _keep(self, n: int, more: np.ndarray, ends: np.ndarray) -> None:
        """The ids of some pieces behind those of the ``n`` pieces before."""
        if self.used + len(more) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(max(len(self.pool), len(more)), dtype=np.uint32))
        if n + len(ends) + 1 > len(self.begin):
            self.begin = np.append(self.begin, np.zeros(max(len(self.begin), len(ends) + 1), dtype=np.int64))
        self.pool[self.used:self.used + len(more)] = more
        self.begin[n + 1:n + 1 + len(ends)] = self.used + ends
        self.used += len(more)

    def _seen(self, keys: np.ndarray) -> np.ndarray:
        """Whether the ids of these pieces are kept."""
        at = np.searchsorted(self.keys, keys)
        seen = at < len(self.keys)
        seen[seen] = self.keys[at[seen]] == keys[seen]
        return seen

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of all texts of a column, and where each text's begin and the last one's end; a null has none."""
        data, offsets = W.text_bytes(col)
        if not self.kind:
            ids, ends = self._encode([t.as_py() or "" for t in col])
            return ids, np.append(0, ends)
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(col) + 1, dtype=np.int64)
        raw = data.tobytes()
        cut = _class_cuts(data, self.kind == "word")
        for special in self.special:
            at = raw.find(special)
            while at >= 0:
                cut[at + 1:at + len(special)] = False
                at = raw.find(special, at + 1)
        if self.kind == "word":
            lowered = W.LOWER_TABLE[data]
            if not any(x.lower() in lowered.tobytes() for x in self.special):
                data, raw = lowered, lowered.tobytes()  # this tokenizer lower-cases anyway
            start, end, first = W.word_bounds(data, offsets)
            cut[start] = True
            inner = np.flatnonzero(cut)
            ends = np.append(inner[1:], len(data))
            end = np.minimum(ends, end[np.searchsorted(start, inner, "right") - 1])
            start = inner
        else:
            cut |= _spaces(data, offsets)
            cut[offsets[:-1][np.diff(offsets) > 0]] = True
            start = np.flatnonzero(cut)
            end = np.append(start[1:], len(data))
        first = np.searchsorted(start, offsets)
        keys, one, which = np.unique(W.word_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self.forget()
        unseen = np.flatnonzero(~self._seen(keys))
        if len(unseen):
            at = one[unseen]
            self._learn(keys[unseen], [raw[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist())])
        piece = self.number[np.searchsorted(self.keys, keys)][which].astype(np.int64)
        sizes = self.begin[piece + 1] - self.begin[piece]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.begin[piece] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[first]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text's."""
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))
