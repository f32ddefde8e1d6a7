"""Pre-tokens of the public word-level BPE tokenizers, and their ids, each found once per worker.

The library splits a text into pre-tokens before BPE and encodes each on its own, so ids of a text are the
concatenated ids of its pre-tokens. Chunks between ASCII white space never share a pre-token; a chunk's
pre-tokens are cached. Texts that, once lower-case, hold special-token strings or characters above U+024F, the white space that
only Unicode knows or the separators that only Python takes for white space are normalised and split by the library itself.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from . import common

_ODD = re.compile("[\x1c-\x1f\x80-\x9f\xa0ɐ-\U0010ffff]|<\\|(?:startoftext|endoftext)\\|>")
_ODD_ASCII = re.compile(rb"[\x1c-\x1f]|<\|(?:startoftext|endoftext)\|>")


def _class(kind: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)


_L, _N = _class("L"), _class("N")
#: Fixed value: the split pattern of the tokenizer file, for characters up to U+024F.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")


#: What an entry of a cache takes besides the bytes it holds: two objects' heads and a place in the table.
ENTRY_BYTES = 150


class PreTokens:
    """path: a tokenizers .json file whose splitter is the pattern above. Sizes are kept of at most about `most` pre-tokens and forgotten
    beyond. Ids are kept in two generations: once the younger takes about `most_bytes` it becomes the older, whose entries are
    forgotten unless asked for again. Chunks and pre-tokens are UTF-8."""

    _of: dict[str, "PreTokens"] = common.kept("pre-tokens", {})

    def __init__(self, path: str, most: int = 1_000_000, most_bytes: int = 48 << 20):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.most, self.most_bytes = most, most_bytes
        self.added = {t.content.encode(): i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(re.escape(t.decode()) for t in self.added) + ")") if self.added else None
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.ends[i] = piece.endswith("</w>")
        self.ids: dict[bytes, bytes] = {}  # of chunks and pre-tokens
        self.older: dict[bytes, bytes] = {}
        self.held = 0  # about the bytes that ids takes
        self.sizes: dict[bytes, int] = {}  # of pre-tokens: how many ids

    @classmethod
    def of(cls, path: str) -> "PreTokens":
        common.only("pre-tokens")
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def plain(self, data: bytes) -> bytes | None:
        """The lower-case text; None for a text that only the library splits."""
        if data.isascii():
            data = data.lower()
            return None if _ODD_ASCII.search(data) else data
        text = data.decode("utf-8").lower()
        return None if _ODD.search(text) else text.encode()

    @staticmethod
    def split(chunk: bytes) -> tuple[bytes, ...]:
        """Pre-tokens of a lower-case chunk without white space; letters alone, and letters before one mark, need no pattern."""
        if chunk.isalpha():
            return (chunk,)
        text = chunk.decode("utf-8")
        if text.isalpha():
            return (chunk,)
        if text[:-1].isalpha() and not text[-1].isalnum():
            last = text[-1].encode()
            return (chunk[: -len(last)], last)
        return tuple(t.encode() for t in _SPLIT.findall(text))

    def library_split(self, data: bytes) -> list[bytes]:
        """Pre-tokens of any text by the library's own parts; a special-token string is one pre-token."""
        out = []
        text = data.decode("utf-8")
        for part in self.cut.split(text) if self.cut else [text]:
            if part.encode() in self.added:
                out.append(part.encode())
            elif part:
                plain = self.tok.normalizer.normalize_str(part)
                out += [plain[a:b].encode() for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(plain)]
        return out

    def encoded(self, tokens: list[bytes]):
        """Yields (pre-tokens, their ids one after the other, where the ids of each end)."""
        for k in range(0, len(tokens), 4096):
            plain = [t for t in tokens[k : k + 4096] if t not in self.added]
            ids = np.asarray(self.tok.encode_batch_fast([b" ".join(plain).decode("utf-8")], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(plain) or (len(ends) and ends[-1] != len(ids)):  # a pre-token whose pieces do not show where it ends
                each = [np.asarray(self.tok.encode(t.decode("utf-8"), add_special_tokens=False).ids, np.uint32) for t in plain]
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            yield plain, ids, ends
        special = [t for t in tokens if t in self.added]
        yield special, np.asarray([self.added[t] for t in special], np.uint32), np.arange(1, len(special) + 1)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """How many pieces each pre-token has; ids are not kept."""
        if len(self.sizes) > self.most:
            self.sizes.clear()
        for plain, _, ends in self.encoded([t for t in dict.fromkeys(tokens) if t not in self.sizes]):
            self.sizes.update(zip(plain, np.diff(ends, prepend=0).tolist()))
        return np.fromiter(map(self.sizes.__getitem__, tokens), np.int64, len(tokens))

    def learn(self, chunks: list[bytes], split=None) -> list[bytes]:
        """The ids of each of these distinct chunks."""
        if self.held > self.most_bytes:
            self.older, self.ids, self.held = self.ids, {}, 0
        ids, older, split, put = self.ids, self.older, split or self.split, []

        def known(c: bytes) -> bool:
            if c not in ids:
                if c not in older:
                    return False
                ids[c] = older[c]
                put.append(c)
            return True

        new = [(c, split(c)) for c in chunks if not known(c)]
        for plain, found, ends in self.encoded([t for t in dict.fromkeys(t for _, ts in new for t in ts) if not known(t)]):
            data, at = found.tobytes(), (4 * np.concatenate([[0], ends])).tolist()
            ids.update(zip(plain, (data[a:b] for a, b in zip(at, at[1:]))))
            put += plain
        for c, ts in new:
            if len(ts) != 1:
                ids[c] = b"".join([ids[t] for t in ts])
                put.append(c)
        self.held += sum(map(len, put)) + sum(len(ids[c]) for c in put) + ENTRY_BYTES * len(put)
        return [ids[c] for c in chunks]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        return list(self.each(texts))

    def each(self, texts: list[bytes], most_words: int = 1 << 17):
        """As encode, one text after the other; the ids of about `most_words` words, or of a single longer text, are in memory at a time."""
        plain = [self.plain(t) for t in texts]
        odd = {i: t for i, (t, p) in enumerate(zip(texts, plain)) if p is None}
        codes, ends, names = common.words([p or b"" for p in plain])
        known = self.learn(names)
        size = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        start, known = np.cumsum(size) - size, np.frombuffer(b"".join(known), np.uint32)
        del plain, names
        row, word = 0, 0
        while row < len(texts):
            last = max(row + 1, int(np.searchsorted(ends, word + most_words, side="right")))
            some = codes[word : ends[last - 1]]
            n = size[some]
            data = known[common.ranges(start[some], n)].tobytes()
            at = (4 * np.concatenate([[0], np.cumsum(n)])[np.concatenate([[word], ends[row:last]]) - word]).tolist()
            for i, a, b in zip(range(row, last), at, at[1:]):
                if i in odd:
                    tokens = self.library_split(odd[i])
                    yield b"".join(map(dict(zip(tokens, self.learn(tokens, lambda t: (t,)))).__getitem__, tokens))
                else:
                    yield data[a:b]
            row, word = last, int(ends[last - 1])
