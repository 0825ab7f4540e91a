"""Byte-level BPE: vocabulary, pre-tokenisation, segment-tree encoder, prefix counts.

The vocabulary is read from a public tokenizer's JSON file; nothing is trained here.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import regex

#: The split of text before the merges, as the byte-level pre-tokenizer has it (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters whose Unicode class is the same in every Unicode version that the libraries have.
#: Texts with others are split by the tokenizer library itself.
_SETTLED = regex.compile(r"[\x00-՗‐-⁞ぁ-ゖァ-ヺ一-龥가-힣\U0001F300-\U0001F5FF]*")
_SPLIT = regex.compile(PATTERN)

#: The same split for texts of these characters, where the standard library's classes agree with it.
_LATIN = re.compile("[\t-\r -~\x80-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*")
_SPLIT_LATIN = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_BLANK = regex.compile(r"\s+")
_SHORTENED = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
_NONE = 1 << 62

#: Pieces that a worker remembers at most; then it forgets all of them.
MEMO = 500_000


def default_path() -> str:
    """byte_bpe_50k.json where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _both(a: int, b: int) -> int:
    return a << 32 | b


class _Memo(dict):
    """What `make` gives for each key, forgotten when MEMO keys are known."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        self[key] = out = self.make(key)
        return out


class Bpe:
    """A byte-level BPE vocabulary with its encoder, decoder and prefix counter."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, of = spec["model"], _byte_of_char()
        raw = {tok: bytes(of[c] for c in tok) for tok in model["vocab"]}
        self.path = path
        self.id_of = {raw[tok]: i for tok, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        self.longest = max(map(len, self.id_of))
        self.byte_id = [self.id_of[bytes([b])] for b in range(256)]
        self.merge: dict[int, tuple[int, int]] = {}  # by _both(left, right): rank, result
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[_both(model["vocab"][a], model["vocab"][b])] = rank, model["vocab"][a + b]
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._library = None
        self._packed = _Memo(self._pack)
        self._counts = _Memo(lambda piece: self.prefix_piece(piece.encode("utf-8", "surrogatepass"))[-1])
        self._pairs = _Memo(self._apart)
        self._alone = {i: False for i in self.bytes_of}
        self._alone |= {i: self.encode_piece(b) == [i] for i, b in self.bytes_of.items() if b in self.id_of}

    def sections(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special tokens: (part, whether it is one)."""
        if not self._special or not any(s in text for s in self.special):
            return [(text, False)] if text else []
        return [(part, k % 2 == 1) for k, part in enumerate(self._special.split(text)) if part]

    def pieces(self, part: str) -> list[str]:
        """The pieces within which merges happen."""
        if _LATIN.fullmatch(part):
            return _SPLIT_LATIN.findall(part)
        if _SETTLED.fullmatch(part):
            return _SPLIT.findall(part)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [part[a:b] for _, (a, b) in self._library.pre_tokenize_str(part)]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Merge the leftmost pair of lowest rank until none is left.

        A segment tree over the pairs holds the least (rank, place) at its root; a merge
        changes three leaves, each in as many steps as the tree is high.
        """
        ids = list(map(self.byte_id.__getitem__, piece))
        n = len(ids)
        if n < 2:
            return ids
        merge = self.merge
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        shift = size.bit_length()
        low = (1 << shift) - 1
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            if found := merge.get(ids[i] << 32 | ids[i + 1]):
                tree[size + i] = found[0] << shift | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] != _NONE:
            i = tree[1] & low
            j = after[i]
            ids[i] = merge[ids[i] << 32 | ids[j]][1]
            ids[j] = -1
            nxt = after[i] = after[j]
            changed = [(i, _NONE)]
            if nxt < n:
                before[nxt] = i
                if found := merge.get(ids[i] << 32 | ids[nxt]):
                    changed[0] = i, found[0] << shift | i
            if j < n - 1:
                changed.append((j, _NONE))
            if (p := before[i]) >= 0:
                found = merge.get(ids[p] << 32 | ids[i])
                changed.append((p, found[0] << shift | p if found else _NONE))
            for at, value in changed:
                k = size + at
                tree[k] = value
                k >>= 1
                while k:
                    a, b = tree[2 * k], tree[2 * k + 1]
                    tree[k] = a if a < b else b
                    k >>= 1
        return [i for i in ids if i >= 0]

    def _pack(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_packed(self, text: str) -> bytes:
        """The ids of the text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part, special in self.sections(text):
            if special:
                out.append(struct.pack("<I", self.special[part]))
            else:
                out.extend(map(self._packed.__getitem__, self.pieces(part)))
        return b"".join(out)

    def encode_plain(self, text: str) -> bytes:
        """Like encode_packed, with special tokens' strings as plain text."""
        return b"".join(map(self._packed.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> list[int]:
        """The ids of the text."""
        packed = self.encode_packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids) -> str:
        """The text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def _apart(self, pair: int) -> bool:
        """Whether two tokens stay two when their bytes are encoded as one piece."""
        a, b = pair >> 32, pair & 0xFFFFFFFF
        return self.encode_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def prefix_piece(self, piece: bytes) -> list[int]:
        """Token counts of piece[:0], piece[:1], ... piece, by dynamic programming.

        The encoding of a prefix is that of a shorter prefix plus one last token, the only
        token that may follow that prefix's own last one without merging with it.
        """
        n, find, longest, apart, alone = len(piece), self.id_of.get, self.longest, self._pairs, self._alone
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                t = find(piece[j:i])
                if t is not None and (apart[last[j] << 32 | t] if j else alone[t]):
                    counts[i], last[i] = counts[j] + 1, t
                    break
        return counts

    def count(self, text: str) -> int:
        """The number of tokens of the text: the last entry of its prefix table."""
        total = 0
        for part, special in self.sections(text):
            total += 1 if special else sum(map(self._counts.__getitem__, self.pieces(part)))
        return total

    def prefix_counts(self, text: str) -> list[int]:
        """The exact token count of text[:0], text[:1], ... text (by code points).

        Within a piece the piece's own table is added to the tokens before it. Three kinds of
        prefix split otherwise than the whole text: those that end within a special token, in a
        shortened form such as 're, or in white space; these take the table of what they
        really split into.
        """
        out, total, ahead = [0], 0, ("", 0)
        for part, special in self.sections(text):
            if special:
                out += [ahead[1] + self.count(ahead[0] + part[:k]) for k in range(1, len(part))] + [total + 1]
                total += 1
                ahead = "", total
                continue
            ahead = part, total
            began = len(out) - 1
            for p in self.pieces(part):
                table, at = self.prefix_piece(p.encode("utf-8", "surrogatepass")), 0
                for k, c in enumerate(p, 1):
                    at += len(c.encode("utf-8", "surrogatepass"))
                    out.append(total + (self.count(p[:k]) if p in _SHORTENED else table[at]))
                total += table[-1]
            for run in _BLANK.finditer(part):
                table, at = self.prefix_piece(run[0].encode()), 0
                for k, c in enumerate(run[0], began + run.start() + 1):
                    at += len(c.encode())
                    out[k] = out[began + run.start()] + table[at]
        return out


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """The vocabulary of a file, once for each worker process."""
    return Bpe(path)
