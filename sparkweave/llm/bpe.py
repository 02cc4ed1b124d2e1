"""Byte-level BPE encoding and decoding over a trie of distinct words.

The encoding of a word is the encoding of one of its prefixes plus one last
token, so it is enough to know the last token of every prefix.  A token that
ends a prefix is the last one exactly if BPE would not merge anything across
its border with the last token of what precedes it.  Distinct words are walked
in sorted order, which is the depth-first order of their trie: the stack holds
the last token of every prefix of the current path, and only the part below
the common prefix with the word before is computed.

Documents are never shuffled; a task sees its own distinct words, and a worker
keeps what it has encoded in a bounded cache.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkweave.llm.common import CACHE_ENTRIES, Cache, held, joined, map_slices, texts
from sparkweave.llm.pretokens import pieces, pretokens, vocabulary_path

_NEVER = 1 << 60
_SHORT = (2, 1)


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file:
    printable Latin-1 bytes stand for themselves, the others follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {chr(b): b for b in own}
    return chars | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}


class TrieEncoder:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_characters()
        raw = lambda s: bytes(chars[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = (raw(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            pair = (self.ids[a], self.ids[b])
            self.rank.setdefault(pair, r)
            made.setdefault(self.ids[a + b], (*pair, r))
        self.made = made
        # Tokens that no merge makes never come out of BPE, but single bytes.
        self.ends = {b: i for b, i in self.ids.items() if len(b) == 1 or i in made}
        lengths: dict[bytes, set[int]] = {}  # of the tokens with the same last three bytes
        for b in self.ends:
            if len(b) > 2:
                lengths.setdefault(b[-3:], {1, 2}).add(len(b))
        self.lengths = {b: tuple(sorted(n, reverse=True)) for b, n in lengths.items()}
        self.right_edge = lru_cache(None)(lambda t: self._edge(t, 1))
        self.left_edge = lru_cache(None)(lambda t: self._edge(t, 0))
        self.fits: dict[tuple[int, int], bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one end of ``token`` as merging goes on, smallest
        first, each with the rank of the merge that ends it."""
        out = [(token, _NEVER)]
        while token in self.made:
            made = self.made[token]
            token = made[side]
            out.append((token, made[2]))
        return out[::-1]

    def stays_cut(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between two adjacent tokens alone.

        Follows the tokens at the border while both sides grow.  A merge over
        the border happens if its rank is the next; of equal ranks the leftmost
        goes first, so the left token's own merge wins a tie and the right
        token's loses it."""
        a, b = self.right_edge(left), self.left_edge(right)
        i = j = 0
        while True:
            (s, until_s), (t, until_t) = a[i], b[j]
            across = self.rank.get((s, t), _NEVER)
            if across < until_s and across <= until_t and across != _NEVER:
                return False
            if until_s == _NEVER and until_t == _NEVER:
                return True
            if until_s <= until_t:
                i += 1
            else:
                j += 1

    def encode_sorted(self, distinct: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, ids) for sorted distinct words; state is shared along prefixes."""
        ends, lengths, fits, stays = self.ends, self.lengths, self.fits, self.stays_cut
        if len(fits) > 2_000_000:
            fits.clear()
        last: list[int] = [-1]  # last[i]: last token of path[:i]
        size: list[int] = [0]
        path = b""
        for word in distinct:
            common = 0
            for x, y in zip(path, word):
                if x != y:
                    break
                common += 1
            del last[common + 1:], size[common + 1:]
            for end in range(common + 1, len(word) + 1):
                for length in lengths.get(word[end - 3:end], _SHORT) if end > 2 else _SHORT:
                    start = end - length
                    token = ends.get(word[start:end]) if start >= 0 else None
                    if token is None:
                        continue
                    if not start:
                        before = True
                    else:
                        pair = (last[start], token)
                        before = fits.get(pair)
                        if before is None:
                            before = fits[pair] = stays(*pair)
                    if before:
                        last.append(token)
                        size.append(length)
                        break
            path = word
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= size[at]
            yield word, ids[::-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD."""
        out = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return out.decode("utf-8", "replace").encode()


class TextEncoder:
    """Encodes whole texts; remembers the ids of short pieces and pre-tokens."""

    def __init__(self, file: str):
        self.trie = TrieEncoder(file)
        self.pieces, self.words = Cache(self._of_pieces), Cache(self._of_words, CACHE_ENTRIES // 2)

    def _of_words(self, distinct: list[str]) -> list[bytes]:
        known = {w: struct.pack("<I", i) for w, i in self.trie.special.items()}
        for word, ids in self.trie.encode_sorted(sorted(w.encode() for w in distinct if w not in known)):
            known[word.decode()] = struct.pack(f"<{len(ids)}I", *ids)
        return [known[w] for w in distinct]

    def _of_pieces(self, distinct: list[str]) -> list[bytes]:
        cut = list(map(pretokens, distinct))
        return joined(cut, self.words.lookup([w for ws in cut for w in ws]))

    def encode(self, documents: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = list(map(pieces, documents))
        return joined(cut, self.pieces.lookup(list(chain.from_iterable(cut))))


def text_encoder(name: str) -> TextEncoder:
    """The worker's encoder of a vocabulary."""
    return held(f"bpe-{name}", lambda: TextEncoder(vocabulary_path(name)))


def encode_texts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """``doc_id``, ``ids`` (array<long>) and ``decoded`` (string) of every row."""

    def run(batches):
        encoder = text_encoder(vocabulary)
        for b in batches:
            ids = [np.frombuffer(x, "<u4") for x in encoder.encode(b["text"].to_pylist())]
            yield {"doc_id": b["doc_id"], "ids": [x.astype("i8") for x in ids],
                   "decoded": [encoder.trie.decode(x).decode() for x in ids]}

    return map_slices(texts(docs), run, "doc_id long, ids array<bigint>, decoded string", holds=f"bpe-{vocabulary}")


def encode_digests(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every row.

    Null and empty texts have no tokens and the digests of empty bytes.
    Repeated rows are encoded each; extra columns are ignored; an empty table
    gives no rows.  Texts are encoded whole, whatever their length."""

    def run(batches):
        encoder = text_encoder(vocabulary)
        for b in batches:
            raw = encoder.encode(b["text"].to_pylist())
            yield {"doc_id": b["doc_id"], "n_tokens": pa.array([len(x) // 4 for x in raw], pa.int64()),
                   "ids_sha256": [hashlib.sha256(x).hexdigest() for x in raw],
                   "decoded_sha256": [hashlib.sha256(encoder.trie.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in raw]}

    return map_slices(texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", holds=f"bpe-{vocabulary}")
