"""Best-fit packing of documents into sequences of a fixed length.

Each document becomes the ids of its text and one end id; only what is longer
than a sequence is cut.  Texts are encoded a batch at a time: Arrow lowers and
cuts them, the batch's distinct words are encoded once, and the ids of all
texts are gathered from theirs.

Pieces are dealt by hash into groups of about ``GROUP_PIECES``, each packed by
the sum-of-squares rule: longest piece first, a piece goes to the open bin that
leaves the smallest sum, over the gaps, of the squared number of open bins with
that gap (of equal sums the tightest gap); a bin is opened where none has room.
Bins that are at most half full are packed again as they are, and then the
pieces of all bins that still have room are dealt out anew and packed again, for
as long as that saves bins.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import discard, held, map_slices, materialise, texts
from sparkweave.llm.pretokens import vocabulary_path

CAPACITY, END_ID, GROUP_PIECES = 4096, 1, 16_384
#: Most words that a worker remembers: some 30 bytes each.
WORDS = 1_000_000
#: Rows and bytes of texts that are encoded together.
BATCH = (4096, 6 << 20)
#: A bin whose room is a larger part of it than this is loose.
LOOSE = 1 / 64

#: Outside these characters, words between white space might not be normalised
#: on their own as they are in a text; such texts go to the library whole.  So do
#: texts with separators that only one side takes for white space, or with what
#: might be a special string (which has to be found before lower case).
_UNSAFE = "[^\\x00-\\x{24F}]|\\x{130}|[\\x1c-\\x1f]|<\\|"
_SIGNS, _PART = list(".,;:!?"), "1"


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries ``which``, end to end, and where each starts (and the
    last one ends)."""
    n = sizes[which]
    upto = np.append(0, np.cumsum(n))
    return flat[np.repeat(starts[which] - upto[:-1], n) + np.arange(upto[-1])], upto


class WordIds:
    """Ids of whole texts for a vocabulary that drops white space: the library
    encodes distinct words between white space, in lower case.  Of a word of
    letters and one last sign, the letters are looked up on their own: the
    vocabulary's pattern cuts there.  Words are remembered, as flat arrays, up to
    ``WORDS`` of them; then remembering starts anew."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok, self.plain = Tokenizer.from_file(file), Tokenizer.from_file(file)
        # For words of letters in lower case nothing is left to normalise or to cut but at the space between them.
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()

    def _forget(self) -> None:
        self.words, self.flat, self.sizes = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, "i8")
        self._remember(pa.array(_SIGNS))

    def _ids(self, parts: list[str], tok=None) -> list[bytes]:
        found = (tok or self.tok).encode_batch_fast(parts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for x in found for ids in (x.ids,)]

    def _of_letters(self, distinct: list[str]) -> list[bytes]:
        """Words of letters go to the library in lines, parted by a digit: its id
        is in no word's ids."""
        plain = [w for w in distinct if w.isalpha()]
        lines = [f" {_PART} ".join([*plain[i:i + 100], ""]) for i in range(0, len(plain), 100)]
        (part,) = struct.unpack("<I", self._ids([_PART])[0])
        found = []
        for raw in self._ids(lines, self.plain):
            ends = np.flatnonzero(np.frombuffer(raw, "<u4") == part) * 4
            found += [raw[a:b] for a, b in zip([0, *(ends + 4).tolist()], ends.tolist())]
        known = dict(zip(plain, found, strict=True))
        other = [w for w in distinct if w not in known]
        known.update(zip(other, self._ids(other)))
        return [known[w] for w in distinct]

    def _remember(self, words: pa.Array) -> None:
        found = self._of_letters(words.to_pylist())
        self.words = pa.concat_arrays([self.words, words])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), "<u4")])
        self.sizes = np.concatenate([self.sizes, np.array([len(x) for x in found], "i8") // 4])

    def _of_words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, end to end, and where each starts."""
        signed = pc.match_substring_regex(distinct, f"^\\pL+[{''.join(_SIGNS)}]$")
        letters = pc.if_else(signed, pc.utf8_slice_codeunits(distinct, 0, -1), distinct).dictionary_encode()
        if len(self.words) + len(letters.dictionary) > WORDS:
            self._forget()
        missing = letters.dictionary.filter(pc.invert(pc.is_in(letters.dictionary, value_set=self.words)))
        if len(missing):
            self._remember(missing)
        entry = pc.index_in(letters.dictionary, value_set=self.words).to_numpy()[letters.indices.to_numpy()].astype("i8")
        last = np.flatnonzero(signed.to_numpy(zero_copy_only=False))
        sign = pc.index_in(pc.utf8_slice_codeunits(distinct.take(pa.array(last)), -1), value_set=self.words).to_numpy().astype("i8")
        parts = np.insert(entry, last + 1, sign)
        flat, upto = gathered(self.flat, np.cumsum(self.sizes) - self.sizes, self.sizes, parts)
        first = np.arange(len(entry)) + np.searchsorted(last, np.arange(len(entry)))  # parts before each word
        return flat, np.append(upto[first], upto[-1])

    def encode_batch(self, documents: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text starts and the last ends)."""
        unsafe = pc.match_substring_regex(documents, _UNSAFE)
        words = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(unsafe, "", documents)))
        coded = words.flatten().dictionary_encode()
        flat, at = self._of_words(coded.dictionary)
        word, ends = coded.indices.to_numpy().astype("i8"), np.cumsum(words.value_lengths().to_numpy())
        whole = np.flatnonzero(unsafe.to_numpy(zero_copy_only=False))
        if len(whole):  # a text that goes to the library whole is a word of its own
            ids = self._ids(documents.take(pa.array(whole)).to_pylist())
            flat = np.concatenate([flat, np.frombuffer(b"".join(ids), "<u4")])
            word = np.insert(word, ends[whole], np.arange(len(at) - 1, len(at) - 1 + len(whole)))
            at = np.append(at, at[-1] + np.cumsum([len(x) // 4 for x in ids]))
            ends = ends + np.cumsum(np.isin(np.arange(len(documents)), whole))
        out, upto = gathered(flat, at[:-1], np.diff(at), word)
        return out, upto[np.append(0, ends)]

    def encode(self, documents: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, at = self.encode_batch(pa.array(documents, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]


def _encoder(vocabulary: str) -> WordIds:
    return held(f"packing-{vocabulary}", lambda: WordIds(vocabulary_path(vocabulary)))


def encode_pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = END_ID,
                  capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every row: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32`` and, on request, ``ids`` (little-endian unsigned 32-bit)."""

    def run(batches):
        encoder, end = _encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            all_ids, at = encoder.encode_batch(b["text"])
            raw = memoryview(all_ids).cast("B")
            for doc, first, last in zip(b["doc_id"].to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                n = last - first + 1
                for i, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    part = raw[4 * (first + start):4 * min(first + start + length, last)]
                    tail = end if start + length == n else b""
                    crc = zlib.crc32(tail, zlib.crc32(part))
                    for k, v in zip(out, (doc, i, start, length, crc, bytes(part) + tail if with_ids else None)):
                        out[k].append(v)
            yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_slices(texts(docs), run, schema, holds=f"packing-{vocabulary}", cut=BATCH)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed longest first."""
    count = np.zeros(capacity + 1, "i8")  # open bins by gap; a full bin isn't counted
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8"), 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        # Moving a bin from gap g to g - s changes the sum by 2 (n[g - s] - n[g]) + 2; closing it, by 1 - 2 n[g].
        change = 2 * (count[:capacity + 1 - s] - count[s:]) + 2
        change[0] = 1 - 2 * count[s]
        change[count[s:] == 0] = np.iinfo("i8").max
        left = int(change.argmin())
        if change[left] < np.iinfo("i8").max:
            b = waiting[left + s].pop()
            count[left + s] -= 1
        else:
            b, left = made, capacity - s
            made += 1
        bins[i], offsets[i] = b, capacity - left - s
        if left:
            count[left] += 1
            waiting[left].append(b)
    return bins, offsets


def _packed(lengths: DataFrame, n: int, capacity: int, turn: int) -> DataFrame:
    """Adds ``sequence_id`` (unique to the turn) and ``offset`` to ``n`` rows with a
    ``length``, group by group; each turn deals the rows out in its own way."""
    groups = max(1, -(-n // GROUP_PIECES))
    out = lengths.schema.add("sequence_id", "long").add("offset", "long")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        group = int(rows.pop("group").iloc[0])
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(turn << 56) + (group << 16) + bins, offset=offsets)

    dealt = lengths.withColumn("group", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(pack, out)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places rows with a ``length`` of 1 to ``capacity``: adds ``sequence_id``
    and ``offset``; the rows of a sequence follow each other without a gap.

    Null ids and repeated rows are packed as rows of their own; an empty table
    gives no rows; other columns are kept, but for ``row``."""
    rows = materialise(pieces.withColumn("row", F.monotonically_increasing_id()), "pack-rows")
    open_ = materialise(_packed(rows.select("row", "length"), rows.count(), capacity, 0), "packed")
    turn, settled = 1, []
    while True:  # bins at most half full, as they are
        light = materialise(open_.groupBy("sequence_id").agg(F.sum("length").alias("length"))
                            .filter(F.col("length") <= capacity // 2).withColumnRenamed("sequence_id", "row"), "light")
        n = light.count()
        if n < 2:
            break
        moved = _packed(light, n, capacity, turn).selectExpr("row AS sequence_id", "sequence_id AS new", "offset AS shift")
        old, open_ = open_, materialise(
            open_.join(moved, "sequence_id", "left").withColumn("sequence_id", F.coalesce("new", "sequence_id"))
            .withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0))).drop("new", "shift"), "packed")
        discard(old, light)
        turn += 1
        if n <= GROUP_PIECES:
            break
    while True:  # the pieces of all bins with room
        loose = materialise(open_.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.count("*").alias("n"))
                            .filter(F.col("fill") <= capacity - max(1, int(capacity * LOOSE))), "loose")
        bins, n = loose.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if bins < 2:
            break
        ids = loose.select("sequence_id")
        again = materialise(_packed(open_.join(ids, "sequence_id", "left_semi").select("row", "length"), n, capacity, turn), "packed")
        turn += 1
        saved = bins - again.select("sequence_id").distinct().count()
        if saved > 0:
            settled.append(open_.join(ids, "sequence_id", "left_anti"))
            open_ = again
        # One group has seen them all, or it is no longer worth a turn.
        if n <= GROUP_PIECES or saved * 1000 < bins:
            break
    placed = reduce(DataFrame.unionByName, [*settled, open_])
    return rows.join(placed.select("row", "sequence_id", "offset"), "row").drop("row")


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all rows with their places.

    A null or empty text is one piece that holds the end id only.  Repeated
    rows and null ids are packed row by row; extra columns are ignored; an
    empty table gives no rows."""
    pieces = materialise(encode_pieces(docs, vocabulary, capacity=capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
