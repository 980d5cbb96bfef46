"""Best-fit packing by the sum-of-squares rule, after tokenizing whole texts.

An item goes where the sum over gaps of (open bins with that gap) squared becomes smallest. Token sizes are
small integers, so a chunk's state is one count for each gap, and a placement is a few vector operations on it.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.scratch import Scratch, col

CAPACITY = 2048
#: Pieces that one task packs, on average. A chunk's last open bins are what packing in chunks can waste.
CHUNK_PIECES = 30_000
#: Share of the tokens still to come that the gaps of open bins may have when one more is opened for the sake of the sum.
FILLABLE = 0.25
#: Words of which a worker keeps the ids; the cache starts anew beyond that.
CACHED_WORDS = 1_000_000

#: The byte-level vocabularies' own pattern, in terms of Python's character classes. It holds for texts without OTHER.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Anything outside Latin letters, common punctuation and plain white space, where the two kinds of classes could differ; and special tokens.
OTHER = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞₠-₿]|<\\|")

#: ASCII where Python's white space is wider than the pattern's.
CONTROLS = "\x1c\x1d\x1e\x1f"
#: White space next to white space, or other than a space or newline.
RUNS = ("  ", " \n", "\n ", "\n\n", *"\t\r\x0b\x0c\x85\xa0", *CONTROLS)


class Encoder(dict):
    """Little-endian 32-bit ids of texts; equal to the tokenizer's own ids, with those of words kept.

    The pattern takes a space that stands alone into the next word, and a newline that stands alone for
    itself, so a text without other white space is encoded word by word. An entry is a word after a space.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        byte = {chr(letter): b for b, letter in _byte_letters().items()}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        # Merges are numbered in order after the 256 bytes, so an id is its token's merge rank.
        ranks = {bytes(byte[c] for c in token): n for token, n in self.tokenizer.get_vocab().items() if token not in special}
        self.merge = tiktoken.Encoding("words", pat_str=r".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.first: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        merge = self.merge
        return array("I", [n for piece in PIECES.findall(text) for n in merge(piece.encode())]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        if word.isalpha():
            ids = array("I", self.merge(f" {word}".encode())).tobytes()
        elif word[:-1].isalpha() and word[-1] in ".,!?;:":
            ids = self[word[:-1]] + self.head(word[-1])
        else:
            ids = self.encode(f" {word}")
        self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not text.isascii() and OTHER.search(text) or "<|" in text:
            return self.tokenizer_ids(text)
        if not text or any(x in text for x in RUNS) or text[0] in " \n" or text[-1] in " \n":
            return self.tokenizer_ids(text) if any(x in text for x in CONTROLS) else self.encode(text)
        get, out, newline = self.__getitem__, [], self.head("\n")
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(self.head(words[0]))
            del words[0]
            out += map(get, words)
            out.append(newline)
        return b"".join(out[:-1])

    def tokenizer_ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def head(self, word: str) -> bytes:
        found = self.first.get(word)
        if found is None:
            if len(self.first) >= CACHED_WORDS // 4:
                self.first.clear()
            found = self.first[word] = self.encode(word)
        return found


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + n for n, b in enumerate(others)}


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, placed in the given order.

    Putting an item into a bin of gap g with n(g) such bins changes the sum of squares by
    2 * (n(g - item) - n(g)) + 2, or by 1 - 2 * n(g) for a bin it fills, and opening one by 2 * n(capacity - item) + 1.
    Ties go to an open bin, of these to the smallest gap. The rule is made for items without end: a bin opened for the sake of the
    sum near the end of a table stays unfilled. So it is only opened while all gaps are at most ``FILLABLE`` of what is still to come.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made, never = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0, np.iinfo(np.int64).max
    to_come, gaps = int(lengths.sum()), 0
    for k, size in enumerate(lengths.tolist()):
        to_come -= size
        if size >= capacity:
            bins[k], made = made, made + 1
            continue
        left = count[: capacity - size].copy()
        left[0] = 0
        change = np.where(count[size:capacity] > 0, 2 * (left - count[size:capacity]) + 2, never)
        if count[size]:
            change[0] = 1 - 2 * count[size]
        best = int(change.argmin())
        opened = 2 * count[capacity - size] + 1
        if change[best] < never and (change[best] <= opened or gaps + capacity - size > FILLABLE * to_come):
            gap = best + size
            bin_no = open_bins[gap].pop()
            count[gap] -= 1
            gaps -= size
        else:
            gap, bin_no, made = capacity, made, made + 1
            gaps += capacity - size
        bins[k], offsets[k] = bin_no, capacity - gap
        if gap - size:
            count[gap - size] += 1
            open_bins[gap - size].append(bin_no)
    return bins, offsets


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of ``capacity`` but the first, which takes the rest."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def _tokenize(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(texts), 500):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i in range(lo, min(lo + 500, len(texts))):
                    raw = encoder.ids(texts[i].as_py() or "") + end
                    for n, (s, size) in enumerate(cut(len(raw) // 4, capacity)):
                        own = raw[4 * s : 4 * (s + size)]
                        row.append(i)
                        piece.append(n)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, np.int32))
                columns = [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["key", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _pack_chunk(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "key", "piece"], kind="stable", ignore_index=True)
        order = packing_order(pdf["length"].to_numpy(), capacity)
        bins, offsets = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        bins[order], offsets[order] = sum_of_squares(pdf["length"].to_numpy()[order], capacity)
        pdf["sequence_id"], pdf["offset"] = pdf["chunk"].to_numpy().astype(np.int64) * (1 << 32) + bins, offsets
        return pdf.drop(columns=["h", "chunk"])

    return run


def packing_order(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Largest first: the small items come last and close the gaps."""
    return np.argsort(-lengths, kind="stable")


def pack_documents(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, chunk_pieces: int = CHUNK_PIECES) -> DataFrame:
    """One row a piece: (key, piece, start, length, ids_crc32, sequence_id, offset), and the ids on request.

    A document is its text's ids and ``end_id``; a null or empty text is ``end_id`` alone. Only documents
    longer than ``capacity`` are cut, into pieces of ``capacity``, the first of which may be shorter. Pieces
    of a sequence follow each other from offset 0 without a gap. Repeated rows are packed each for itself;
    a null key is a value like any other. No rows give no rows. Full pieces are sequences of their own.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    rows = df.select(col(key).alias("key"), col(text).alias("text"))
    pieces = scratch.write(rows.mapInArrow(_tokenize(tokenizer_path, end_id, capacity, with_ids), schema), "pieces")
    chunks = max(1, -(-pieces.filter(F.col("length") < capacity).count() // chunk_pieces))
    full = pieces.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.filter(F.col("length") < capacity).withColumn("h", F.xxhash64("key", "piece", "ids_crc32")).withColumn("chunk", F.pmod("h", F.lit(chunks)).cast("int"))
    packed = short.groupBy("chunk").applyInPandas(_pack_chunk(capacity), f"{schema}, sequence_id long, offset long")
    return packed.unionByName(full).withColumnRenamed("key", key)


def op6_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
