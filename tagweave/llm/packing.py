"""Packing documents into fixed-length training sequences.

Each document is tokenised once and cut into pieces of the sequence length; only its last piece is
shorter. Pieces are dealt to randomised groups of bounded size, and every group runs first-fit
decreasing on its own, finding the first bin with room by a tournament tree over the bins' free space.
Only descriptions of pieces are shuffled, never texts, and ids only where they are asked for. The group
is a hash of the piece and of its row's position, so repeated rows spread over groups like others, and
another order of the rows gives another packing.

Null or empty texts are one piece that holds the closing id alone. Repeated rows are packed as often
as they occur. An empty table gives an empty result. Columns other than the id and text are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import materialize, prepare

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"

_encoders: dict = {}


#: Characters of a text that are encoded at once, to the next place where words part.
LONG = 1 << 20
#: Between a character and a lone space before another, the split pattern always parts.
_PARTING = re.compile(r"(?<=\S) (?=\S)")
#: The split pattern of the tokenizers library's ByteLevel step, a fixed value.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of a file of the tokenizers library.

    Where the file is plain byte-level BPE, the same vocabulary and merges run through tiktoken, which is
    four times as fast and gives the same ids. Texts that hold a special token's string, texts on
    which tiktoken gives up (runs of a million spaces) and files of another shape go through the
    tokenizers library itself. A text longer than LONG goes in parts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens") or ()]
        self.plain = self._plain(spec)
        self.fast = self._fast(spec) if self.plain else None

    @staticmethod
    def _plain(spec: dict) -> bool:
        """Whether the file's steps are those that tiktoken goes through."""
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        as_bytes = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
        exact = not any(x.get(k) for x in spec.get("added_tokens") or () for k in ("lstrip", "rstrip", "single_word", "normalized"))
        return bool(model.get("type") == "BPE" and as_bytes and not spec.get("normalizer") and not any(model.get(k) for k in odd) and exact)

    def _fast(self, spec: dict):
        """tiktoken with the bytes of each ordinary entry. Printable bytes stand for themselves in the file, others for 256, 257 and so on."""
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        return tiktoken.Encoding("tagweave", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if not self.plain or any(s in text for s in self.special):
            return self._slowly(text)
        if len(text) <= LONG:
            return self._part(text)
        parts, at = [], 0
        while at < len(text):
            found = _PARTING.search(text, at + LONG)
            end = found.start() if found else len(text)
            parts.append(self._part(text[at:end]))
            at = end
        return np.concatenate(parts)

    def _part(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), "<u4")
        except ValueError:  # the stack that its regular expressions have is used up
            return self._slowly(text)

    def _slowly(self, text: str) -> np.ndarray:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(docs: DataFrame, tokenizer_path: str, sequence_length: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: where it starts, its length, checksum and, if wanted, ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), np.array([end_id], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            parts: list[np.ndarray] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                for start in range(0, len(ids), sequence_length):
                    piece = ids[start : start + sequence_length]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece), len(ids)))
                    if with_ids:
                        parts.append(piece)
            if rows:
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                if with_ids:
                    columns.append(pa.array([p.astype("int32") for p in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES + ", ids array<int>" * with_ids)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item, its bin and the offset there. Longest first; each goes to the first bin with room."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths >= capacity).sum())  # these open a bin each and leave no room in it
    bins[order[:full]] = np.arange(full)
    rest = order[full:].tolist()
    leaves = 1 << max(0, (len(rest) - 1).bit_length())
    free = [capacity] * (2 * leaves)  # a parent holds the larger of its children
    sizes = lengths.tolist()
    for item in rest:
        need, at = sizes[item], 1
        while at < leaves:
            at *= 2
            if free[at] < need:
                at += 1
        bins[item], offsets[item] = full + at - leaves, capacity - free[at]
        free[at] -= need
        at //= 2
        while at and free[at] != (most := max(free[2 * at], free[2 * at + 1])):
            free[at] = most
            at //= 2
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str, sequence_length: int = 1024, end_id: int = 0, group_pieces: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pieces with the sequence that each goes to and its offset there; with_ids adds the ids themselves.

    group_pieces is the mean number of pieces that one group packs: it bounds a task's memory, and
    more of them leave less padding.
    """
    pieces = cut(docs, tokenizer_path, sequence_length, end_id, with_ids).withColumn("pack_row", F.monotonically_increasing_id())
    pieces = materialize(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), sequence_length)
        return pdf.assign(sequence_id=pdf["pack_group"] * 2**32 + bins, offset=offsets).drop(columns="pack_group")

    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "pack_row"), F.lit(groups))
    schema = PIECES + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return pieces.withColumn("pack_group", group).drop("pack_row").groupBy("pack_group").applyInPandas(place, schema)


def padding(packed: DataFrame, sequence_length: int = 1024) -> float:
    """The share of padding among all positions. A sequence whose length is a power of two is not padded."""
    own = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    full = F.when(F.col("n").bitwiseAND(F.col("n") - 1) == 0, F.col("n")).otherwise(sequence_length)
    of = own.agg(F.sum(full - F.col("n")), F.sum(full)).first()
    return of[0] / of[1] if of[1] else 0.0


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pieces packed with with_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
