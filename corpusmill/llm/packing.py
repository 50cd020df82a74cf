"""Best-fit packing of token sequences.

Documents become token ids where they lie; only their pieces' lengths and checksums move on.
Pieces are dealt and sorted by the hash of their place in a written table, so that a rerun of a
task meets the same pieces in the same order. Each task packs online into a fixed number of
open bins: a bit set keyed by free space gives the bin with the least room that still holds
the piece; where none does, a new bin opens, and if all are in use the fullest one closes.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusmill.llm.arrow import bound_batches, held, map_texts, release
from corpusmill.sources.tables import materialise, read_table

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
OPEN_BINS = 4096
END = b"\0\0\0\0"

#: Fixed value: the pattern by which byte-level tokenizers part words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of byte-level vocabularies stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked_vocabulary(file: dict[str, Any], merge: Callable[[str], list]) -> dict[bytes, int] | None:
    """Ids by bytes, if merging neighbours of lowest id gives what the tokenizer's list of merges gives; else None.

    It does for a plain byte-level tokenizer whose merges stand in order of the ids that they
    make, if every token of its vocabulary, taken as a text, becomes that token alone. For while
    two tokens lie side by side, what was merged between their outer ends is how the merges
    begin for that stretch as a text; so if it is a token, its last merge is of these two.
    """
    model, words = file["model"], file["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if any(not t["special"] for t in file.get("added_tokens") or ()):
        return None
    if not plain or file["normalizer"] or words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex", True):
        return None
    letters, vocabulary = _byte_letters(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocabulary[a + b] for a, b in pairs]
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)) or any(c not in vocabulary for c in letters) or any(set(t) - set(letters) for t in vocabulary):
        return None
    if any(len(merge(t)) != 1 for t in vocabulary):
        return None
    return {bytes(map(letters.__getitem__, t)): i for t, i in vocabulary.items()}


def make_encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids, as little-endian unsigned 32-bit numbers.

    Special tokens' strings in a text are ordinary text. Where ``ranked_vocabulary`` shows that
    ranks alone decide, the ids come from a merger of ranks, which is several times faster.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        ranks = ranked_vocabulary(json.load(f), tokenizer.model.tokenize)
    if ranks is None:
        return lambda text: b"".join([i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids])
    import tiktoken

    merger = tiktoken.Encoding(path, pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    return lambda text: merger.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def encoder(path: str) -> Callable[[str], bytes]:
    """``make_encoder``, once in a worker."""
    return held(("encoder", path), lambda: make_encoder(path))


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """Start, length and CRC-32 of each piece of a document's ids; the first may be shorter."""
    n = len(ids) // 4
    first = (n - 1) % capacity + 1
    edges = [0, *range(first, n + 1, capacity)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(edges, edges[1:], strict=False)]


class Packer:
    """Online best fit into at most ``open_bins`` bins of ``capacity``."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
        self.bits = self.n_open = self.made = 0

    def _put(self, bin_: int, free: int) -> None:
        if free:
            self.free[free].append(bin_)
            self.bits |= 1 << free
            self.n_open += 1

    def _take(self, free: int) -> int:
        bin_ = self.free[free].pop()
        if not self.free[free]:
            self.bits ^= 1 << free
        self.n_open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of ``length`` (1 to capacity)."""
        if fits := self.bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            bin_, free = self.made, self.capacity
            self.made += 1
        self._put(bin_, free - length)
        return bin_, self.capacity - free


def _cut(texts: list[str | None], path: str, capacity: int) -> dict[str, list]:
    encode = encoder(path)
    return {"pieces": [[dict(zip(("start", "length", "ids_crc32"), p, strict=True)) for p in pieces(encode(t or "") + END, capacity)] for t in texts]}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pack every row of ``docs`` into sequences of at most ``capacity`` tokens.

    A document's tokens are its text's and a final 0; null counts as an empty text, of one
    token. Only documents of over ``capacity`` tokens are cut; all pieces but the first fill a
    sequence. Returns one row for each piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Rows with a null id and repeated rows are packed like any other.
    An empty table gives an empty result. Other columns of ``docs`` are not read. ``tokenizer`` is a
    file among the public tokenizers, or a path that every executor has.

    Pieces are written once, so that a lost executor costs no encoding, and dealt by their
    place in that table, whatever their ids are.
    """
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS string) AS text")
    step = lambda texts: _cut(texts, tokenizer if "/" in tokenizer else tokenizer_path(tokenizer), capacity)
    cut = map_texts(rows, "text", step, "pieces array<struct<start:long, length:long, ids_crc32:long>>")
    flat = materialise(cut.select("doc_id", F.posexplode("pieces").alias("piece", "p")).select("doc_id", "piece", "p.*"), "pieces")
    placed = flat.withColumn("__place", F.xxhash64(F.monotonically_increasing_id()))
    dealt = placed.repartition("__place").sortWithinPartitions("__place").drop("__place")
    out = StructType([*dealt.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    bound_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, base = Packer(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            at = [packer.place(n) for n in batch.column("length").to_pylist()]
            columns = [*batch.columns, pa.array([base + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)
        release()

    return dealt.mapInArrow(each, out)


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document is packed."""
    return pack(read_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op6_best_fit": op6_best_fit}
SQL: dict[str, str] = {}
