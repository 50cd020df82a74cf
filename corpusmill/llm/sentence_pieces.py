"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the model's compiled character map: at each place the longest prefix that the
map holds is replaced, and every byte that is written remembers where in the original its
prefix began. The normalised bytes are cut into pieces, whose lengths the bytes' origins then
project to spans of the original.

No piece of the vocabulary goes on over the beginning of a word's spaces. So words become pieces on their own,
each distinct word once in a worker as long as it is kept; the library itself merges those that
a worker meets for the first time, many at once.
"""

from __future__ import annotations

import heapq
import itertools
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.arrow import bound_batches, held, release, slices
from corpusmill.sources.tables import read_table

MODEL = "piece_bpe_32k.model"
#: Words that a worker keeps with their ids, and bytes of the longest that is kept.
CACHE_WORDS, CACHE_BYTES = 400_000, 64
#: The sign for a space, the sign for what can't be decoded, types of pieces.
SPACE, BAD = "▁".encode(), "�".encode()
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


#: Ids, starts and ends.
Pieces = tuple[np.ndarray, np.ndarray, np.ndarray]


class CharMap:
    """A compiled character map: a double-array trie of prefixes, and what each becomes.

    A unit of the array holds in its low byte its label; bit 8 tells that a value hangs below it, bits 10
    and up, times 256 with bit 9, the offset to its children. A value's unit has bit 31 set.
    """

    def __init__(self, compiled: bytes):
        self.units = np.zeros(0, "<u4")
        self.strings = b""
        if compiled:
            size = struct.unpack_from("<I", compiled)[0]
            self.units, self.strings = np.frombuffer(compiled, "<u4", size // 4, 4), compiled[4 + size :]
        self.array = self.units.tolist()
        root = self._offset(self.array[0]) if self.array else 0
        heads = [c for c in range(1, 256) if self.array and self.array[root ^ c] & 0x800000FF == c]
        #: A place where a prefix of the map may begin.
        self.heads = re.compile(b"[" + b"".join(re.escape(bytes([c])) for c in heads) + b"]") if heads else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """How many bytes the longest prefix at ``at`` has (0 if none does), and what it becomes."""
        array, node = self.array, self._offset(self.array[0])
        length = value = 0
        for i in range(at, len(text)):
            node ^= text[i]
            unit = array[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit & 0x100:
                length, value = i + 1 - at, array[node] & 0x7FFFFFFF
        return length, self.strings[value : self.strings.index(b"\0", value)] if length else b""

    def replaced(self, text: bytes) -> list[tuple[int, int, bytes]]:
        """Start, length and replacement of each prefix that the map or an invalid byte changes, in order."""
        bad: set[int] = set()
        rest = 0
        while True:
            try:
                text[rest:].decode()
                break
            except UnicodeDecodeError as e:
                bad.update(range(rest + e.start, rest + e.end))
                rest += e.end
        out: list[tuple[int, int, bytes]] = []
        if self.heads is None:
            return [(i, 1, BAD) for i in sorted(bad)]
        at = 0
        places = heapq.merge((m.start() for m in self.heads.finditer(text)), sorted(bad))
        for i in places:
            if i < at or (text[i] & 0xC0 == 0x80 and i not in bad):
                continue  # within a prefix, or within a character
            length, new = self.longest(text, i)
            if not length and i in bad:
                length, new = 1, BAD
            if length:
                out.append((i, length, new))
                at = i + length
        return out


class Model:
    """A SentencePiece model of merges (BPE), with the library's own rules."""

    def __init__(self, serialised: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(serialised)
        rules, trainer = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        if trainer.model_type != trainer.BPE or trainer.treat_whitespace_as_suffix or not rules.escape_whitespaces or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE} or proto.denormalizer_spec.precompiled_charsmap:
            raise ValueError("not a plain BPE model: other types, user-defined or unused pieces, spaces as suffixes and denormalisers aren't supported")
        self.map = CharMap(rules.precompiled_charsmap)
        self.prefix, self.squeeze = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        pieces = [p.piece.encode() for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.unknown, self.has_bytes = self.kinds.index(UNKNOWN), BYTE in kinds
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p, k in zip(pieces, self.kinds, strict=True) if k == NORMAL)
        # What a piece adds to normalised bytes, and to a decoded text.
        self.lengths = np.array([1 if k == BYTE else len(p) for p, k in zip(pieces, self.kinds, strict=True)], np.int64)
        surface = {NORMAL: lambda p: p.replace(SPACE, b" "), UNKNOWN: lambda p: trainer.unk_surface.encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.surface = [surface[k](p) for p, k in zip(pieces, self.kinds, strict=True)]
        # The library, for bytes that are normalised already.
        rules.name, rules.precompiled_charsmap, rules.add_dummy_prefix, rules.remove_extra_whitespaces = "identity", b"", False, False
        self.library = SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.cache: dict[bytes, bytes] = {}

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, spaces written as spaces, and where in ``text`` each comes from (and the end)."""
        text_array = np.frombuffer(text, np.uint8)
        origin = np.arange(len(text))
        if len(text):
            origin = np.maximum.accumulate(np.where(text_array & 0xC0 != 0x80, origin, 0))
        changes = self.map.replaced(text)
        if changes:
            new, parts, origins, at = [], [], [], 0
            for i, length, made in changes:
                parts += [text[at:i], made]
                origins += [origin[at:i], np.full(len(made), i)]
                at = i + length
            new = b"".join([*parts, text[at:]])
            origin = np.concatenate([*origins, origin[at:]]) if origins else origin
        else:
            new = text
        end = len(text)
        if self.squeeze:
            spaces = np.frombuffer(new, np.uint8) == 32
            keep = ~(spaces & np.append(True, spaces[:-1]))[: len(new)]
            new, origin = np.frombuffer(new, np.uint8)[keep].tobytes(), origin[keep]
        if SPACE in new:  # the sign itself counts as a space
            at = np.array([m.start() for m in re.finditer(SPACE, new)])
            keep = np.ones(len(new), bool)
            keep[np.concatenate([at + 1, at + 2])] = False
            new, origin = new.replace(SPACE, b" "), origin[keep]
        if self.squeeze and new.endswith(b" "):
            bare = new.rstrip(b" ")
            new, end, origin = bare, int(origin[len(bare)]), origin[: len(bare)]
        if self.prefix and (new or (text and not self.squeeze)):
            head = 0  # where the text begins for the library: behind prefixes that are spaces, if those go
            by_start = {i: (length, made) for i, length, made in changes} if self.squeeze else {}
            while self.squeeze and (step := by_start.get(head, (1, text[head : head + 1])))[1] == b" ":
                head += step[0]
            new, origin = b" " + new, np.append(head, origin)
        return new, np.append(origin, end)

    def _keep(self, words: set[bytes]) -> None:
        """Have the ids of ``words``, as 32-bit numbers, in the cache."""
        new = [w for w in words if w not in self.cache]
        made = self.library.encode([w.replace(b" ", SPACE) for w in new], num_threads=1)
        self.cache.update(zip(new, (array("i", ids).tobytes() for ids in made), strict=True))

    def _words(self, normal: bytes) -> list[bytes]:
        """Parts of the normalised bytes that no piece reaches over: words with the spaces before them."""
        if not normal or not self.by_word:
            return [normal] if normal else []
        return re.findall(rb" *[^ ]+| +", normal) if b"  " in normal or normal[-1:] == b" " else [b" " + w for w in normal[1:].split(b" ")] if normal[:1] == b" " else re.findall(rb" ?[^ ]+", normal)

    def encode(self, texts: list[bytes]) -> list[Pieces]:
        """For each text ids, and the span of original bytes of each; a character's byte pieces but the last are empty spans at its start."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        normal = [self.normalise(t) for t in texts]
        words = [self._words(n) for n, _ in normal]
        seen = set().union(*words)
        self._keep(seen)
        out = [self._spans(w, n, origin) for w, (n, origin) in zip(words, normal, strict=True)]
        for word in (w for w in seen if len(w) > CACHE_BYTES):
            del self.cache[word]
        return out

    def _spans(self, words: list[bytes], normal: bytes, origin: np.ndarray) -> Pieces:
        ids = np.frombuffer(b"".join(map(self.cache.__getitem__, words)), np.int32)
        if not len(ids):
            return ids, ids, ids
        if self.has_bytes or not (ids == self.unknown).any():
            sizes = self.lengths[ids]
        else:
            ids, sizes = self._with_unknown(words)
        # Lengths count a space's sign, of three bytes; ``normal`` has one byte for it.
        ends = np.cumsum(sizes)
        spread = np.repeat(np.arange(len(normal)), np.where(np.frombuffer(normal, np.uint8) == 32, 3, 1))
        place = np.append(spread, len(normal))
        return ids, origin[place[ends - sizes]].astype(np.int32), origin[place[ends]].astype(np.int32)

    def _with_unknown(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths for a model without byte pieces: unknown characters side by side are one piece, whatever word they are in."""
        ids, sizes = [], []
        for word in words:
            for p in self.library.encode(word.replace(b" ", SPACE), return_type="proto").pieces:
                if p.id == self.unknown and ids and ids[-1] == self.unknown:
                    sizes[-1] += p.end - p.begin
                else:
                    ids.append(p.id)
                    sizes.append(p.end - p.begin)
        return np.array(ids, np.int32), np.array(sizes, np.int64)

    def decode(self, ids: list[int]) -> bytes:
        """The text of any ids: control pieces are nothing, bytes that aren't UTF-8 the replacement character each."""
        surface = self.surface
        parts = [surface[i] for i in ids]
        if self.prefix or self.squeeze:
            # The first piece with a text loses the space before it; where such spaces go, all of the first pieces do.
            for n, i in enumerate(ids):
                if self.kinds[i] == CONTROL:
                    continue
                if self.kinds[i] == NORMAL and parts[n][:1] == b" ":
                    parts[n] = parts[n][1:]
                    if self.squeeze and not parts[n]:
                        continue
                break
        whole = b"".join(parts)
        try:
            whole.decode()
            return whole
        except UnicodeDecodeError:
            runs = itertools.groupby(zip(ids, parts, strict=True), lambda x: self.kinds[x[0]] == BYTE)
            return b"".join(_repaired(b"".join(p for _, p in run)) if is_byte else b"".join(p for _, p in run) for is_byte, run in runs)


def _repaired(raw: bytes) -> bytes:
    """Valid characters of ``raw``, and a replacement character for each other byte."""
    out, at = [], 0
    while at < len(raw):
        try:
            return b"".join([*out, raw[at:].decode().encode()])
        except UnicodeDecodeError as e:
            out += [raw[at : at + e.start], BAD * (e.end - e.start)]
            at += e.end
    return b"".join(out)


def model_path(name: str = MODEL) -> str:
    """The place of a public model's file on this machine; a path stays as it is."""
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def _load(name: str) -> Model:
    def read() -> Model:
        with open(model_path(name), "rb") as f:
            return Model(f.read())

    return held(("sentence-pieces", name), read)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    edges = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays])))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, decoded: bool = False) -> DataFrame:
    """The pieces of every whole text: doc_id, ids, starts, ends (spans of bytes of the UTF-8 text); if asked for, ``decoded``, as ``decode`` gives.

    Ids are those of the SentencePiece library for the model, without begin or end ids and without
    sampling. A null text counts as empty; an empty one has no ids. Rows with a null id and
    repeated rows are encoded like any other. An empty table gives an empty result. Other columns are not read.
    ``model`` is a file among the public tokenizers, or a path that every executor has; it holds a
    plain BPE model (``Model``). A text's pieces are made at once: memory goes with the longest text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    bound_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(model)
        for batch in batches:
            for part in slices(batch, "text"):
                made = pieces.encode([t or b"" for t in part.column("text").to_pylist()])
                columns = [part.column("doc_id"), *(_lists([m[i] for m in made]) for i in range(3))]
                if decoded:
                    columns.append(pa.array([pieces.decode(m[0].tolist()) for m in made], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "starts", "ends", "decoded"][: len(columns)])
        release()

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {id_type}, ids array<int>, starts array<int>, ends array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """All columns of ``encoded``, and ``decoded``, the text of the ids; null ids give an empty text.

    Ids that the model hasn't raise an error, as they do in the library. A column ``decoded`` is replaced.
    """
    rows = encoded.drop("decoded").withColumn("__ids", F.col(ids_col).cast("array<int>"))
    bound_batches(encoded.sparkSession)
    kept = [f for f in rows.schema.fields if f.name != "__ids"]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "decoded string"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(model)
        for batch in batches:
            texts = [pieces.decode(ids or []).decode() for ids in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), "decoded"])
        release()

    return rows.mapInArrow(each, out)


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded text, as digests."""
    coded = encode(read_table(spark, sf_dir, "documents", "doc_id", "text"), decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), F.xxhash64("starts", "ends").alias("spans_hash"),
    )


QUERIES = {"op11_sentence_pieces": op11_sentence_pieces}
SQL: dict[str, str] = {}
