"""SentencePiece encoding and decoding over a table of distinct chunks.

The library marks each space (and the beginning of a text that isn't empty) with U+2581 and merges pieces from there. In the
vocabularies that this operator takes, no piece holds a marker after another character; so a text falls into chunks, each
a run of markers and what follows up to the next marker, and no piece crosses from one into another. A task cuts its texts into
chunks by array operations, finds the distinct ones, has the library segment those it hasn't met yet, each once, and joins
the ids and the decoded strings back by position. `check_vocabulary` refuses a model for which this doesn't hold (pieces with a
marker inside, a normalisation of its own, symbols that users defined, markers at the end of words).

Memory: a task remembers `REMEMBERED` to twice as many chunks of up to `LONGEST` bytes; longer ones are segmented where they
occur. A text is worked on whole: its ids and its decoded text are a row, as its text is.

Edge cases: a null or empty text has the end id only and decodes to the empty text; spaces at either end, runs of spaces,
U+2581 in the text (which reads as a space), control characters and characters outside the vocabulary (bytes) come out as
the library has them; names of control symbols in a text are plain text. A text of many megabytes without a space is one
chunk. Equal rows and null keys are kept as they are, an empty table gives an empty result, and extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.llm.common import map_texts
from graticule.llm.textkernel import Block

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Chunks that a task remembers at least, and the longest (in bytes) that it remembers.
REMEMBERED = 150_000
LONGEST = 64
#: Chunks that are looked up at once.
AT_ONCE = 50_000


def check_vocabulary(path: str) -> None:
    """Raise if pieces of this model may cross from one chunk into another."""
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    rules = proto.normalizer_spec
    crossing = [p.piece for p in proto.pieces if MARK in p.piece.lstrip(MARK)]
    defined = [p.piece for p in proto.pieces if p.type == model.ModelProto.SentencePiece.USER_DEFINED]
    plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
    if crossing or defined or not plain or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"pieces of {path} may cross whitespace markers: {(crossing or defined)[:3]}")


def spaced(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and offsets with a space for each marker, and one more space before each text that isn't empty."""
    data, offsets = block.data, block.offsets
    if len(data) > 2:
        marks = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        if len(marks):
            data = data.copy()
            data[marks] = 32
            data = np.delete(data, np.r_[marks + 1, marks + 2])
            offsets = offsets - 2 * np.searchsorted(marks, offsets)
    filled = offsets[1:] > offsets[:-1]
    return np.insert(data, offsets[:-1][filled], 32), offsets + np.r_[0, np.cumsum(filled)]


class Chunks:
    """The library's processor and what it has made of the chunks met so far."""

    _made: dict[str, Chunks] = {}

    def __init__(self, path: str):
        import sentencepiece

        check_vocabulary(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.mark, self.end = self.processor.piece_to_id(MARK), self.processor.eos_id()
        self.recent: dict[bytes, tuple[np.ndarray, str]] = {}
        self.older: dict[bytes, tuple[np.ndarray, str]] = {}

    @classmethod
    def of(cls, path: str) -> Chunks:
        """The worker's table for this model."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def segment(self, chunks: list[bytes]) -> list[tuple[np.ndarray, str]]:
        """Ids and decoded text of chunks, each of which begins with a space. The library adds that space itself."""
        ids = self.processor.encode([c[1:].decode() for c in chunks], num_threads=1)
        ids = [own if len(chunk) > 1 else [self.mark] for own, chunk in zip(ids, chunks, strict=True)]  # it adds none to nothing
        said = self.processor.decode(ids, num_threads=1) if ids else []
        return [(np.array(i, dtype=np.int32), " " + t) for i, t in zip(ids, said, strict=True)]

    def look_up(self, chunks: list[bytes]) -> list[tuple[np.ndarray, str]]:
        if len(self.recent) > REMEMBERED:
            self.older, self.recent = self.recent, {}
        found = [self.recent.get(c) or self.older.get(c) for c in chunks]
        new = [i for i, x in enumerate(found) if x is None]
        for i, made in zip(new, self.segment([chunks[i] for i in new]), strict=True):
            found[i] = made
        for c, made in zip(chunks, found, strict=True):
            if len(c) <= LONGEST:
                self.recent[c] = made
        return found

    def joined(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """All ids, number of ids and decoded text of the chunks between `edges`, in order."""
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        found = self.look_up(chunks.dictionary.to_pylist())
        which = chunks.indices.to_numpy()
        flat = np.concatenate([x for x, _ in found])
        many = np.array([len(x) for x, _ in found], dtype=np.int64)
        first = (np.cumsum(many) - many)[which]
        many = many[which]
        ids = flat[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        return ids, many, pa.array([t for _, t in found], pa.large_string()).take(chunks.indices)

    def encode(self, block: Block, end: bool) -> dict[str, pa.Array]:
        """`ids` and `decoded` of every text of a block."""
        data, offsets = spaced(block)
        begins = data == 32
        begins[1:] &= data[:-1] != 32
        begins[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        starts = np.flatnonzero(begins)
        edges = np.r_[starts, len(data)].astype(np.int64)
        of_text = np.searchsorted(starts, offsets)  # the first chunk of each text
        parts = [self.joined(data, edges[at : at + AT_ONCE + 1]) for at in range(0, len(starts), AT_ONCE)]
        none = (np.zeros(0, np.int32), np.zeros(0, np.int64), pa.array([], pa.large_string()))
        ids, many, said = zip(*(parts or [none]), strict=True)
        ids, said, upto = np.concatenate(ids), pa.concat_arrays(said), np.r_[0, np.cumsum(np.concatenate(many))]
        bounds = upto[of_text]
        if end:
            ids = np.insert(ids, bounds[1:], self.end)
            bounds = bounds + np.arange(len(bounds))
        texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(of_text), said), pa.scalar("", pa.large_string()))
        return {"ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), "decoded": pc.utf8_slice_codeunits(texts, 1).cast(pa.string())}


def encode(docs: DataFrame, model: str, keep: list[str] | None = None, end: bool = True) -> DataFrame:
    """The columns `keep` of every document with `ids`, as the library encodes its text (with the end id if `end`), and
    `decoded`, what it decodes these to. One pass over the rows; nothing is exchanged."""
    check_vocabulary(model)
    return map_texts(docs, lambda block: Chunks.of(model).encode(block, end), [("ids", "array<int>"), ("decoded", "string")], keep or ["doc_id"])


def encoded_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, number of ids, hash of the ids as decimals with spaces between, hash of the decoded text."""
    rows = encode(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model)
    spelled = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelled.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
