"""SentencePiece encoding and decoding of whole texts with a streaming Viterbi.

The encoder finds the segmentation of greatest score sum over the model's pieces. It reads a text
from left to right and keeps the best path to each of the last `longest piece` positions only.
Whenever all of these surviving paths run through one boundary, the ids up to it are final and
are given out; so memory depends on the pieces and on how long paths disagree, not on the text.
Where no piece joins two neighbouring characters all paths meet: with the usual models every word
starts at such a place, and what lies between two of them is found once and remembered.

Models are read with the sentencepiece library, whatever their kind; scores are used as those of a
unigram model (a BPE model's scores are its merge ranks), which is what Viterbi defines. A
character without a piece becomes its UTF-8 bytes if the model has byte pieces, else the unknown
id. A literal U+2581, which the format uses for a blank, is written as bytes where they exist, so
that decoding gives back every text exactly.

Defined results: null and empty texts have no ids and decode to the empty text; control and
unknown ids decode to nothing and to " ⁇ "; bytes that are not UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewerk.llm.shared import fresh, pieces, texts

BLANK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 300_000
_NEVER = float("-inf")


class Codec:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap:
            raise ValueError("only models without character rules are supported")
        self.dummy_prefix = rules.add_dummy_prefix
        self.trim = rules.remove_extra_whitespaces
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.surface: list[str] = []
        self.bytes: dict[int, int] = {}
        known: dict[str, tuple[int, float, tuple[int]]] = {}
        lowest, highest = 0.0, -1e30
        for i, piece in enumerate(proto.pieces):
            text = piece.piece
            if piece.type == kind.BYTE:
                self.bytes[i] = int(text[3:5], 16)
            elif piece.type in (kind.NORMAL, kind.USER_DEFINED):
                known[text] = (i, piece.score, (i,))
                if piece.type == kind.NORMAL:
                    lowest, highest = min(lowest, piece.score), max(highest, piece.score)
            self.surface.append(
                "" if piece.type in (kind.CONTROL, kind.BYTE)
                else " ⁇ " if piece.type == kind.UNKNOWN
                else text.replace(BLANK, " ")
            )
        for piece in proto.pieces:
            if piece.type == kind.USER_DEFINED:
                i = known[piece.piece][0]
                known[piece.piece] = (i, len(piece.piece) * highest - 0.1, (i,))
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.unknown = library.unk_id()
        self.penalty = lowest - UNKNOWN_PENALTY
        self.longest = max(map(len, known), default=1)
        self.known = known
        #: Pieces by their characters; a piece that ends at a node is held under "".
        self.tree: dict = {}
        for text, piece in known.items():
            node = self.tree
            for char in text:
                node = node.setdefault(char, {})
            node[""] = piece
        self.stretches = self._stretches(known)
        self.is_byte = np.zeros(len(self.surface), bool)
        self.is_byte[list(self.bytes)] = True
        #: Ids of stretches met lately: two generations, the older is dropped when full.
        self.remembered: tuple[dict[str, array], dict[str, array]] = ({}, {})

    @staticmethod
    def _stretches(known: Iterable[str]):
        """Splits a text at places that no piece spans: before blanks after other characters,
        and around characters that no longer piece holds. None if pieces span the former."""
        if any(BLANK in text.lstrip(BLANK) for text in known):
            return None
        joined = {char for text in known if len(text) > 1 for char in text} - {BLANK}
        if not joined:
            return None
        chars = "".join(map(re.escape, sorted(joined)))
        return re.compile(f"{BLANK}*[{chars}]+|{BLANK}+|[^{BLANK}{chars}]").findall

    def _spell(self, char: str) -> list[int]:
        if not self.byte_id:
            return [self.unknown]
        return [self.byte_id[b] for b in char.encode()]

    def stream(self, text: str) -> Iterator[int]:
        """Ids of normalised text, given out as soon as they are final.

        `score`, `back` and `via` describe the best path to each position from `base` on, the
        last boundary given out. After every `longest` characters the surviving paths, those to
        the positions that the next piece can start from, are followed back to where they meet.
        """
        tree, longest, size = self.tree, self.longest, len(text)
        score, back, via = [0.0] + [_NEVER] * size, [0] * (size + 1), [()] * (size + 1)
        if size > 2 * longest:
            for part in (score, back, via):
                del part[2 * longest :]
        base = 0
        for at in range(size):
            here, so_far = at - base, score[at - base]
            if so_far == _NEVER:
                continue
            single = False
            node, to = tree, here
            for char in text[at : at + longest]:
                node = node.get(char)
                if node is None:
                    break
                to += 1
                piece = node.get("")
                if piece is not None:
                    if to == here + 1:
                        single = True
                    reached = so_far + piece[1]
                    if reached > score[to]:
                        score[to], back[to], via[to] = reached, at, piece[2]
            if not single and so_far + self.penalty > score[here + 1]:
                score[here + 1] = so_far + self.penalty
                back[here + 1], via[here + 1] = at, self._spell(text[at])
            if size > longest and (at + 1) % longest == 0:
                alive = {p for p in range(at + 1, base + len(score)) if score[p - base] != _NEVER}
                while len(alive) > 1:
                    last = max(alive)
                    alive.remove(last)
                    alive.add(back[last - base])
                meet = alive.pop()
                yield from self._path(back, via, base, meet)
                gone, least = meet - base, score[meet - base]
                score = [x - least for x in score[gone:]]
                back, via, base = back[gone:], via[gone:], meet
                more = min(size, at + 2 * longest + 1) - base + 1 - len(score)
                score += [_NEVER] * more
                back += [0] * more
                via += [()] * more
        yield from self._path(back, via, base, size)

    @staticmethod
    def _path(back: list, via: list, base: int, end: int) -> list[int]:
        parts = []
        while end > base:
            parts.append(via[end - base])
            end = back[end - base]
        return [i for part in reversed(parts) for i in part]

    def _encode_part(self, text: str, out: array) -> None:
        if self.stretches is None:
            out.extend(self.stream(text))
            return
        young, old = self.remembered
        for word in self.stretches(text):
            ids = young.get(word)
            if ids is None:
                ids = old.get(word)
                if ids is None:
                    ids = array("i", self.stream(word))
                if len(word) <= 64:
                    if len(young) >= REMEMBERED:
                        young, old = self.remembered = {}, young
                    young[word] = ids
            out.extend(ids)

    def encode(self, text: str) -> array:
        out = array("i")
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return out
        parts = text.split(BLANK) if self.byte_id else [text]
        for k, part in enumerate(parts):
            if k:
                out.extend(self._spell(BLANK))
            normal = part.replace(" ", BLANK)
            self._encode_part(BLANK + normal if not k and self.dummy_prefix else normal, out)
        return out

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        surface = self.surface
        spelled = self.is_byte[ids]
        if spelled.any():
            edges = np.flatnonzero(np.diff(spelled)) + 1
            text = "".join(
                bytes(self.bytes[i] for i in run.tolist()).decode("utf-8", "replace")
                if len(run) and self.is_byte[run[0]]
                else "".join([surface[i] for i in run.tolist()])
                for run in np.split(ids, edges)
            )
        else:
            text = "".join([surface[i] for i in ids.tolist()])
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file, read once through Spark's file system and shipped to the tasks."""
    where = path if "://" in path else f"file://{path}"
    if where.startswith("file://"):
        with open(where.removeprefix("file://"), "rb") as file:
            return file.read()
    return bytes(spark.read.format("binaryFile").load(where).select("content").first()[0])


def _held(spark: SparkSession, model_path: str):
    model = spark.sparkContext.broadcast(read_model(spark, model_path))
    made: list[Codec] = []

    def codec() -> Codec:
        if not made:
            made.append(Codec(model.value))
        return made[0]

    return codec


def encode_column(docs: DataFrame, text_col: str = "text", model_path: str = DEFAULT_MODEL):
    """Ids of each text, as a column."""
    codec = _held(docs.sparkSession, model_path)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.asarray(codec().encode(t or "")) for t in batch], dtype=object)

    return encode(F.col(f"`{text_col}`"))


def encode_and_decode(
    docs: DataFrame, keep: list[str], text_col: str = "text", model_path: str = DEFAULT_MODEL
) -> DataFrame:
    """The columns `keep` of each row with ids, n_tokens, decoded_sha256 and round_trip.

    round_trip says whether the ids decode to the text.
    """
    codec = _held(docs.sparkSession, model_path)
    ids, count, sha, back = fresh(keep, "ids", "n_tokens", "decoded_sha256", "round_trip")
    kept = [docs.schema[name] for name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec()
        for batch in pieces(batches, 256):
            made, sizes, digests, same = array("i"), [0], [], []
            for text in texts(batch.column(len(keep))):
                own = tool.encode(text)
                made.extend(own)
                sizes.append(len(made))
                decoded = tool.decode(own)
                digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                same.append(decoded == text)
            offsets = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(keep)],
                    pa.ListArray.from_arrays(offsets, pa.array(np.asarray(made, np.int32))),
                    pa.array(np.diff(np.asarray(sizes, np.int64))),
                    pa.array(digests, pa.string()),
                    pa.array(same, pa.bool_()),
                ],
                names=[*keep, ids, count, sha, back],
            )

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    schema = ", ".join([*columns, f"{ids} array<int>, {count} long, {sha} string, {back} boolean"])
    chosen = docs.select(*[F.col(f"`{n}`") for n in keep], F.col(f"`{text_col}`").alias("text"))
    return chosen.mapInArrow(run, schema)


def decode_column(rows: DataFrame, ids_col: str = "ids", model_path: str = DEFAULT_MODEL):
    """Text of each list of ids, as a column."""
    codec = _held(rows.sparkSession, model_path)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([codec().decode([] if i is None else i) for i in batch], dtype=object)

    return decode(F.col(f"`{ids_col}`"))
