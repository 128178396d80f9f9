"""Byte-level BPE by a sentencepiece model that is written directly from a rank file.

Every token's bytes are mapped to one printable character each; the model holds these
pieces, scored by negative rank, with identity normalisation and no added prefix or white-space rule.  Sentencepiece
then merges the adjacent pair of the best score first, which is the lowest rank
first.  A match of the split pattern that is a token itself is taken as it is.  Decoding
maps ids back to pieces and pieces back to bytes.
"""

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import batch_of, worker_state

MEMO_ENTRIES = 500_000  # matches a worker remembers the ids of


def letters() -> list[str]:
    """One printable character for every byte, none of them white space."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


# ------------------------------------------------- protocol buffer wire format ---
def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _bytes_field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes last.

    Ranks must be 0, 1, ... without gaps.  Field numbers are those of the public model format.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be consecutive from 0")
    to_letter = letters()
    model = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join([to_letter[b] for b in token]).encode()
        body = _bytes_field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _int_field(3, 1)
        model += _bytes_field(1, body)
    unknown = _bytes_field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int_field(3, 2)
    model += _bytes_field(1, unknown)
    trainer = _int_field(3, 2) + _int_field(4, len(tokens) + 1) + _int_field(40, len(tokens))  # BPE, size, unknown id
    trainer += b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43))  # no begin, end or pad piece
    model += _bytes_field(2, trainer)
    normaliser = _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)
    model += _bytes_field(3, normaliser)
    return bytes(model)


def read_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


class Codec:
    """Encoder and decoder of one rank file, with a bounded memo of matches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks = ranks
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.table = dict(enumerate(letters()))
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def _match(self, match: str) -> tuple[int, ...]:
        data = match.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        return tuple(self.processor.encode(data.decode("latin-1").translate(self.table)))

    def encode(self, text: str) -> list[int]:
        memo, ids = self.memo, []
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        for match in self.split(text):
            found = memo.get(match)
            if found is None:
                found = self._match(match)
                if len(match) <= 64:
                    memo[match] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def _codec(lines, pattern: str, name: str):
    return worker_state(("byte bpe", name, pattern), lambda: Codec(read_ranks(lines.value), pattern))


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text; null and empty texts have no ids.

    The driver reads ``rank_file`` (a vocabulary of about a megabyte) and ships its bytes.
    Repeated rows and null ids stay; other columns are ignored.
    """
    with open(rank_file, "rb") as file:
        lines = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        codec = _codec(lines, pattern, rank_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                yield batch_of(schema, [some.column(0), [codec.encode(t or "") for t in some.column(1).to_pylist()]])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data) with the bytes of every id list; a null list is empty."""
    with open(rank_file, "rb") as file:
        lines = rows.sparkSession.sparkContext.broadcast(file.read())
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def run(batches):
        codec = _codec(lines, pattern, rank_file)
        for batch in batches:
            yield batch_of(schema, [batch.column(0), [codec.decode(i or []) for i in batch.column(1).to_pylist()]])

    return rows.select(F.col(id_col).cast("long"), F.col(ids_col)).mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of both directions in one pass over the texts.

    The ids are hashed as decimals joined by commas.  Same rules as :func:`encode`.
    """
    with open(rank_file, "rb") as file:
        lines = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        codec = _codec(lines, pattern, rank_file)
        decimal = worker_state(("decimals", len(codec.tokens)), lambda: [str(i) for i in range(len(codec.tokens))])
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text or "")
                listed = ",".join([decimal[i] for i in ids]).encode()
                out.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            yield batch_of(schema, [batch.column(0), *(list(zip(*out)) or [[]] * 3)])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
