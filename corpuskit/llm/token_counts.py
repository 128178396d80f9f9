"""Token counts by rank-synchronous merging of ragged numpy arrays.

The pre-tokens of a batch lie end to end in one array of symbols.  A round finds every
sequence's lowest-rank pair, merges all its occurrences in all sequences at once and looks up
only the pairs that changed; sequences without a pair that merges leave with the number of
their symbols.  No ids are produced.  Counts of pre-tokens and of space-delimited chunks are
remembered in each Python worker within a fixed bound.
"""

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.llm.common import worker_state

MEMO_ENTRIES = 1_500_000  # remembered counts of a worker (about 200 MB), and the longest text remembered
MEMO_CHARS = 64
BLOCK_CHARS = 1 << 20  # characters of a text whose chunks are held at once
NONE = np.iinfo(np.int64).max  # the rank of a pair that never merges


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """Merge rules of a byte-level BPE definition as sorted arrays."""

    def __init__(self, pairs: list[tuple[int, int]], products: list[int], byte_symbols: list[int]):
        left, right = np.array(pairs, np.int64).reshape(-1, 2).T
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.products = np.array(products, np.int64)
        self.byte_symbols = np.array(byte_symbols, np.int64)
        # merging this rank can make a pair of a lower rank, so its occurrences go one by one
        lowest = np.full(max(self.products.max(initial=0), keys.max(initial=0) >> 32, right.max(initial=0)) + 1, NONE)
        np.minimum.at(lowest, left, np.arange(len(keys)))
        np.minimum.at(lowest, right, np.arange(len(keys)))
        self.one_by_one = lowest[self.products] <= np.arange(len(keys))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE)
        keys = left << 32 | right
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.ranks[place], NONE)

    def surviving(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each byte sequence when no pair merges any more."""
        if not sequences:
            return np.zeros(0, np.int64)
        counts = np.fromiter(map(len, sequences), np.int64, len(sequences))
        names = np.flatnonzero(counts > 1)
        lengths = counts[names]
        if not len(names):
            return counts
        flat = np.frombuffer(b"".join([sequences[i] for i in names.tolist()]), np.uint8)
        symbols = self.byte_symbols[flat]
        ends = np.cumsum(lengths)
        ranks = np.append(self.rank(symbols[:-1], symbols[1:]), NONE)
        ranks[ends - 1] = NONE
        while True:
            best = np.minimum.reduceat(ranks, ends - lengths)
            done = best == NONE
            if done.any():
                counts[names[done]] = lengths[done]
                keep = np.repeat(~done, lengths)
                symbols, ranks = symbols[keep], ranks[keep]
                names, lengths, best = names[~done], lengths[~done], best[~done]
                ends = np.cumsum(lengths)
                if not len(names):
                    return counts
            owner = np.repeat(np.arange(len(names)), lengths)
            hits = self._apart(np.flatnonzero(ranks == best[owner]), best, owner)
            symbols[hits] = self.products[ranks[hits]]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            merged = hits - np.arange(len(hits))  # places after the right halves are gone
            lengths = lengths - np.bincount(owner[hits], minlength=len(names))
            symbols, ranks = symbols[keep], ranks[keep]
            ends = np.cumsum(lengths)
            last = np.zeros(len(symbols), bool)
            last[ends - 1] = True
            touched = np.zeros(len(symbols), bool)
            touched[merged] = touched[np.maximum(merged - 1, 0)] = True
            ranks[touched] = NONE
            inner = np.flatnonzero(touched & ~last)
            ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])

    def _apart(self, hits: np.ndarray, best: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Occurrences that do not overlap, from the left; the first alone where order matters."""
        opens = np.ones(len(hits), bool)
        opens[1:] = np.diff(hits) > 1
        place = np.arange(len(hits))
        hits = hits[(place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0]
        sequence = owner[hits]
        first = np.ones(len(hits), bool)
        first[1:] = np.diff(sequence) > 0
        return hits[first | ~self.one_by_one[best[sequence]]]


class Counter:
    """Token counts of texts, as the tokenizer library's ``encode`` gives them without added tokens."""

    def __init__(self, definition: str):
        import regex
        from public_tokenizers import PATTERN

        spec = json.loads(definition)
        model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space"):
            raise ValueError("token counts need a byte-level BPE definition without prefix space")
        if spec.get("normalizer") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("token counts need a definition without normalizer and with plain added tokens")
        vocabulary, byte_of = model["vocab"], printable_bytes()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        symbols = {byte: vocabulary[character] for character, byte in byte_of.items()}
        self.merges = Merges(
            [(vocabulary[a], vocabulary[b]) for a, b in pairs],
            [vocabulary[a + b] for a, b in pairs],
            [symbols[b] for b in range(256)],
        )
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.matches = regex.compile(PATTERN).findall
        self.safe_cut = regex.compile(r"(?<=\S) (?=\S)")
        self.chunks: dict[str, int] = {}  # of text after a space, the space not written
        self.parts: dict[str, int] = {}  # of pre-tokens other than a space and letters

    def blocks(self, text: str) -> Iterator[str]:
        """The text between added tokens, cut where no pre-token can cross; the space at a cut opens the next block."""
        for section in self.special.split(text) if self.special else [text]:
            start = 0
            while len(section) - start > BLOCK_CHARS:
                cut = self.safe_cut.search(section, start + BLOCK_CHARS)
                if cut is None:
                    break
                yield section[start : cut.start()]
                start = cut.start()
            yield section[start:]

    def count(self, texts: list[str]) -> list[int]:
        totals = []
        for text in texts:
            added = sum(1 for _ in self.special.finditer(text)) if self.special else 0
            totals.append(added + sum(map(self._block, self.blocks(text))))
        return totals

    def prepare(self, texts: list[str]) -> None:
        """Count the chunks of several short texts that are not remembered yet, in one go."""
        if len(self.chunks) + len(self.parts) > MEMO_ENTRIES:
            self.chunks.clear()
            self.parts.clear()
        wanted: set[str] = set()
        heads = []
        for text in texts:
            head, *rest = text.split(" ")
            heads += self.matches(head)
            wanted.update(rest)
        self._learn(wanted.difference(self.chunks), set(heads))

    def _learn(self, chunks: set[str], parts: set[str] = frozenset()) -> None:
        """Remember the counts of chunks that may be cut off, and of ``parts``; leave out other chunks."""
        chunks = [c for c in chunks if c and len(c) <= MEMO_CHARS and not c[0].isspace() and not c[-1].isspace()]
        split = {c: self.matches(" " + c) for c in chunks if not c.isalpha()}
        counts = self._count_parts(
            {p for found in split.values() for p in found}.union(parts, [" " + c for c in chunks if c.isalpha()])
        )
        for chunk, found in split.items():
            self.chunks[chunk] = sum(map(counts.__getitem__, found))

    def _remembered(self, part: str) -> int | None:
        return self.chunks.get(part[1:]) if part[0] == " " and part[1:].isalpha() else self.parts.get(part)

    def _count_parts(self, parts: set[str]) -> dict[str, int]:
        counts = {p: self._remembered(p) for p in parts}
        new = [p for p, n in counts.items() if n is None]
        for part, n in zip(new, self.merges.surviving([p.encode() for p in new]).tolist()):
            counts[part] = n
            if len(part) <= MEMO_CHARS:
                if part[0] == " " and part[1:].isalpha():
                    self.chunks[part[1:]] = n
                else:
                    self.parts[part] = n
        return counts

    def _block(self, block: str) -> int:
        first, *rest = block.split(" ")
        try:
            total = sum(map(self.chunks.__getitem__, rest))
        except KeyError:
            self._learn(set(rest).difference(self.chunks))
            if any(c not in self.chunks for c in rest):  # other white space, or a very long chunk
                return self._sum(self.matches(block))
            total = sum(map(self.chunks.__getitem__, rest))
        return total + self._sum(self.matches(first))

    def _sum(self, parts: list[str]) -> int:
        return sum(map(self._count_parts(set(parts)).__getitem__, parts))


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens`` of every row of ``docs``.

    ``tokenizer`` is the path of a byte-level BPE definition (driver only; its text of 1 to 2 MB
    is broadcast).  Added tokens that occur in a text count as one each, nothing is cut or padded.
    A null or empty text has 0 bytes and 0 tokens, a null id stays null, repeated rows are
    counted again and other columns are ignored whatever their names.
    """
    with open(tokenizer, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)])
    out = out.add("n_bytes", T.LongType()).add("n_tokens", T.LongType())

    def count(batches):
        counter = worker_state(("token counter", tokenizer), lambda: Counter(definition.value))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counter.prepare([t for t in texts if len(t) <= BLOCK_CHARS])
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(counter.count(texts), pa.int64())], names=[id_col, "n_bytes", "n_tokens"]
            )

    return rows.mapInArrow(count, out)
