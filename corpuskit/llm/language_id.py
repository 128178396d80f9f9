"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword.  One binary n-gram classifier per bit tells the languages with
a one there from those with a zero; its weights are log odds of smoothed n-gram
frequencies, counted over all labelled training rows in one distributed pass.  Decoding
sums the logistic loss of every bit against each codeword, weighted by how well the bit is
predicted for that language, and picks the least; a small margin flags ambiguity.
"""

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import batch_of, binary_values, by_bytes, free_name, joined

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
UNKNOWN = "und"
CHUNK = 1 << 18  # bytes whose n-grams are looked up together
SHARE = 4096  # buckets that travel in one row of counts


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits, log odds
    trust: np.ndarray  # languages x bits, rows sum to 1


def codewords(count: int, dense_bits: int = 10, seed: int = 7) -> np.ndarray:
    """Distinct rows of -1 and 1: all splits for up to six languages, else the best of many dense random codes."""
    if count < 2:
        return np.ones((count, 1))
    if count <= 6:
        rest = [s for k in range(count - 1) for s in combinations(range(1, count), k)]
        return np.array([[1 if r == 0 or r in s else -1 for s in rest] for r in range(count)], float)
    rng, bits = np.random.default_rng(seed), int(np.ceil(dense_bits * np.log2(count)))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (count, bits))
        code = code[:, np.abs(code.sum(0)) < count]
        apart = min(int((a != b).sum()) for a, b in combinations(code, 2))
        if apart > far:
            best, far = code, apart
    return best


def _letters() -> np.ndarray:
    """Byte map: A-Z to lower case; digits, punctuation and white space to a space."""
    byte = np.arange(256, dtype=np.uint8)
    upper = (byte >= 65) & (byte <= 90)
    letter = upper | ((byte >= 97) & (byte <= 122)) | (byte >= 128)
    return np.where(upper, byte + 32, np.where(letter, byte, 32)).astype(np.uint8)


def ngram_buckets(values: list[bytes]):
    """Yield (document of each n-gram, bucket of each n-gram), chunk by chunk, n-grams inside texts only.

    Every text is framed by spaces, so short texts have n-grams too.
    """
    table, gap = _letters(), max(ORDERS)
    framed = [b" " + v + b" " for v in values]
    # long texts are cut; the cut pieces overlap by what n-grams reach over
    pieces = [(d, at) for d, v in enumerate(framed) for at in range(0, len(v), CHUNK)]
    for a, b in by_bytes([min(CHUNK, len(framed[d]) - at) for d, at in pieces], CHUNK):
        some = pieces[a:b]
        data, starts, lengths = joined([framed[d][at : at + CHUNK + gap - 1] for d, at in some], gap)
        data = table[data].astype(np.uint64)
        counted = np.array([min(CHUNK, len(framed[d]) - at) for d, at in some])
        docs = np.repeat([d for d, _ in some], counted)
        inside = np.arange(int(counted.sum())) - np.repeat(np.cumsum(counted) - counted, counted)
        places = np.repeat(starts, counted) + inside
        left = np.repeat(lengths, counted) - inside  # bytes from the place to the end of its text
        key = np.zeros(len(places), np.uint64)
        for order in range(1, max(ORDERS) + 1):
            key = (key << np.uint64(8)) | data[places + order - 1]
            if order in ORDERS:
                hashed = (key + np.uint64(order << 40)) * np.uint64(0x9E3779B97F4A7C15)
                buckets = (hashed >> np.uint64(48)).astype(np.int64) % BUCKETS
                whole = left >= order
                yield (docs, buckets) if whole.all() else (docs[whole], buckets[whole])


def has_letter(value: bytes) -> bool:
    if any(65 <= c <= 90 or 97 <= c <= 122 for c in value[:64]):
        return True
    return any(c.isalpha() for c in value.decode("utf-8", "replace"))


def _counts(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """n-gram counts, languages x buckets, over all rows of (text, lang)."""
    place = {name: i for i, name in enumerate(languages)}
    schema = pa.schema([("language", pa.int32()), ("share", pa.int32()), ("n", pa.list_(pa.int64()))])

    def count(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            at = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for docs, buckets in ngram_buckets(binary_values(batch.column(0))):
                flat = np.bincount(at[docs] * BUCKETS + buckets, minlength=total.size)
                total += flat.reshape(total.shape)
        shares = total.reshape(-1, SHARE)
        per = BUCKETS // SHARE
        keys = np.arange(len(shares))
        yield batch_of(schema, [keys // per, keys % per, list(shares)])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([x.as_py() for x in table.column("n")], axis=0)
        return pa.Table.from_arrays(
            [table.column("language").slice(0, 1), table.column("share").slice(0, 1), pa.array([total], pa.list_(pa.int64()))],
            schema=schema,
        )

    kind = "language int, share int, n array<long>"
    # first within groups of partitions, so that no task reads a share of all of them
    parts = rows.mapInArrow(count, kind).withColumn("part", F.spark_partition_id() % 64)
    near = parts.groupBy("language", "share", "part").applyInArrow(lambda t: add(t.drop_columns("part")), kind)
    summed = near.groupBy("language", "share").applyInArrow(add, kind)
    total = np.zeros((len(languages), BUCKETS), np.int64)
    for language, share, n in summed.collect():  # languages x 16 rows
        total[language, share * SHARE : (share + 1) * SHARE] = n
    return total


def bit_scores(values: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Documents x bits: mean log odds of the n-grams, sharpened by the root of their number."""
    total = np.zeros((len(values), weights.shape[1]))
    number = np.zeros(len(values))
    for docs, buckets in ngram_buckets(values):
        if not len(docs):
            continue
        heads = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        total[docs[heads]] += np.add.reduceat(weights[buckets], heads, axis=0, dtype=np.float64)
        number[docs[heads]] += np.diff(np.append(heads, len(docs)))
    return total / np.sqrt(np.maximum(number, 1))[:, None]


def _losses(scores: np.ndarray, model: Model) -> np.ndarray:
    """Documents x languages: weighted logistic loss of every bit against the codeword."""
    agreement = scores[:, None, :] * model.code[None, :, :]
    return (np.logaddexp(0, -agreement) * model.trust[None, :, :]).sum(2)


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", trust_rows: int = 4000) -> Model | None:
    """Train on all rows with a language and a text; ``None`` if there are none.

    Counts cover every row.  Only the decoding weights, one number per language and bit, are
    estimated on a sample of about ``trust_rows`` rows.
    """
    rows = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    code = codewords(len(languages))
    counts = _counts(rows, languages)
    share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
    sides = [(share[code[:, j] > 0], share[code[:, j] < 0]) for j in range(code.shape[1])]
    weights = [np.log(one.mean(0)) - np.log(zero.mean(0)) if len(zero) else np.ones(BUCKETS) for one, zero in sides]
    model = Model(languages, code, np.array(weights, np.float32).T.copy(), np.full(code.shape, 1 / code.shape[1]))

    place = {name: i for i, name in enumerate(languages)}
    cut = int(min(1.0, trust_rows / sum(sizes.values())) * (2**31 - 1))
    schema = pa.schema([("cell", pa.int32()), ("good", pa.int64()), ("n", pa.int64())])

    def judge(batches):
        good, seen = np.zeros(code.shape), np.zeros(len(languages))
        for batch in batches:
            at = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            right = bit_scores(binary_values(batch.column(0)), model.weights) * code[at] > 0
            np.add.at(good, at, right)
            np.add.at(seen, at, 1)
        yield batch_of(schema, [np.arange(good.size), good.ravel().astype(int), np.repeat(seen, code.shape[1]).astype(int)])

    sample = rows.where(F.crc32(F.col("text").cast("binary")) % (2**31 - 1) <= cut)
    judged = sample.mapInArrow(judge, "cell int, good long, n long").groupBy("cell").agg(F.sum("good"), F.sum("n"))
    trust = np.ones(code.size)
    for cell, good, n in judged.collect():
        trust[cell] = (good + 1) / (n + 2)
    trust = trust.reshape(code.shape)
    return model._replace(trust=trust / trust.sum(1, keepdims=True))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.05) -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    The score is the share of the best codeword among all, from the decoded losses.  A row is flagged if the loss
    of the second nearest codeword is less than ``margin`` above that of the nearest, however many languages there are.  A text that is null or has no letter is ``und`` with
    score 0 and flagged, as is every row without a model; ties go to the first language in
    alphabetical order.  All rows and columns stay; columns named like the new ones are replaced.
    """
    new = ["lang_pred", "score", "ambiguous"]
    if model is None:
        return docs.drop(*new).select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    kind = "struct<lang_pred:string,score:double,ambiguous:boolean>"
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(model))  # plain values: workers may lack this package
    schema = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def decide(parts):
        model = Model(*shipped.value)
        for texts in parts:
            values = binary_values(texts)
            losses = _losses(bit_scores(values, model.weights), model)
            share = np.exp(losses.min(1, keepdims=True) - losses)
            share = share / share.sum(1, keepdims=True)
            ahead = np.diff(np.partition(losses, 1, 1)[:, :2], axis=1)[:, 0] if losses.shape[1] > 1 else np.full(len(losses), np.inf)
            out = []
            for value, loss, row, lead in zip(values, losses, share, ahead):
                best = int(loss.argmin())
                known = has_letter(value)
                score = float(row[best]) if known else 0.0
                out.append({"lang_pred": model.languages[best] if known else UNKNOWN, "score": score, "ambiguous": not known or bool(lead < margin)})
            yield pa.array(out, schema)

    from collections.abc import Iterator

    from pyspark.sql.functions import arrow_udf

    decide.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    docs = docs.drop(*new)
    name = free_name(docs, "language")
    decided = docs.withColumn(name, arrow_udf(decide, kind)(F.col(text_col).cast("string")))
    return decided.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{name}.{c}").alias(c) for c in new])
