"""URL rules looked up in a sorted array of 64-bit digests.

A rule is a host and the start of a path.  Its key, the xxhash of ``host + path``, stands in a
sorted array that workers map into memory; a page's candidate keys (every parent
host with every path start of a length that rules have) are found by vectorised
binary search, and a hit counts only if the stored strings are equal, so
digest collisions change nothing.

Spark builds the array in key order, in shards.  While it is within ``index_limit`` bytes it is
sent to every executor once; a larger one stays sharded by key, and the
candidates, made distinct first, are brought to their shards.
"""

import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.llm.common import batch_of, worker_state

SHARDS = "shard int, data binary"
_SHARD = pa.schema([("shard", pa.int32()), ("data", pa.binary())])
SALT = 16  # tasks that share one shard of a sharded index


def split_url(column: str):
    """Host (A-Z in lower case) and path of a URL as columns; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"(?s)://(.*)", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def digest(texts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))


class DigestIndex:
    """Sorted keys, and per key the end of its rule in one byte string: host, NUL, path, NUL, verdict."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray, strings):
        self.keys, self.ends, self.strings = keys, ends, strings

    @staticmethod
    def dump(rules: list[tuple[bytes, bytes, bytes]]) -> bytes:
        keys = digest([h + p for h, p, _ in rules])
        order = np.argsort(keys, kind="stable")
        entries = [b"\0".join(rules[i]) for i in order]
        ends = np.cumsum([len(e) for e in entries], dtype="<u8")
        return np.array([len(rules)], "<u8").tobytes() + keys[order].astype("<u8").tobytes() + ends.tobytes() + b"".join(entries)

    @classmethod
    def load(cls, data) -> "DigestIndex":
        """From bytes or a memory-mapped byte array; nothing is copied."""
        data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
        n = int(data[:8].view("<u8")[0])
        return cls(data[8 : 8 + 8 * n].view("<u8"), data[8 + 8 * n : 8 + 16 * n].view("<u8"), data[8 + 16 * n :])

    @classmethod
    def mapped(cls, data: bytes) -> "DigestIndex":
        """Write the index to a nameless file of this worker and map it into memory."""
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            return cls.load(np.memmap(file, np.uint8, "r"))

    def entry(self, i: int) -> list[bytes]:
        start = int(self.ends[i - 1]) if i else 0
        return self.strings[start : int(self.ends[i])].tobytes().split(b"\0")

    def find(self, hosts: list[bytes], paths: list[bytes]) -> list[bytes | None]:
        """Verdict of the rule (host, path) for each pair, or ``None``."""
        if not hosts:
            return []
        wanted = digest([h + p for h, p in zip(hosts, paths)])
        place = np.searchsorted(self.keys, wanted)
        near = np.minimum(place, max(len(self.keys) - 1, 0))
        hit = np.flatnonzero(self.keys[near] == wanted) if len(self.keys) else []
        found: list[bytes | None] = [None] * len(hosts)
        for i in hit:
            at = int(place[i])
            while at < len(self.keys) and self.keys[at] == wanted[i]:
                host, path, verdict = self.entry(at)
                if host == hosts[i] and path == paths[i]:
                    found[i] = verdict
                    break
                at += 1
        return found


def build_index(rules: DataFrame, shards: int) -> DataFrame:
    """(shard, data): the sorted digest array of ``rules`` (host, path, verdict), by leading key bits.

    Null hosts or paths are empty.  Of rules with equal host and path, a block wins.
    """
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("host", "path")]
    one = rules.select(*text, "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    schema = _SHARD

    def place(batches):
        for batch in batches:
            rows = [[v.encode() for v in c.to_pylist()] for c in batch.columns]
            shard = (digest([h + p for h, p in zip(*rows[:2])]) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
            yield batch_of(pa.schema([("shard", pa.int32()), *[(c, pa.binary()) for c in ("host", "path", "verdict")]]), [shard.astype(np.int32), *rows])

    def build(table: pa.Table) -> pa.Table:
        data = DigestIndex.dump(list(zip(*[c.to_pylist() for c in table.columns[1:]])))
        return pa.Table.from_arrays([table.column(0).slice(0, 1), pa.array([data], pa.binary())], schema=schema)

    placed = one.mapInArrow(place, "shard int, host binary, path binary, verdict binary")
    return placed.groupBy("shard").applyInArrow(build, SHARDS)


def _candidates(host: str, path: str, lengths: list[int]):
    """Parent hosts (longest first) with path starts of the given lengths."""
    parts = host.split(".")
    starts = [path[:n] for n in lengths if n <= len(path)]
    return [(".".join(parts[i:]), s) for i in range(len(parts)) for s in starts]


def _best(candidates, verdicts):
    """The longest rule that fits: by host and path together, then by host."""
    fitting = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in zip(candidates, verdicts) if v is not None]
    return max(fitting)[2:] if fitting else (None, None)


def judge(
    pages: DataFrame,
    rules: DataFrame,
    url_col: str = "url",
    default: str = "allow",
    index_limit: int = 64 << 20,
    shard_bytes: int = 64 << 20,
) -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``).  A rule fits its host and
    every host below it, where the page's path starts with the rule's; the longest fitting rule
    gives the verdict, and no rule the ``default``.  A null URL or one without ``://`` has an empty host and
    path, which no rule with a host fits.  All rows and columns stay; columns named like the new ones are
    replaced.  The lengths of rule paths (a few thousand numbers at most) reach the driver, rules do not unless
    the whole index is within ``index_limit`` bytes.
    """
    new = ["host", "path", "rule", "verdict"]
    spark = pages.sparkSession
    host, path = split_url(url_col)
    # the page's own columns travel in one, so that no name of theirs can clash
    own = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in new])
    pages = pages.select(own.alias("row"), host.alias("at_host"), path.alias("at_path"))
    sizes = rules.select(F.char_length(F.coalesce("path", F.lit(""))).alias("n"), (F.octet_length(F.coalesce("host", F.lit(""))) + F.octet_length(F.coalesce("path", F.lit(""))) + 32).alias("bytes"))
    by_length = sizes.groupBy("n").agg(F.sum("bytes").alias("bytes")).collect()
    lengths, total = sorted(r["n"] for r in by_length), sum(r["bytes"] for r in by_length)
    kind = "struct<rule:string,verdict:string>"
    result = pa.struct([("rule", pa.string()), ("verdict", pa.string())])
    kept = ["row.*"]
    named = [F.col("at_host").alias("host"), F.col("at_path").alias("path")]

    if total <= index_limit:
        rows = build_index(rules, 1).collect()  # within index_limit by the sum above
        data = spark.sparkContext.broadcast(bytes(rows[0]["data"]) if rows else DigestIndex.dump([]))
        name = os.urandom(8).hex()

        def look_up(hosts: pa.Array, paths: pa.Array) -> pa.Array:
            index = worker_state(("url index", name), lambda: DigestIndex.mapped(data.value))
            options = [_candidates(h, p, lengths) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            flat = [(h.encode(), p.encode()) for o in options for h, p in o]
            verdicts = iter(index.find([h for h, _ in flat], [p for _, p in flat]))
            out = []
            for o in options:
                rule, verdict = _best(o, [next(verdicts) for _ in o])
                out.append({"rule": rule, "verdict": verdict.decode() if verdict else default})
            return pa.array(out, result)

        from pyspark.sql.functions import arrow_udf

        found = pages.withColumn("found", arrow_udf(look_up, kind)("at_host", "at_path"))
        return found.select(*kept, *named, F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"))

    shards = -(-total // shard_bytes)
    index = build_index(rules, shards)
    texts = pages.select("at_host", "at_path").distinct()

    def spread(batches):
        schema = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), *[(c, pa.string()) for c in ("at_host", "at_path", "h", "p")]])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = [
                    (h, p, *c)
                    for h, p in zip(*[c.to_pylist() for c in batch.slice(at, 500).columns])
                    for c in _candidates(h, p, lengths)
                ]
                keys = digest([(r[2] + r[3]).encode() for r in rows])
                shard = (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
                salt = digest([(r[0] + r[1]).encode() for r in rows]) % np.uint64(SALT)
                yield batch_of(schema, [shard.astype(np.int32), salt.astype(np.int32), *(list(zip(*rows)) or [[]] * 4)])

    def probe(wanted: pa.Table, stored: pa.Table) -> pa.Table:
        columns = [wanted.column(c).to_pylist() for c in ("at_host", "at_path", "h", "p")]
        found: list = [None] * wanted.num_rows
        for data in stored.column("data") if stored.num_rows else []:
            found = DigestIndex.mapped(data.as_py()).find([h.encode() for h in columns[2]], [p.encode() for p in columns[3]])
        rows = [(a, b, h, p, v.decode()) for a, b, h, p, v in zip(*columns, found) if v is not None]
        return pa.table([pa.array(c, pa.string()) for c in (list(zip(*rows)) or [[]] * 5)], names=["at_host", "at_path", "h", "p", "verdict"])

    salted = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"), "data")
    wanted = texts.mapInArrow(spread, "shard int, salt int, at_host string, at_path string, h string, p string")
    both = wanted.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt"))
    hits = both.applyInArrow(probe, "at_host string, at_path string, h string, p string, verdict string")
    order = F.struct(F.char_length("h") + F.char_length("p"), F.char_length("h"))
    best = hits.groupBy("at_host", "at_path").agg(F.max_by(F.struct(F.concat("h", "p").alias("rule"), "verdict"), order).alias("found"))
    found = pages.join(best, ["at_host", "at_path"], "left")
    verdict = F.coalesce("found.verdict", F.lit(default)).alias("verdict")
    return found.select(*kept, *named, F.col("found.rule").alias("rule"), verdict)


RULES = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "verdict")])
