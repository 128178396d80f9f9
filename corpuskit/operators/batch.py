"""Batch translation as data work around a caller-supplied function."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuskit.functions.text import sanitize_translation, strip, strip_code_fences
from corpuskit.operators.ordering import free_name, with_position
from corpuskit.operators.setops import missing_ids
from corpuskit.session import freeze
from corpuskit.sources.tables import read_or_empty

# --- Fixed values: batch limits and response pattern --------------------------
DEFAULT_BATCH_SIZE = 20
MAX_BATCH_SIZE = 50
SLICE = 16  # requests of an Arrow batch that are Python strings at a time
FALLBACK = (
    r"""\bid\b\s*[:=]\s*["']?([a-zA-Z0-9_-]+)["']?.*?\btranslated\b\s*[:=]\s*["']?(.+?)["']?"""
    r"""(?=\s*[,}\]]|$)"""
)
# ------------------------------------------------------------------------------

ITEM_SCHEMA = "struct<id:string,translated:string>"


def assign_batches(
    df: DataFrame,
    order_by: list[str],
    batch_size: int = DEFAULT_BATCH_SIZE,
    max_batches: int | None = None,
    row_id: str = "id",
) -> DataFrame:
    """Number rows in order and cut them into batches of ``batch_size`` (``batch_id`` from 0).

    Only ids and sort keys are sorted and frozen; the numbers then join the rows by ``row_id``, which must
    be unique, so texts are neither sorted nor written.  Ties of ``order_by`` go by id.  ``max_batches`` keeps
    the first batches.
    """
    if not 0 < batch_size <= MAX_BATCH_SIZE:
        raise ValueError(f"batch_size must be between 1 and {MAX_BATCH_SIZE}: larger responses get cut off")
    order = list(dict.fromkeys([*order_by, row_id]))
    numbered = with_position(df.select(*order), order, "position")
    if max_batches is not None:
        numbered = numbered.where(F.col("position") < batch_size * max_batches)
    own = free_name(df, "own")
    numbers = numbered.select(
        F.col(row_id).alias(own),
        F.col("position").cast("long").alias("position"),
        F.floor(F.col("position") / batch_size).cast("long").alias("batch_id"),
    )
    kept = df.drop("position", "batch_id")
    return kept.join(numbers, kept[row_id].eqNullSafe(F.col(own))).drop(own)


def format_requests(
    batched: DataFrame, prompt: str, row_id: str = "id", text: str = "comment_text"
) -> DataFrame:
    """One request text per batch, ``prompt`` first; a batch holds at most ``MAX_BATCH_SIZE`` rows."""
    line = F.concat(
        F.lit("id: "), F.col(row_id).cast("string"), F.lit(", text: '"), F.coalesce(text, F.lit("nan")), F.lit("'")
    )
    lines = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return batched.groupBy("batch_id").agg(
        F.count("*").alias("n_rows"),
        F.concat(F.lit(prompt), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("request"),
    )


def apply_batches(requests: DataFrame, fn: Callable[[str], str], parallelism: int | None = None) -> DataFrame:
    """Call ``fn(request) -> response`` per batch; a failing batch gets an ``error`` and no response.

    ``parallelism`` limits how many calls run at once, as it sets the number of tasks.  An Arrow batch may hold 64 MB
    of requests; its responses are handed back slice by slice.
    """
    fields = requests.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(start, SLICE) for batch in batches for start in range(0, batch.num_rows, SLICE)):
            responses, errors = [], []
            for request in part.column("request"):
                try:
                    responses.append(fn(request.as_py()))
                    errors.append(None)
                except Exception as problem:  # one bad batch must not fail the job
                    responses.append(None)
                    errors.append(f"{type(problem).__name__}: {problem}")
            added = [pa.array(responses, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, "response", "error"])

    if parallelism:
        requests = requests.repartition(parallelism, "batch_id")
    return requests.mapInArrow(run, f"{fields},response:string,error:string")


RESPONSES = "digest string, response string, error string, called timestamp"


def apply_resumable(
    requests: DataFrame, fn: Callable[[str], str], log: str, parallelism: int | None = None, batches_per_task: int = 16
) -> DataFrame:
    """:func:`apply_batches` with a memory: the Parquet table ``log`` gets every answer, by digest of the request.

    A request with an answer in the log is not sent again, whoever sent it: a repeated job calls
    for what is missing and for what failed with an error.  A task holds ``batches_per_task`` requests and its
    answers are in the log as soon as it ends, also if the job fails later, so a lost executor costs at most
    the calls of the tasks it was running.  With ``parallelism`` the requests go out in waves of that many tasks.
    Equal requests are sent once.  The log is only ever appended to; of several answers the
    latest one without an error counts.
    """
    spark = requests.sparkSession
    keyed = freeze(requests.withColumn("digest", F.sha2("request", 256)))
    known = read_or_empty(spark, log, StructType.fromDDL(RESPONSES)).where("error IS NULL").select("digest")
    pending = keyed.select("digest", "request").dropDuplicates(["digest"]).join(known, "digest", "left_anti")
    tasks = -(-pending.count() // batches_per_task)
    waves = -(-tasks // parallelism) if parallelism else min(tasks, 1)
    if waves > 1:
        pending = freeze(pending)  # every wave reads it
    wave = F.pmod(F.xxhash64("digest"), F.lit(max(waves, 1)))
    for number in range(waves):
        some = pending.where(wave == number).repartition(parallelism or tasks, "digest")
        called = apply_batches(some, fn).select("digest", "response", "error", F.current_timestamp().alias("called"))
        # this committer moves the files of a task into the table when the task ends
        called.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(log)
    answers = read_or_empty(spark, log, StructType.fromDDL(RESPONSES))
    latest = F.struct(F.col("error").isNull(), "called")
    answers = answers.groupBy("digest").agg(
        F.max_by(F.struct("response", "error"), latest).alias("answer"),
    )
    return keyed.join(answers, "digest", "left").select(*requests.columns, "answer.response", "answer.error")


def _parsed(bare: Column) -> Column:
    """The response as an array, null unless it is a well-formed JSON list.

    Every element is read by itself, so one that is no object costs no other element.
    """
    is_list = bare.startswith("[") & bare.endswith("]")
    elements = F.from_json(bare, "array<string>")
    return F.when(is_list, F.transform(elements, lambda x: F.from_json(x, ITEM_SCHEMA)))


def _tidy(rows: DataFrame, keep: list[str]) -> DataFrame:
    usable = rows.where(F.col("item.id").isNotNull() & F.col("item.translated").isNotNull())
    return usable.select(
        *keep, strip(F.col("item.id")).alias("id"), sanitize_translation(F.col("item.translated")).alias("translated")
    )


def parse_responses(responses: DataFrame, keep: list[str] = ["batch_id"]) -> DataFrame:
    """(batch, id, translated) rows; malformed JSON falls back to a pattern search."""
    bare = responses.where(F.col("response").isNotNull()).select(
        *keep, strip_code_fences(F.col("response")).alias("bare")
    )
    pattern = F.lit("(?isdU)" + FALLBACK)
    ids = F.regexp_extract_all("bare", pattern, F.lit(1))
    texts = F.regexp_extract_all("bare", pattern, F.lit(2))
    searched = F.transform(
        F.arrays_zip(ids.alias("id"), texts.alias("translated")),
        lambda x: F.struct(x["id"].alias("id"), strip(x["translated"]).alias("translated")),
    )
    parsed = bare.select(*keep, "bare", _parsed(F.col("bare")).alias("parsed"))
    items = F.when(F.col("parsed").isNotNull(), F.col("parsed")).otherwise(searched)
    return _tidy(parsed.select(*keep, F.explode(items).alias("item")), keep)


def translation_report(batched: DataFrame, translated: DataFrame, row_id: str = "id") -> DataFrame:
    """Per batch: rows asked for, rows parsed, ids missing and whether nothing was parsed."""
    requested = batched.select("batch_id", F.col(row_id).cast("string").alias("id"))
    asked = requested.groupBy("batch_id").agg(F.count("*").alias("requested"))
    parsed = translated.groupBy("batch_id").agg(F.count("*").alias("parsed"))
    lost = missing_ids(requested, translated).groupBy("batch_id").agg(F.count("*").alias("missing"))
    report = asked.join(parsed, "batch_id", "left").join(lost, "batch_id", "left")
    report = report.na.fill(0, ["parsed", "missing"])
    return report.withColumn("none_parsed", F.when(F.col("parsed") == 0, 1).otherwise(0))
