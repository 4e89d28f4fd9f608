"""Document fingerprints by one-permutation MinHash.

Every shingle is hashed once; its high bits choose a bin, and each bin keeps
its least hash.  Empty bins are filled by optimal densification: bin i takes
the value of bin h(i, 1), h(i, 2), ..., the first that isn't empty, the same
way for every document.  Only the low ``bits`` bits of each bin are stored,
packed, as hexadecimal digits; the share of equal bins then overstates
similarity by the chance that different values agree, which is taken out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import U64, Words, chunks, flat, mix, shingles

_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


@lru_cache(maxsize=4)
def _detour(bins: int, attempt: int) -> np.ndarray:
    """For each bin the bin that it asks at this attempt."""
    return (mix(np.arange(bins, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(attempt + 1)) % U64(bins)).astype(np.int64)


def minima(hashes: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """The least hash of each bin of each row after densification; a row without shingles stays empty."""
    rows = len(first) - 1
    out = np.full(rows * bins, _EMPTY, U64)
    row = np.repeat(np.arange(rows), np.diff(first))
    shift = U64(64 - (bins - 1).bit_length())
    np.minimum.at(out, row * bins + (hashes >> shift).astype(np.int64), hashes)
    out = out.reshape(rows, bins)
    full = out != _EMPTY
    todo = np.flatnonzero(~full.all(axis=1) & full.any(axis=1))
    result, attempt = out.copy(), 0
    while len(todo):
        to = _detour(bins, attempt)
        own = result[todo]
        own = np.where(own == _EMPTY, out[todo][:, to], own)
        result[todo] = own
        todo = todo[(own == _EMPTY).any(axis=1)]
        attempt += 1
    return result


def pack(values: np.ndarray, bits: int) -> list[bytes]:
    """The low bits of each row's bins, packed; a row without shingles is empty."""
    # the bin is mixed in, or two short texts, whose few values fill all bins, would agree everywhere by one chance
    low = (mix(values + mix(np.arange(values.shape[1], dtype=U64) + U64(1))[None, :]) & U64((1 << bits) - 1)).astype(np.uint8)
    planes = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :]
    packed = np.packbits(planes.reshape(len(values), -1), axis=1)
    none = (values == _EMPTY).all(axis=1)
    return [b"" if x else row.tobytes() for row, x in zip(packed, none.tolist(), strict=True)]


def fingerprints(texts: pa.Array, bins: int = 256, bits: int = 4, width: int = 5) -> list[bytes]:
    """Fingerprints of whole texts: A-Z lower-cased, words at ASCII white space, shingles of ``width`` words."""
    data, offsets = flat(texts)
    out: list[bytes] = []
    for i, j in chunks(offsets, 1 << 20):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        words = Words(part, at)
        hashes, first = shingles(words.hashes(part, lower=True), words.first, width)
        out += pack(minima(hashes, first, bins), bits)
    return out


def likeness(a: bytes, b: bytes, bits: int = 4) -> float:
    """Estimated Jaccard similarity, 0 to 1, of two fingerprints; 1 for two empty ones, 0 if one is empty."""
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    share = float((np.unpackbits(x).reshape(-1, bits) == 0).all(axis=1).mean())
    chance = 0.5**bits
    return max(0.0, (share - chance) / (1 - chance))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = 256, bits: int = 4, width: int = 5) -> DataFrame:
    """(doc_id, fingerprint) for every row, the fingerprint as hexadecimal digits.

    Null, empty and wordless texts have the empty fingerprint; equal texts have
    equal ones; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.hex() for x in fingerprints(batch.column(1), bins, bits, width)], pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, fingerprint string")


def _spread(spark: SparkSession, parts: int) -> list[int]:
    """A number for each of ``parts`` tasks that hash partitioning sends there."""
    tasks = spark.range(parts * 32).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("task"))
    found = {r["task"]: r["id"] for r in tasks.groupBy("task").agg(F.min("id").alias("id")).collect()}
    return [found.get(k, k) for k in range(parts)]


def splice_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = 256, bits: int = 4, width: int = 5, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of an edited one, and how alike they are.

    The edited text has its last floor(n/2) code points replaced by the first
    as many, or all, of the next document's, in descending order of id (after
    the last: the first).  Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt to ranges of ids, and each range also gets the first
    document of the range after it, so every task reads its rows once in order
    and holds one batch of them.  Null texts are empty; of rows with the same id
    the larger text comes first; a null id comes last of all; a document alone
    in its table is its own next one; an empty table gives no rows.  Ids are
    numbers.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.where("doc_id is not null").select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10000).alias("q")).first()["q"] if parts > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)  # as many numbers as there are ranges
    edges = F.array(*[F.lit(x).cast(kind) for x in cuts]) if cuts else F.array().cast(f"array<{kind}>")
    block = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(F.size(F.filter(edges, lambda x: F.col("doc_id") <= x)))
    dealt = rows.withColumn("block", block)
    heads = dealt.groupBy("block").agg(F.max("doc_id").alias("doc_id")).orderBy("block").collect()  # one id for each range
    first_of = [(h["block"], heads[k - 1]["block"], h["doc_id"]) for k, h in enumerate(heads)]
    spark = docs.sparkSession
    if not heads:
        return spark.createDataFrame([], f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    wanted = F.broadcast(spark.createDataFrame(first_of, f"block int, before int, doc_id {kind}"))
    extra = dealt.join(wanted.withColumnRenamed("block", "own").withColumnRenamed("doc_id", "head"), (F.col("block") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("head")))
    extra = extra.groupBy("before", "doc_id").agg(F.max("text").alias("text")).select("doc_id", "text", F.col("before").alias("block"), F.lit(1).alias("extra"))
    # a number for each range whose hash is that of a task of its own: ranges hold about as many documents each
    number = F.element_at(F.array(*[F.lit(x).cast("long") for x in _spread(spark, parts)]), F.col("block") % parts + 1).alias("task")
    together = dealt.withColumn("extra", F.lit(0)).unionByName(extra).select("*", number).repartition(max(1, parts), "task")
    together = together.sortWithinPartitions("block", "extra", F.col("doc_id").desc_nulls_last(), F.col("text").desc())

    def edit(texts: list[str], after: list[str]) -> list[str]:
        return [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, after, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that still waits for its next one
        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).to_pylist()
            i, size = 0, 0
            for j, n in enumerate(lengths):
                size += n
                if size < 1 << 22 and j + 1 < len(lengths):
                    continue
                part = batch.slice(i, j + 1 - i)
                i, size = j + 1, 0
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                extras = part.column(3).to_pylist()
                marks = [x.hex() for x in fingerprints(part.column(1), bins, bits, width)]
                if held:
                    ids, texts, extras, marks = [held[0], *ids], [held[1], *texts], [held[2], *extras], [held[3], *marks]
                held = ids[-1], texts[-1], extras[-1], marks[-1]
                own = [k for k in range(len(ids) - 1) if not extras[k]]  # an extra row is only its predecessor's next one
                if not own:
                    continue
                edited = edit([texts[k] for k in own], [texts[k + 1] for k in own])
                changed = [x.hex() for x in fingerprints(pa.array(edited, pa.large_string()), bins, bits, width)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[k] for k in own], part.column(0).type),
                        pa.array([len(texts[k]) for k in own], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                        pa.array([marks[k] for k in own]),
                        pa.array(changed, pa.string()),
                        pa.array([likeness(bytes.fromhex(marks[k]), bytes.fromhex(x), bits) for k, x in zip(own, changed, strict=True)]),
                        pa.array([likeness(bytes.fromhex(marks[k]), bytes.fromhex(marks[k + 1]), bits) for k in own]),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return together.select("doc_id", "text", "block", "extra").mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
