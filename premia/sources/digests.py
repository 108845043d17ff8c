"""SHA-256 of large files: blocks read one after the other, the state handed from task to task."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark import RDD, SparkContext
from pyspark.sql import SparkSession

_RECORDS = "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat"
_RECORD_BYTES = 1 << 20
_LEAST_BLOCK = 1 << 16
_MOST_BLOCKS = 1 << 14
_STATE_BYTES = 256  # OpenSSL's SHA256_CTX takes 112


def _openssl() -> ctypes.CDLL | None:
    """OpenSSL as ``hashlib`` loaded it: its state of a digest is plain bytes, ``hashlib``'s cannot be taken along."""
    try:
        import _hashlib

        library = ctypes.CDLL(getattr(_hashlib, "__file__", None))
        library.SHA256_Init.argtypes = [ctypes.c_char_p]
        library.SHA256_Update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
        library.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_char_p]
    except (ImportError, OSError, AttributeError):
        return None
    return library


def _advance(state: bytes, at: int, pieces: Iterable[tuple[int, bytes]]) -> Iterator[tuple[bytes, int]]:
    """The state and the place in the file after ``pieces``, which must follow each other from ``at``."""
    library, context = _openssl(), ctypes.create_string_buffer(state, _STATE_BYTES)
    for place, piece in pieces:
        if place != at:
            raise ValueError(f"bytes from {place} follow those up to {at}")
        library.SHA256_Update(context, bytes(piece), len(piece))
        at += len(piece)
    yield context.raw, at


def escape_glob(path: str) -> str:
    """``path`` as a pattern that only ``path`` itself fits."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _records(sc: SparkContext, path: str, block: int, record: int) -> RDD:
    """(place, bytes) of the records of a file, a partition for each ``block`` bytes."""
    return sc.newAPIHadoopRDD(
        _RECORDS, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={
            "mapreduce.input.fileinputformat.inputdir": re.sub(r"([\\,])", r"\\\1", escape_glob(path)),
            "mapreduce.input.fileinputformat.split.minsize": str(block),
            "mapreduce.input.fileinputformat.split.maxsize": str(block),
            "fixedlengthinputformat.record.length": str(record)})


def _sha256(sc: SparkContext, path: str, length: int, block: int) -> str:
    """The SHA-256 of a file; one task at a time reads one block and hands on the state.

    Records of one length do not end where the file does, so the last partition is left to smaller
    blocks, and that of the smallest is read byte by byte.
    """
    library, context = _openssl(), ctypes.create_string_buffer(_STATE_BYTES)
    library.SHA256_Init(context)
    state, at, last = context.raw, 0, False
    least = min(max(_LEAST_BLOCK, length // _MOST_BLOCKS), block // 4)
    while not last:
        last = block // 4 < least
        records = _records(sc, path, block, 1 if last else min(block, _RECORD_BYTES))
        for i in range(at // block, records.getNumPartitions() - (not last)):
            before = state, at
            [(state, at)] = sc.runJob(records, lambda pieces: _advance(*before, pieces), [i])
        block //= 4
    if at != length:
        raise ValueError(f"{path} had {length} bytes and now has {at}")
    digest = ctypes.create_string_buffer(32)
    library.SHA256_Final(digest, ctypes.create_string_buffer(state, _STATE_BYTES))
    return digest.raw.hex()


def readable_in_blocks(spark: SparkSession, paths: list[str]) -> set[str]:
    """Those of ``paths`` that Hadoop reads in blocks: it unpacks files named ``.gz`` and the like and skips ``_…``."""
    if not paths or _openssl() is None:
        return set()
    hadoop = spark._jvm.org.apache.hadoop
    codecs = hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration())
    return {p for p in paths if not p.rsplit("/", 1)[-1].startswith("_") and codecs.getCodec(hadoop.fs.Path(p)) is None}


def sha256_in_blocks(spark: SparkSession, files: list[tuple[str, int]], block: int,
                     parallel: int) -> list[tuple[str, int, str]]:
    """path, length and SHA-256 of files given by path and length, ``parallel`` at a time."""
    sc = spark.sparkContext
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(lambda file: (*file, _sha256(sc, *file, block)), files))
