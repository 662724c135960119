"""Token counts of texts by a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from importlib import util
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lectern.scale import all_cores

#: Default vocabulary; the path is a parameter of every operator, and the file stays where it is.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenizer pattern of that vocabulary, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest text given to the encoder at once; longer ones are cut before a space, which this pattern never crosses.
PIECE_CHARS = 1 << 20

_LOADED: dict = {}
_SHIPPED: set = set()


def vocabulary_path(path: str | None = None) -> str:
    """The given path, else the default one, else that of the installed package of public tokenizers."""
    if path:
        return path
    if not Path(VOCABULARY).exists() and (spec := util.find_spec("public_tokenizers")) and spec.origin:
        return str(Path(spec.origin).parent / Path(VOCABULARY).name)
    return VOCABULARY


def shipped(spark: SparkSession, path: str) -> None:
    """Hand the rank file to the executors of a cluster, once a session, so that they need no copy of their own."""
    sc = spark.sparkContext
    if (sc.applicationId, path) in _SHIPPED or sc.master == "local" or sc.master.startswith("local[") or not Path(path).exists():
        return
    sc.addFile(path)
    _SHIPPED.add((sc.applicationId, path))


def encoder(path: str):
    """The tokenizer of a rank file, loaded once a process: from the path, or where there is none from what was shipped."""
    if path not in _LOADED:
        import tiktoken
        from pyspark import SparkFiles

        with open(path if Path(path).exists() else SparkFiles.get(Path(path).name), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[path] = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(text: str | None, encode) -> int:
    """Tokens of a whole text; null and empty texts have none."""
    if not text:
        return 0
    if len(text) <= PIECE_CHARS:
        return len(encode(text))
    n = at = 0
    while at < len(text):
        end = min(at + PIECE_CHARS, len(text))
        while end < len(text) and not (text[end] == " " and text[end - 1].isalnum() and text[end + 1 : end + 2].isalpha()):
            end += 1
        n += len(encode(text[at:end]))
        at = end
    return n


def with_tokens(rows: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``rows`` with ``text`` replaced by ``n_tokens`` (int)."""
    path = vocabulary_path(vocabulary)
    shipped(rows.sparkSession, path)
    kept = [c for c in rows.columns if c != text]
    schema = ", ".join([f"`{c}` {dict(rows.dtypes)[c]}" for c in kept] + ["n_tokens int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            counts = pa.array([count_tokens(t.as_py(), encode) for t in b[text]], pa.int32())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), counts], names=[*kept, "n_tokens"])

    return all_cores(rows).mapInArrow(run, schema)
