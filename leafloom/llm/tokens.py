"""Token counts of whole texts by a public tokenizer, whose folder is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that cuts a text into pieces before the merges of this vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(folder: str, file: str):
    """The tokenizer, loaded once in each Python worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(folder, file).read_bytes().splitlines())}
    return tiktoken.Encoding(file, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def counter(folder: str = TOKENIZERS, file: str = VOCABULARY) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(folder, file).encode_ordinary
        for b in batches:
            n = pa.array([len(encode(t)) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.record_batch([*b.columns[:-1], n], names=[*b.schema.names[:-1], "n_tokens"])

    return count


def token_counts(texts: DataFrame, keep: list[str], text: str = "text", folder: str = TOKENIZERS, file: str = VOCABULARY) -> DataFrame:
    """``keep`` and n_tokens of each row; a null text has none."""
    rows = texts.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(counter(folder, file), f"{fields}, n_tokens bigint")
