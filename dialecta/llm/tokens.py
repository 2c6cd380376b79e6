"""Token counts of texts by a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rank file: lines of base64 token and rank. The path is a parameter everywhere.
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text_col: str, *keep: str, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(rid, n_tokens, *keep): whole texts; null texts have no tokens. ``keep`` are string columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            n = [0 if t is None else len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *b.columns[2:]], ["rid", "n_tokens", *(f"k{i}" for i in range(len(keep)))])

    base = df.select(F.col(id_col).cast("long").alias("rid"), F.col(text_col).alias("txt"), *(F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keep)))
    out = base.where("rid is not null").mapInArrow(run, "rid long, n_tokens long" + "".join(f", k{i} string" for i in range(len(keep))))
    return out.select("rid", "n_tokens", *(F.col(f"k{i}").alias(k) for i, k in enumerate(keep)))
