"""Token counts of whole texts (operator 10)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import TokenCounter
from tidemark.llm.shared import ship, table

_COUNTERS: dict[str, object] = {}


class _LibraryCounter:
    """Vocabularies of other kinds, counted by their own library."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)] if texts else []
        else:
            from tokenizers import Tokenizer

            coder = Tokenizer.from_file(path)
            coder.no_truncation()
            coder.no_padding()
            self.count = lambda texts: [len(coder.encode(x, add_special_tokens=False)) for x in texts]


def counter(path: str):
    """This worker's counter of the vocabulary at ``path``."""
    if path not in _COUNTERS:
        try:
            if path.endswith(".model"):
                raise ValueError(path)
            _COUNTERS[path] = TokenCounter(path)
        except ValueError:
            _COUNTERS[path] = _LibraryCounter(path)
    return _COUNTERS[path]


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of ``df``: the id, ``n_bytes``, ``n_tokens`` and ``over_limit``; a pure projection, no shuffle.

    ``path`` is the vocabulary file, at the same place on every executor. A byte-level BPE ``.json`` is counted by
    rank-synchronous merging; other files by their library. Null and empty texts have 0 bytes and 0 tokens; null ids and
    repeated rows stay as they are; further columns are ignored.
    """
    ship(df.sparkSession)

    @F.arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        return pa.array(counter(path).count(texts.to_pylist()), pa.int64())

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.select(F.col(id_col).alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by byte_bpe_50k, over the limit from 513; null and empty texts have none."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
