"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from volseg.storage import spread

#: Byte-level BPE for many languages; any path with one of the known endings will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[str], int]:
    """A function that counts the tokens of a text, for a vocabulary file of tiktoken, tokenizers or sentencepiece."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(processor.encode(text))


def token_counts(documents: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of every row's whole ``text``; a null text has 0 tokens."""
    rows = spread(documents.select(*keep, "text"))
    schema = documents.select(*keep).schema.add("n_tokens", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            n = [count(t.as_py()) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return rows.mapInArrow(run, schema)
