"""Token counts of texts by a public tokenizer whose file is a parameter."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.session import ship, spread

VOCABULARY = os.environ.get("LAMINA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
_LOADED: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in a worker; special tokens in a text are ordinary text."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _LOADED[path] = t
    return _LOADED[path]


def count_tokens(df: DataFrame, text: str, path: str = VOCABULARY, into: str = "tokens", content: str = "content") -> DataFrame:
    """The rows without their text, with its number of tokens and a 64-bit hash of its content. A null text has 0 tokens and a null hash."""
    ship(df.sparkSession)
    rest = [c for c in df.columns if c != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema), f"`{into}` int", f"`{content}` long"])

    def run(batches):
        import xxhash

        t = tokenizer(path)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            sizes, marks = [], []
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                sizes += [len(e.ids) for e in t.encode_batch([x or "" for x in part], add_special_tokens=False)]
                marks += [None if x is None else xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in part]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(sizes, pa.int32()), pa.array(marks, pa.int64())], names=[*rest, into, content])

    return spread(df).mapInArrow(run, schema)
