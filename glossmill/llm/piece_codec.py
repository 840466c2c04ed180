"""Operator 9, SentencePiece encoding and decoding through a distinct-chunk table.

Where no piece crosses a whitespace marker (checked when the model is loaded), each distinct marked word is segmented, and
decoded again, once per worker table; a text's ids are the ids of its words in order. The table is per worker and bounded,
so nothing is shuffled: a table of all distinct words of a corpus would itself grow with the corpus and would have to be
joined to every word of it.

Defined results: null and empty texts give the begin and end ids and an empty decoded text; texts of any length are encoded
whole; repeated rows repeat; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_table import PieceTable, groups, table
from .common import tidy


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per document: id, ids array<int> (with begin and end), decoded string. With keep_ids=False: n_tokens and digests."""
    kind = docs.schema[id_col].dataType.simpleString()
    if keep_ids:
        out, schema = ("ids", "decoded"), f"{id_col} {kind}, ids array<int>, decoded string"
    else:
        out, schema = ("n_tokens", "ids_sha256", "decoded_sha256"), f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        import numpy as np

        codec = table(PieceTable, path or model_path())
        for batch in batches:
            rows = []
            for _, run_of in groups(batch.column(1).to_pylist()):
                for ids, text in codec.encode(run_of):
                    if keep_ids:
                        rows.append((np.frombuffer(ids, "<u4").astype(np.int32), text))
                    else:
                        rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in out]
            kinds = (pa.list_(pa.int32()), pa.string()) if keep_ids else (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[id_col, *out])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run, keeps=True), schema)
