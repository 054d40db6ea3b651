"""Token counts of whole texts; only lengths leave the Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetra.llm.tokens import encoder, parts

#: Production parameter: tokens beyond which a document is over the limit.
LIMIT = 512


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit, a row for each row of docs, for a byte-level BPE file of the tokenizers library.

    Arrow batches are worked through in runs of about equal bytes, and texts are split before a lone space, where a cut
    changes no token; only what has no such space stays in one. Null and empty texts have 0 tokens. Special strings
    inside texts count as the library counts them. A null doc_id stays null, equal rows get a row each, an empty table
    gives an empty one, and other columns, whatever their names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, True).encode
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            for rows, texts in parts(batch["text"], True):
                np.add.at(counts, rows, np.diff(encode(texts)[1], prepend=0))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
