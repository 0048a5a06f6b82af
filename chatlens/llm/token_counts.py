"""Token counts with a whole-token shortcut (see ``wordbpe``)."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.tables import small_batches
from chatlens.llm.wordbpe import loaded, proofs


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row, in one pass and no shuffle.

    ``tokenizer`` is the path of a word-end BPE file, readable on every
    executor.  The proof of whole tokens is made once on the driver; its table
    is bounded by the vocabulary.  Begin, end and added special tokens are not
    counted; special strings inside a text count as the library takes them.

    Defined results: a null or empty text has 0 bytes and 0 tokens; rows stay
    as they are, repeated ones too; a null id stays null; an empty table gives
    no rows; other columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    whole, doubt = proofs(tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = loaded(tokenizer, whole, doubt)
        for batch in batches:
            text = batch.column(1)
            n = counter.counts(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
