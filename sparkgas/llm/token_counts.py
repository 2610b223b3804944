"""Token counts: heap-and-linked-list byte-pair merging, no identifiers emitted."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkgas.llm.common import bounded_batches, texts
from sparkgas.llm.tokens import MergeCounter, default_file, read_file

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def token_counts(
    docs: DataFrame,
    limit: int = 2048,
    tokenizer_file: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per input row.

    ``n_tokens`` is what the tokenizers library gives for the file without added
    special tokens.  A null or empty text has 0 bytes and 0 tokens; a null id
    stays null; repeated rows are counted one by one; an empty table gives no
    rows; other columns are ignored.  Nothing is exchanged, and a worker holds
    one batch and a bounded set of words.
    """
    bounded_batches(docs.sparkSession)
    spec = read_file(tokenizer_file or default_file())

    def count(batches):
        import pyarrow as pa

        counter = MergeCounter(spec)
        for batch in batches:
            found = batch.column("text").to_pylist()
            n = [counter.count(text) for text in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(text.encode("utf-8", "surrogatepass")) for text in found], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs, id_col, text_col).mapInArrow(count, SCHEMA)
