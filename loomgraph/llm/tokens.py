"""Token counts and ids with public tokenizers, in Arrow batches.

Rows are taken in runs of about BATCH_BYTES, so a batch of long texts is no heavier than one of short texts, and each
run is encoded by one call of the library; only lengths are kept where only counts are wanted. A text of
more than LONG_CHARS is cut where a space or line break stands between characters that are no white space; the pattern
that splits text before the merges starts a new piece there in any case, so the parts encode alone as they do in the
text. Byte-level vocabularies in .json files run on the tiktoken library from the same vocabulary, several times
faster, once its ids agree with the file's own library on a probe text; otherwise the file's own library runs.

Defined results: null is the empty text, which has no tokens; special strings inside texts are the library's default,
that is, special tokens; repeated rows are counted one by one; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import text as T
from loomgraph.session import ensure_importable

TOKEN_LIMIT = 512
BATCH_BYTES = 2 << 20
LONG_CHARS = 1 << 18
_SAFE = re.compile(r"(?<=\S)[ \n](?=\S)")
_PROBE = "It's 12 o'clock, isn't it?  Größe\n\n\n\tλ日本 --- end<|endoftext|> of\r\n it "
#: Encoders of this worker process, by path.
_encoders: dict = {}


def safe_parts(text: str, limit: int = LONG_CHARS) -> list[str]:
    parts, first = [], 0
    while len(text) - first > limit and (cut := _SAFE.search(text, first + limit)):
        parts.append(text[first : cut.start()])
        first = cut.start()
    return [*parts, text[first:]]


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids as little-endian uint16 (vocabularies up to 65,536) or uint32."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            size = model.get_vocab_size(with_added_tokens=True)
            own = lambda text: model.encode(text, add_special_tokens=False).ids
            self.batch = lambda texts: [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]
            fast = self._fast(path)
            if fast and (probe := own(_PROBE)) == fast.encode(_PROBE, allowed_special="all"):
                assert fast.encode_batch([_PROBE], num_threads=1, allowed_special="all") == [probe]
                self.ids = lambda text: fast.encode_to_numpy(text, allowed_special="all")
                self.batch = lambda texts: fast.encode_batch(texts, num_threads=1, allowed_special="all")
            else:
                self.ids = own
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            size = model.get_piece_size()
            self.ids = self.batch = lambda texts: model.encode(texts, num_threads=1)
        else:
            raise ValueError(f"neither a .json nor a .model file: {path}")
        self.splits = path.endswith(".json") and self.ids is not own
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")

    @staticmethod
    def _fast(path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            return None
        import public_tokenizers
        import tiktoken

        to_byte = _byte_of_character()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        return tiktoken.Encoding("from-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, kind = self.ids, self.dtype
        return [
            np.asarray(ids(x), kind).tobytes() if len(x) <= LONG_CHARS or not self.splits else b"".join([np.asarray(ids(p), kind).tobytes() for p in safe_parts(x)])
            for x in texts
        ]

    def counts(self, texts: list[str]) -> list[int]:
        """The number of ids of each text, from one call for all of them."""
        parts = [safe_parts(x) if self.splits else [x] for x in texts]
        lengths = iter([len(ids) for ids in self.batch([p for text in parts for p in text])])
        return [sum(next(lengths) for _ in text) for text in parts]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def runs(column):
    """(first row, texts) for runs of rows of about BATCH_BYTES."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    for a, b in T.slices(offsets, BATCH_BYTES):
        yield a, [x or "" for x in column.slice(a, b - a).to_pylist()]


def encoded(column, model: Encoder):
    """(first row, list of id bytes) for runs of rows of about BATCH_BYTES."""
    for a, texts in runs(column):
        yield a, model.encode(texts)


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs; only lengths leave the Python workers."""
    ensure_importable(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def count(batches):
        model = encoder(path)
        for batch in batches:
            column = batch.column("text")
            n = [count for _, texts in runs(column) for count in model.counts(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()), pa.array(n, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
