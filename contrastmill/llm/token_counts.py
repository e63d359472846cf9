"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A text up to ``huge`` characters is encoded at once. A longer one is cut into chunks that overlap
and that go to different tasks. Each chunk is encoded with the offsets of its pieces. Two
neighbours are spliced at a *stable boundary* of their overlap: a space after another character
at which both encodings begin a piece. No piece of the vocabulary has a space after another
character (checked when the model is loaded), so no merge crosses such a place and the pieces on
either side do not depend on what lies beyond. A document with an overlap without one goes into
another round with twice the overlap, in the end as a single chunk.

Null text counts as empty and has no tokens. Repeated rows keep their own result rows. Other
columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrastmill.runtime import materialize

HUGE = 1 << 16
OVERLAP = 1 << 10


def load_model(path: str):
    """The processor, after a check that splices at spaces are right for its vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError(f"{path}: a piece crosses the beginning of a word, so chunks cannot be spliced at spaces")
    return model


def _groups(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _count_whole(model_path: str):
    def run(batches):
        model = load_model(model_path)
        for batch in batches:
            texts, counts = batch.column("text").to_pylist(), []
            for part in _groups(texts):
                counts += [len(x) for x in model.encode(part, num_threads=1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def _cut(huge: int):
    """Chunks of ``huge`` characters that begin every ``huge - overlap`` of them."""

    def run(frames):
        for frame in frames:
            for key, text, overlap in zip(frame["key"], frame["text"], frame["overlap"]):
                step = max(1, huge - overlap) if overlap < huge else len(text)
                size = huge if overlap < huge else len(text)
                for number, begin in enumerate(range(0, max(1, len(text) - (size - step)), step)):
                    end = min(len(text), begin + size)
                    yield pd.DataFrame(
                        {
                            "key": [key], "number": [number], "begin": [begin], "chunk": [text[begin:end]],
                            "overlap": [size - step], "last": [end == len(text)],
                        }
                    )

    return run


def chunk_pieces(model, chunk: str) -> np.ndarray:
    """Where the pieces of a chunk begin, as characters from its start.

    The library puts a space before any text. At a chunk that is not the first one that space
    stands for a character that is not there, but only the pieces before the chunk's first stable
    boundary can depend on it, and those are taken from the chunk before.
    """
    begins = np.array([p.begin for p in model.encode(chunk, return_type="proto").pieces], np.int64)
    continued = (np.frombuffer(chunk.encode(), np.uint8) & 0xC0) == 0x80
    return (np.cumsum(~continued) - 1)[begins]


def stable_boundaries(chunk: str, begins: np.ndarray) -> np.ndarray:
    """Characters of the chunk that are a space after something else and begin a piece."""
    spaces = [i for i in range(1, len(chunk)) if chunk[i] == " " and chunk[i - 1] != " "]
    return np.intersect1d(np.array(spaces, np.int64), begins)


def _encode_chunks(model_path: str):
    def run(frames):
        model = load_model(model_path)
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                begins = chunk_pieces(model, r.chunk)
                stable = stable_boundaries(r.chunk, begins)
                # in the overlap with the chunk before: from where on this chunk counts
                head = stable[stable <= r.overlap] if r.number else stable[:0]
                # in the overlap with the chunk after: up to where the next one may take over
                tail = stable[stable >= len(r.chunk) - r.overlap] if not r.last else stable[:0]
                index = np.searchsorted(begins, np.concatenate([head, tail]))
                rows.append(
                    (r.key, r.number, bool(r.last), len(begins), (r.begin + head).tolist(), index[: len(head)].tolist(),
                     (r.begin + tail).tolist(), index[len(head) :].tolist())
                )
            yield pd.DataFrame(rows, columns=["key", "number", "last", "n", "head", "head_index", "tail", "tail_index"])

    return run


def _splice(chunks: DataFrame) -> DataFrame:
    """``key, n_tokens`` of every document, null where two neighbours have no common boundary."""
    following = chunks.select(
        "key", (F.col("number") - 1).alias("number"), F.col("head").alias("next_head"), F.col("head_index").alias("next_index")
    )
    joined = chunks.join(following, ["key", "number"], "left")
    common = F.array_min(F.array_intersect("tail", "next_head"))
    at = lambda values, index: F.get(F.col(index), (F.array_position(values, common) - 1).cast("int"))
    # pieces before the boundary, less those of the next chunk before it
    joined = joined.withColumn(
        "own", F.when(F.col("last"), F.col("n")).otherwise(at("tail", "tail_index") - at("next_head", "next_index"))
    )
    return joined.groupBy("key").agg(
        F.when(F.count("own") == F.count(F.lit(1)), F.sum("own")).alias("n_tokens"), F.max("number").alias("chunks")
    )


def token_counts(docs: DataFrame, model_path: str, huge: int = HUGE, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs`` (``doc_id``, ``text``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    small = docs.where(F.length("text") <= huge)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    done = small.mapInArrow(_count_whole(model_path), f"doc_id {id_type}, n_bytes long, n_tokens long")

    # The same text is cut once. What is left of a huge text after this is a few numbers.
    key = F.sha2("text", 256)
    long = docs.where(F.length("text") > huge).select("doc_id", "n_bytes", "text", key.alias("key"))
    named = materialize(long.select("doc_id", "n_bytes", "key"))
    texts, counted, width = long.select("key", "text"), None, overlap
    while not named.isEmpty():
        width_now = width
        cut = texts.withColumn("overlap", F.lit(width_now)).mapInPandas(
            _cut(huge), "key string, number long, begin long, chunk string, overlap long, last boolean"
        )
        pieces = cut.dropDuplicates(["key", "number"]).mapInPandas(
            _encode_chunks(model_path),
            "key string, number long, last boolean, n long, head array<long>, head_index array<long>, tail array<long>, tail_index array<long>",
        )
        spliced = materialize(_splice(pieces))
        good = spliced.where("n_tokens is not null").select("key", "n_tokens")
        counted = good if counted is None else counted.unionByName(good)
        failed = spliced.where("n_tokens is null").select("key")
        if failed.isEmpty():
            break
        texts = long.select("key", "text").join(failed, "key", "left_semi")
        width *= 2
    if counted is None:
        return done
    return done.unionByName(named.join(counted, "key").select("doc_id", "n_bytes", "n_tokens"))
