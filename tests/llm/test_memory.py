"""Work space of tasks."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from contrastmill.llm.sentencepiece_scan import Pieces, _encode


def test_work_space_of_an_encoding_task_follows_its_slice():
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz     ", np.uint8)
    texts = [" " + bytes(rng.choice(letters, 4000)).decode() for _ in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "spaced"])
    run = _encode(Pieces(public_tokenizers.path("piece_bpe_32k.model")))
    tracemalloc.start()
    try:
        assert sum(len(b) for b in run(iter([batch]))) == len(texts)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak < 180 << 20, peak >> 20
