"""A worker that samples has one slice in memory at a time."""

import weakref

import numpy as np
import pyarrow as pa

from quillmill.llm import piece_sampling


def test_one_slice_at_a_time(monkeypatch):
    alive, seen, sample = [], [], piece_sampling.sample

    def watched(*args):
        seen.append(sum(x() is not None for x in alive))
        out = sample(*args)
        alive.extend(weakref.ref(x) for x in out[2])
        return out

    monkeypatch.setattr(piece_sampling, "sample", watched)
    monkeypatch.setattr(piece_sampling, "SLICE", 50)
    rows = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(np.arange(4)), pa.array(["some words of a text " * 3] * 4)], names=["doc_id", "key", "text"])
    n = sum(out.num_rows for out in piece_sampling._sampler("/opt/tokenizers/piece_bpe_32k.model", 2, 1.0, True)(iter([rows])))
    assert n == 8 and seen == [0, 0, 0, 0]
