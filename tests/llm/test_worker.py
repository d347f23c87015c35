"""What a worker holds at once."""

import public_tokenizers
import pyarrow as pa

from tracelake.llm import bpe


class Rows:
    """Stands for a table: gives the function that its tasks run."""

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_bpe_takes_small_parts_of_a_batch(monkeypatch):
    """A worker of the pipeline's last stage took 270 MB more than before it while it cut 4 MB of text into chunks."""
    sizes, packed = [], bpe.Table.packed
    monkeypatch.setattr(bpe.Table, "packed", lambda self, texts: sizes.append(texts.nbytes) or packed(self, texts))
    run = bpe.encode(Rows(), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    batch = pa.record_batch({"doc_id": list(range(40)), "text": [f"{i} " + "some words here " * 8000 for i in range(40)]})
    assert sum(b.num_rows for b in run(iter([batch]))) == 40
    assert len(sizes) > 4 and max(sizes) < 1.2 * (1 << 20)
