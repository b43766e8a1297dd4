"""What a task holds in its Python worker follows neither the batch nor the number of different words."""

import random
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa

from notewise.llm import bpe, parity_join, queries


class Docs:
    """Stands for a DataFrame: keeps the function that mapInArrow would run."""

    schema = {"doc_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run
        return self


def batch_of(rows: int, words: int) -> pa.RecordBatch:
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(words)) for _ in range(rows)]
    return pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array(texts)], names=["doc_id", "text"])


def peak_mb(run, batch: pa.RecordBatch) -> tuple[int, float]:
    """Rows returned, and the most that Python and numpy held meanwhile."""
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return rows, peak


def test_bpe_holds_a_slice_and_a_bounded_dictionary():
    path = queries.tokenizer_path()
    bpe.load(path)
    task, batch = Docs(), batch_of(2000, 100)
    bpe.round_trip(task, path)
    rows, peak = peak_mb(task.run, batch)
    assert rows == 2000 and peak < 80
    digests = bpe._Digests(bpe.load(path), 100_000)
    for at in range(0, 200, 20):
        digests.of(batch.slice(at, 20).column("text").to_pylist())
        assert digests.held <= 50_000 and len(digests.recent) + len(digests.older) <= 1000


def test_parts_of_a_batch_come_slice_by_slice():
    task, batch = Docs(), batch_of(4000, 100)
    parity_join._parts(task, 5, 80)
    small = sum(b.num_rows for at in range(0, 4000, 100) for b in task.run(iter([batch.slice(at, 100)])))
    sizes = [b.num_rows for b in task.run(iter([batch]))]
    assert sum(sizes) == small and max(sizes) < small / 2, "rows of the whole batch at once"
