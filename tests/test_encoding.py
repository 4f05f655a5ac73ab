"""Encoders behind a cache: what is encoded, and how often a model is loaded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from fathomflow.operators import encoding


def counting(log):
    """A loader of a model that gives lengths of texts, and notes each load and each text that is encoded."""

    def load():
        class Counting:
            def note(self, line):
                with open(log, "a") as f:
                    f.write(f"{line}\n")

            def encode(self, texts):
                for t in texts:
                    self.note(f"text {t}")
                return np.array([[float(len(t)), 1.0] for t in texts])

        model = Counting()
        model.note("load")
        return model

    return load


def test_texts_are_encoded_once(spark, tmp_path):
    log, cache = str(tmp_path / "log"), f"file://{tmp_path}/cache"
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, ""), (6, "a")], "id long, text string").repartition(3)
    first = {r.id: r.vector for r in encoding.encode(rows, "lengths", counting(log), cache).collect()}
    assert first == {1: [1.0, 1.0], 2: [2.0, 1.0], 3: [1.0, 1.0], 4: None, 5: [0.0, 1.0], 6: [1.0, 1.0]}
    lines = open(log).read().split("\n")[:-1]
    assert sorted(x for x in lines if x != "load") == ["text ", "text a", "text bb"]
    more = spark.createDataFrame([(7, "bb"), (8, "ccc")], "id long, text string")
    assert {r.id: r.vector for r in encoding.encode(more, "lengths", counting(log), cache).collect()} == {7: [2.0, 1.0], 8: [3.0, 1.0]}
    lines = open(log).read().split("\n")[:-1]
    assert sorted(x for x in lines if x != "load") == ["text ", "text a", "text bb", "text ccc"]
    # Another model shares nothing.
    assert {r.id: r.vector for r in encoding.encode(more, "other", counting(log), cache).collect()} == {7: [2.0, 1.0], 8: [3.0, 1.0]}
    assert open(log).read().count("text bb") == 2
    assert encoding.encode(more.where("false"), "other", counting(log), cache).count() == 0


def test_a_worker_loads_a_model_once():
    loads = []

    class One:
        def encode(self, texts):
            return np.ones((len(texts), 1))

    batch = pa.RecordBatch.from_pydict({"digest": [b"x"] * 200, "text": ["t"] * 200})
    encoding._models.pop("one", None)
    run = encoding._encoding("one", lambda: loads.append(1) or One())
    assert sum(b.num_rows for b in run([batch, batch])) == 400 and loads == [1]


def test_a_token_is_hashed_once(monkeypatch):
    """Results are those of plain counts, also where the encoder's memory is emptied on the way."""
    encoder, hashed, md5 = encoding.HashEncoder(16), [], encoding.hashlib.md5
    monkeypatch.setattr(encoding.hashlib, "md5", lambda x: hashed.append(x) or md5(x))
    found = encoder.encode(["a b a 因", "", "b b"])
    assert sorted(hashed) == sorted({b"a", b"b", "因".encode()})
    place = lambda t: int(md5(t.encode()).hexdigest()[:8], 16) % 16
    want = np.zeros((3, 16))
    for row, text in enumerate(("ab因a", "", "bb")):
        for t in text:
            want[row, place(t)] += 1
    norms = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.array_equal(found, want / np.where(norms > 0, norms, 1))
    monkeypatch.setattr(encoding, "KNOWN_TOKENS", 1)
    assert np.array_equal(encoding.HashEncoder(16).encode(["a b a 因", "", "b b"]), found)
