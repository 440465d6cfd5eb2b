"""What workers keep between tasks and stages."""

import json

import numpy as np
import public_tokenizers
import pyarrow as pa

from cohortlake.llm import byte_dedup, exchange, packed, packing


def test_no_powers_are_kept_after_a_stage(spark):
    def powers_kept(batches):
        for _ in batches:
            yield pa.record_batch([pa.array([sum(x.nbytes for x in packed._powers.values())], pa.int64())], names=["n"])

    docs = spark.createDataFrame([(i, f"document {i} " + "the same words again " * 20) for i in range(64)], "doc_id long, text string")
    assert byte_dedup.repeated_bytes(docs).filter("n_removed > 0").count() == 64
    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(powers_kept, "n long").collect()} == {0}


def test_powers_given_back_are_made_again():
    up, down = (x.tolist() for x in packed.powers(100))
    exchange.give_back()
    assert not packed._powers
    assert [x.tolist() for x in packed.powers(100)] == [up, down]


def test_only_the_rules_of_a_model_are_read_as_python_objects(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        model = file.read()
    read, loads = [], json.loads
    monkeypatch.setattr(packing.json, "loads", lambda raw: (read.append(len(raw)), loads(raw))[1])
    exchange.drop_tables()
    assert packing._word_ids(model, "H").lower and max(read) < 10_000


def test_packed_documents_are_cut_a_megabyte_at_a_time():
    n = np.array([1, 5000, 2048, 300_000, *[4096] * 400, 900_000, 7])
    at = np.cumsum(n) - n
    ids = [np.random.default_rng(i).integers(0, 1 << 16, k).astype("<u2") for i, k in enumerate(n.tolist())]
    batch = pa.record_batch([pa.array(np.arange(len(n))), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(at)], names=["doc_id", "doc_tokens", "ids", "at"])
    out = list(packing.cut_at([batch], 2048))
    assert len(out) > 4 and sum(b.nbytes > 3 << 20 for b in out) == 1  # that of the document of 900,000 ids
    table = pa.Table.from_batches(out)
    assert b"".join(table.column("ids").to_pylist()) == np.concatenate(ids).astype("<u4").tobytes()
    place = table.column("sequence_id").to_numpy() * 2048 + table.column("offset").to_numpy()
    size = table.column("length").to_numpy()
    assert (place == np.cumsum(size) - size).all() and (table.column("offset").to_numpy() + size <= 2048).all()
    assert (place == at[table.column("doc_id").to_numpy()] + table.column("start").to_numpy()).all()
