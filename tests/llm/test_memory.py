"""What the Python workers are sent and keep stays bounded, whatever the texts."""

import random

import pyarrow as pa

from talktable.llm import common, packing, substring


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    texts = spark.range(3000, numPartitions=1).selectExpr("id", "repeat('word ', 1000) text")
    found = common.written(texts.mapInArrow(sizes, "n long, bytes long")).collect()
    assert sum(r.n for r in found) == 3000
    assert max(r.bytes for r in found) <= 1.1 * common.BATCH_BYTES
    assert spark.conf.get(common._BATCH, None) is None
    spark.conf.set(common._BATCH, str(1 << 18))
    try:
        found = common.written(texts.mapInArrow(sizes, "n long, bytes long")).collect()
        assert max(r.bytes for r in found) <= 1.1 * (1 << 18)
        assert spark.conf.get(common._BATCH) == str(1 << 18)
    finally:
        spark.conf.unset(common._BATCH)


def test_the_units_are_found_before_the_cut_texts_are_read(make, capsys):
    line = "one two three four five six"
    cut = substring.drop_repeated_units(make([(i, f"{line}\nown line of number {i}") for i in range(600)]))
    cut.explain()
    assert "MapInArrow" not in capsys.readouterr().out
    rows = {r.doc_id: r for r in cut.collect()}
    assert rows[0].text.startswith(line) and not rows[0].removed
    for i in range(1, 600):
        assert rows[i].text == f"own line of number {i}" and [tuple(s) for s in rows[i].removed] == [(0, len(line) + 1)]


def test_an_encoder_forgets_pieces_that_do_not_come_again(byte_file):
    rng = random.Random(5)
    with open(byte_file, encoding="utf-8") as f:
        definition = f.read()
    small, large = packing.Encoder(definition, remember=20), packing.Encoder(definition)
    for _ in range(30):
        text = " ".join(rng.choice(["the", "of", f"x{rng.randrange(10 ** 9)}"]) for _ in range(50))
        assert small(text) == large(text)
        assert len(small.known) <= 20 and len(small.older) <= 20
    assert {"the", "of"} <= set(small.known) | set(small.older)
