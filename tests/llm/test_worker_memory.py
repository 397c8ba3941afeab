"""What stays in worker processes, and how often texts are read."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from gleaner.llm import op07_quality as quality
from gleaner.llm import tokens
from gleaner.llm.op05_mixing import mix


class Handed:
    """Stands in for a DataFrame, to get at the function that mapInArrow is given."""

    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

    def select(self, *_):
        return self

    toDF = select

    def mapInArrow(self, f, _):
        return f


def test_quality_takes_little_text_at_a_time_and_drops_other_caches(spark):
    """A worker may not need memory that grows with the text of a batch, nor hold vocabularies of the stage before."""
    text = "Some words of 12 letters, and so on. " * 270
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(600), pa.int64()), "text": [text] * 600})
    tokens.encoder(tokens.default_path())
    pool = quality.pooled(Handed(), np.ones((quality.WIDTH, quality.VOCABULARY), np.float32))
    tracemalloc.start()
    rows = sum(x.num_rows for x in pool(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 600 and not tokens._encoders
    assert peak < 60e6, peak


def test_mixing_splits_no_text_a_third_time(spark):
    """The result is read from what was written beside the hits; columns without a type come back as nulls."""
    docs = spark.sql("SELECT id AS doc_id, concat('alpha beta ', id % 3, ' gamma') AS text, 'web' AS source, 'en' AS lang, NULL AS nothing, id AS `a.b` FROM range(40)")
    out = mix(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "regexp_count" not in plan and "regexp_extract_all" not in plan
    rows = out.collect()
    assert out.columns == [*docs.columns, "mix_tokens", "mix_probability", "mix_kept"]
    assert sorted((r["doc_id"], r["text"], r["nothing"], r["a.b"], r["mix_tokens"]) for r in rows) == [(i, f"alpha beta {i % 3} gamma", None, i, 4) for i in range(40)]
    few = mix(docs, columns=["a.b"])
    assert few.columns == ["a.b", "mix_tokens", "mix_probability", "mix_kept"]
    assert {(r["a.b"], r["mix_probability"], r["mix_kept"]) for r in few.collect()} == {(r["a.b"], r["mix_probability"], r["mix_kept"]) for r in rows}
