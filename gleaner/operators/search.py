"""Hybrid search of a table of queries over a table of chunks, from candidates to final hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import diversity, fusion
from gleaner.params import Params


def finish(dense: DataFrame, sparse: DataFrame, chunks: DataFrame, questions: DataFrame, query: str = "query_id", key: str = "key", params: Params = Params(), strict: bool = False) -> DataFrame:
    """(query, position, key, stage, score_type, rrf_raw, score) from both channels' candidates.

    ``chunks`` has key, source, project, section_type and vector; only candidates meet it. ``questions`` has the query, intents and target.
    ``strict`` leaves demoted hits out instead of putting them at the tail.
    """
    fused = fusion.reciprocal_rank(dense, sparse, query, key, params)
    fused = fusion.display_score(fused, query, params.weights)
    known = fused.join(chunks.select(key, "source", "project", "section_type", "vector"), key).join(questions.select(query, "intents", "target"), query)
    # Everything from here on is by query and stays on its partitions.
    boosted = fusion.project_filter(fusion.boost(known, query, key, params))
    main, backup = boosted.filter("NOT is_backup"), boosted.filter("is_backup")
    chosen = diversity.diversify(main, query, key, params)
    if strict:
        chosen = chosen.filter("stage = 0")
    filled = fusion.backfill(chosen, backup, query, key, params)
    out = filled.join(boosted.select(query, key, "score_type", "rrf_raw", "dense_score", "sparse_score"), [query, key])
    return fusion.display_score(out, query, params.weights).select(query, "position", key, "stage", "score_type", F.round("rrf_raw", 6).alias("rrf_raw"), "score")
