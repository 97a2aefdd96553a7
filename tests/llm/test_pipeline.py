from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute
from test_operators import check_packing

import corpus_pipeline
from concordia.llm import secret_scan
from concordia.llm.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, docs, rows):
    """Each stage is held against a plain version over what its predecessor kept."""
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language id", "n-gram Jaccard join", "secret scans", "mixing", "best-fit packing"]
    language, near, secrets, mixture, packed = (stage for _, stage in corpus_pipeline.STAGES)

    first = materialize(language(spark, docs, ""), "t1")
    assert first.columns == COLUMNS
    kept = [tuple(r) for r in first.collect()]
    lettered = [r[0] for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert set(lettered) - {r[0] for r in kept} <= {6, 8} and {r[0] for r in kept} <= set(lettered)
    assert all(r[2] is not None for r in kept)

    second = materialize(near(spark, first, ""), "t2")
    component = brute.components(kept, 5, 8, 10)
    want = {r for r in kept if component[r[0]][1] == r[0]}
    assert second.columns == COLUMNS and Counter(map(tuple, second.collect())) == Counter(want)

    third = materialize(secrets(spark, second, ""), "t3")
    clean = {(d, secret_scan.redact(t), lang, s) for d, t, lang, s, _ in want}
    assert third.columns == COLUMNS and {tuple(r)[:4] for r in third.collect()} == clean

    fourth = materialize(mixture(spark, third, ""), "t4")
    sizes = Counter()
    for _, t, _, s in clean:
        sizes[s] += len(brute.words(t))
    taken = Counter()
    mixed = [tuple(r) for r in fourth.collect()]
    texts = {d: brute.words(t) for d, t, *_ in clean}
    for d, t, _, s, n in mixed:
        assert brute.words(t) == texts[d][: len(brute.words(t))] and n == len(t)
        taken[s] += len(brute.words(t))
    assert {s: taken[s] for s in sizes} == {s: int(v + 1e-9) for s, v in brute.targets(sizes, (5, 2, 1), 1.5, 2.0).items()}

    check_packing(mixed, packed(spark, fourth, "").collect())


def test_language_stage_keeps_a_users_columns(spark, docs):
    from pyspark.sql import functions as F

    own = docs.withColumns({"score": F.lit(777), "rejected": F.lit("no"), "lang_pred": F.col("doc_id") + 1})
    kept = corpus_pipeline.language(spark, own, "")
    assert kept.schema.simpleString() == own.schema.simpleString()
    assert all(r.score == 777 and r.rejected == "no" and r.lang_pred == r.doc_id + 1 for r in kept.collect())


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
