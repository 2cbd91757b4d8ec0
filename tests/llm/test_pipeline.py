import collections
import os
import zlib

import numpy as np

import corpus_pipeline
from tessera.llm import registry
from tessera.llm.bpe import vocabulary_path
from tessera.llm.common import cut

from . import brute
from .test_near import components

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402


def test_queries_and_sql_names():
    names = list(registry.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and set(registry.oracle_sql()) <= set(names)


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, after = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        after.append(cut(stage(spark, after[-1], small), "stage"))
    assert all(d.columns == columns for d in after[:-1])
    rows = [[(r.doc_id, r.text) for r in d.collect()] for d in after[:-1]]
    assert set(rows[1]) <= set(rows[0]) and set(rows[2]) <= set(rows[1])
    for i, t in set(rows[0]) - set(rows[1]):
        n, _, _, _, again = brute.rule_counts(t)
        if n >= 20 and 100 * again <= 30 * n:  # the regression's own rejections are junk by sight
            assert sum(map(t.count, "#*$%&|!")) > 5, i
    assert sorted(i for i, _ in rows[3]) == sorted(set(components(rows[2])))
    assert sorted(rows[4]) == sorted(brute.clean(rows[3], corpus_pipeline.REPEAT_BYTES)) and sorted(rows[4]) != sorted(rows[3])
    library, pieces = Tokenizer.from_file(vocabulary_path()), after[-1].collect()
    want = []
    for i, t in rows[4]:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want += [(i, s // 2048, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for s in range(0, len(ids), 2048)]
    assert sorted(tuple(r)[:5] for r in pieces) == sorted(want)
    used = collections.Counter()
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= sum(used.values()) / 2048 * 1.05 + 1


def test_run(spark, small):
    assert set(corpus_pipeline.run(spark, small).columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_stages_on_odd_rows(spark, odd, nothing, labels, tmp_path):
    folder = f"file://{tmp_path}"
    for docs in (odd, nothing):
        docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == docs.columns
            docs = cut(stage(spark, docs, folder), "stage")
        texts = [r.text for r in docs.collect()]
        packed = corpus_pipeline.packing_stage(spark, docs, folder).collect()
        assert len(packed) >= len(texts) and sum(r.piece == 0 for r in packed) == len(texts)
