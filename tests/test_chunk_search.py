import numpy as np

from stratamem.functions.providers import HashEmbedder
from stratamem.plans.corpus import QUERY_TEXT
from stratamem.plans.retrieval import QUERIES


def _expected(rows, limit):
    q = np.array(HashEmbedder()([QUERY_TEXT])[0], np.float64)
    near, said = [], []
    for i, _, text in rows:
        if text is None:
            continue
        v = np.array(HashEmbedder()([text])[0], np.float64)
        near.append((round(1 - float(v @ q) / float(np.linalg.norm(v) * np.linalg.norm(q)), 9), i))
        words = text.lower().split()
        if all(w in words for w in QUERY_TEXT.split()):
            said.append((-sum(w in QUERY_TEXT.split() for w in words), i))
    score = {}
    for leg in (near, said):
        for k, (_, i) in enumerate(sorted(leg)[:50]):
            score[i] = score.get(i, 0) + 1 / (61 + k)
    return sorted(((round(x, 9), i) for i, x in score.items()), key=lambda x: (-x[0], x[1]))[:limit]


def test_fused_chunk_search_has_both_legs(spark, tmp_path):
    rows = [(k, k % 7, f"chunk {k} " + ("keeps this beside that " * (k % 4) if k % 9 == 0 else "says nothing")) for k in range(200)] + [(900, 1, None)]
    rows.append((901, 1, QUERY_TEXT))
    spark.createDataFrame([(i, d, 0, t) for i, d, t in rows], "chunk_id long, ingest_id long, ord int, content string").write.parquet(f"{tmp_path}/doc_chunks.parquet")
    got = [(r["score"], r["id"]) for r in QUERIES["chunk_search_fused"](spark, str(tmp_path)).collect()]
    want = _expected(rows, 10)
    assert [i for _, i in got] == [i for _, i in want] and 901 in [i for _, i in got]
    assert np.allclose([x for x, _ in got], [x for x, _ in want])
    lexical = {r["id"] for r in QUERIES["chunk_search"](spark, str(tmp_path)).collect()}
    assert {i for _, i in got} - lexical
