import random

import pytest

from opstrata.llm import tokenize
from opstrata.llm.queries import QUERIES
from opstrata.sources.tables import table


def test_p7_ids_are_the_vocabularys(spark, sf):
    want = {r.doc_id: tokenize.encoding().encode_ordinary(r.text or "") for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    assert {r.doc_id: r.ids for r in QUERIES["p7_ids"](spark, sf).collect()} == want


@pytest.mark.parametrize(("chunk", "overlap"), [(8, 3), (16, 15), (5, 1), (64, 16)])
def test_chunks_are_stitched_exactly(spark, chunk, overlap):
    rng = random.Random(chunk)
    parts = ["word", " ", "  ", "\n\n", "123", "'s", "'", "don't", "ß", "日本語", "!?", "\t", "aaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>", "🙂", "é", "　", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(250)] + ["a" * 500, " " * 100, "", None, "'" * 40 + "s" * 40]
    rows = list(enumerate(texts)) + [(7, texts[7])] * 2 + [(None, "x" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = tokenize.encode_documents(df, chunk=chunk, overlap=overlap).collect()
    key = lambda r: (r[0] is None, r[0])
    want = [(i, tokenize.encoding().encode_ordinary(t or "")) for i, t in rows]
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(want, key=key)
    assert tokenize.decode([x for r in got if r.doc_id == 3 for x in r.ids]) == texts[3]
    assert tokenize.encode_documents(df.limit(0)).count() == 0
