"""A search gives the same scores whether the queries come in one block or in many."""

from peerlume.operators import retrieve


def test_blocks(spark):
    docs = spark.createDataFrame([(i, f"alpha word{i % 7} word{i % 5} common{'' if i % 2 else ' common'} text") for i in range(60)], "no bigint, text string")
    index = retrieve.build_index(docs, "no", "text")
    queries = docs.where("no % 3 = 0")
    score = lambda block: {(r.query, r.doc): round(r.score, 9) for r in retrieve.search(index, queries, "no", "text", block).collect()}
    one = score(10**6)
    assert one == score(13) and len(one) == 20 * 60
    top = retrieve.top_docs(retrieve.search(index, queries, "no", "text", 13)).collect()
    assert max(r.rank for r in top) <= retrieve.TOP_DOCS and all(r.doc != r.query for r in top)
