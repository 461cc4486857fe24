"""Signs of spam that need no single frequent word."""

from peerlume.llm import spam


def test_a_line_of_many_keywords_repeated(spark):
    keywords = "cheap watches outlet bags shoes jackets belts rings scarves gloves hats coats boots wallets perfume lipstick mascara lotion shampoo soap"
    prose = "We measured the uptake of zinc in the roots of these plants and it was not as high as we would have expected from the model."
    texts = [(1, "\n".join([keywords] * 10)), (2, "\n".join([prose] * 10)), (3, keywords)]
    measured = spam.features(spark.createDataFrame(texts, "doc_id int, text string"), "doc_id", "text")
    assert {r.doc_id: "duplicate lines" in r.signs for r in spam.spam_pages(measured).collect()} == {1: True}
