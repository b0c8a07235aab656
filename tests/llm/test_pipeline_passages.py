"""What the pipeline's suffix-array stage leaves of passages of more than fifty words in fewer than 400 bytes."""

import random

import corpus_pipeline


def test_passages_of_over_fifty_words(spark):
    """Short passages in several documents are gone from each; documents that share none, or 49 words, stay as they are."""
    r = random.Random(8)
    some = lambda n: [r.choice("abcdefghäöü") + r.choice("abcdefgh") * r.randrange(4) + str(r.randrange(99)) for _ in range(n)]
    shared, below = [" ".join(some(n)) for n in (51, 55, 59)], " ".join(some(49))
    assert max(len(x.encode()) for x in shared) < 400
    rows = [(i, [" ".join(some(60)), shared[i % 3], " ".join(some(40))]) for i in range(9)]
    rows += [(i, [" ".join(some(60)), below, " ".join(some(40))]) for i in (20, 21)] + [(i, [" ".join(some(100))]) for i in (30, 31)]
    texts = {i: "\n".join(parts) for i, parts in rows}
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    got = {x["doc_id"]: x for x in corpus_pipeline.without_repeats(spark, docs, "").collect()}
    assert sorted(got) == sorted(texts)
    for i, parts in rows:
        assert got[i]["text"] == ("\n".join([parts[0], "", parts[2]]) if i < 9 else texts[i])
        assert got[i]["n_chars"] == len(got[i]["text"])
