"""The pipeline's near dedup goes by fingerprints and by shingles."""

import corpus_pipeline
from tidegrid.llm import nearcopy, simhash


def test_near_dedup_drops_what_either_method_links(spark):
    """Long repeated texts with other endings share fingerprints but few distinct shingles; edits the other way round."""
    refrain = "the same few words said once more " * 300  # an odd number of shingles, so no bit hangs on the ending
    base = [f"w{k}" for k in range(120)]
    texts = [refrain + " ".join(f"{c}{k}" for k in range(12)) for c in "ab"] + [" ".join(base), " ".join(base[:60] + ["other"] + base[61:]), "something else"]
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")

    def kept(df):
        return sorted(r.doc_id or -1 for r in df.collect())

    assert kept(simhash.one_of_each(docs)) == [-1, 1, 3, 4, 5]
    assert kept(nearcopy.one_of_each(docs)) == [-1, 1, 2, 3, 5]
    assert kept(corpus_pipeline.near_dedup(spark, docs, "")) == [-1, 1, 3, 5]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0
