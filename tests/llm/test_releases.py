from tidegraph import storage
from tidegraph.llm import components, ngram_join


def test_no_long_run_of_steps_without_release(spark, monkeypatch):
    """Between two releases, which give the driver's garbage back, there is a bounded number of saved steps, also where pairs are doubtful."""
    steps, longest = [0], [0]

    def counted(df, what="step", real=storage.saved):
        steps[0] += 1
        longest[0] = max(longest[0], steps[0])
        return real(df, what)

    def released(_):
        steps[0] = 0

    for module in (ngram_join, components):
        monkeypatch.setattr(module, "saved", counted)
        monkeypatch.setattr(module, "release", released, raising=False)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:i] + [f"x{i}"] + words[i:]) for i in range(0, 60, 3)] + [" ".join(words[: 40 + i]) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert ngram_join.first_of_groups(df, k=3, num=80, den=100).count() < len(texts)
    assert longest[0] <= 6
