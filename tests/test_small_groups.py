"""Groups compared where they lie: the same pairs as in cells and rounds, few of them scored, little written."""

import random

from test_known_hot import checkpoints  # noqa: F401


def bullets(spark, seed):
    rnd, words = random.Random(seed), "Built led ran the a cost by team system Kafka down up 12 30".split()
    rows = [(d, i, " ".join(rnd.choices(words, k=rnd.randint(0, 6)))) for d in (1, 2, 3, None) for i in range(rnd.randint(0, 14))]
    return spark.createDataFrame([*rows, (1, 90, None), (7, 1, "Alone")][: None if seed % 2 else -1], "doc_id long, idx long, text string")


def test_diff_of_small_groups_equals_cells(spark, monkeypatch, checkpoints):  # noqa: F811
    from quire.operators import pairs

    for seed in (1, 2):
        a, b = bullets(spark, seed).filter("text IS NOT NULL"), bullets(spark, seed + 10).filter("text IS NOT NULL")
        checkpoints.clear()
        run = lambda: sorted(map(str, pairs.diff_bullets(a, b, ["doc_id"]).collect()))
        small = run()
        assert len(checkpoints) == 1 and small
        for rows in (0, 8):
            monkeypatch.setattr(pairs, "GROUP_ROWS", rows)
            assert run() == small
        monkeypatch.setattr(pairs, "GROUP_ROWS", 128)


def test_reuse_of_small_groups_equals_cells(spark, monkeypatch):
    from quire.operators import pairs

    a, b = bullets(spark, 3), bullets(spark, 5)
    run = lambda: sorted(map(str, pairs.container_reuse(a, b.withColumnRenamed("text", "line"), "doc_id", "idx", "idx2", "text", "line").collect()))
    b = b.withColumnRenamed("idx", "idx2")
    small = run()
    assert any("True" in r for r in small) and any("False" in r for r in small)
    monkeypatch.setattr(pairs, "GROUP_ROWS", 0)
    assert run() == small


def test_pairs_without_hope_are_not_scored():
    from quire.plans.matching import best_pairs, ratio_bounds
    from quire.operators.pairs import _ratio

    scored, real = [], _ratio()

    def counted(right):
        f = real(right)
        return lambda left: scored.append((left, right)) or f(left)

    texts = [f"built number {i} with {'abcdefghij'[i] * 12}" for i in range(10)]
    left, right = list(enumerate(texts)), list(enumerate(x + " overall" for x in texts))
    assert sorted(best_pairs(left, right, counted, 0.45)) == [(i, i) for i in range(10)]
    assert len(scored) == 10
    bound = ratio_bounds(["", "ab"], ["", "ba"])
    assert bound.tolist() == [[1.0, 0.0], [0.0, 1.0]]


def test_experience_diff_of_small_documents_equals_the_large_path(spark, monkeypatch, checkpoints):  # noqa: F811
    from quire.operators import pairs

    rnd = random.Random(4)
    lines = ["Experience", "Professional Experience", "Skills", "Acme | Berlin", "- Built x", "• Led y", "- Ran the z | q", "Jan 2019 - Present", "", "plain text", "Education"]
    def table(n):  # noqa: E306
        rows = [(d, i, lines[0] if i == 2 else rnd.choice(lines if i % 9 == 0 else lines[3:10])) for d in range(12) for i in range(rnd.randint(0, n))]
        return spark.createDataFrame([*rows, (None, 1, "Experience")], "doc_id long, line_no long, line string")

    a, b = table(40), table(40)
    run = lambda: sorted(map(str, pairs.experience_diff(a, b).collect()))
    checkpoints.clear()
    small = run()
    assert len(checkpoints) == 1 and small
    for rows in (0, 40):
        monkeypatch.setattr(pairs, "GROUP_ROWS", rows)
        assert run() == small
