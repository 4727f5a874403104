from vellumine.operators import sections
from vellumine.plans import registry


def test_running_heads_are_whole_texts(spark):
    rows = [
        (1, 1, "The tides of 2001"), (1, 2, "the  TIDES of\u00a02002 "), (1, 1, "They differ here"), (1, 2, "Then others too"), (1, 1, "page 1"), (1, 2, "page 2"),
        (1, 1, "see doi: 10.1000/abcdef"), (1, 2, "see doi: 10.1000/abcdef"), (2, 1, "once only here"), (2, 1, "once only here"), (2, 2, None),
    ]
    got = sections.furniture(spark.createDataFrame(rows, "paper_id long, page long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, "the tides of #", 2)]


def test_running_lines_reads_whole_lines(spark, tmp_path):
    line = "A running head of vol. {} with a long tail"
    rows = [(0, 0, "user", "Abc first\n" + line.format(1)), (0, 1, "user", "Abc second\n" + line.format(22)), (1, 0, "user", line.format(3))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES["running_lines"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(0, "a running head of vol. # with a long tail", 2)]
