"""Turns with many lines, which look at their neighbours."""

import time

from arclet.llm import quotation


def test_time_of_a_turn_with_many_quoted_lines_is_linear(spark):
    n = 400
    said = "\n".join(f"Line {i} says this." for i in range(n))
    again = "\n".join(f"> Line {i} says this." for i in range(n))
    rows = [(1, 0, "user", said), (1, 1, "assistant", f"user wrote:\n{again}\nYes.")]
    began = time.time()
    got = {r.turn: r for r in quotation.reply_threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].n_quoted, got[1].n_linked, got[1].parent_turn, got[1].text) == (n, n, 0, "Yes.")
    assert time.time() - began < 40
