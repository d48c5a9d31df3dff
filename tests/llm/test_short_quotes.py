"""Quotations of one character."""

from tessera.llm import quotes


def test_quotes_of_one_character_are_kept(spark):
    rows = [(1, 0, "y"), (1, 1, "> y\nyes"), (1, 2, "> 5\nfive"), (1, 3, "> \nnone")]
    got = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert (got[1].n_quotes, got[1].n_linked, got[1].reply_to, got[1].unlinked) == (1, 1, 0, [])
    assert (got[2].n_quotes, got[2].n_linked, got[2].reply_to, got[2].unlinked) == (1, 0, None, ["5"])
    assert (got[3].n_quotes, got[3].unlinked) == (0, [])
