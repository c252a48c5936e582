from skillscope.llm import quotations

SCHEMA = "conv_id long, turn long, role string, text string, thread int, position int, level int"


def chat(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA)


def test_nested_quotes_link_to_their_originals(spark):
    rows = [
        (1, 0, "a", "First question about shards.\nIt has two lines."),
        (1, 1, "b", "An unrelated start."),
        (1, 2, "c", "On Monday a wrote:\n> First  question about SHARDS.\n> It has two lines.\nAnswer to the first."),
        (1, 3, "a", "> An unrelated start.\nA reply to b."),
        (1, 4, "b", "c wrote:\n>> First question about shards.\n>> It has two lines.\n> Answer to the first.\nThird level."),
        (1, 5, "a", "> never written by anyone\nOwn words."),
        (2, 0, "x", "> First question about shards.\nQuote from another conversation."),
    ]
    got = {(r.conv_id, r.turn): r for r in quotations.reply_ordered(chat(spark, rows)).collect()}
    assert {k: (r.reply_to, r.thread) for k, r in got.items()} == {
        (1, 0): (None, 0), (1, 1): (None, 1), (1, 2): (0, 0), (1, 3): (1, 1), (1, 4): (2, 0), (1, 5): (None, 5),
        (2, 0): (None, 0)}
    assert [t for _, t in sorted((r.position, k[1]) for k, r in got.items() if k[0] == 1)] == [0, 2, 4, 1, 3, 5]
    assert got[1, 2].text == "Answer to the first." and got[1, 2].n_quoted_lines == 2
    assert got[1, 4].text == "Third level." and got[1, 4].n_quoted_lines == 3
    assert got[1, 5].text == "Own words." and got[1, 5].n_linked == 0
    assert ">" not in "".join(r.text for r in got.values())


def test_long_chain_is_one_thread_and_positions_are_dense(spark, monkeypatch):
    monkeypatch.setattr(quotations, "RANGE", 8)
    rows = [(7, 0, "u", "message number 0")]
    rows += [(7, i, "u", f"> message number {i - 1}\nmessage number {i}") for i in range(1, 40)]
    rows += [(7, i, "u", f"alone {i}") for i in range(40, 90)]
    got = quotations.reply_ordered(chat(spark, rows).repartition(5)).collect()
    assert all(r.thread == (0 if r.turn < 40 else r.turn) for r in got)
    assert all(r.position == r.turn for r in got)


def test_odd_messages(spark):
    rows = [(None, 0, "u", "> x\ny"), (1, None, "u", "x"), (1, 0, None, None), (1, 0, None, None), (1, 1, "u", ""),
            (1, 2, "u", ">\n> >\n"), (1, 3, "u", "z" * 200_000)]
    got = quotations.reply_ordered(chat(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(r.position for r in got if r.conv_id == 1) == [0, 1, 2, 3, 4, 5]
    assert next(r for r in got if r.turn is None).position == 0
    assert [r.text for r in got if r.turn == 2] == [""]
    assert quotations.reply_ordered(chat(spark, [])).count() == 0


def test_a_hot_line_links_in_linear_work(spark):
    rows = [(1, i, "u", "the very common line\nand text %d" % i) for i in range(300)]
    rows += [(1, 300 + i, "u", "> the very common line\nreply %d" % i) for i in range(300)]
    got = quotations.reply_ordered(chat(spark, rows)).collect()
    assert all(r.reply_to == 0 for r in got if r.turn >= 300)
