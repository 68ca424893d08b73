"""Rows that repeat id and text, in the near-duplicate stage."""

from rowmill.llm import neardup


def test_one_row_of_each_group_stays(llm):
    text = "one two three four five six seven eight nine ten " * 3
    near = text + "eleven"
    rows = [(1, text, "a"), (1, text, "a"), (1, text, "b"), (1, near, "a"), (2, text, "a"), (1, "another text of the same id it is", "a"),
            (3, "alone here", "a"), (4, "", "a"), (4, "", "a"), (None, "no id but these words", "a"), (None, "no id but these words", "a")]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = sorted(((r["doc_id"], r["text"]) for r in neardup.one_of_each(docs).collect()), key=repr)
    assert len([r for r in got if r[0] == 1 and r[1] in (text, near)]) == 1
    rest = [r for r in got if r[1] not in (text, near)]
    assert rest == sorted([(1, rows[5][1]), (3, "alone here"), (4, ""), (4, ""), (None, rows[-1][1])], key=repr)
