"""The rows of the edge-case table, for tests that compare them with brute force."""

LONG = "word " * 3000 + "end"
LINE = "This Line is Long Enough to count as a Repeated one."


def row(doc_id, text, source="s"):
    return ("other", doc_id, text, source, len(text or ""), "en", None, "x", None, 1)


def edge_rows():
    texts = [None, "", " \n\t ", "one", "two words", LONG, "a b c d e f", "a b c d e f", "é — ß ÷ <|endoftext|> it's 42",
             *[f"{LINE.upper() if i % 2 else '  ' + LINE}\nown line of {i}\n{LINE}" for i in range(6)]]
    rows = [row(i, t, [None, "", "s", "t"][i % 4]) for i, t in enumerate(texts)]
    return rows + [row(None, "no id", None), row(None, None, None), row(5, LONG), row(5, LONG), row(5, "another text")]
