"""Rows with nulls, ties, repeats, no words, and very long texts."""

ODD = [(1, None), (2, ""), (3, "  \n\t"), (4, "one two"), (5, "one two"), (5, "one two"), (6, "é ü ß 漢字 \U0001f600"), (None, "no id here at all today"),
       (7, "word " * 30000), (8, "a" * 200000)]
