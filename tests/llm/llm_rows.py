"""Rows that every operator is tested on."""

#: Nulls, empty and blank texts, ties, repeated rows and copies, next to ordinary prose.
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly box five jugs of liquid on a cold morning"
ROWS = [
    (1, PROSE + "\nA common line of text\nend one"), (2, PROSE + "\n a COMMON line of text \nend two"), (3, None), (4, ""), (5, " \n\t"), (6, "x"),
    (7, PROSE + "\nA common line of text\nend one"), (7, PROSE + "\nA common line of text\nend one"), (8, "tie tie tie tie"), (9, "tie tie tie tie"), (None, "no id at all but a common line"), (10, "word " * 3000 + "end"),
    (11, "völlig andere Wörter — 漢字 😀 und <|endoftext|> im Text " * 3),
]
