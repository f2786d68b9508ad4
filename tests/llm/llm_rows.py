"""Rows that the tests of the corpus operators share."""

SF = "/root/testdata/sf0.01"

#: Nulls, empty and white texts, ties, repeated rows, long words and texts, foreign white space.
ODD = [
    (1, "the of and the"), (1, "the of and the"), (2, None), (3, ""), (4, " \n\t "), (None, "a b c d e f g h i j k"),
    (5, "x" * 5000), (6, "word " * 3000), (7, "und der  die éte <|endoftext|> a<|startoftext|>b"),
    (8, "A\x0bB\x0cC\r\nD|E<f>"), (9, "1234 5678 !!"), (10, "\U0001f600 café Été don't I'll"), (11, "line\nline\n\nline"),
]
