"""Rows and helpers shared by the tests of this folder."""

#: Texts that every operator must take: null, empty, white space, repeats, long, odd characters.
LONG = " ".join(f"word{i % 977} {i}" for i in range(20_000))
TEXTS = [
    None, "", " ", "a", "a  b\tc\n\nd", "same text here", "same text here", "same  text\there", "Ünïcode ▁x ▁ — “quoted” 　 end\x00",
    "  leading and trailing  ", "0" * 700, LONG, LONG, LONG + " more", "password = 'abcdef123'", "Released under the MIT License.",
]


def pairs(df, *columns):
    return sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)
