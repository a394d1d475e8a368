"""Small documents, and strange ones."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te") for b in ("na", "sh", "on", "vel", "d", "ing")]


def prose(rng, n):
    """n words in sentences of about nine, a line now and then."""
    out = []
    while len(out) < n:
        k = rng.randint(4, 13)
        s = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(k)]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + rng.choice([".", ".", "!", ".\n"])]
    return " ".join(out)


def strange(rng):
    """Nulls, empty and very long texts, repeated rows, a repeated id, other scripts, white space of all kinds."""
    long = prose(rng, 30_000)
    same = prose(rng, 300)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, same), (6, same), (7, same), (7, same), (8, prose(rng, 60)), (8, prose(rng, 60)), (None, same), (None, None), (9, "一二三。四五六！ 七八九"), (10, "aaaa " * 300), (11, "x" * 5000), (12, "Ωmega é́   \x1c \xa0 ok 😀"), (13, "one"), (14, "one two"), (15, "ONE TWO three")]
    return [(i, t, "en", None if k % 5 == 4 else f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
