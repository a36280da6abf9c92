"""Rows for the small tests."""

import random

WORDS = "alpha beta Gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def document_rows(seed=7):
    rng = random.Random(seed)
    rows = []
    shared = [sentence(rng, 40) for _ in range(4)]
    for i in range(120):
        lines = [sentence(rng, rng.randint(1, 25)) for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), "A line  of the site, number %d" % (i % 2))
        if i % 4 == 0:
            lines.append(rng.choice(shared))
        rows.append((i, "\n".join(lines), "s%d" % (0 if i % 2 else i % 7), 0))
    text = rows[5][1]
    rows += [(200 + i, text, "s0", 1) for i in range(5)]
    rows += [(300 + i, text.replace(text.split()[3], "x", 1) + f" y{i}", "s1", None) for i in range(5)]
    rows += [(5, text, "s0", 0), (7, "same id, other text", "s0", 0), (None, "no id at all here", None, 3), (None, None, None, None)]
    rows += [(400, "", "s2", 0), (401, " \n\t ", "s2", 0), (402, None, "s3", 0), (403, "token", None, 0)]
    rows += [(404, "b " * 30_000, "s4", 0), (405, "é\U0001F600 password = 'abcDEF123456' x " * 300, "s4", 0)]
    return rows


def plain(rows):
    """Sorted tuples, NULLs first."""
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v) for v in r))
