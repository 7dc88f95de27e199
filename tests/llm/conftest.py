import random

import pytest


@pytest.fixture(scope="session")
def lines():
    """Log messages: random ones, exact and near copies, short ones, empty, null, a very long one, repeated ids, a null id."""
    rng = random.Random(5)
    names = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "lmnrst"]
    text = lambda n: " ".join(rng.choice(names) for _ in range(n))
    rows = [(i, text(rng.choice([3, 8, 40, 120]))) for i in range(60)]
    for i in range(60, 110):
        words = rows[rng.randrange(60)][1].split()
        for _ in range(max(1, len(words) // rng.choice([15, 30, 60]))):
            words[rng.randrange(len(words))] = rng.choice(names)
        rows.append((i, " ".join(words)))
    rows += [(110 + i, rows[3][1]) for i in range(12)] + [(130, None), (131, ""), (132, " \t\n "), (133, "One"), (134, "oNE"), (135, text(9000)), (3, rows[3][1]), (136, "Größe größe ÖL"), (137, "größe GRößE Öl")]
    return rows + [(None, rows[3][1])]
