"""Plain versions that the operators are tested against."""

import random


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def alike(a: str, b: str, num: int = 4, den: int = 5) -> bool:
    return 2 * den * lcs(a, b) > num * (len(a) + len(b))


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def mutated(s: str, r: random.Random, n: int) -> str:
    t = list(s)
    for _ in range(n):
        i = r.randrange(len(t))
        kind = r.randrange(3)
        if kind == 0:
            t[i] = r.choice("ACDEFGHIKLMNPQRSTVWY")
        elif kind == 1:
            t.insert(i, r.choice("ACDEFGHIKLMNPQRSTVWY"))
        elif len(t) > 2:
            del t[i]
    return "".join(t)


def family(seed: int, roots: int, per: int, size: tuple[int, int] = (25, 50), most: int = 6) -> list[str]:
    r = random.Random(seed)
    out = []
    for _ in range(roots):
        s = "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(r.randint(*size)))
        out += [s] + [mutated(s, r, r.randint(0, most)) for _ in range(per)]
    return out
